import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm.alignment import align, alignment_digests, byte_level, byte_of_symbol, common_ends, gallop, group_links

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, batch string, links string"
TEXTS = [
    "The harbour lay still.", "the harbour, the harbour", "Größe und Maß: 12.50 €", "日本語のテキスト", "a  b\n\n\tc", "<|endoftext|> plain", "", None, " leading",
    "trailing  ", "<0x41> and ▁", "😀😀 zwei", "x" * 3000, "The harbour lay still.", "\u0000nul", "é combining", "ab" * 20_000,
]


@given(st.lists(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 60), max_size=40), st.integers(1, 50))
def test_gallop_finds_the_shared_values(x, y, block):
    x, y = sorted(set(x)), sorted(set(y))
    a, b = np.array(x, np.int64), np.array(y, np.int64)
    assert [(x[i], y[j]) for i, j in zip(*gallop(a, b, block), strict=True)] == [(v, v) for v in sorted(set(x) & set(y))]
    ia, ib = common_ends(a, b)
    assert [x[i] for i in ia] == [y[j] for j in ib] == sorted(set(x) & set(y))


def test_links_of_large_groups_are_counted_alike(monkeypatch):
    a, b = np.arange(40) % 7, np.arange(30) % 5
    ends = np.array([9, 39]), np.array([14, 29])
    want = group_links(a, b, *ends)
    monkeypatch.setattr("tidewater.llm.alignment.FLAT_LINKS", 1)
    got = group_links(a, b, *ends)
    assert all((x == y).all() for x, y in zip(want, got, strict=True)) and want[1].sum() == 10 * 15 + 30 * 15


def brute(texts):
    coder, model, of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_symbol()
    coder.encode_special_tokens = True
    held, documents = [], Counter()
    for text in texts:
        text = text or ""
        e, b = coder.encode(" " + text, add_special_tokens=False), model.encode(text)
        left = [bytes(of[c] for c in t) for t in e.tokens]
        right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b)]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (left, right)):
            held.append(None)
            continue
        groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(left) or j < len(right):
            if at_a <= at_b and i < len(left):
                at_a, i = at_a + len(left[i]), i + 1
                groups[-1][0].append(e.ids[i - 1])
            else:
                at_b, j = at_b + len(right[j]), j + 1
                groups[-1][1].append(b[j - 1])
            if at_a == at_b and (i < len(left) or j < len(right)):
                groups.append(([], []))
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        documents.update(links.keys())
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        held.append((len(left), len(right), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest()))
    top = Counter()
    for (x, _), n in documents.items():
        top[x] = max(top[x], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(t for (x, y), t in h[3].items() if documents[x, y] == top[x])
            out.append((*h[:3], sum(h[3].values()), best, sum(t * documents[p] for p, t in h[3].items()), h[4]))
    return out


RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_ranks_give_the_ids_of_the_tokenizer_file():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += [t or "" for t in TEXTS]
    one, other = byte_level(A), byte_level(RANKS, P.PATTERN)
    assert one.encode(texts) == [x.tolist() for x in other.encode(texts)]
    assert one.token_bytes[: len(other.token_bytes)] == other.token_bytes


@pytest.mark.parametrize(("batch_bytes", "ranks"), [(1, False), (100, True), (1 << 23, True)])
def test_digests_equal_brute_force_for_any_batch(spark, batch_bytes, ranks):
    ids = [*range(len(TEXTS) - 2), None, 3]
    rows = [(i, t, "clash", "clash") for i, t in zip(ids, TEXTS, strict=True)]
    got = alignment_digests(spark.createDataFrame(rows, SCHEMA), RANKS if ranks else A, B, P.PATTERN if ranks else None, batch_bytes=batch_bytes).collect()
    want = [(i, *w) for i, w in zip(ids, brute(TEXTS), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_groups_of_an_alignment(spark):
    rows = align(spark.createDataFrame([(1, "The harbour lay still.", "", ""), (2, None, "", "")], SCHEMA), A, B).collect()
    one = next(r for r in rows if r.doc_id == 1)
    assert one.a_ends[-1] == len(one.a_ids) and one.b_ends[-1] == len(one.b_ids) and len(one.a_ends) == len(one.b_ends)
    assert next(r for r in rows if r.doc_id == 2).a_ids == []


def test_empty_table(spark):
    assert alignment_digests(spark.createDataFrame([], SCHEMA), A, B).count() == 0
