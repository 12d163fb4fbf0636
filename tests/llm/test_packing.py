import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.packing import pack, pack_lengths


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), min_size=1, max_size=60), st.integers(1, 16))
def test_every_token_in_one_place(lengths, capacity):
    pieces = pack_lengths(lengths, capacity)
    seen = {d: [] for d in range(len(lengths))}
    fill = {}
    for d, s, n, seq, off in pieces:
        seen[d].append((s, n))
        if n:
            fill.setdefault(seq, []).append((off, n))
    for d, parts in seen.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == lengths[d]
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    assert len(fill) == -(-sum(lengths) // capacity)  # as few sequences as the tokens allow


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(20, 400, 400)]
    cost = {}
    for _, _, n, seq, _ in pack_lengths(lengths, 2048):
        cost[seq] = cost.get(seq, 0) + n + n * n / 2048
    full = sorted(cost.values())[1:]
    assert max(full) / min(full) < 1.25


@pytest.mark.parametrize("capacity", [64, 2048])
def test_ids_are_those_of_the_tokenizers_library(spark, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello there", None, "", "näïve  \n\n x" * 300, "a<|endoftext|>b", "    tab\t end ", "日本語😀" * 20]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, start string")
    got = pack(
        df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256},
        sequence_tokens=capacity,
    ).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert all(r[3] == len(ids) for r in mine)
        assert sum(r[1] for r in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c, _ in mine)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_repeated_rows_null_ids_and_a_text_longer_than_a_group(spark):
    texts = [(1, "one two"), (1, "one two"), (None, "three"), (2, "word " * 9000), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, sequence_tokens=128, group_tokens=512).collect()
    held = {}
    for r in got:
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert sorted(held[1]) == [(0, 3, 3), (0, 3, 3)] and held[None] == [(0, 2, 2)] and held[3] == [(0, 1, 1)]
    at = 0
    for start, n, total in sorted(held[2]):
        assert start == at and n <= 128
        at += n
    assert at == total
    for seq in {r.sequence_id for r in got}:
        at = 0
        for off, n in sorted((r.offset, r.length) for r in got if r.sequence_id == seq):
            assert off == at
            at += n
        assert at <= 128
