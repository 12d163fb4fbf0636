import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.bpe import Bpe, decode_table, encode_table, round_trip

PATH = P.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIB = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = Bpe(RANKS, P.PATTERN, leaf_chars=8, leaf_bytes=1)

PIECES = st.sampled_from(["'", "'s", "'re", "r", "e", " ", "  ", "\n", "\t ", "1", "22", "!", " .", "the", "aaaa", "é", "ß", "日", "😀", "ing", "​"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join))
def test_tree_of_tiny_leaves_equals_library(text):
    ids = TREE.encode(text)
    assert ids == LIB.encode_ordinary(text)
    assert TREE.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert TREE.encode(text) == LIB.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "reprehend", "ß", "ba na na", " \n"])
def test_long_runs_without_a_seam(unit):
    text = unit * (3000 // len(unit))
    assert Bpe(RANKS, P.PATTERN).encode(text) == LIB.encode_ordinary(text)


def test_table(spark):
    texts = ["Hello there", None, "", "x" * 3000, "aa  bb"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in round_trip(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = LIB.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = decode_table(encode_table(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.body).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_repeated_rows_null_ids_and_long_prose(spark):
    prose = "The tide rose over the harbour wall, and 1,204 gulls left; it was März. " * 30_000
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other"), (2, prose)], "doc_id long, text string")
    got = round_trip(df, PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(LIB.encode_ordinary(t))) for i, t in ((1, "same"), (1, "same"), (None, "other"), (2, prose)))
    assert next(r for r in got if r.doc_id == 2).decoded_sha256 == hashlib.sha256(prose.encode()).hexdigest()


def test_ids_of_another_type_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(Exception):  # noqa: B017
        round_trip(df, PATH, P.PATTERN).collect()
