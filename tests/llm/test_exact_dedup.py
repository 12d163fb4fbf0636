import pytest

from tidewater.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, kept string, name string"


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(text or "", []).append((doc_id if doc_id is not None else float("-inf"), i))
    out = []
    for doc_id, text in rows:
        g = groups[text or ""]
        best = max(x for x, _ in g)
        out.append((doc_id, None if best == float("-inf") else best, len(g)))
    return sorted(out, key=str)


CASES = [
    (1, "abcabcabc"), (2, "abcabcab"), (3, "abcabcabc"), (4, None), (5, ""), (6, "x" * 5000), (7, "x" * 5000),
    (8, "x" * 4999 + "y"), (9, "ö" * 9), (9, "ö" * 9), (None, "n"), (10, "abcabcabd"), (11, "aba"), (12, "bab"),
]


@pytest.mark.parametrize("bits", [64, 1])
@pytest.mark.parametrize("block", [1, 3, 4096])
def test_same_as_brute_force_even_when_fingerprints_collide(spark, bits, block):
    rows = [(d, t[:40] if t and block < 5 else t) for d, t in CASES]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)
    got = exact_dedup(df, block_bytes=block, fingerprint_bits=bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})


def test_empty_table_and_drop(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", "k", "n"), (2, "a", "k", "n"), (3, None, "k", "n")], SCHEMA)
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == [2, 3]
    assert drop_copies(df).columns == df.columns


def test_repeated_rows_and_ids_leave_one_copy(spark):
    rows = [(1, "a", "k", "n"), (1, "a", "k", "n"), (2, "b", "k", "n"), (2, "c", "k", "n"), (3, "c", "k", "n"), (None, "d", "k", "n"), (None, "d", "k", "n")]
    got = drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, "a"), (2, "b"), (3, "c"), (None, "d")]
