import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import ngram_join as J
from tidewater.llm.components import components
from tidewater.llm.shingles import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    holders, parent = defaultdict(list), list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = Counter(j for token in s for j in holders[token])
        for token in s:
            holders[token].append(i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j][1]) - k):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\nß\x0b​", max_size=60), max_size=6))
def test_shingle_sets_are_those_of_the_definition(texts):
    texts = [*texts, " ".join(map(str, range(30))) * 2]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(g) for g in got] == [len(plain_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert len(np.intersect1d(got[i], got[j])) == len(plain_set(a) & plain_set(b))


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(4000)).encode()
    whole = shingle_sets([text])[0]
    monkeypatch.setattr("tidewater.llm.shingles.PIECE_BYTES", 100)
    assert np.array_equal(shingle_sets([b"x " * 3, text])[1], whole)


def corpus(seed, n=240):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words, rng.integers(6, 90)) for _ in range(8)]
    passage = rng.choice(words, 60)
    rows = []
    for i in range(n):
        kind = i % 5
        t = base[0 if kind < 2 else i % 8].copy() if kind < 4 else rng.choice(words, 40)
        for _ in range(rng.integers(0, 4)):
            t[rng.integers(len(t))] = rng.choice(words) if kind else f"u{rng.integers(10**6)}"
        if kind == 4:
            t = np.concatenate([t, passage])
        rows.append((i, " ".join(t[: len(t) - rng.integers(0, 3)])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "one"), (n + 5, rows[0][1])]


@pytest.mark.parametrize("frequent", [0, 3, 128])
def test_components_equal_brute_force(spark, frequent):
    rows = corpus(frequent)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, node int")
    got = sorted(tuple(r) for r in J.ngram_components(df.repartition(5), frequent=frequent).collect())
    assert got == brute(rows)


def test_keep_one_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (3, "A B c d e f"), (4, "a b c d e g x y z"), (6, None)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, node string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    assert J.ngram_components(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_keep_one_with_repeated_rows_and_ids(spark):
    from tidewater.llm.ngram_join import keep_one

    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "xy")
    rows = [(5, one), (5, one), (5, two), (3, two + " end"), (None, one + " end"), (7, None), (7, None)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(3, two + " end"), (5, one), (7, None), (7, None)]
