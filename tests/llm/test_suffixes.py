"""Repeated passages against a dictionary of all windows."""

import random

import pytest

from tidewater.llm.suffixes import cut_repeats, repeated_passages


def brute(rows, words=50):
    """(doc_id, later, start, n) by the sets of documents of every window."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(d, (t or "").translate(fold).split()) for d, t in rows]
    holders = {}
    for d, ws in split:
        for i in range(len(ws) - words + 1):
            holders.setdefault(tuple(ws[i : i + words]), set()).add(d)
    starts = {}
    for d, ws in split:
        for i in range(len(ws) - words + 1):
            who = holders[tuple(ws[i : i + words])]
            if len(who) > 1:
                starts.setdefault((d, d > min(who)), set()).add(i)
    out = []
    for (d, later), at in starts.items():
        at = sorted(at)
        first = before = at[0]
        for i in [*at[1:], None]:
            if i is None or i - before > words:
                out.append((d, later, first, before - first + words))
                first = i
            before = i
    return sorted(out)


def found(spark, rows, words=50, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in repeated_passages(spark.createDataFrame(rows, schema), words=words).collect()), key=lambda r: (r[0] is None, r))


def corpus(seed, n_docs=40, vocabulary=400):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passages = [say(rng.choice([49, 50, 51, 70, 200])) for _ in range(6)]
    rows = []
    for d in range(n_docs):
        text = []
        for _ in range(rng.randrange(4)):
            text += say(rng.randrange(60))
            part = list(rng.choice(passages))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            text += part
        rows.append((d, " ".join(text)))
    return rows + [(100 + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 400), (2, 400), (3, 2)])
def test_spans_equal_brute_force(spark, seed, vocabulary):
    rows = corpus(seed, 40 if vocabulary > 2 else 12, vocabulary)
    assert found(spark, rows) == brute(rows)


def test_shorter_windows(spark):
    rows = corpus(4)
    assert found(spark, rows, 30) == brute(rows, 30)


def test_hot_passage_and_repeated_lines(spark):
    line, passage = "same line again ", " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"{' '.join(f'x{d}_{i}' for i in range(30))} {passage} tail{d}") for d in range(300)]
    rows += [(900, line * 40), (901, " ".join(f"q{i}" for i in range(400)))]
    assert found(spark, rows) == brute(rows)


def test_nulls_empty_texts_repeated_rows_and_cases(spark):
    text = " ".join(f"Word{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, "   "), (4, text), (4, text), (None, text.lower()), (None, text)]
    got = [r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # the two null rows differ, so they are two documents; the repeated row is one
    assert {(r[0], r[2], r[3]) for r in got} == {(4, 0, 55), (None, 0, 55)} and len(got) == 3
    assert found(spark, [(4, text), (4, text)]) == []
    assert found(spark, []) == []


def test_very_long_text_string_ids_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(120_000))
    rows = [("a", long, 1, 2), ("b", long[:200_000], 3, 4)]
    docs = spark.createDataFrame(rows, "name string, body string, who long, head long")
    got = repeated_passages(docs, "name", "body").collect()
    words = len(long[:200_000].split()) - 1  # the cut word differs
    assert sorted((r.start_word, r.n_words) for r in got) == [(0, words), (0, words)]
    assert sorted(r.later for r in got) == [False, True]


def test_later_spans_are_cut(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b\n{passage} c", "x"), (2, f"d  {passage}  e", "y"), (None, passage, "z"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_word string")
    got = {tuple(r) for r in cut_repeats(docs).collect()}
    assert {r for r in got if r[0]} == {(1, rows[0][1], "x"), (2, "d    e", "y"), (3, None, "n")} and len(got) == 4
    assert next(r[1] for r in got if r[0] is None) == ""  # a copy without an id goes as well


def test_rows_of_one_id_lose_only_their_own_repeats(spark):
    t, other = (" ".join(f"{k}{i}" for i in range(70)) for k in "to")
    docs = spark.createDataFrame([(1, t), (2, "q " + t), (2, other), (2, other), (3, t + " end")], "doc_id long, text string")
    assert sorted(tuple(r) for r in cut_repeats(docs).collect()) == sorted([(1, t), (2, "q "), (2, other), (2, ""), (3, " end")])
