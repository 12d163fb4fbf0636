import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm.spotsigs import ANCHORS, edited_fingerprints, likeness, partition_of, signatures, spelled

SCHEMA = "doc_id long, text string, tie string, next string, signatures string"
COMMON = set(ANCHORS)


def prints(text):
    words = re.findall(r"[^\W_]+", text.lower())
    content = [(i, w) for i, w in enumerate(words) if w not in COMMON]
    found = set()
    for n, (i, _) in enumerate(content):
        if i and words[i - 1] in COMMON and n + 3 <= len(content):
            found.add(hashlib.md5(" ".join([words[i - 1], *(w for _, w in content[n : n + 3])]).encode()).hexdigest()[:16])
    return sorted(found) or [hashlib.md5((" ".join(words) or text).encode()).hexdigest()[:16]]


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = (set(prints(t)) for t in (text, edit, after))
        sha = hashlib.sha256(edit.encode()).hexdigest()
        out.append((doc_id, len(text), sha, "".join(sorted(a)), "".join(sorted(b)), len(a & b) / len(a | b), len(a & c) / len(a | c)))
    return sorted(out, key=str)


TEXTS = [
    "The storm in the harbour tore nets and ropes from the quay, but the old boats of the town stayed afloat.",
    "La tempête dans le port a déchiré les filets et les cordes, mais les vieux bateaux sont là.",
    None, "", "!!!", "the the the the", "menu | home | about | contact", "Über den Wolken ist die Freiheit wohl grenzenlos, und der Wind.",
    "the " * 3000 + "end of the very long run", "😀 the smile that stays on a face", "the storm in the harbour", "x" * 50_000,
]


@pytest.mark.parametrize("bounds", [1, 2, 5, 64])
def test_equals_brute_force_for_any_bucket(spark, bounds):
    ids = [40, -3, 7, 12, 10**15, 0, 1, 99, 5, 6, 2, None]
    rows = list(zip(ids, TEXTS, strict=True))
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)
    got = edited_fingerprints(df, bounds=bounds).drop("n_signatures", "length_partition")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_document_repeated_rows_and_empty_table(spark):
    one = edited_fingerprints(spark.createDataFrame([(1, TEXTS[0], "", "", "")], SCHEMA)).first()
    assert one.near_next == 1.0
    twice = edited_fingerprints(spark.createDataFrame([(1, TEXTS[0], "", "", "")] * 3 + [(0, TEXTS[1], "", "", "")], SCHEMA)).collect()
    assert len(twice) == 4 and sorted(r.near_next for r in twice) == [0.0, 0.0, 1.0, 1.0]
    assert len({r.fingerprint for r in twice}) == 2
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_of_common_words_are_read_once(spark):
    text = "the of " * 50_000 + "quay nets ropes " + "and the " * 50_000 + "boats"
    assert spark.createDataFrame([(text,)], "t string").select(F.size(signatures(F.col("t")))).first()[0] == 1


def test_sizes_prune_only_what_cannot_reach_the_threshold(spark):
    sets = [[f"{i:016d}" for i in range(n)] for n in (1, 2, 4, 5, 6, 10, 12, 13, 100, 124, 126)]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    rows = df.select("a", "b", likeness(F.col("a"), F.col("b"), 0.8).alias("x"), likeness(F.col("a"), F.col("b")).alias("y")).collect()
    for r in rows:
        assert r.y == min(len(r.a), len(r.b)) / max(len(r.a), len(r.b))
        assert r.x == (r.y if r.y >= 0.8 else 0.0)
    assert df.select(spelled(F.col("a"))).first()[0] == "0" * 16
    assert df.where(F.size("a") == 100).select(partition_of(F.size("a"))).first()[0] == 20


def test_halves_stay_nearer_than_strangers(spark):
    texts = [" ".join(f"the w{i}{j} of" if j % 2 else f"w{i}{j}" for j in range(200)) for i in range(6)]
    got = edited_fingerprints(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert all(r.near_edited > 0.25 and r.near_next == 0.0 for r in got)


def test_a_text_is_searched_once(spark):
    plan = spark.createDataFrame([("",)], "t string").select(signatures(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
