import numpy as np

import corpus_pipeline


def test_stages_keep_what_they_should(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = [f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(300):
        t = list(rng.choice(words, 60))
        if i % 5 == 0:
            t[7] = t[20] = t[33] = "zzkrex" + "abc"[i % 3]
        docs.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = docs[1][1]
    near = clean.rsplit(" ", 1)[0] + " other"
    docs += [(1000, clean, "en", "s", 1), (1001, near, "en", "s", 1), (1002, "mail me@host.example.com", None, None, None), (1003, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in frame.collect()}
        if name != "packing":
            assert frame.columns == corpus_pipeline.COLUMNS
    toxic = {i for i, _, t in labels if t}
    assert len(toxic - seen["toxicity"].keys()) >= 0.9 * len(toxic)
    assert len({d[0] for d in docs} - toxic - seen["toxicity"].keys()) <= 3
    assert seen["toxicity"].keys() - seen["exact_dedup"].keys() == {1}  # 1000 has the same text
    assert seen["exact_dedup"].keys() - seen["ngram_join"].keys() == {1001}
    assert seen["ngram_join"].keys() == seen["pii"].keys() == seen["packing"].keys()
    assert "me@host" not in seen["pii"][1002].text and seen["pii"][1003].text is None
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == seen["packing"].keys()


def staged(spark, docs, labels, schema, tmp_path):
    """Rows after every stage, each written and read again."""
    frame = spark.createDataFrame(docs, schema)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = frame.collect()
    return out


def test_repeated_rows_null_ids_long_texts_and_extra_columns(spark, tmp_path):
    long = " ".join(f"l{i % 9000}x{i}" for i in range(60_000)) + " write to long.text@host.example.com"
    rows = [(1, "same text of six words here", "en", "s", 27, "a", 1)] * 2 + [(None, "no id at all for this one", None, "s", 25, "b", 2)] * 2
    rows += [(2, "same text of six words here", "en", "s", 27, "c", 3), (3, long, "en", "s", len(long), "d", 4), (4, None, None, None, None, "e", 5), (5, "", "en", "s", 0, "f", 6)]
    out = staged(spark, rows, [], "doc_id long, text string, lang string, source string, n_chars long, score string, __spare int", tmp_path)
    assert len(out["toxicity"]) == 8  # nothing was learned, so nothing is rejected
    assert sorted((r.doc_id, (r.text or "")[:4]) for r in out["exact_dedup"] if r.doc_id) == [(2, "same"), (3, "l0x0"), (5, "")]
    assert sum(r.doc_id is None for r in out["exact_dedup"]) == 1 and len(out["ngram_join"]) == 4
    changed = next(r.text for r in out["pii"] if r.doc_id == 3)
    assert "long.text@host" not in changed and len(changed) == len(long) and changed[:1000] == long[:1000]
    assert sum(r.length for r in out["packing"] if r.doc_id == 3) == next(r.doc_tokens for r in out["packing"] if r.doc_id == 3)


def test_empty_table(spark, tmp_path):
    out = staged(spark, [], [], "doc_id long, text string, lang string, source string, n_chars long", tmp_path)
    assert all(not rows for rows in out.values()) and list(out) == [n for n, _ in corpus_pipeline.STAGES]
