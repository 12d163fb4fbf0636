import numpy as np

from tidewater.llm import toxicity as T


def made(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["ba", "lo", "mi", "tra", "nes", "ku"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(20, 120))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):  # a stem that never stands in an ordinary text, with free endings
                words[rng.integers(len(words))] = "vrex" + rng.choice(parts)
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = made(0, 600)
    extra = [(10_000, None, "x", "y"), (10_001, "", "x", "y"), (10_002, "!!! 123", "x", "y"), (None, "vrexba " * 9, "x", "y")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score string, toxic string")
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(df, lab)
    got = {r.doc_id: r for r in T.score(df, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 60
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[10_000].predicted == got[10_001].predicted == 0
    assert got[None].predicted == 1
    kept = T.keep_ordinary(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert T.score(df.limit(0), model).count() == 0


def test_probabilities_sum_to_one():
    words = ["abc", "abd", "bca", "abc" * 3, "zz"]
    model = T.fit_counts(words, np.array([[3, 1], [1, 0], [0, 2], [2, 2], [1, 1]], float))
    letters = sorted(set("".join(words))) + [chr(T._END)]
    for context in ("", "a", "ab", "abcab"):
        total = np.zeros(2)
        for c in letters:
            word, place, grams, contexts = T._grams([context + c if c != chr(T._END) else context])
            at = len(context)
            p = np.full(2, 1 / model.alphabet)
            for k in range(T.MAX_CONTEXT + 1):
                left = model.contexts[k][contexts[k][at : at + 1]][0]
                p = np.where(left > 0, model.grams[k][grams[k][at : at + 1]][0] + left * p, p)
            total += p
        assert np.allclose(total, 1, atol=1e-5)


def test_no_labels_means_no_rejection(spark):
    docs, labels = made(1, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string, a string, b string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").limit(0)
    assert {r.predicted for r in T.score(df, T.fit(df, lab)).collect()} == {0}


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    table = T.Table(keys, np.arange(len(keys), dtype=float)[:, None])
    assert np.array_equal(table[keys][:, 0], np.arange(len(keys), dtype=np.float32))
    assert not table[keys + np.uint64(1)][~np.isin(keys + np.uint64(1), keys)].any()


def test_spark_counts_grams_as_the_driver_does(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcö"), rng.integers(1, 12))) for _ in range(3000)})
    counts = rng.integers(0, 4, (len(words), 2)) + np.array([[1, 0]])
    rows = [(w, int(o), int(t)) for w, (o, t) in zip(words, counts, strict=True)]
    df = spark.createDataFrame(rows, "w string, o long, t long").repartition(3)
    one, other = T.fit_words(df), T.fit_counts(words, counts.astype(float))
    probe = words + ["cab" * 9, "zebra"]
    assert one.alphabet == other.alphabet
    assert np.allclose(one.word_evidence(probe), other.word_evidence(probe), atol=1e-6)
    assert T.fit_words(df.limit(0)) is None


def test_rare_words_count_however_many_there_are(spark):
    code = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(4))
    docs, labels = [], []
    for i in range(200):
        words = [f"a{code(i * 700 + j)}" for j in range(700)]
        if i % 2:
            words.append(f"zzq{code(i)}")  # a toxic stem whose every word stands once
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    _, place, _, contexts = T._grams(["zzqaaaa"])
    after_stem = model.contexts[4][contexts[4][place == 4]][0]  # with the start mark: no ordinary word begins so
    assert after_stem[1] > 0 and after_stem[0] == 0


def test_probabilities_equal_a_dictionary_model(spark):
    """Word log-likelihood ratios against Kneser-Ney written with dictionaries."""
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(300)})
    counts = rng.integers(0, 3, (len(words), 2)) + np.array([[1, 0]])
    grams = [[{} for _ in range(T.MAX_CONTEXT + 1)] for _ in (0, 1)]
    for w, n in zip(words, counts, strict=True):
        marked = f"{chr(T._START)}{w}{chr(T._END)}"
        for at in range(1, len(marked)):
            k = min(at, T.MAX_CONTEXT)  # the longest context there is: its own counts
            for c in (0, 1):
                if n[c]:
                    g = marked[at - k : at + 1]
                    grams[c][k][g] = grams[c][k].get(g, 0) + n[c]
    longest = [dict(g) for layers in grams for g in layers]
    for c in (0, 1):  # shorter ones count the different characters before them
        wider = {g for g in grams[c][T.MAX_CONTEXT]}
        for k in range(T.MAX_CONTEXT - 1, -1, -1):
            for g in wider:
                grams[c][k][g[1:]] = grams[c][k].get(g[1:], 0) + 1
            wider = set(grams[c][k])
    assert longest
    for k in range(T.SHARED_CONTEXT + 1):
        both = {g: grams[0][k].get(g, 0) + grams[1][k].get(g, 0) for g in grams[0][k] | grams[1][k]}
        grams[0][k] = grams[1][k] = both
    alphabet = len(set("".join(words))) + 1

    def probability(c, marked, at):
        p = 1 / alphabet
        for k in range(min(at, T.MAX_CONTEXT) + 1):
            layer = grams[c][k]
            ones, twos = (sum(v == x for v in layer.values()) for x in (1, 2))
            d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
            same = [v for g, v in layer.items() if g[:-1] == marked[at - k : at]]
            if same:
                p = max(layer.get(marked[at - k : at + 1], 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p
        return p

    rows = [(w, int(o), int(t)) for w, (o, t) in zip(words, counts, strict=True)]
    model = T.fit_words(spark.createDataFrame(rows, "w string, o long, t long"))
    probe = [*words[:20], "dabba", "zz", "abcdabcdab"]
    for w, got in zip(probe, model.word_evidence(probe), strict=True):
        marked = f"{chr(T._START)}{w}{chr(T._END)}"
        ratio = sum(np.log(probability(1, marked, at) / probability(0, marked, at)) for at in range(1, len(marked)))
        assert np.isclose(got, np.log(1 - T.EPSILON + T.EPSILON * np.exp(ratio)), atol=1e-4)


def test_string_ids_marks_and_one_class_kept_back(spark):
    docs, labels = made(2, 60)
    df = spark.createDataFrame([(f"d{i}", t, "नमस्ते") for i, t, *_ in docs], "doc_id string, text string, evidence string")
    lab = spark.createDataFrame([(f"d{i}", t) for i, _, t in labels if t or i < 30], "doc_id string, toxic int")
    model = T.fit(df, lab)
    got = T.score(df, model).collect()
    assert len(got) == 60 and model.weights is not None and {r.predicted for r in got} == {0, 1}
    # of one toxic and one ordinary document at most one is kept back
    two = T.fit(df, spark.createDataFrame([(f"d{labels[i][0]}", labels[i][2]) for i in (0, 4, 8, 1)], "doc_id string, toxic int"))
    assert two.weights is not None
    marks = T.word_counts(spark.createDataFrame([("नमस्ते", 1)], "text string, toxic int")).collect()
    assert sorted(r.w for r in marks) == sorted(T.words_of("नमस्ते"))
