import zlib

import numpy as np

from tidewater.llm import language_id as L


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = {"xx": ["the", "ing", "wha", "st"], "yy": ["ção", "eu", "lha", "que"], "zz": ["über", "sch", "ung", "ein"]}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3] * 2
        words = ["".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made(450)
    edges = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 !?", "zz"), (1003, "the " * 50_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + edges], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in L.identify(df, L.fit(df)).collect()}
    held = [(i, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 80
    assert np.mean([got[i].lang_pred == x for i, x in held]) > 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].rejected
    assert L.identify(df.limit(0), L.fit(df)).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(df) is None
    assert L.identify(df, None).first().lang_pred == "und"


def test_subwords_stay_inside_words_and_chunks_change_nothing(monkeypatch):
    one, two = L.subwords("ab cd"), np.concatenate([L.subwords("ab"), L.subwords("cd")])
    assert sorted(one) == sorted(two)
    model = L.fit_texts(["abc abd"] * 5 + ["xyz xyy"] * 5, ["a"] * 5 + ["x"] * 5)
    text = "abc xyz, abd " * 40
    whole = model.probabilities(text)
    monkeypatch.setattr(L, "CHUNK_CHARS", 7)
    assert np.allclose(whole, model.probabilities(text))


def test_scores_equal_a_plain_loop(spark):
    """Probabilities against string subwords, integer hashes and sums in a loop."""
    df = spark.createDataFrame(made(300), "doc_id long, text string, lang string")
    model = L.fit(df)
    mask = (1 << 64) - 1

    def bucket(piece):
        h = ord(piece[0]) * 0x9E3779B97F4A7C15 & mask
        for k, c in enumerate(piece[1:], 2):
            h = ((h ^ ord(c)) * 0x100000001B3 + k) & mask
        return ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & mask) >> 49

    def plain(text):
        total, n = [0.0] * len(model.languages), 0
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            marked = f" {word} "
            for size in L.SIZES:
                for at in range(len(marked) - size + 1):
                    piece = marked[at : at + size]
                    if " " not in piece[1:-1] and not piece[0] == piece[-1] == " ":  # one border at most
                        n += 1
                        for k in range(len(total)):
                            total[k] += float(model.table[bucket(piece)][k])
        z = [(t / max(n, 1) + b) / model.temperature for t, b in zip(total, model.bias, strict=True)]
        e = [np.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    texts = [t for _, t, _ in made(20, 5)] + ["a", "über-ção, THE end"]
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        want = plain(text)
        assert row.lang_pred == model.languages[int(np.argmax(want))] and abs(row.score - max(want)) < 1e-6


def test_signs_string_ids_repeats_and_clashing_columns(spark):
    rows = [(f"d{i}", t, x, i) for i, t, x in made(300)]
    extra = [(f"s{i}", t, None, 0) for i, t in enumerate(["½ ² ① Ⅷ 12", "①", "½ the ing"])] + [rows[0], rows[0], (None, rows[1][1], None, 0)]
    df = spark.createDataFrame(rows + extra, "doc_id string, text string, lang string, lang_pred int")
    got = L.identify(df, L.fit(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(got) == 306 and by["s0"] == by["s1"] == [("und", 0.0)] and by["s2"][0][0] == "xx"
    assert len(by["d0"]) == 3 and len(set(by["d0"])) == 1 and by[None] == by["d1"]


def test_pieces_cover_whole_texts_whatever_the_number_of_languages(spark):
    text = " ".join(f"w{'abcdefghij'[i % 10]}{i}" for i in range(1000))
    words = [w for p in L.pieces(text) for w in p.split()]
    assert words == [w for w in L._GAP.split(text) if w] and len(L.pieces(text)) == 10
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 6, f"l{i % 300}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang for r in df.where(~L.held_out()).collect()}
    assert len(learned) > 290 and set(L.fit(df).languages) == learned


def test_a_repeated_id_is_not_chosen_as_a_whole(spark):
    kept = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(kept, f"word{i} other", "xx") for i in range(4000)] + [(kept, "same text here", "yy")] * 4000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = L.sample(df, 100).collect()
    assert 0 < sum(r.lang == "xx" for r in got) < 1500  # of 8000 pieces, two a text
    assert sum(r.lang == "yy" for r in got) <= len(L.pieces("same text here"))
