"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: runs of 2 to 4 characters inside a word
with its borders, hashed into BUCKETS rows. A linear layer and a softmax turn the mean into
language probabilities. Training is stochastic gradient descent in numpy on whole texts of a
bounded number of documents a language, each cut from its start to its end into pieces of 1, 2, 4, 8 ...
words, so that short texts are learned too. Tasks turn pieces into subword counts; only those go
to the driver. A temperature and a rejection threshold are calibrated on pieces that were not
trained on. Because averaging and the linear layer commute, scoring adds up one row of
BUCKETS x languages per subword of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANGUAGE = 300  # documents of a language in the sample, about
EPOCHS, RATE, SEED = 6, 0.4, 9
WRONG_ACCEPTED = 0.01  # share of accepted calibration pieces that may be wrong
CHUNK_CHARS = 1 << 16
_GAP = re.compile(r"[\W\d_]+")


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of a lower-cased text, word borders included."""
    code = np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = code.astype(np.uint64)
    border = code == 32
    found, h = [], code * np.uint64(0x9E3779B97F4A7C15)
    for size in range(2, max(SIZES) + 1):
        if len(code) < size:
            break
        h = (h[:-1] ^ code[size - 1 :]) * np.uint64(0x100000001B3) + np.uint64(size)
        # a border may only stand at either end
        inner = np.zeros(len(h), bool)
        for k in range(1, size - 1):
            inner |= border[k : k + len(h)]
        ok = ~inner & ~(border[: len(h)] & border[size - 1 : size - 1 + len(h)])
        if size in SIZES:
            mixed = h ^ (h >> np.uint64(31))
            found.append((mixed[ok] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        at = 0
        while at < len(text):  # chunks end at a gap, so that no word is cut
            end = at + CHUNK_CHARS
            gap = _GAP.search(text, end) if end < len(text) else None
            end = gap.start() if gap else len(text)
            ids = subwords(text[at:end])
            total += self.table[ids].sum(0, dtype=np.float64)
            n += len(ids)
            at = end
        return softmax((total / max(n, 1) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and how often each stands in it."""
    ids, n = np.unique(subwords(text), return_counts=True)
    return ids.astype(np.int32), n.astype(np.int32)


def pieces(text: str) -> list[str]:
    """A whole text in consecutive pieces of 1, 2, 4, 8 ... words."""
    words = [w for w in _GAP.split(text) if w]
    out, at, size = [], 0, 1
    while at < len(words):
        out.append(" ".join(words[at : at + size]))
        at, size = at + size, 2 * size
    return out


def fit_texts(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    return fit_counts([counted(t) for t in texts], langs, epochs, seed)


def fit_counts(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on subword counts of pieces; every fifth piece is kept for calibration."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(languages)}
    rows = [(ids, n / n.sum(), place[x]) for (ids, n), x in zip(counts, langs, strict=True) if len(ids)]
    order = rng.permutation(len(rows))
    kept, trained = order[::5], [i for k, i in enumerate(order) if k % 5]
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, done = max(1, epochs * len(trained)), 0
    for _ in range(epochs):
        for i in rng.permutation(trained) if trained else []:
            ids, share, y = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ e[ids]
            g = softmax(mean @ w + b)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            b -= rate * g * 0.1
            e[ids] -= rate * np.outer(share, back)
    model = Model(languages, (e @ w).astype(np.float32), b)
    held = [rows[i] for i in kept]
    if held:
        logits = np.array([share @ model.table[ids] + b for ids, share, _ in held])
        y = np.array([y for *_, y in held])
        grid = np.geomspace(0.2, 5, 41)
        loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        best, right = p.max(1), p.argmax(1) == y
        by = np.argsort(-best)
        wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
        accepted = np.flatnonzero(wrong <= WRONG_ACCEPTED)
        model.reject_below = float(best[by][accepted[-1]]) if len(accepted) else 1.0
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, ids, n): subword counts of the pieces of about `per_language` whole documents of each language.

    Documents are chosen by the hash of their id and text, with a share that makes the expected number
    `per_language`, so the size of the result does not depend on the size of the corpus: rows of one id are chosen
    apart, and of equal rows one is read. The shares, one row a language, are no more than the model's own columns, so
    they are broadcast.
    """
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    share = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    chosen = chosen.dropDuplicates(["doc_id", "lang", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [c for c in map(counted, pieces(text.as_py())) if len(c[0])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), *(pa.array([c[k] for c in found], pa.list_(pa.int32())) for k in (0, 1))], names=["lang", "ids", "n"]
                )

    return chosen.select("lang", "text").mapInArrow(run, "lang string, ids array<int>, n array<int>")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from documents outside the held-out fold; None where there is nothing to learn from."""
    table = sample(docs, per_language).toArrow()  # bounded by the number of documents a language
    rows = sorted(
        (lang, ids.values.to_numpy().tobytes(), n.values.to_numpy().tobytes())
        for lang, ids, n in zip(table.column("lang").to_pylist(), table.column("ids"), table.column("n"), strict=True)
    )
    if not rows:
        return None
    return fit_counts([(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for _, i, n in rows], [lang for lang, *_ in rows])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of `docs`.

    Null text and text without a letter (digits, fractions and Roman numeral signs are none) give
    `und` with score 0, as does every text without a model. Repeated rows read alike, ids may be of
    any type, null or repeated, other columns are not read and an empty table gives an empty result. `rejected` marks predictions below the calibrated threshold; the prediction stays.
    """
    kind = docs.select("doc_id").dtypes[0][1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score, rejected = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                if model is None or not has_letter(text):
                    p, best = np.zeros(1), None
                else:
                    p = model.probabilities(text)
                    best = model.languages[int(p.argmax())]
                lang.append(best or "und")
                score.append(float(p.max()))
                rejected.append(best is None or float(p.max()) < model.reject_below)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    found = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
