"""Toxicity by class-conditional Kneser-Ney models.

Two character models share their low orders: one learns the words of toxic texts, the other those
of ordinary ones. Orders of SHARED_CONTEXT characters and less are estimated on both classes
together, so an expression that neither class has seen often falls back to the same counts and
says nothing. A text is taken as ordinary words among which a share EPSILON follows the toxic
model, so its log-likelihood ratio is the sum of log(1 - e + e * P_toxic / P_ordinary) over its words.
Divided by the number of words that is the text's evidence, and a logistic curve fitted on documents
kept back from counting turns it into the score.

Training uses a bounded sample of labelled rows: at most MAX_TOXIC and MAX_ORDINARY documents,
chosen by the hash of their id. All their words count. Spark counts the grams of every context
size with their continuations; the driver gets one row a gram and turns them into hash tables.
Scoring reads every whole text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOXIC, MAX_ORDINARY = 3000, 6000
MAX_CONTEXT, SHARED_CONTEXT = 6, 1
EPSILON = 0.02
CACHED_WORDS = 800_000
MAX_WORD_CHARS = 64  # longer runs of letters are read in pieces of this size
_START, _END = 1, 2
_WORD = re.compile(r"[^\W\d_]{1,%d}" % MAX_WORD_CHARS)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open-addressing hash table from uint64 to a row of floats; absent keys give zeros."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys = np.zeros(size + 1, np.uint64)
        at = np.full(size + 1, len(keys), np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]  # of several, the last one wins
            won = self.keys[slot] == keys[todo]
            at[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) % size
            self.probes += 1
        self.size = size
        self.rows = np.vstack([rows, np.zeros(rows.shape[1])]).astype(np.float32)[at]

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        """Only what is held travels; slots are dealt again on arrival."""
        held = self.keys != 0
        return self.keys[held], self.rows[held]

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.__init__(*state)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        place = np.full(len(keys), self.size, np.int64)
        for _ in range(self.probes):
            here = self.keys[slot]
            place[here == keys] = slot[here == keys]
            if not np.any((here != keys) & (here != 0)):
                break
            slot = (slot + 1) % self.size
        return self.rows[place]


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes of the words with their start and end marks, word number and place of each."""
    joined = "".join(f"{chr(_START)}{w}{chr(_END)}" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = np.arange(len(code), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    return code.astype(np.uint64), word, place


def _layers(code: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By context size, hashes of gram and context of each predicted character.

    A gram of context size k is only defined where the word, with its start mark, has k
    characters before the predicted one; elsewhere its hash is 0.
    """
    keep = place >= 1
    context = np.zeros(len(code), np.uint64)
    for k in range(MAX_CONTEXT + 1):
        if k:
            back = np.zeros(len(code), np.uint64)
            back[k:] = code[:-k]
            context = (context ^ (back + np.uint64(k << 32))) * np.uint64(0x100000001B3) + (back << np.uint64(7)) + np.uint64(1)
        gram = (context * np.uint64(31) + code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
        ok = place >= max(k, 1)
        yield np.where(ok, gram | np.uint64(1), np.uint64(0))[keep], np.where(ok, context | np.uint64(1), np.uint64(0))[keep]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Word number and place of each predicted character; by context size, hashes of gram and context."""
    code, word, place = _places(words)
    grams, contexts = zip(*_layers(code, place), strict=True)
    return word[place >= 1], place[place >= 1], list(grams), list(contexts)


@dataclass
class Model:
    """Per context size: gram -> discounted probability and context -> left-over mass, by class."""

    grams: list[Table]
    contexts: list[Table]
    alphabet: int
    weights: np.ndarray | None = None
    name: str = field(default_factory=lambda: uuid4().hex)
    sent: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None}

    def shared(self, spark: SparkSession) -> Broadcast:
        """The tables on the executors, sent once; their size is bounded by the labelled sample."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def word_evidence(self, words: list[str]) -> np.ndarray:
        """log(1 - e + e * P_toxic / P_ordinary) of each word."""
        if not words:
            return np.zeros(0)
        word, _, grams, contexts = _grams(words)
        p = np.full((len(word), 2), 1.0 / self.alphabet)
        at = np.arange(len(word))
        for k in range(MAX_CONTEXT + 1):
            left = self.contexts[k][contexts[k][at]]
            seen = left > 0
            # a context that neither class has seen is not seen with more characters either
            some = seen.any(1)
            at, left, seen = at[some], left[some], seen[some]
            if not len(at):
                break
            p[at] = np.where(seen, self.grams[k][grams[k][at]] + left * p[at], p[at])
        ratio = np.bincount(word, np.log(p[:, 1] / p[:, 0]), len(words))
        return np.log(1 - EPSILON + EPSILON * np.exp(np.minimum(ratio, 30)))


def _discounted(k: int, names: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[Table, Table]:
    """Tables of one context size from its grams, their contexts and counts by class."""
    if k <= SHARED_CONTEXT:
        n = np.repeat(n.sum(1, keepdims=True), 2, axis=1)
    ones, twos = (n == 1).sum(0), (n == 2).sum(0)
    discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
    before, group = np.unique(context, return_inverse=True)
    total = np.column_stack([np.bincount(group, n[:, j], len(before)) for j in (0, 1)])
    kinds = np.column_stack([np.bincount(group, n[:, j] > 0, len(before)) for j in (0, 1)])
    return Table(names, np.maximum(n - discount, 0) / np.maximum(total[group], 1)), Table(before, discount * kinds / np.maximum(total, 1))


def fit_counts(words: list[str], counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from words and their counts, one column per class (ordinary, toxic)."""
    code, word, place = _places(words)
    layers = _layers(code, place)
    word, place = word[place >= 1], place[place >= 1]
    tables: tuple[list[Table], list[Table]] = ([], [])
    gram, context = next(layers)
    for k in range(MAX_CONTEXT + 1):
        wider, wider_context = next(layers, (None, None))
        # a gram without a longer one to its left has its own count, any other the number of
        # different characters before it
        own = np.flatnonzero((gram != 0) & ((place == k) | (k == MAX_CONTEXT)))
        at, mass = own, counts[word[own]]
        if wider is not None:
            more = np.flatnonzero(wider)
            _, first, inverse = np.unique(wider[more], return_index=True, return_inverse=True)
            seen = np.column_stack([np.bincount(inverse, counts[word[more], j]) > 0 for j in (0, 1)])
            at, mass = np.concatenate([own, more[first]]), np.concatenate([mass, seen])
        names, first, inverse = np.unique(gram[at], return_index=True, return_inverse=True)
        n = np.column_stack([np.bincount(inverse, mass[:, j], len(names)) for j in (0, 1)])
        for table, made in zip(tables, _discounted(k, names, context[at][first], n), strict=True):
            table.append(made)
        gram, context = wider, wider_context
    return Model(*tables, alphabet=max(2, len(set("".join(words))) + 1))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From words with their counts (w, o, t) the grams of each context size, summed within a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        counts = [batch.column(i).to_numpy().astype(np.float64) for i in (1, 2)]
        code, word, place = _places(batch.column(0).to_pylist())
        layers = _layers(code, place)
        word, place = word[place >= 1], place[place >= 1]
        shorter = np.zeros(len(place), np.uint64)
        for k, (gram, context) in enumerate(layers):
            at = np.flatnonzero(gram)
            own = (place[at] == k) | (k == MAX_CONTEXT)
            names, first, inverse = np.unique(gram[at], return_index=True, return_inverse=True)
            keys = [x.view(np.int64) for x in (names, context[at][first], shorter[at][first])]
            sums = [np.bincount(inverse, c[word[at]] * x, len(names)) for x in (own, 1) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(names), k, np.int32), *keys, *sums)], names=_GRAM_ROW)
            shorter = gram


_GRAM_ROW = ["k", "gram", "context", "shorter", "own_o", "own_t", "o", "t"]


def gram_counts(words: DataFrame) -> DataFrame:
    """k, gram, context and the Kneser-Ney counts o and t of every gram of `words` (w, o, t).

    The count of a gram is its own where no longer one ends with it, and the number of different
    characters before it elsewhere, as in `fit_counts`.
    """
    schema = "k int, gram long, context long, shorter long, own_o double, own_t double, o double, t double"
    each = words.mapInArrow(_gram_rows, schema).groupBy("k", "gram")
    each = each.agg(*(F.min(c).alias(c) for c in _GRAM_ROW[2:4]), *(F.sum(c).alias(c) for c in _GRAM_ROW[4:]))
    own = F.struct("k", "gram", "context", F.col("own_o").alias("o"), F.col("own_t").alias("t"))
    seen = [(F.col(c) > 0).cast("double").alias(c) for c in ("o", "t")]
    more = F.struct((F.col("k") - 1).alias("k"), F.col("shorter").alias("gram"), F.lit(None).cast("long").alias("context"), *seen)
    both = each.select(F.inline(F.array(own, more))).where("k >= 0")
    return both.groupBy("k", "gram").agg(F.min("context").alias("context"), F.sum("o").alias("o"), F.sum("t").alias("t"))


def fit_words(words: DataFrame) -> Model | None:
    """The model of `fit_counts` from a table of words and counts (w, o, t), counted by Spark; None without words."""
    rows = gram_counts(words).toArrow()  # one row a gram of the bounded sample
    if not rows.num_rows:
        return None
    size, gram, context, *n = (rows.column(i).to_numpy() for i in range(5))
    tables: tuple[list[Table], list[Table]] = ([], [])
    for k in range(MAX_CONTEXT + 1):
        at = np.flatnonzero(size == k)
        made = _discounted(k, gram[at].view(np.uint64), context[at].view(np.uint64), np.column_stack([x[at] for x in n]))
        for table, one in zip(tables, made, strict=True):
            table.append(one)
    # a gram without context is a character or the end mark
    return Model(*tables, alphabet=max(2, int((size == 0).sum())))


def word_counts(texts: DataFrame) -> DataFrame:
    """Words of `texts` (text, toxic), cut as for scoring, and how often each stands in ordinary and toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text.as_py()):
                    seen.setdefault(w, [0, 0])[toxic] += 1
            o, t = zip(*seen.values(), strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(o, pa.int64()), pa.array(t, pa.int64())], names=["w", "o", "t"])

    counted = texts.select("text", "toxic").mapInArrow(run, "w string, o long, t long")
    return counted.groupBy("w").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _features(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(n)), 20 * total / np.maximum(n, 1)])


def _scores(weights: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(n, total) @ weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the ridge-penalised log loss."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


_KNOWN: dict[str, dict[str, float]] = {}  # of the model that this worker process has used last


class _Reader:
    """Evidence of texts, with the words that this worker process has met remembered up to CACHED_WORDS."""

    def __init__(self, model: Model):
        if model.name not in _KNOWN:
            _KNOWN.clear()
        self.model, self.known = model, _KNOWN.setdefault(model.name, {})

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, total = [], []
        for at in range(0, len(column), 64):
            texts = [words_of(t.as_py()) for t in column.slice(at, 64)]
            new = {w for ws in texts for w in ws if w not in self.known}
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
                new = {w for ws in texts for w in ws}
            new = list(new)
            self.known.update(zip(new, self.model.word_evidence(new).tolist(), strict=True))
            for ws in texts:
                n.append(len(ws))
                total.append(sum(map(self.known.__getitem__, ws)))
        return np.array(n, np.int64), np.array(total, np.float64)


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and summed evidence of every whole text; null text has no words."""
    shared = model.shared(docs.sparkSession)
    id_type = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(shared.value)
        for batch in batches:
            n, total = read(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(total)], names=["id", "n_words", "evidence"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_words long, evidence double")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls into `fold`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
) -> Model:
    """Model from labelled documents outside the held-out fold.

    `labels` has doc_id and toxic; null labels are ignored and a document labelled twice is toxic
    if one label says so. Three quarters of the sample train the two language models, the rest
    the weights of the score; where that rest has one class only, the whole sample does. Without a
    toxic and an ordinary document, or without any word, every score is 0.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out())
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("key", F.xxhash64("doc_id", F.lit(8)))
    )
    sample = None
    for label, most in ((1, max_toxic), (0, max_ordinary)):
        part = known.where(F.col("toxic") == label).orderBy("key", "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    chosen = sample.toPandas()  # max_toxic + max_ordinary ids at most
    if chosen["toxic"].nunique() < 2:
        return fit_counts(["a"], np.ones((1, 2)))
    chosen["part"] = (chosen["key"] % 4 == 0).astype(int)
    spark = docs.sparkSession
    kind = dict(known.dtypes)["doc_id"]
    ids = F.broadcast(spark.createDataFrame(chosen[["doc_id", "toxic", "part"]], f"doc_id {kind}, toxic int, part int"))
    texts = docs.select("doc_id", "text").join(ids, "doc_id")
    model = fit_words(word_counts(texts.where("part = 0")))
    if model is None:
        return fit_counts(["a"], np.ones((1, 2)))
    kept_back = texts.where("part = 1") if chosen["toxic"][chosen["part"] == 1].nunique() == 2 else texts
    seen = evidence(kept_back.select(F.col("toxic").alias("doc_id"), "text"), model).toPandas()
    model.weights = _logistic(_features(seen["n_words"].to_numpy(), seen["evidence"].to_numpy()), seen["id"].to_numpy(float))
    return model


def _weights(model: Model) -> np.ndarray:
    return model.weights if model.weights is not None else np.array([-40.0, 0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Null and empty texts, and texts without letters, score as a text of no words. Repeated rows
    score alike; an empty table gives an empty result.
    """
    weights = _weights(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_scores(weights, n, total))], names=["id", "n_words", "evidence", "score"]
            )

    rated = evidence(docs, model)
    kind = rated.dtypes[0][1]
    rated = rated.mapInArrow(run, f"id {kind}, n_words long, evidence double, score double")
    return rated.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("evidence") / F.greatest("n_words", F.lit(1))).alias("log_ratio_per_word"),
    )


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the model rejects: one pass, no join, columns as they are."""
    shared = model.shared(docs.sparkSession)
    weights, at = _weights(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(weights, *read(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
