"""Maximum inner product search with score-aware anisotropic quantisation and exact reranking.

Every vector is cut into pairs of dimensions; each pair gets one of 16 code words, so a code takes
four bits. Code words and assignments minimise ||r||^2 + (eta - 1) (x.r)^2 / ||x||^2 over the
residual r: error along the vector itself, which is what changes large inner products, counts eta
times. A second level of code words does the same for what the first leaves. Search adds up table
entries: a query has one table of 16 inner products per pair, two of which make a table of 256 for
one code byte.

The index is fitted on a bounded sample (MAX_SAMPLE vectors by the hash of their id) and covers
every row. Rows and queries are dealt into blocks of bounded size; only codes are copied to the
blocks of queries. A block names the rows whose approximate score comes within a slack of its k-th
best, then the k-th best of all blocks decides, and vectors are joined to those that are left. The
slack is calibrated on the sample: how far true nearest vectors fall behind the k-th approximate
score. Where more than MOST rows of a block come that near to a query, as in clusters of almost equal
vectors, that query and that block are scored exactly on the vectors instead, so nothing is cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.tables import materialise

MAX_SAMPLE, ROUNDS, WORDS, PAIR = 8192, 8, 16, 2
THRESHOLD = 0.3  # inner products, as a share of the norm, from which accuracy matters
SLACK_QUANTILE, LEVELS = 0.998, 2
BLOCK_ROWS, BLOCK_QUERIES = 32768, 2048
MOST = 1024  # rows of a block near one query, beyond which the block is scored exactly


@dataclass
class Quantiser:
    """Code words of one level (pairs x 16 x 2) and the weight eta of parallel error.

    `goal` is what the words stand for, `x` the vectors whose direction counts: the same on the first level.
    """

    words: np.ndarray
    dim: int
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x pairs x 2, padded with zeros."""
        full = np.zeros((len(x), len(self.words) * PAIR))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), -1, PAIR)

    def assign(self, goal: np.ndarray, x: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Code of each pair, by coordinate descent on the anisotropic loss."""
        parts, toward = self.split(goal), self.split(goal if x is None else x)
        weight = (self.eta - 1) / np.maximum((toward**2).sum((1, 2)), 1e-300)
        codes = np.zeros(parts.shape[:2], np.uint8)
        along = np.zeros(parts.shape[:2])  # x_m . r_m of the chosen word
        options = [self._options(parts, toward, m) for m in range(parts.shape[1])]
        for m, (error, dot) in enumerate(options):
            codes[:, m] = error.argmin(1)
            along[:, m] = np.take_along_axis(dot, codes[:, m : m + 1].astype(int), 1)[:, 0]
        for _ in range(sweeps):
            total = along.sum(1)
            for m, (error, dot) in enumerate(options):
                others = total - along[:, m]
                best = (error + weight[:, None] * (others[:, None] + dot) ** 2).argmin(1)
                codes[:, m] = best
                along[:, m] = dot[np.arange(len(dot)), best]
                total = others + along[:, m]
        return codes

    def _options(self, parts: np.ndarray, toward: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        r = parts[:, m, None, :] - self.words[m]
        return (r**2).sum(2), (r * toward[:, m, None, :]).sum(2)

    def refine(self, goal: np.ndarray, codes: np.ndarray, x: np.ndarray | None = None) -> None:
        """Weighted least squares for the words of each pair, the other pairs held fixed."""
        parts, toward = self.split(goal), self.split(goal if x is None else x)
        weight = (self.eta - 1) / np.maximum((toward**2).sum((1, 2)), 1e-300)
        pair = np.arange(parts.shape[1])
        along = (toward * (parts - self.words[pair, codes])).sum(2)
        total = along.sum(1)
        for m in pair:
            p, t = parts[:, m], toward[:, m]
            wanted = total - along[:, m] + (t * p).sum(1)
            left = np.eye(PAIR) + weight[:, None, None] * t[:, :, None] * t[:, None, :]
            right = p + (weight * wanted)[:, None] * t
            for k in range(WORDS):
                own = codes[:, m] == k
                if own.sum() >= PAIR:
                    self.words[m, k] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
            along[:, m] = (t * (p - self.words[m, codes[:, m]])).sum(1)
            total = along.sum(1)

    def rest(self, goal: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the words of `codes` leave of `goal`."""
        return goal - self.words[np.arange(len(self.words)), codes].reshape(len(goal), -1)[:, : self.dim]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, ::2] << 4) | codes[:, 1::2]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """bytes x 256 table of what each code byte adds to the score."""
        q = self.split(query[None])[0]
        t = np.einsum("mkd,md->mk", self.words, q)
        return (t[::2, :, None] + t[1::2, None, :]).reshape(-1, WORDS * WORDS).astype(np.float32)

    def scan(self, packed: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Approximate scores; `packed` has one row per code byte."""
        total = np.zeros(packed.shape[1], np.float32)
        for table, column in zip(self.tables(query), packed, strict=True):
            total += table[column]
        return total


@dataclass
class Index:
    """Levels of code words, each for what the levels before it leave, and the slack of approximate scores."""

    levels: list[Quantiser]
    slack: float = 0.0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """n x bytes, level after level."""
        goal, out = x, []
        for q in self.levels:
            c = q.assign(goal, x)
            out.append(q.pack(c))
            goal = q.rest(goal, c)
        return np.concatenate(out, 1)

    def scan(self, packed: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Approximate scores; `packed` has one row per code byte."""
        each = np.split(packed, len(self.levels))
        return sum(q.scan(p, query) for q, p in zip(self.levels, each, strict=True))


def fit(x: np.ndarray, seed: int = 3, toward: np.ndarray | None = None) -> Quantiser:
    """One level for `x`, where error along `toward` (x itself, if not given) counts more."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    pairs = -(-dim // (2 * PAIR)) * 2
    t2 = THRESHOLD**2
    q = Quantiser(np.zeros((pairs, WORDS, PAIR)), dim, max(1.0, (dim - 1) * t2 / (1 - t2)))
    start = q.split(x[rng.choice(len(x), WORDS, replace=len(x) < WORDS)])
    q.words = start.transpose(1, 0, 2) + rng.normal(0, 1e-6, q.words.shape)
    for _ in range(ROUNDS):
        q.refine(x, q.assign(x, toward), toward)
    return q


def build(x: np.ndarray, k: int, seed: int = 3) -> Index:
    """Levels and slack from a sample; its own near vectors show how far behind the k-th a true one may fall."""
    index, goal = Index([]), x
    for _ in range(LEVELS):
        q = fit(goal, seed, x)
        index.levels.append(q)
        goal = q.rest(goal, q.assign(goal, x))
    packed = np.ascontiguousarray(index.codes(x).T)
    rng, behind, errors = np.random.default_rng(seed), [], []
    for i in rng.choice(len(x), min(256, len(x)), replace=False):
        exact, about = x @ x[i], index.scan(packed, x[i])
        top = np.argsort(-exact)[:k]
        errors.append(exact[top] - about[top])
        behind.append(np.sort(about)[-len(top)] - about[top])
    # more rows than the sample has push the k-th approximate score up by about one error
    index.slack = max(0.0, float(np.quantile(np.concatenate(behind), SLACK_QUANTILE))) + float(np.std(np.concatenate(errors)))
    return index


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Distinct ids with finite, non-zero vectors of the most frequent length, and that length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("v", lambda e: e != 0)
    )
    length = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = length[0]["d"] if length else 0
    return v.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def _encoder(index: Index):
    def run(batches):
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else None
            codes = [c.tobytes() for c in index.codes(x)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return run


def _table(rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def _scanner(index: Index, k: int, most: int):
    """Rows of a block near each query by their codes; a row without vec_id where they are more than `most`."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and queries.num_rows:
            ids = rows.column("vec_id").to_numpy()
            packed = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).T)
            for query_id, v in zip(queries.column("vec_id").to_numpy(), queries.column("v").to_numpy(), strict=True):
                about = index.scan(packed, np.asarray(v, np.float64))
                about[ids == query_id] = -np.inf
                floor = np.partition(about, -k)[-k] if len(about) > k else -np.inf
                near = np.flatnonzero((about >= floor - index.slack) & (ids != query_id))
                if len(near) > most:
                    found.append((np.full(1, query_id), np.full(1, -1), np.full(1, floor, np.float32), np.ones(1, bool)))
                else:
                    found.append((np.full(len(near), query_id), ids[near], about[near], np.zeros(len(near), bool)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [[], [], [], []]
        block = pa.array([key[0].as_py()] * len(columns[0]), pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.float32(), pa.bool_())
        names = ["i", "query_id", "vec_id", "about", "crowded"]
        return pa.table([block, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return run


def _searcher(k: int):
    """The k best rows of a block for each query, on the vectors themselves."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and queries.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), np.stack(rows.column("v").to_numpy()).astype(np.float64)
            for query_id, v in zip(queries.column("query_id").to_pylist(), queries.column("q").to_numpy(), strict=True):
                score = (x * np.asarray(v, np.float64)).sum(1)
                score[ids == query_id] = -np.inf
                floor = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                near = np.flatnonzero((score >= floor) & (ids != query_id))
                best = near[np.lexsort((ids[near], -score[near]))[:k]]
                found += [(query_id, i) for i in ids[best].tolist()]
        return _table(found, ["query_id", "vec_id"], (pa.int64(), pa.int64()))

    return run


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    most: int = MOST,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    Queries are the rows whose id is divisible by `every`; a query is no candidate of its own.
    Ties go to the smaller id. Rows with a null id take no part, nor do vectors that are null, zero,
    of another length than most, or hold a null or non-finite component. Of rows with one id the
    smallest vector counts. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    usable, dim = _usable(vectors, id_col, vector_col)
    rows = materialise(usable, "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("v").toPandas()["v"]
    index = build(np.stack(drawn.to_numpy()).astype(np.float64), k)
    asked = rows.where(F.col("vec_id") % every == 0)
    row_blocks, query_blocks = -(-n // block_rows), -(-max(asked.count(), 1) // block_queries)
    # of equal vectors only the k + 1 smallest ids can be among k nearest
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    spot = F.xxhash64("vec_id")
    block = F.pmod(spot, F.lit(row_blocks).cast("long"))
    first = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v")
    held = materialise(first, "candidates")
    codes = held.mapInArrow(_encoder(index), "vec_id long, code binary").select("vec_id", "code", block.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"))
    to = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("i"), F.pmod(spot, F.lit(query_blocks)).cast("int").alias("j"))
    pairs = codes.groupBy("i", "j").cogroup(to.groupBy("i", "j"))
    found = materialise(pairs.applyInArrow(_scanner(index, k, most), "i long, query_id long, vec_id long, about float, crowded boolean"), "near")

    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    crowded = found.where("crowded").select("query_id", "i")
    parts = crowded.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("parts"))
    dealt = crowded.join(parts, "i").join(queries, "query_id").select("query_id", "q", "i", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("j"))
    whole = held.withColumn("i", block).join(parts, "i").select("vec_id", "v", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    exact = whole.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInArrow(_searcher(k), "query_id long, vec_id long")

    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    kth = found.where("not crowded").withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query_id", F.col("about").alias("kth"))
    near = found.where("not crowded").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("about") >= F.col("kth") - float(index.slack)))
    near = near.select("query_id", "vec_id").unionByName(exact)
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    met = near.join(held, "vec_id").join(queries, "query_id").select("query_id", "vec_id", score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
