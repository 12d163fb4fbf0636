"""Evaluation of scored events: trade metrics, ranking statistics, calibration, equal-N comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY, clip, finite, ratio
from tidewater.operators.series import quantiles, running_sums, value_ordinal
from tidewater.sources.store import materialise

COST = 2 * (10 + 5) / 1e4  # fee and slippage per side, both ways


def count() -> Column:
    return F.count(F.lit(1))


def net(events: DataFrame, cost: float = COST) -> DataFrame:
    """Net return and win flag after the round-trip cost."""
    return events.withColumn("net", F.col("ret") - cost).withColumn("win", (F.col("net") > 0).cast("int"))


def scopes(spark, evaluated: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """Bridge from scopes to folds: each fold alone, all but the last, all."""
    rows = [(f"fold_{k}", k) for k in evaluated] + [("folds_2_4", k) for k in evaluated[:-1]] + [("folds_2_5", k) for k in evaluated]
    return F.broadcast(spark.createDataFrame(rows, "scope string, fold int"))


def threshold_statistics(events: DataFrame, score: str, thresholds: Sequence[float], keys: Sequence[str] = ("fold",), vertical: Column | None = None) -> DataFrame:
    """Trades at or above each threshold: number, win rate, mean and sum of net returns, and the share that ran out of time."""
    tau = F.explode(F.array(*map(F.lit, thresholds)))
    picked = events.withColumn("threshold", tau)
    taken = F.col(score) >= F.col("threshold")
    out = picked.groupBy(*keys, "threshold").agg(
        F.count_if(taken).alias("n"),
        F.avg(F.when(taken, F.col("win"))).alias("win_rate"),
        F.avg(F.when(taken, F.col("net"))).alias("mean_net"),
        F.sum(F.when(taken, F.col("net"))).alias("sum_net"),
        *([] if vertical is None else [F.avg(F.when(taken, vertical.cast("int"))).alias("vertical_rate")]),
    )
    return out


def best_thresholds(history: DataFrame, at_least: int = 30) -> DataFrame:
    """(fold, b) with the best threshold of summed statistics: the largest sum among those with enough trades.

    Sums within 1e-12 tie; ties go to the higher threshold, then to fewer trades.
    """
    order = F.struct(F.round("sum_net", 12).alias("s"), "threshold", (-F.col("n")).alias("k"))
    return history.where(F.col("n") >= at_least).groupBy("fold").agg(F.max(order).alias("b"))


def pick_thresholds(stats: DataFrame, folds: Sequence[int], at_least: int = 30, first: float = 0.55, abstain: float = 1.01) -> DataFrame:
    """Threshold per fold from the folds before it, see `best_thresholds`. The first fold takes `first`; a fold without an
    eligible threshold abstains."""
    wanted = stats.sparkSession.createDataFrame([(k,) for k in folds], "for_fold int")
    past = stats.join(wanted, F.col("fold") < F.col("for_fold")).groupBy(F.col("for_fold").alias("fold"), "threshold")
    best = best_thresholds(past.agg(F.sum("n").alias("n"), F.sum(F.coalesce("sum_net", F.lit(0.0))).alias("sum_net")), at_least)
    chosen = F.when(F.col("fold") == min(folds), first).otherwise(F.coalesce(F.col("b.threshold"), F.lit(abstain)))
    return wanted.withColumnRenamed("for_fold", "fold").join(best, "fold", "left").select("fold", chosen.alias("threshold"))


def trade_metrics(events: DataFrame, keys: Sequence[str], tail: float = 0.05) -> DataFrame:
    """Count, sum and mean net, win rate, drawdown of the additive equity, holding hours, expected shortfall."""
    e = events.withColumn("hold", (F.col("exit_us") - F.col("decision_us")) / 3.6e9)
    curve = running_sums(e, keys, ["decision_us", "symbol"], {"equity": "net"})
    peaks = peak_so_far(curve, keys)
    base = e.groupBy(*keys).agg(
        count().alias("n"), F.sum("net").alias("sum_net"), F.avg("net").alias("mean_net"), F.avg("win").alias("win_rate"),
        F.avg("hold").alias("mean_hold"), F.sum("hold").alias("sum_hold"),
    )
    down = peaks.groupBy(*keys).agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))
    middle = quantiles(e, keys, "hold", {"median_hold": 0.5})
    return base.join(down, list(keys)).join(middle, list(keys), "left").join(expected_shortfall(e, keys, tail), list(keys))


def peak_so_far(curve: DataFrame, keys: Sequence[str], value: str = "equity", span: int = 30 * DAY) -> DataFrame:
    """Running maximum in two passes: within a time bucket, and of the buckets before."""
    keys = list(keys)
    c = curve.withColumn("_b", F.floor(F.col("decision_us") / span))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = c.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).withColumn("_before", F.max("_m").over(before)).drop("_m")
    own = Window.partitionBy(*keys, "_b").orderBy("decision_us", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    return c.join(tops, [*keys, "_b"]).withColumn("peak", F.greatest(F.max(value).over(own), "_before")).drop("_b", "_before")


def expected_shortfall(events: DataFrame, keys: Sequence[str], tail: float = 0.05) -> DataFrame:
    """Mean of the ceil(tail * n) smallest net returns.

    Counts per distinct value and their two-pass running sums find the cut, so no group is sorted in one task.
    """
    keys = list(keys)
    size = events.groupBy(*keys).agg(F.greatest(F.ceil(count() * tail), F.lit(1)).alias("_k"))
    each = events.groupBy(*keys, "net").agg(count().alias("_c"))
    run = running_sums(each, keys, ["net"], {"_upto": "_c"}, by_value=True).join(size, keys)
    took = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_k") - (F.col("_upto") - F.col("_c"))))
    return run.groupBy(*keys).agg((F.sum(took * F.col("net")) / F.first("_k")).alias("expected_shortfall"))


def auc(events: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with a single class.

    Rows are first counted per distinct score; the running count of negatives is a two-pass
    prefix sum over score ranges.
    """
    keys = list(keys)
    each = events.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    run = running_sums(each, keys, ["_s"], {"upto": "q"}, by_value=True)
    area = F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2))
    both = F.sum("p") * F.sum("q")
    return run.groupBy(*keys).agg((area / F.when(both > 0, both)).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def weighted_auc(scored: DataFrame, score: str, label: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve of each key with row weights, ties counted half; NULL with a single class."""
    keys = list(keys)
    positive = F.col(label) == 1
    each = scored.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(F.when(positive, F.col(weight)).otherwise(0.0)).alias("p"), F.sum(F.when(positive, 0.0).otherwise(F.col(weight))).alias("q")
    )
    run = running_sums(each, keys, ["_s"], {"upto": "q"}, by_value=True)
    both = F.sum("p") * F.sum("q")
    return run.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2)) / F.when(both > 0, both)).alias("auc"))


def losses(events: DataFrame, score: str, label: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """Brier score and log loss, weighted and not; probabilities are clipped at 1e-15."""
    p, y, w = F.col(score), F.col(label), F.col(weight)
    q = clip(p, 1e-15, 1 - 1e-15)
    brier, log = (p - y) * (p - y), -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
    return events.groupBy(*keys).agg(
        F.avg(brier).alias("brier"), (F.sum(w * brier) / F.sum(w)).alias("weighted_brier"),
        F.avg(log).alias("log_loss"), (F.sum(w * log) / F.sum(w)).alias("weighted_log_loss"),
    )


def reliability(events: DataFrame, score: str, label: str, weight: str, keys: Sequence[str], bins: int = 10, span: int = 30 * DAY) -> DataFrame:
    """Equal-count bins by (score, time, symbol): mean score, observed rate, their weighted forms.

    Rows are summed up per distinct score, and a score whose ranks lie in one bin counts as a whole. Only scores that a
    border of bins cuts, fewer than `bins` a key, are summed up by `span` of time, and only spans that a border cuts row by row.
    """
    from tidewater.operators.labels import equal_parts

    keys = list(keys)
    w, s, y = F.col(weight), F.col(score), F.col(label)
    sums = {"n": count(), "_w": F.sum(w), "_s": F.sum(s), "_y": F.sum(y), "_ns": F.count(s), "_ny": F.count(y), "_ws": F.sum(w * s), "_wy": F.sum(w * y)}
    named = [v.alias(n) for n, v in sums.items()]
    size = events.groupBy(*keys).agg(count().alias("_size"))

    def binned(parts: DataFrame) -> DataFrame:
        """First and last bin of parts with `n` rows from rank `_from` on."""
        first, last = (equal_parts(r, F.col("_size"), bins) for r in (F.col("_from"), F.col("_from") + F.col("n") - 1))
        return parts.withColumns({"bin": first, "_last": last})

    each = events.groupBy(*keys, s.alias("_score")).agg(*named)
    run = running_sums(each, keys, ["_score"], {"_upto": "n"}, by_value=True).withColumn("_from", F.col("_upto") - F.col("n"))
    scores = materialise(binned(run.join(size, keys)), "scores")
    cut = scores.where("bin != _last").select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_score"), F.col("_from").alias("_base"), "_size")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), s.eqNullSafe(F.col("_score")))
    rows = events.join(cut, same).drop(*(f"_k_{k}" for k in keys)).withColumn("_span", F.floor(F.col("decision_us") / span))
    by = [*keys, "_score"]
    each = rows.groupBy(*by, "_span").agg(F.first("_base").alias("_base"), F.first("_size").alias("_size"), *named)
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    spans = materialise(binned(each.withColumn("_from", F.col("_base") + F.coalesce(F.sum("n").over(before), F.lit(0)))), "spans")
    cut = spans.where("bin != _last").select(*by, "_span", F.col("_from").alias("_first"))
    own = Window.partitionBy(*by, "_span").orderBy("decision_us", "symbol")
    near = rows.join(cut.select(*(F.col(c).alias(f"_j_{c}") for c in [*by, "_span"]), "_first"), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in [*by, "_span"])))
    single = near.withColumn("bin", equal_parts(F.col("_first") + F.row_number().over(own) - 1, F.col("_size"), bins)).groupBy(*keys, "bin").agg(*named)
    parts = [df.where("bin = _last").select(*keys, "bin", *sums) for df in (scores, spans)]
    total = {n: F.sum(n) for n in sums}
    mean = lambda x, k: total[x] / F.when(total[k] > 0, total[k])
    return reduce(DataFrame.unionByName, [*parts, single.select(*keys, "bin", *sums)]).groupBy(*keys, "bin").agg(
        total["n"].alias("n"), total["_w"].alias("weight"), mean("_s", "_ns").alias("mean_score"), mean("_y", "_ny").alias("rate"),
        (total["_ws"] / total["_w"]).alias("weighted_score"), (total["_wy"] / total["_w"]).alias("weighted_rate"),
    )


def calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap, wgap = F.abs(F.col("mean_score") - F.col("rate")), F.abs(F.col("weighted_score") - F.col("weighted_rate"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), (F.sum(F.col("weight") * wgap) / F.sum("weight")).alias("weighted_ece"))


def dispersion(events: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    s = F.col(score)
    return events.groupBy(*keys).agg(F.min(s).alias("lowest"), F.max(s).alias("highest"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), F.countDistinct(s).alias("distinct"))


def top_n(events: DataFrame, score: str, sizes: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """The n best events of each key by (score desc, time, symbol), n from `sizes`."""
    e = events.where(F.col(score).isNotNull()).withColumn("_at", -F.col(score))
    ranked = value_ordinal(e, keys, ["_at", "decision_us", "symbol"], "_rank")
    return ranked.join(sizes, list(keys)).where(F.col("_rank") < F.col("n")).drop("_at", "_rank", "n")


def equal_n(events: DataFrame, a: str, b: str, sizes: DataFrame) -> DataFrame:
    """Sum and win rate of the n best events by either score, per fold, with their overlap."""
    sides = {}
    for name, score in (("a", a), ("b", b)):
        sides[name] = top_n(events, score, sizes).select("fold", "event_id", "net", "win")
    both = sides["a"].join(sides["b"].select("event_id").withColumn("_b", F.lit(1)), "event_id", "left")
    left = both.groupBy("fold").agg(F.sum("net").alias("sum_a"), F.avg("win").alias("win_a"), F.count("_b").alias("overlap"), count().alias("n"))
    right = sides["b"].groupBy("fold").agg(F.sum("net").alias("sum_b"), F.avg("win").alias("win_b"))
    return left.join(right, "fold").withColumn("difference", F.col("sum_a") - F.col("sum_b"))


def overlap_regions(events: DataFrame, a: Column, b: Column, keys: Sequence[str]) -> DataFrame:
    """Counts and net of events taken by both rules, by the first only, by the second only."""
    region = F.when(a & b, "common").when(a, "a_only").when(b, "b_only")
    e = events.withColumn("region", region).where("region is not null")
    return e.groupBy(*keys, "region").agg(count().alias("n"), F.sum("net").alias("sum_net"), F.avg("net").alias("mean_net"))


def coverage(events: DataFrame, features: Sequence[str], matched: str) -> DataFrame:
    """Match rate and usable rates overall, by symbol, by fold and by both."""
    usable = reduce(lambda x, y: x & y, (F.col(f).isNotNull() for f in features))
    out = events.cube("symbol", "fold").agg(
        count().alias("rows"), F.avg(F.col(matched).cast("int")).alias("match_rate"),
        *(F.avg(F.col(f).isNotNull().cast("int")).alias(f"usable_{f}") for f in features), F.avg(usable.cast("int")).alias("all_usable"),
    )
    return out


def reconciliation(events: DataFrame, label: str) -> DataFrame:
    """2 x 2 table of label against win, over the cube of symbol and fold."""
    y = F.col(label)
    return events.cube("symbol", "fold").agg(*(F.count_if((y == i) & (F.col("win") == j)).alias(f"y{i}_win{j}") for i in (0, 1) for j in (0, 1)))


def class_weights(events: DataFrame, label: str, weight: str, keys: Sequence[str]) -> DataFrame:
    mass = [F.sum(F.when(F.col(label) == k, F.col(weight)).otherwise(0.0)) for k in (0, 1)]
    return events.groupBy(*keys).agg(mass[0].alias("negative_mass"), mass[1].alias("positive_mass"), ratio(mass[0], mass[1]).alias("scale_pos_weight"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties at their mean, from counts per distinct value summed up in two passes."""
    keys = list(keys)
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count().alias("_c"))
    ranks = running_sums(each, keys, [value], {"_upto": "_c"}, by_value=True)
    ranks = ranks.withColumn(name, F.col("_upto") - (F.col("_c") - 1) / 2).drop("_c", "_upto")
    return df.join(ranks, [*keys, value], "left")


def information_coefficients(df: DataFrame, features: Sequence[str], labels: Sequence[str], at_least: int = 10) -> DataFrame:
    """Pearson and Spearman correlation of every feature with every label over rows that have both."""
    long = df.select(
        F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.col(f).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for f in features for y in labels))).alias("p")
    ).select("p.*")
    long = long.where("x is not null and y is not null")
    keys = ["feature", "label"]
    ranked = average_ranks(average_ranks(long, keys, "x", "rx"), keys, "y", "ry")
    out = ranked.groupBy(*keys).agg(count().alias("n"), finite(F.corr("x", "y")).alias("pearson"), finite(F.corr("rx", "ry")).alias("spearman"))
    few = F.col("n") < at_least
    return out.select(*keys, "n", *(F.when(~few, F.col(c)).alias(c) for c in ("pearson", "spearman")), F.when(few, "insufficient").otherwise("ok").alias("status"))


def correlation_p_values(ic: DataFrame) -> DataFrame:
    """Adds p_pearson and p_spearman, two-sided, from Student's t with n - 2 degrees; the table has one row per feature and label."""
    from tidewater.operators.indicators import incomplete_beta

    def of(r: float | None, n: int) -> float | None:
        if r is None or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_pylist()
            out = batch
            for c in ("pearson", "spearman"):
                out = out.append_column(f"p_{c}", pa.array([of(r, k) for r, k in zip(batch.column(c).to_pylist(), n, strict=True)], pa.float64()))
            yield out

    return ic.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in ic.dtypes) + ", p_pearson double, p_spearman double")


def feature_verdicts(ic: DataFrame, rows: DataFrame) -> DataFrame:
    """skipped below 20 % coverage, insufficient below 50 rows, useful from 0.05 on, else weak.

    `rows` holds the number of rows of the table as `rows`.
    """
    best = ic.groupBy("feature").agg(F.max(F.abs("spearman")).alias("strength"), F.max("n").alias("n")).join(rows.select("rows"))
    verdict = F.when(F.col("n") / F.col("rows") < 0.2, "skipped").when(F.col("n") < 50, "insufficient").when(F.col("strength") >= 0.05, "useful").otherwise("weak")
    return best.withColumn("verdict", verdict).drop("rows")


def spark_hash(seed: int, ids: np.ndarray) -> np.ndarray:
    """xxhash64 of (int, bigint) as Spark's function of that name gives it, for many bigints at once."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in XX_PRIMES)
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    def settle(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        first = settle(turn((np.uint64(42) + p5 + np.uint64(4)) ^ (np.array([seed & 0xFFFFFFFF], np.uint64) * p1), 23) * p2 + p3)
        h = first + p5 + np.uint64(8)
        h = h ^ (turn(ids.view(np.uint64) * p2, 31) * p1)
        return settle(turn(h, 27) * p1 + p4).view(np.int64)


#: Fixed values of the hash function.
XX_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


class HashTable:
    """`spark_hash` of many seeds and ids, table by table, in arrays that stay in a core's cache.

    The turn of seed and id is the turn of each, so both are turned once. A table holds the hashes before their last
    step, which leaves the upper half as it is; `finished` takes that step.
    """

    SEEDS, IDS = 8, 4096

    def __init__(self, seeds: np.ndarray, ids: np.ndarray):
        p1, p2, p3, _, p5 = (np.uint64(p) for p in XX_PRIMES)
        turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
        with np.errstate(over="ignore"):
            h = turn((np.uint64(42) + p5 + np.uint64(4)) ^ ((seeds.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            self.seeds = turn((h ^ (h >> np.uint64(32))) + p5 + np.uint64(8), 27)
            self.ids = turn(turn(ids.view(np.uint64) * p2, 31) * p1, 27)
        self._h, self._t = (np.empty(self.SEEDS * self.IDS, np.uint64) for _ in range(2))

    def tables(self):
        """(first seed, first id, hashes of the seeds and ids from there on); a table is overwritten by the next."""
        p1, p2, p3, p4, _ = (np.uint64(p) for p in XX_PRIMES)
        for i in range(0, len(self.seeds), self.SEEDS):
            for j in range(0, len(self.ids), self.IDS):
                x, y = self.seeds[i : i + self.SEEDS, None], self.ids[None, j : j + self.IDS]
                h, t = (a[: x.size * y.size].reshape(x.size, y.size) for a in (self._h, self._t))
                np.bitwise_xor(x, y, out=h)
                np.add(np.multiply(h, p1, out=h), p4, out=h)
                np.multiply(np.bitwise_xor(h, np.right_shift(h, np.uint64(33), out=t), out=h), p2, out=h)
                np.multiply(np.bitwise_xor(h, np.right_shift(h, np.uint64(29), out=t), out=h), p3, out=h)
                yield i, j, h.view(np.int64)

    @staticmethod
    def finished(h: np.ndarray) -> np.ndarray:
        u = h.view(np.uint64)
        return (u ^ (u >> np.uint64(32))).view(np.int64)


CHUNK_EVENTS = 1 << 16
SEED_BLOCK = 500
SEED_PART = 50  # seeds of a row that a chunk hands on
WIDTH = 8.0  # deviations of the expected cut that candidates may lie apart


def placebo(events: DataFrame, cells: Sequence[str], sizes: DataFrame, seeds: int, chunk_events: int = CHUNK_EVENTS, width: float = WIDTH) -> DataFrame:
    """Number, summed net and summed holding hours of `seeds` random draws without replacement, per seed and fold.

    An event's place in a draw is the hash of (seed, event_id), an integer, and of each cell (fold, or fold and symbol)
    the n smallest are drawn. A cell is cut into chunks of about `chunk_events`, and a task hashes a chunk for a block of
    seeds, all of them where a cell has many chunks. A chunk gives, for each seed, the sums of what lies below `width`
    deviations under the expected cut, and the events within as many above it; the cut is found among those of all
    chunks. So seeds move a few numbers each, not events. A draw whose cut lies outside is drawn from all its events.
    """
    spark, cells = events.sparkSession, list(cells)
    hold = (F.col("exit_us") - F.col("decision_us")) / 3.6e9
    slim = events.select("fold", *(c for c in cells if c != "fold"), F.col("event_id").cast("long").alias("event_id"), "net", hold.alias("_hold"))
    slim = slim.join(sizes.select(*cells, F.col("n").cast("long").alias("_n")).where("n > 0"), cells)
    pool = slim.groupBy(*cells).agg(count().alias("_pool"))
    dealt = slim.join(pool, cells).withColumn("_chunks", F.ceil(F.col("_pool") / chunk_events))
    # about as many tasks a cell as there are blocks of seeds or chunks, whichever are more
    per = F.lit(SEED_BLOCK) * F.least(F.col("_chunks"), F.lit(-(-seeds // SEED_BLOCK)))
    dealt = dealt.withColumn("_per", per).withColumns({"_chunk": F.pmod(F.xxhash64("event_id", F.lit(1)), F.col("_chunks")), "_block": F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(seeds - 1) / F.col("_per"))))})
    names = [*dict.fromkeys(["fold", *cells])]
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    head = ", ".join(f"{c} {kinds[c]}" for c in names)

    def same(table: pa.Table, rows: int) -> dict:
        return {c: pa.array([table.column(c)[0].as_py()] * rows, table.schema.field(c).type) for c in names}

    def draw(table: pa.Table) -> pa.Table:
        ids, net_, held = (table.column(c).to_numpy() for c in ("event_id", "net", "_hold"))
        order = np.lexsort((held, net_, ids))
        ids, net_, held = ids[order], net_[order], held[order]
        want, size, block, per = (table.column(c)[0].as_py() for c in ("_n", "_pool", "_block", "_per"))
        share = min(want / size, 1.0)
        slack = width * (share * (1 - share) / size) ** 0.5 + 2 / size
        # bounds with an empty lower half, so that the last step of the hash changes no comparison
        lo, hi = (int(min(max((share + k * slack) * 2.0**32 - 2.0**31, -(2.0**31)), 2.0**31 - 1)) << 32 for k in (-1, 1))
        lo, hi = (np.int64(lo), np.int64(max(hi, lo))) if share < 1 else (np.int64(2**63 - 1), np.int64(2**63 - 1))
        own = np.arange(block * per, min((block + 1) * per, seeds))
        below, sums, near = np.zeros(len(own), np.int64), np.zeros((2, len(own))), [[] for _ in own]
        hashed = HashTable(own, ids)
        flags, other = (np.empty(HashTable.SEEDS * HashTable.IDS, bool) for _ in range(2))
        ones = np.empty(HashTable.SEEDS * HashTable.IDS)
        for i, j, h in hashed.tables():
            (n, m), k = h.shape, h.size
            under, about, one = (a[:k].reshape(n, m) for a in (flags, other, ones))
            np.less(h, lo, out=under)
            np.less(h, hi, out=about)
            np.not_equal(about, under, out=about)
            np.copyto(one, under)
            below[i : i + n] += one.sum(axis=1).astype(np.int64)
            sums[0, i : i + n] += np.vecdot(one, net_[j : j + m])  # unlike a matrix product, one thread
            sums[1, i : i + n] += np.vecdot(one, held[j : j + m])
            at = np.flatnonzero(about)
            if len(at):
                found = HashTable.finished(h.ravel()[at])
                ends = np.searchsorted(at, np.arange(n + 1) * m)
                at = at % m + j
                for s in range(n):
                    if ends[s] < ends[s + 1]:
                        near[i + s].append((found[ends[s] : ends[s + 1]], at[ends[s] : ends[s + 1]]))
        rows = []
        for s in range(0, len(own), SEED_PART):
            part = near[s : s + SEED_PART]
            h, at = (np.concatenate([x[k] for p in part for x in p] or [np.zeros(0, np.int64)]) for k in (0, 1))
            count_ = np.array([sum(len(x[0]) for x in p) for p in part], np.int32)
            rows.append((int(own[s]), below[s : s + SEED_PART].tobytes(), sums[:, s : s + SEED_PART].tobytes(), count_.tobytes(), h.tobytes(), net_[at].tobytes(), held[at].tobytes()))
        found = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)]
        return pa.table({**same(table, len(rows)), **dict(zip(("first", "below", "sums", "sizes", "h", "net", "hold"), found, strict=True)), "want": pa.array([min(want, size)] * len(rows), pa.int64())})

    def settle(table: pa.Table) -> pa.Table:
        first, want = table.column("first")[0].as_py(), table.column("want")[0].as_py()
        read = {c: [np.frombuffer(b, t) for b in table.column(c).to_pylist()] for c, t in (("below", np.int64), ("sums", np.float64), ("sizes", np.int32), ("h", np.int64), ("net", np.float64), ("hold", np.float64))}
        below, sums = sum(read["below"]), sum(read["sums"]).reshape(2, -1)
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in read["sizes"]]
        rows = []
        for s, under in enumerate(below.tolist()):
            more = want - under
            h, net_, held = (np.concatenate([x[e[s] : e[s + 1]] for x, e in zip(read[c], ends, strict=True)]) for c in ("h", "net", "hold"))
            if not 0 <= more <= len(h):
                rows.append((first + s, want, None, None))
                continue
            took = np.argsort(h, kind="stable")[:more]
            rows.append((first + s, want, float(sums[0, s] + net_[took].sum()), float(sums[1, s] + held[took].sum())))
        found = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.table({**same(table, len(rows)), **dict(zip(("seed", "n", "net", "hold"), found, strict=True))})

    # a fixed number of tasks: few bytes are much work here, so they must not be put together by size
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, *cells, "_chunk", "_block")
    parts = dealt.groupBy(*cells, "_chunk", "_block").applyInArrow(draw, f"{head}, first int, below binary, sums binary, sizes binary, h binary, net binary, hold binary, want long")
    by = ["seed", *names]
    draws = materialise(parts.groupBy(*names, "first").applyInArrow(settle, f"{head}, seed int, n long, net double, hold double"), "draws")
    done = draws.where("net is not null")
    rest = slim.join(draws.where("net is null").select(*by), names).withColumn("_h", F.xxhash64("seed", "event_id"))
    order = Window.partitionBy(*by).orderBy("_h", "event_id")
    rest = rest.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n"))
    rows = done.select(*by, "n", "net", "hold").unionByName(rest.groupBy(*by).agg(count().alias("n"), F.sum("net").alias("net"), F.sum("_hold").alias("hold")))
    return rows.groupBy("seed", "fold").agg(F.sum("n").alias("n"), F.sum("net").alias("sum_net"), F.sum("hold").alias("sum_hold"))


def exposure(draws: DataFrame, value: str, at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Linear percentiles of a value over draws, one row."""
    return draws.agg(*(F.percentile(value, q).alias(f"p{round(q * 100)}") for q in at))


def mid_rank(draws: DataFrame, value: str, observed: float) -> DataFrame:
    """Percentile mid-rank of an observed value among draws, and its Monte-Carlo p-value."""
    less, equal = F.count_if(F.col(value) < observed), F.count_if(F.col(value) == observed)
    above = F.count_if(F.col(value) >= observed)
    return draws.agg(((less + 0.5 * equal) / count() * 100).alias("percentile"), ((1 + above) / (count() + 1)).alias("p_value"))


def catalog(spark, axes: dict[str, Sequence], prefix: str = "cfg_") -> DataFrame:
    """Cross product of small parameter axes with ids in the order of the axes."""
    out = spark.range(1, numPartitions=1).drop("id")
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    place = F.lit(0)
    for name, values in axes.items():
        place = place * len(values) + F.col(f"_{name}")
    return out.withColumn("config_id", F.concat(F.lit(prefix), F.lpad(place.cast("string"), 3, "0"))).drop(*(f"_{n}" for n in axes))


def block_matrix(values: DataFrame, rows: str, column: str, columns: Sequence, value: Column) -> DataFrame:
    """Pivot with a fixed column list; absent cells are NULL."""
    return values.groupBy(rows).pivot(column, list(columns)).agg(value)


def anchors(events: DataFrame, label: str, weight: str, folds: Sequence[int]) -> DataFrame:
    """(metric, value) of the evaluated population: rows in all and per fold, base rate plain and weighted, missing labels, bad weights."""
    e = events.where(F.col("fold").isin(list(folds)))
    w = finite(F.col(weight).cast("double"))
    known = F.col(label).isNotNull()
    whole = {
        "rows": count(), "base_rate": F.avg(label), "weighted_base_rate": F.sum(F.col(label) * w) / F.sum(F.when(known, w)),
        "missing_labels": F.count_if(~known), "bad_weights": F.count_if(w.isNull()), **{f"rows_fold_{k}": F.count_if(F.col("fold") == k) for k in folds},
    }
    return e.agg(*(v.cast("double").alias(n) for n, v in whole.items())).unpivot([], list(whole), "metric", "value")


def expectation_gaps(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected metrics (metric, value) with tolerances; missing ones fail."""
    e = expected.select("metric", F.col("value").alias("expected"), "tolerance")
    o = observed.select("metric", F.col("value").alias("observed"))
    both = e.join(o, "metric", "full")
    gap = F.abs(F.col("observed") - F.col("expected"))
    return both.withColumn("gap", gap).withColumn("ok", F.coalesce(gap <= F.col("tolerance"), F.lit(False)))
