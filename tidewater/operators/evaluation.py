"""Walk-forward evaluation of scores: arms, calibration choice, threshold replay, gates, pools, winners.

Everything here is joins and grouped sums over scored events; per-fold and per-configuration tables
are small results of those, never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR, finite, ratio
from tidewater.operators.metrics import auc, best_thresholds, calibration_error, count, losses, reliability, threshold_statistics, top_n
from tidewater.operators.series import quantiles

ABSTAIN, FIRST = 1.01, 0.55


def history_statistics(events: DataFrame, score: str, thresholds: Sequence[float], folds: Sequence[int]) -> DataFrame:
    """Per evaluated fold and threshold, trades and summed net of all evaluated folds before it."""
    spark = events.sparkSession
    each = threshold_statistics(events.where(F.col("fold").isin(list(folds))), score, thresholds)
    wanted = spark.createDataFrame([(k, j) for k in folds for j in folds if j < k], "for_fold int, fold int")
    past = each.join(wanted, "fold").groupBy(F.col("for_fold").alias("fold"), "threshold")
    return past.agg(F.sum("n").alias("n"), F.sum(F.coalesce("sum_net", F.lit(0.0))).alias("sum_net"))


def chosen_thresholds(history: DataFrame, folds: Sequence[int], forced: bool = False, at_least: int = 30) -> DataFrame:
    """(fold, threshold, reason) by the largest summed net of the history.

    The first fold takes FIRST, others see `best_thresholds`. Without `forced`, abstaining stands against the thresholds with a sum of 0; with it, a
    fold without an eligible threshold takes FIRST.
    """
    spark = history.sparkSession
    wanted = spark.createDataFrame([(k,) for k in folds], "fold int")
    rows = wanted.join(best_thresholds(history, at_least), "fold", "left")
    first = F.col("fold") == min(folds)
    if forced:
        tau = F.when(first, FIRST).otherwise(F.coalesce(F.col("b.threshold"), F.lit(FIRST)))
        reason = F.when(first, "first_fold").when(F.col("b").isNull(), "forced_fallback").otherwise("best_eligible")
    else:
        positive = F.col("b.s") > 0
        tau = F.when(first, FIRST).when(positive, F.col("b.threshold")).otherwise(ABSTAIN)
        reason = F.when(first, "first_fold").when(F.col("b").isNull(), "none_eligible").when(positive, "best_eligible").otherwise("abstain")
    return rows.select("fold", tau.alias("threshold"), reason.alias("reason"))


def arms(events: DataFrame, folds: Sequence[int], meta_taus: Sequence[float], base_taus: Sequence[float]) -> DataFrame:
    """Evaluated events with a flag per arm: meta and baseline, both forced, and meta matched to the baseline's number.

    The reference of the match is the baseline, or the forced baseline in folds where the baseline
    abstains; the match takes as many events of the fold by p_meta.
    """
    evaluated = events.where(F.col("fold").isin(list(folds)))
    for name, score, taus in (("meta", "p_meta", meta_taus), ("baseline", "p_primary", base_taus)):
        past = history_statistics(events, score, taus, folds)
        for forced in (False, True):
            suffix = name + ("_forced" if forced else "")
            tau = chosen_thresholds(past, folds, forced).select("fold", F.col("threshold").alias(f"tau_{suffix}"))
            evaluated = evaluated.join(tau, "fold").withColumn(f"traded_{suffix}", F.col(score) >= F.col(f"tau_{suffix}"))
    reference = F.when(F.col("tau_baseline") >= ABSTAIN - 1e-12, F.col("traded_baseline_forced")).otherwise(F.col("traded_baseline"))
    evaluated = evaluated.withColumn("traded_reference", reference)
    sizes = evaluated.groupBy("fold").agg(F.count_if("traded_reference").alias("n"))
    matched = top_n(evaluated, "p_meta", sizes).select("event_id", F.lit(True).alias("traded_matched"))
    return evaluated.join(matched, "event_id", "left").withColumn("traded_matched", F.coalesce("traded_matched", F.lit(False)))


ARMS = ("meta", "baseline", "meta_forced", "baseline_forced", "matched", "reference")


def arm_report(flagged: DataFrame, scopes: DataFrame) -> DataFrame:
    """Trades, profit-taking rate, win rate, mean in basis points, summed net and effective number per arm and scope."""
    flags = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"traded_{a}").alias("taken")) for a in ARMS)))
    long = flagged.join(scopes, "fold").select("scope", "ret", "net", "win", "uniqueness", flags.alias("x")).where("x.taken")
    return long.groupBy("scope", F.col("x.arm").alias("arm")).agg(
        count().alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("pt_hit"), F.avg("win").alias("win_rate"),
        (F.avg("net") * 1e4).alias("mean_bps"), F.sum("net").alias("sum_net"), F.sum("uniqueness").alias("effective_n"),
    )


def entry_rate(events: DataFrame, taken: Column, scopes: DataFrame) -> DataFrame:
    """Share of the evaluated events of a scope that are traded."""
    return events.join(scopes, "fold").groupBy("scope").agg(count().alias("events"), F.count_if(taken).alias("trades"), F.avg(taken.cast("int")).alias("entry_rate"))


def calibration_table(events: DataFrame, versions: Sequence[str], label: str, weight: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """AUC, losses and calibration errors of several versions of a score, one row per key and version."""
    cols = [*keys, "decision_us", "symbol", label, weight]
    long = events.select(*cols, F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(v).alias("score")) for v in versions))).alias("x"))
    long = long.select(*cols, "x.version", "x.score").where("score is not null")
    by = [*keys, "version"]
    area = auc(long, "score", label, by).select(*by, "auc")
    return losses(long, "score", label, weight, by).join(area, by).join(calibration_error(reliability(long, "score", label, weight, by), by), by)


def auc_invariance(table: DataFrame, raw: str, versions: Mapping[str, str], keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Change of AUC of each version against the raw score; a monotone map of a single fold must not change it."""
    base = table.where(F.col("version") == raw).select(*keys, F.col("auc").alias("raw_auc"))
    rest = table.where(F.col("version").isin(list(versions))).join(base, list(keys))
    must = F.create_map(*(F.lit(x) for kv in versions.items() for x in kv))
    delta = F.col("auc") - F.col("raw_auc")
    kind = F.try_element_at(must, F.col("version"))
    return rest.select(*keys, "version", "raw_auc", "auc", delta.alias("delta"), F.when(kind == "monotone", F.coalesce(F.abs(delta) <= 1e-9, F.lit(True))).alias("passed"))


def chosen_method(briers: DataFrame, tie: float = 0.001, least_gain: float = 0.001) -> DataFrame:
    """Method per key from weighted Brier scores (identity, platt, isotonic): all within `tie` of the best are
    eligible, and platt comes before identity before isotonic. A gain over identity counts from above `least_gain`."""
    best = F.least("identity", "platt", "isotonic") + tie
    method = F.when(F.col("platt") <= best, "platt").when(F.col("identity") <= best, "identity").otherwise("isotonic")
    out = briers.withColumn("method", method)
    own = F.when(F.col("method") == "platt", F.col("platt")).when(F.col("method") == "isotonic", F.col("isotonic")).otherwise(F.col("identity"))
    return out.withColumn("gain", F.col("identity") - own).withColumn("demonstrated", F.col("gain") > least_gain)


def replayed(events: DataFrame, score: str, folds: Sequence[int], thresholds: Sequence[float], maps: DataFrame | None = None) -> DataFrame:
    """Threshold, trades and summed net per fold when history and fold are scored by the fold's own past-fitted map.

    `maps` has fold, slope and intercept of a logistic map fitted before the fold; without it, and in
    the first fold, the raw score counts.
    """
    spark = events.sparkSession
    pairs = spark.createDataFrame([(k, j) for k in folds for j in folds if j <= k], "for_fold int, fold int")
    rows = events.join(pairs, "fold").withColumn("now", F.col("fold") == F.col("for_fold"))
    value = F.col(score)
    if maps is not None:
        rows = rows.join(maps.select(F.col("fold").alias("for_fold"), "slope", "intercept"), "for_fold", "left")
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), value))
        mapped = 1 / (1 + F.exp(-(F.col("slope") * F.ln(p / (1 - p)) + F.col("intercept"))))
        value = F.when((F.col("for_fold") == min(folds)) | F.col("slope").isNull(), value).otherwise(mapped)
    rows = rows.select("for_fold", "now", "net", value.alias("_s"))
    past = rows.where("not now").select(F.col("for_fold").alias("fold"), "_s", "net", F.lit(0).alias("win"))
    past = threshold_statistics(past, "_s", thresholds).select("fold", "threshold", "n", F.coalesce("sum_net", F.lit(0.0)).alias("sum_net"))
    tau = chosen_thresholds(past, folds).select(F.col("fold").alias("for_fold"), "threshold", "reason")
    taken = F.col("_s") >= F.col("threshold")
    return rows.where("now").join(tau, "for_fold").groupBy(F.col("for_fold").alias("fold"), "threshold", "reason").agg(
        F.count_if(taken).alias("n"), F.coalesce(F.sum(F.when(taken, F.col("net"))), F.lit(0.0)).alias("sum_net")
    )


def additivity_gate(events: DataFrame, folds: Sequence[int], label: str, sizes: DataFrame) -> DataFrame:
    """Verdict over evaluated folds: does the second score add to the first by AUC and by equal numbers of trades?"""
    evaluated = events.where(F.col("fold").isin(list(folds))).withColumn("_all", F.lit(1))
    area = {s: auc(evaluated, s, label, ["_all"]).select("_all", F.col("auc").alias(f"auc_{s}")) for s in ("p_meta", "p_primary")}
    sums = {s: top_n(evaluated, s, sizes).groupBy("_all").agg(F.sum("net").alias(f"sum_{s}")) for s in ("p_meta", "p_primary")}
    one = reduce(lambda a, b: a.join(b, "_all"), [*area.values(), *sums.values()])
    better = [F.col(f"{m}_p_meta") > F.col(f"{m}_p_primary") for m in ("auc", "sum")]
    verdict = F.when(better[0] & better[1], "pass").when(~better[0] & ~better[1], "not_demonstrated").otherwise("mixed")
    return one.drop("_all").withColumn("verdict", verdict)


def displacement(events: DataFrame, a: str, b: str, sizes: DataFrame) -> DataFrame:
    """Overlap, displaced events and change of summed net per fold between the n best events of two scores."""
    x = top_n(events, a, sizes).select("fold", "event_id", F.col("net").alias("net_a"))
    y = top_n(events, b, sizes).select("fold", "event_id", F.col("net").alias("net_b"))
    both = x.join(y, ["fold", "event_id"], "full").groupBy("fold")
    sums = {s: F.coalesce(F.sum(f"net_{s}"), F.lit(0.0)) for s in "ab"}
    return both.agg(
        F.count("net_a").alias("n"), F.count_if(F.col("net_a").isNotNull() & F.col("net_b").isNotNull()).alias("overlap"),
        F.count_if(F.col("net_b").isNull()).alias("displaced"), (F.count_if(F.col("net_b").isNull() | F.col("net_a").isNull()) == 0).alias("identical"),
        sums["a"].alias("sum_a"), sums["b"].alias("sum_b"), (sums["b"] - sums["a"]).alias("change"),
    )


def scaled_log_loss(events: DataFrame, score: str, label: str, weight: str, scale: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Weighted log loss with the positive class weighted `scale_pos_weight` times more, clipped at 1e-15."""
    y, p = F.col(label), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    e = events.join(scale.select(*keys, "scale_pos_weight"), list(keys))
    w = F.col(weight) * F.when(y == 1, F.col("scale_pos_weight")).otherwise(1.0)
    return e.groupBy(*keys).agg((F.sum(w * -(y * F.ln(p) + (1 - y) * F.ln(1 - p))) / F.sum(w)).alias("scaled_log_loss"))


def expected_value_rule(events: DataFrame, score: str, folds: Sequence[int]) -> DataFrame:
    """Evaluated events with p * mean win + (1 - p) * mean loss, both means of strictly earlier folds; losses include 0."""
    spark = events.sparkSession
    spread = spark.createDataFrame([(k, j) for k in folds for j in range(1, k)], "for_fold int, fold int")
    sums = events.groupBy("fold").agg(*(F.sum(F.when(t, F.col("net"))).alias(f"s{i}") for i, t in enumerate((F.col("net") > 0, F.col("net") <= 0))), *(F.count_if(t).alias(f"n{i}") for i, t in enumerate((F.col("net") > 0, F.col("net") <= 0))))
    past = sums.join(spread, "fold").groupBy(F.col("for_fold").alias("fold")).agg(ratio(F.sum("s0"), F.sum("n0")).alias("mean_win"), ratio(F.sum("s1"), F.sum("n1")).alias("mean_loss"))
    value = F.col(score) * F.col("mean_win") + (1 - F.col(score)) * F.col("mean_loss")
    out = events.where(F.col("fold").isin(list(folds))).join(past, "fold")
    return out.withColumn("expected_value", value).withColumn("traded", F.coalesce(value > 0, F.lit(False)))


def pools(flagged: DataFrame, arm: str, reference: str) -> DataFrame:
    """Placebo pools of an arm: `universe` is every evaluated event, `primary_informed` those of the arm or the reference."""
    return flagged.withColumns({"pool_universe": F.lit(True), "pool_primary_informed": F.col(arm) | F.col(reference)})


def pool_contract(pooled: DataFrame, pool: str, arm: str, scores: Sequence[str]) -> DataFrame:
    """Per fold: size of pool and arm, arm rows outside the pool, pool rows without a score."""
    missing = reduce(lambda a, b: a | b, (F.col(s).isNull() for s in scores))
    out = pooled.groupBy("fold").agg(
        F.count_if(pool).alias("pool"), F.count_if(arm).alias("arm"), F.count_if(F.col(arm) & ~F.col(pool)).alias("outside"), F.count_if(F.col(pool) & missing).alias("unscored")
    )
    return out.withColumn("ok", (F.col("outside") == 0) & (F.col("unscored") == 0) & (F.col("arm") <= F.col("pool")))


def pool_composition(pooled: DataFrame, pool: str, unique: Column, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Size, mean and median net of a pool, and its mean without the events that only the arm takes."""
    inside = pooled.where(F.col(pool)).withColumn("_unique", unique)
    out = inside.groupBy(*keys).agg(
        count().alias("pool_size"), F.avg("net").alias("mean_net"), F.avg(F.when(~F.col("_unique"), F.col("net"))).alias("mean_without_unique"), F.count_if("_unique").alias("removed"),
    )
    return out.join(quantiles(inside, keys, "net", {"median_net": 0.5}), list(keys), "left")


def sampling_plan(pooled: DataFrame, pool: str, arm: str, cells: Sequence[str]) -> DataFrame:
    """Pool size and number to draw of each cell (a fold, or a fold and symbol); cells that cannot be drawn are marked."""
    plan = pooled.groupBy(*cells).agg(F.count_if(pool).alias("pool"), F.count_if(arm).alias("k")).where("k > 0")
    return plan.withColumn("feasible", F.col("k") <= F.col("pool"))


def winner(table: DataFrame, keys: Sequence[str], loss: str = "loss") -> DataFrame:
    """Configuration of the smallest loss per key; losses within 1e-12 tie and go to the simpler configuration.

    Simpler is: less depth, more L2, a lower rate, plain before bagged, unweighted before weighted.
    """
    order = F.struct(F.round(loss, 12).alias("a"), F.col("depth").alias("b"), (-F.col("l2")).alias("c"), F.col("rate").alias("d"), F.col("bag").alias("e"), F.col("w").alias("f"), F.col("config_id").alias("config_id"))
    return table.groupBy(*keys).agg(F.min(order).alias("x"), F.min(loss).alias("least_loss")).select(*keys, "x.config_id", "least_loss")


def importance_summary(importances: DataFrame, keep: float = 0.5) -> DataFrame:
    """Mean importance and mean of the average ranks of features over symbols; the top share by mean importance is kept.

    The table has one row per symbol and feature.
    """
    each = Window.partitionBy("symbol").orderBy(F.desc("importance"))
    ties = Window.partitionBy("symbol", "importance")
    ranked = importances.withColumn("_rank", F.rank().over(each) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    out = ranked.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.avg("_rank").alias("mean_rank"))
    total = out.agg(F.greatest(F.ceil(count() * keep), F.lit(1)).alias("_keep"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_importance"), "feature"))  # one row per feature
    return out.withColumn("place", place).join(total).withColumn("kept", F.col("place") <= F.col("_keep")).drop("_keep")


def feature_rows(events: DataFrame, features: Sequence[str], label: str, weight: str, ret: str) -> DataFrame:
    """Labelled rows with every feature, the weight and the return finite; y is 1 exactly for label 1."""
    clean = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in (*features, weight, ret)}
    rows = events.where(F.col(label).isNotNull()).withColumns(clean).withColumn("y", (F.col(label) == 1).cast("int"))
    return rows.withColumn("valid", reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in clean)))


ARM_CHANGES = {  # arm: (families taken away, columns added)
    "no_calendar": (("calendar",), ()), "no_micro": (("micro",), ()), "session": (("calendar",), ("session",)),
    "no_symbol": (("symbol",), ()), "no_regime": (("regime",), ()), "extended": ((), ("extra",)),
}


def arm_columns(arm: str, families: Mapping[str, Sequence[str]], extra: Sequence[str] = ()) -> list[str]:
    """Feature columns of an ablation arm: the base families without those taken away, plus what the arm adds."""
    away, added = ARM_CHANGES[arm]
    if unknown := set(away) - set(families):
        raise ValueError(f"no such feature family: {sorted(unknown)}")
    base = [c for family, columns in families.items() if family not in away for c in columns]
    new = [c for name in added for c in (extra if name == "extra" else [name])]
    if len(set(base + new)) != len(base + new):
        raise ValueError(f"arm {arm} has a column twice")
    return base + new


def project(frame: DataFrame, arm: str, families: Mapping[str, Sequence[str]], keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return frame.select(*keys, *arm_columns(arm, families, extra))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], least: int = 4 * HOUR, most: int = 96 * HOUR) -> DataFrame:
    """Left rows with their only right row, plus `violation`: unmatched, repeated, no_exit or exit_outside.

    A key may stand once on either side, and an exit lies between `least` and `most` after the decision.
    """
    keys = list(keys)
    twice = left.groupBy(*keys).count().unionByName(right.groupBy(*keys).count()).where("count > 1").select(*keys).distinct()
    once = right.join(twice, keys, "left_anti").withColumn("_matched", F.lit(True))
    out = left.join(once, keys, "left").join(twice.withColumn("_twice", F.lit(True)), keys, "left")
    wait = F.col("exit_us") - F.col("decision_us")
    violation = (
        F.when(F.col("_twice").isNotNull(), "repeated").when(F.col("_matched").isNull(), "unmatched")
        .when(F.col("exit_us").isNull(), "no_exit").when(~wait.between(least, most), "exit_outside")
    )
    return out.withColumn("violation", violation).drop("_matched", "_twice")


def attach_predictions(events: DataFrame, predictions: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Events with the prediction of their key; a key predicted more than once, or not at all, gives NULL and a mark."""
    keys = list(keys)
    each = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias(name))
    out = events.join(each, keys, "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").otherwise("ok")
    return out.withColumn("prediction", state).withColumn(name, F.when(F.col("_n") == 1, F.col(name))).drop("_n")


def members(rows: DataFrame, usable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands in the usable index, each once, whatever is repeated there.

    The index is cut to distinct keys first, so that few keys on many rows are not sorted with all their repeats.
    """
    return rows.join(usable.select(*keys).distinct(), list(keys), "left_semi")


def aligned(bars: DataFrame, micro: DataFrame, keys: Sequence[str], prefix: str = "m_") -> DataFrame:
    """Bars with the feature row of exactly their key, NULL where there is none; of repeated feature rows none counts."""
    values = [c for c in micro.columns if c not in keys]
    once = micro.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*values)).alias("_v")).where("_n = 1")
    out = bars.join(once, list(keys), "left")
    return out.select(*bars.columns, *(F.col(f"_v.{c}").alias(prefix + c) for c in values))


def set_sizes(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of intersection and of both differences of two sets of keys."""
    x, y = (df.select(*keys).distinct() for df in (a, b))
    parts = {"both": x.intersect(y), "left_only": x.exceptAll(y), "right_only": y.exceptAll(x)}
    rows = [df.agg(count().alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def signal_overlap(events: DataFrame, benchmark: str) -> DataFrame:
    """Share of the benchmark's events, and the times at which several symbols signal at once, per fold."""
    each = events.groupBy("fold", "decision_us").agg(count().alias("n"), F.count_if(F.col("symbol") == benchmark).alias("b"))
    return each.groupBy("fold").agg(
        F.sum("n").alias("events"), (F.sum("b") / F.sum("n")).alias("benchmark_share"), F.count_if(F.col("n") > 1).alias("shared_times"), F.max("n").alias("most_at_once"),
    )


def threshold_diagnostic(statistics: DataFrame) -> DataFrame:
    """Of the thresholds summed over folds, that of the largest net; the higher one on ties."""
    total = statistics.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum(F.coalesce("sum_net", F.lit(0.0))).alias("sum_net"))
    return total.agg(F.max(F.struct(F.round("sum_net", 12).alias("s"), "threshold", "n")).alias("b")).select("b.threshold", "b.n", F.col("b.s").alias("sum_net"))


def chained(events: DataFrame, score: str, folds: Sequence[int], thresholds: Sequence[float], maps: DataFrame) -> DataFrame:
    """Effective score, threshold and trade flag of every evaluated event under its fold's map, as `replayed` counts them."""
    tau = replayed(events, score, folds, thresholds, maps).select("fold", "threshold")
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score)))
    mapped = 1 / (1 + F.exp(-(F.col("slope") * F.ln(p / (1 - p)) + F.col("intercept"))))
    rows = events.where(F.col("fold").isin(list(folds))).join(maps, "fold", "left").join(tau, "fold")
    effective = F.when((F.col("fold") == min(folds)) | F.col("slope").isNull(), F.col(score)).otherwise(mapped)
    return rows.withColumn("effective", effective).withColumn("traded", F.col("effective") >= F.col("threshold")).drop("slope", "intercept")


def reconstruction_gaps(rows: DataFrame, replay: DataFrame) -> DataFrame:
    """Per fold, trades and net of flagged events against the replay's: numbers equal, sums within 1e-9."""
    own = rows.groupBy("fold").agg(F.count_if("traded").alias("_n"), F.coalesce(F.sum(F.when(F.col("traded"), F.col("net"))), F.lit(0.0)).alias("_s"))
    both = replay.join(own, "fold")
    return both.select("fold", "n", "sum_net", ((F.col("n") == F.col("_n")) & (F.abs(F.col("sum_net") - F.col("_s")) <= 1e-9)).alias("ok"))


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation; NULL where a side does not vary."""
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def imbalance_report(live: DataFrame, rebuilt: DataFrame, value: str, differences: bool = False, at: str = "open_us") -> DataFrame:
    """Agreement of a live and a rebuilt series per symbol, at common times; the last of repeated rows on either side.

    Pearson and Spearman correlation, median of live minus rebuilt, and a verdict: under 50 pairs insufficient_overlap, a
    constant side insufficient_variation, series known to differ by design (`differences`) reference_only, then by Pearson
    from 0.7 approved, from 0.4 caution, else rejected. Symbols without a common time have 0 pairs.
    """
    from tidewater.operators.metrics import average_ranks

    keys = ["symbol", at]
    sides = [df.where(finite(F.col(value)).isNotNull()).groupBy(*keys).agg(F.max_by(value, "seq").alias(n)) for df, n in ((live, "x"), (rebuilt, "y"))]
    pairs = sides[0].join(sides[1], keys).withColumn("_gap", F.col("x") - F.col("y"))
    ranked = average_ranks(average_ranks(pairs, ["symbol"], "x", "rx"), ["symbol"], "y", "ry")
    found = ranked.groupBy("symbol").agg(
        count().alias("n"), _correlation("x", "y").alias("pearson"), _correlation("rx", "ry").alias("spearman"), ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("_constant")
    )
    found = found.join(quantiles(pairs, ["symbol"], "_gap", {"median_bias": 0.5}), "symbol")
    out = live.select("symbol").distinct().join(found, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    varied = ~F.coalesce("_constant", F.lit(True))
    out = out.withColumns({c: F.when(varied, finite(F.col(c))) for c in ("pearson", "spearman")})
    verdict = (
        F.when(F.col("n") < 50, "insufficient_overlap").when(~varied, "insufficient_variation").when(F.lit(differences), "reference_only")
        .when(F.col("pearson").isNull(), "insufficient_variation").when(F.col("pearson") >= 0.7, "approved").when(F.col("pearson") >= 0.4, "caution").otherwise("rejected")
    )
    return out.withColumn("verdict", verdict).drop("_constant")
