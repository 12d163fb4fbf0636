"""Barrier labels, concurrency and uniqueness weights, purged and embargoed folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.operators.features import KEYS, ORDER
from tidewater.operators.series import SPAN, ordinal, rolling, running_sums


def triple_barrier(
    bars: DataFrame, vol: str, horizon: int = 12, up: float = 2.0, down: float = 2.0, both: str = "sl", min_return: float = 0.0
) -> DataFrame:
    """First touch of close * (1 +- mult * vol) by the highs and lows of the next `horizon` bars.

    Adds tb_label (1 profit, -1 stop, 0 neither), tb_event (pt, sl, vertical), tb_return (log) and
    tb_exit_us; a bar that touches both barriers counts as `both`. Bars without `horizon` bars after
    them, without volatility, or whose profit barrier is below `min_return` stay unlabelled.
    """

    def columns(w) -> dict[str, Column]:
        f = w.rowsBetween(1, horizon)
        bar = F.struct(F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("open_us").alias("t"))
        return {"_ahead": F.collect_list(bar).over(f)}

    v = F.greatest(F.col(vol), F.lit(1e-6))
    top, floor = F.col("close") * (1 + up * v), F.col("close") * (1 - down * v)
    out = rolling(bars, KEYS, ORDER, 0, columns, ahead=horizon).withColumns({"_top": top, "_floor": floor})
    hit = F.filter("_ahead", lambda b: (b.h >= F.col("_top")) | (b.l <= F.col("_floor")))
    out = out.withColumn("_hit", F.get(hit, F.lit(0))).withColumn("_end", F.get("_ahead", F.lit(horizon - 1)))
    over, under = F.col("_hit.h") >= F.col("_top"), F.col("_hit.l") <= F.col("_floor")
    event = (
        F.when(F.col("_hit").isNull(), "vertical").when(over & under, both).when(over, "pt").otherwise("sl")
    )
    labelled = (F.size("_ahead") == horizon) & F.col(vol).isNotNull() & (up * v >= min_return)
    out = out.withColumn("tb_event", F.when(labelled, event))
    exit_price = F.when(F.col("tb_event") == "pt", F.col("_top")).when(F.col("tb_event") == "sl", F.col("_floor")).otherwise(F.col("_end.c"))
    return out.withColumns(
        {
            "tb_label": F.when(F.col("tb_event") == "pt", 1).when(F.col("tb_event") == "sl", -1).when(F.col("tb_event") == "vertical", 0),
            "tb_return": F.when(F.col("tb_event").isNotNull(), F.ln(exit_price / F.col("close"))),
            "tb_exit_us": F.when(F.col("tb_event").isNotNull(), F.coalesce("_hit.t", "_end.t")),
        }
    ).drop("_ahead", "_top", "_floor", "_hit", "_end")


def uniqueness(labelled: DataFrame) -> DataFrame:
    """Mean of 1 / concurrency over (start, exit] of every labelled bar, from two prefix sums.

    Concurrency is a running sum of +1 after a start and -1 after an exit; no event is spread over
    the bars it spans.
    """
    bars = labelled.select("symbol", "open_us", "pos")
    ends = bars.select("symbol", F.col("open_us").alias("tb_exit_us"), F.col("pos").alias("exit_pos"))
    events = labelled.where("tb_event is not null").join(ends, ["symbol", "tb_exit_us"])
    steps = events.select("symbol", F.explode(F.array(F.struct((F.col("pos") + 1).alias("pos"), F.lit(1).alias("d")), F.struct((F.col("exit_pos") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    deltas = steps.groupBy("symbol", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    at = bars.join(deltas, ["symbol", "pos"], "left").fillna(0, ["d"])
    at = running_sums(at, ["symbol"], ["open_us"], {"concurrency": "d"})
    at = at.withColumn("_inv", F.when(F.col("concurrency") > 0, 1.0 / F.col("concurrency")).otherwise(0.0))
    at = running_sums(at, ["symbol"], ["open_us"], {"P": "_inv"}).select("symbol", "pos", "concurrency", "P")
    to = at.select("symbol", F.col("pos").alias("exit_pos"), F.col("P").alias("P1"))
    weight = (F.col("P1") - F.col("P")) / (F.col("exit_pos") - F.col("pos"))
    out = events.join(at, ["symbol", "pos"]).join(to, ["symbol", "exit_pos"])
    return out.withColumn("tb_uniqueness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))).drop("P", "P1")


def equal_parts(rank: Column, total: Column, parts: int) -> Column:
    """Part 0.. of the row with rank 0..total-1; the first total % parts parts have one row more."""
    size, more = F.floor(total / parts), total % parts
    cut = more * (size + 1)
    return F.when(rank < cut, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - cut) / F.when(size > 0, size)))


def purged_folds(events: DataFrame, folds: int = 5, embargo: int = 4) -> DataFrame:
    """(symbol, fold, role, pos) of expanding train and following test sets, per symbol.

    `events` has symbol, open_us, pos (bar ordinal) and exit_pos. Part k of folds + 1 equal parts tests
    fold k; events before it train it if they end before the bar `embargo` bars before its first one.
    """
    n = events.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    e = ordinal(events, ["symbol"], ["open_us"], "_rank").join(n, "symbol")
    e = e.withColumn("part", equal_parts(F.col("_rank"), F.col("_n"), folds + 1))
    tests = e.where("part >= 1").select("symbol", F.col("part").alias("fold"), F.lit("test").alias("role"), "pos")
    bounds = e.where("part >= 1").groupBy("symbol", F.col("part").alias("fold")).agg((F.min("pos") - embargo).alias("bound"))
    train = e.join(bounds, "symbol").where((F.col("part") < F.col("fold")) & (F.col("exit_pos") < F.col("bound")))
    return tests.unionByName(train.select("symbol", "fold", F.lit("train").alias("role"), "pos"))


def purged_training(events: DataFrame, after_exit: int = 4 * HOUR, embargo: int = 96 * HOUR) -> DataFrame:
    """Pooled events: per fold the earlier events that end an embargo before its first decision, and how many do not."""
    starts = events.groupBy("fold").agg(F.min("decision_us").alias("start"))
    early = events.select(F.col("fold").alias("own"), "exit_us").join(starts).where("own < fold")
    ok = F.col("exit_us") + after_exit < F.col("start") - embargo
    return early.groupBy("fold").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def last_share(events: DataFrame, share: float, keys: list[str] | None = None, up: bool = False, span: int = SPAN) -> DataFrame:
    """Marks the last share of the rows of each key by (decision_us, symbol) as validation. Keys are few: folds, symbols.

    Spans of time are counted, and only rows of the span in which a key's share begins are ranked.
    """
    keys = keys or ["fold"]
    at, n = F.floor(F.col("decision_us") / span), F.col("_n")
    each = events.groupBy(*keys, at.alias("_edge")).agg(F.count(F.lit(1)).alias("_n"))
    all_of = Window.partitionBy(*keys)  # a row a span
    upto = each.withColumns({"_upto": F.sum("_n").over(all_of.orderBy("_edge")), "_all": F.sum("_n").over(all_of)})
    begins = F.col("_all") - (F.ceil if up else F.floor)(F.col("_all") * share)
    cut = upto.withColumn("_skip", begins - (F.col("_upto") - n)).where((F.col("_skip") >= 0) & (F.col("_skip") < n)).select(*keys, "_edge", "_skip")
    marked = events.dropna(subset=[*keys, "decision_us"]).join(F.broadcast(cut), keys, "left")
    edge = F.coalesce(at == F.col("_edge"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("decision_us", "symbol"))
    inside = marked.where(edge).withColumn("validation", rank > F.col("_skip"))
    others = marked.where(~edge).withColumn("validation", F.coalesce(at > F.col("_edge"), F.col("_skip").isNotNull()))
    return others.unionByName(inside).drop("_edge", "_skip")


def selection_split(events: DataFrame, share: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """Adds `part`: the last share of each key validates, earlier events train if they end before it starts, the rest is purged."""
    keys = keys or ["fold"]
    e = last_share(events, share, keys, up=True)
    starts = e.where("validation").groupBy(*keys).agg(F.min("decision_us").alias("_start"))
    part = F.when(F.col("validation"), "validation").when(F.col("exit_us") < F.col("_start"), "train").otherwise("purged")
    return e.join(F.broadcast(starts), keys).withColumn("part", part).drop("_start", "validation")


def time_blocks(events: DataFrame, blocks: int = 4) -> DataFrame:
    """Blocks per fold that never split a time: block ends where 4 * running count >= b * total."""
    n = events.groupBy("fold", "decision_us").agg(F.count(F.lit(1)).alias("n"))
    total = events.groupBy("fold").agg(F.count(F.lit(1)).alias("_total"))
    run = running_sums(n, ["fold"], ["decision_us"], {"_run": "n"}).join(total, "fold")
    before = F.col("_run") - F.col("n")
    block = 1 + sum((blocks * before >= b * F.col("_total")).cast("int") for b in range(1, blocks))
    return run.select("fold", "decision_us", block.alias("block"), "n")


def concurrent_positions(events: DataFrame, keys: list[str], after_exit: int = 4 * HOUR) -> DataFrame:
    """Largest number of open positions per key; at equal times starts come before ends."""
    ends = F.struct((F.col("exit_us") + after_exit).alias("t"), F.lit(-1).alias("d"), F.lit(1).alias("late"))
    begins = F.struct(F.col("decision_us").alias("t"), F.lit(1).alias("d"), F.lit(0).alias("late"))
    steps = events.select(*keys, F.explode(F.array(begins, ends)).alias("x")).select(*keys, "x.*")
    steps = steps.groupBy(*keys, "t", "late").agg(F.sum("d").alias("d"))
    run = running_sums(steps, keys, ["t", "late"], {"open": "d"})
    return run.groupBy(*keys).agg(F.max("open").alias("most_open"))


def quarantine_violations(assignments: DataFrame, quarantined: int = 5) -> DataFrame:
    """Rows that break fold discipline: the last fold used for selection, or training on a later fold."""
    return assignments.agg(
        F.count_if((F.col("role") == "selection") & (F.col("fold") == quarantined)).alias("quarantined_used"),
        F.count_if((F.col("role") == "train") & (F.col("source_fold") >= F.col("fold"))).alias("not_earlier"),
    )


def swing_stops(bars: DataFrame, atr: str, n: int = 12) -> DataFrame:
    """Stop at the larger of swing low * 0.998 and entry - 2.5 ATR, target at 2 risks above."""
    w_cols = lambda w: {"_swing": F.min("low").over(w.rowsBetween(-n + 1, 0))}
    out = rolling(bars, KEYS, ORDER, n, w_cols)
    stop = F.greatest(F.col("_swing") * 0.998, F.col("close") - 2.5 * F.col(atr))
    return out.withColumn("stop", stop).withColumn("target", F.col("close") + 2 * (F.col("close") - F.col("stop"))).drop("_swing")


