"""Causal features of bars: scalars, rolling statistics, resampling, context joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR, clip, finite, ratio
from tidewater.operators.series import asof_join, islands, ordinal, quantiles, rolling

KEYS, ORDER = ["symbol"], ["open_us"]


def back(w: WindowSpec, n: int, until: int = 0) -> WindowSpec:
    """The last n rows up to `until` rows from the current one."""
    return w.rowsBetween(until - n + 1, until)


def full(x: Column, n: int, over: WindowSpec, value: Column, at_least: int | None = None) -> Column:
    """`value` where the frame holds enough non-null x; a null inside a window voids it."""
    return F.when(F.count(x).over(over) >= (n if at_least is None else at_least), value)


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    """Inclusive z-score with population deviation; NULL on flat or incomplete windows."""
    f = back(w, n)
    return full(x, n, f, ratio(x - F.avg(x).over(f), F.stddev_pop(x).over(f)))


def prior_zscore(x: Column, n: int, w: WindowSpec) -> Column:
    """z-score against the n rows before the current one."""
    f = back(w, n, -1)
    return full(x, n, f, ratio(x - F.avg(x).over(f), F.stddev_pop(x).over(f)))


def tail_zscore(x: Column, n: int, w: WindowSpec) -> Column:
    """z-score within the last rows, 0 where there are fewer than two or no deviation."""
    f = back(w, n)
    sd = F.stddev_pop(x).over(f)
    return F.when((F.count(x).over(f) >= 2) & (sd > 1e-12), (x - F.avg(x).over(f)) / sd).otherwise(0.0)


def base_features(bars: DataFrame) -> DataFrame:
    """Returns, range, volume change, taker share, calendar; one pass, looking one row back."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        c, v = F.col("close"), F.col("volume")
        c1, v1 = F.lag("close").over(w), F.lag("volume").over(w)
        taker = F.when(v > 0, clip(F.col("taker_buy") / F.when(v > 0, v), 0, 1)).otherwise(0.5)
        seconds = F.floor(F.col("open_us") / 1_000_000)
        return {
            "pct_return": ratio(c, c1) - 1,
            "log_return": F.ln(ratio(c, c1)),
            "log_range": F.ln(ratio(F.col("high"), F.col("low"))),
            "volume_change": F.when((v > 0) & (v1 > 0), F.ln(v / v1)),
            "taker_ratio": taker,
            "flow_imbalance": 2 * taker - 1,
            "hour": F.pmod(F.floor(seconds / 3600), F.lit(24)),
            "weekday": F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)),
        }

    return rolling(bars, KEYS, ORDER, 1, columns)


def trends(bars: DataFrame, steps: tuple[int, ...] = (1, 7, 12, 24)) -> DataFrame:
    def columns(w: WindowSpec) -> dict[str, Column]:
        return {f"trend_{k}": F.ln(ratio(F.col("close"), F.lag("close", k).over(w))) for k in steps}

    return rolling(bars, KEYS, ORDER, max(steps), columns)


def rolling_statistics(bars: DataFrame) -> DataFrame:
    """Inclusive, prior and tail z-scores, deviations and lag-1 autocorrelation of returns."""
    x = F.col("log_return")

    def columns(w: WindowSpec) -> dict[str, Column]:
        f20, f24 = back(w, 20), back(w, 24)
        return {
            "volume_z20": zscore(F.col("volume"), 20, w),
            "volume_z50": zscore(F.col("volume"), 50, w),
            "prior_z50": prior_zscore(F.col("volume"), 50, w),
            "tail_z20": tail_zscore(F.col("volume"), 20, w),
            "std_pop20": full(x, 20, f20, F.stddev_pop(x).over(f20)),
            "std_samp24": full(x, 24, f24, F.stddev_samp(x).over(f24)),
            "autocorr24": full(x, 24, f24, finite(F.corr(x, F.lit(0.0) + F.col("previous")).over(back(w, 23)))),
            "mean8": full(x, 8, back(w, 8), F.avg(x).over(back(w, 8)), 3),
        }

    lagged = rolling(base_features(bars), KEYS, ORDER, 1, lambda w: {"previous": F.lag("log_return").over(w)})
    return rolling(lagged, KEYS, ORDER, 55, columns)


def distances(bars: DataFrame, n: int = 168) -> DataFrame:
    """Log distance of the close from the highest and lowest close of the last n bars."""
    c = F.col("close")

    def columns(w: WindowSpec) -> dict[str, Column]:
        f = back(w, n)
        return {
            "from_high": F.ln(c / F.max(c).over(f)),
            "from_low": F.ln(c / F.min(c).over(f)),
            "swing_low": F.min("low").over(back(w, 12)),
            "swing_high": F.max("high").over(back(w, 12)),
        }

    return rolling(bars, KEYS, ORDER, n, columns)


def ewm_std(bars: DataFrame, x: str, span: int, name: str = "ewm_std") -> DataFrame:
    """Exponentially weighted deviation, recursive weights, bias-corrected, first `span` values needed.

    Weights of age k are a(1-a)^k and (1-a)^age for the first value of the series; they decay over
    missing values by row distance. A series is cut into blocks; within one, weighted sums are running
    sums of values scaled up by (1-a)^-k, and a block hands on the sums at its end. Blocks are as long as
    doubles allow, so that what lies before the last block with values weighs 1e-140 of it and adds nothing.
    """
    a = 2 / (span + 1)
    d = 1 - a
    length = int(140 / -math.log10(d)) if d > 0 else 1
    placed = ordinal(bars, KEYS, ORDER, "pos")
    firsts = placed.where(F.col(x).isNotNull()).groupBy(*KEYS).agg(F.min("pos").alias("_first"))
    dealt = placed.join(firsts, KEYS, "left").withColumns({"_block": F.floor(F.col("pos") / length), "_k": F.col("pos") % length})
    value = F.col(x).cast("double")
    share = F.when(value.isNull(), 0.0).when(F.col("pos") == F.col("_first"), 1.0).otherwise(a) * F.pow(F.lit(1 / d), F.col("_k"))
    terms = {"_w": share, "_w2": share * share, "_wx": share * F.coalesce(value, F.lit(0.0)), "_wxx": share * F.coalesce(value * value, F.lit(0.0))}
    power = {"_w": 1, "_w2": 2, "_wx": 1, "_wxx": 1}
    within = Window.partitionBy(*KEYS, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    down = F.pow(F.lit(d), F.col("_k"))
    here = dealt.withColumns({**{n: F.sum(t).over(within) * F.pow(down, F.lit(power[n])) for n, t in terms.items()}, "_n": F.count(x).over(within)})
    ends = dealt.groupBy(*KEYS, "_block").agg(*(F.sum(t).alias(n) for n, t in terms.items()), F.count(x).alias("_n"), F.max("_k").alias("_last"))
    before = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    fall = F.pow(F.lit(d), F.col("_last"))
    end = F.struct((F.col("_block") * length + F.col("_last")).alias("at"), *((F.col(n) * F.pow(fall, F.lit(power[n]))).alias(n) for n in terms))
    carried = ends.select(*KEYS, "_block", F.last(F.when(F.col("_n") > 0, end), True).over(before).alias("_end"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seen"))
    both = here.join(carried, [*KEYS, "_block"])
    decay = F.pow(F.lit(d), F.col("pos") - F.col("_end.at"))
    total = {n: F.col(n) + F.coalesce(F.col(f"_end.{n}") * F.pow(decay, F.lit(power[n])), F.lit(0.0)) for n in terms}
    out = both.withColumns(total)
    w, w2 = F.when(F.col("_w") > 0, F.col("_w")), F.col("_w2")
    mean = F.col("_wx") / w
    fix = w * w / F.when(w * w > w2, w * w - w2)
    deviation = F.sqrt(F.greatest((F.col("_wxx") / w - mean * mean) * fix, F.lit(0.0)))
    out = out.withColumn(name, F.when(F.col("_seen") + F.col("_n") >= span, deviation))
    return out.drop("_block", "_k", "_first", "_end", "_seen", "_n", *terms)


def forward_labels(bars: DataFrame, horizon: int = 5, quantile: float = 0.9) -> DataFrame:
    """Forward return, its size, and a jump label against the quantile of the sizes known before."""
    n, least = max(50, 10 * horizon), max(20, 5 * horizon)

    def forward(w: WindowSpec) -> dict[str, Column]:
        return {"fwd_return": F.ln(ratio(F.lead("close", horizon).over(w), F.col("close")))}

    def label(w: WindowSpec) -> dict[str, Column]:
        f = back(w, n, -1)
        own = F.when(F.count("fwd_abs").over(f) >= least, F.percentile("fwd_abs", quantile).over(f))
        return {"_threshold": own}

    ahead = rolling(bars, KEYS, ORDER, 0, forward, ahead=horizon).withColumn("fwd_abs", F.abs("fwd_return"))
    overall = quantiles(ahead, ["symbol"], "fwd_abs", {"_overall": quantile})
    out = rolling(ahead, KEYS, ORDER, n + 1, label).join(overall, "symbol", "left")
    threshold = F.coalesce("_threshold", "_overall")
    return out.withColumn("jump", F.when(F.col("fwd_abs").isNotNull(), (F.col("fwd_abs") >= threshold).cast("int"))).drop("_threshold", "_overall")


def resample(bars: DataFrame, span: int = 4 * HOUR) -> DataFrame:
    """Bars of a longer span, left-closed and left-labelled from the epoch; empty spans are absent."""
    at = F.floor(F.col("open_us") / span) * span
    return bars.groupBy("symbol", at.alias("open_us")).agg(
        F.min_by("open", bars.open_us).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", bars.open_us).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("taker_buy").alias("taker_buy"),
        F.sum("trades").alias("trades"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def multi_timeframe(bars: DataFrame, span: int = 24 * HOUR, step: int = HOUR) -> DataFrame:
    """Each bar with the last bar of the longer span that has closed when the bar closes."""
    higher = resample(bars, span).select("symbol", (F.col("open_us") + span).alias("close_us"), "close", "volume")
    rows = bars.withColumn("row_close_us", F.col("open_us") + step)
    return asof_join(rows, higher, KEYS, "row_close_us", "close_us", prefix="d_")


def relative_strength(bars: DataFrame, benchmark: str, steps: int = 12) -> DataFrame:
    """Trend of each bar against the benchmark symbol's trend at the same time."""
    t = trends(bars, (steps,))
    b = t.where(F.col("symbol") == benchmark).select("open_us", F.col(f"trend_{steps}").alias("benchmark_trend"))
    return t.join(b, "open_us", "left").withColumn("relative", F.col(f"trend_{steps}") - F.col("benchmark_trend"))


def return_correlations(bars: DataFrame, at_least: int = 100) -> DataFrame:
    """Pearson correlation of returns of symbol pairs at common times; NULL below `at_least` pairs."""
    r = base_features(bars).where("pct_return is not null").select("open_us", "symbol", "pct_return")
    a, b = (r.select("open_us", F.col("symbol").alias(s), F.col("pct_return").alias(f"r_{s}")) for s in ("a", "b"))
    pairs = a.join(b, "open_us").where("a < b").groupBy("a", "b")
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.corr("r_a", "r_b").alias("c"))
    return out.select("a", "b", "n", F.when(F.col("n") >= at_least, finite(F.col("c"))).alias("correlation"))


def momentum(bars: DataFrame, steps: int = 24) -> DataFrame:
    """BUY or HOLD per symbol from the log momentum of its closed bars; the last bar is still open."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {"past": F.lag("close", steps).over(w), "newer": F.lead("pos", 1).over(w), "last": F.lead("pos", 2).over(w)}

    placed = rolling(bars, KEYS, ORDER, steps, columns, ahead=2)
    closed = placed.where("newer is not null and last is null")
    buy = (F.col("past") > 0) & (F.col("close") > 0) & (F.ln(F.col("close") / F.col("past")) > 0)
    vote = F.when(buy, "BUY").otherwise("HOLD")
    return closed.select("symbol", "open_us", vote.alias("vote"), F.when(buy, 68).otherwise(60).alias("confidence"))


def session_of(hour: Column) -> Column:
    """Session of a four-hour bar by its hour; NULL for hours that start no such bar, see `off_session`."""
    return F.when(hour.isin(0, 4), "asia").when(hour.isin(8, 12), "europe").when(hour.isin(16, 20), "america")


def off_session(bars: DataFrame, hour: str = "hour", step: int = 4) -> DataFrame:
    """Per symbol: rows, and rows whose hour does not start a bar of `step` hours, so that no session owns them."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(hour).isNull() | (F.col(hour) % step != 0)).alias("off_session"))


def regime_ages(bars: DataFrame) -> DataFrame:
    """Direction of each bar's close against its open as a regime, and how long it has lasted."""
    state = F.when(F.col("close") > F.col("open"), "bull").when(F.col("close") < F.col("open"), "bear").otherwise("neutral")
    return islands(bars.withColumn("regime", state), KEYS, "open_us", "regime")


def winsorised(bars: DataFrame, x: str, low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Clipped to the quantiles of its keys, then (x - median) / IQR (deviation where IQR is 0), within 8.

    With a window among the keys no value depends on later windows; quantiles are exact over a key.
    """
    keys = list(keys)
    cut = bars.join(quantiles(bars, keys, x, {"_low": low, "_high": high}), keys)
    cut = cut.withColumn("_x", F.greatest(F.col("_low"), F.least(F.col("_high"), F.col(x))))
    spread = cut.groupBy(*keys).agg(F.stddev_pop("_x").alias("_sd"))
    s = quantiles(cut, keys, "_x", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).join(spread, keys)
    iqr = F.col("_q3") - F.col("_q1")
    scale = F.coalesce(F.when(iqr > 1e-12, iqr), F.when(F.col("_sd") > 1e-12, F.col("_sd")), F.lit(1.0))
    out = cut.join(s, keys).withColumn("scaled", clip((F.col("_x") - F.col("_q2")) / scale, -8, 8))
    return out.drop("_low", "_high", "_x", "_q1", "_q2", "_q3", "_sd")


def sane_bars(bars: DataFrame) -> DataFrame:
    """Bars with finite prices and volume, prices above 0 and no negative volume."""
    price = [finite(F.col(c).cast("double")) for c in ("close", "high", "low")]
    ok = (finite(F.col("volume").cast("double")) >= 0) & finite(F.col("open").cast("double")).isNotNull()
    for p in price:
        ok &= p > 0
    return bars.where(F.coalesce(ok, F.lit(False)))


def legacy_regime_features(bars: DataFrame) -> DataFrame:
    """Log return, its 24-bar deviation and 8-bar mean, log range and log volume change; values are floored at 1e-12."""
    floor = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))

    def first(w: WindowSpec) -> dict[str, Column]:
        return {"ret": floor("close") - F.lag(floor("close")).over(w), "range": floor("high") - floor("low"), "dvolume": floor("volume") - F.lag(floor("volume")).over(w)}

    def second(w: WindowSpec) -> dict[str, Column]:
        x = F.col("ret")
        return {"deviation24": full(x, 24, back(w, 24), F.stddev_samp(x).over(back(w, 24))), "trend8": full(x, 8, back(w, 8), F.avg(x).over(back(w, 8)))}

    return rolling(rolling(bars, KEYS, ORDER, 1, first), KEYS, ORDER, 24, second)
