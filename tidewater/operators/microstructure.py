"""Order books, trades and the volume clock, set-oriented: no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY, HOUR, MINUTE, clip, ratio
from tidewater.operators.features import back, full, prior_zscore, tail_zscore
from tidewater.operators.series import SPAN, asof_join, quantiles, rolling, running_sums
from tidewater.sources.store import materialise

UNITS = 10**9  # of volume in 1


def books(levels: DataFrame) -> DataFrame:
    """One row per (symbol, seq) with sorted arrays `bids` (price falling) and `asks` (rising) of (price, qty).

    Levels without a positive price, or with a negative or missing quantity, are dropped.
    """
    ok = levels.where("price > 0 and qty >= 0")
    level = F.struct("price", "qty")

    def side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, level)), name == "ask")

    return ok.groupBy("symbol", "seq").agg(side("bid").alias("bids"), side("ask").alias("asks"))


def _depth(levels: Column, n: int, value) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + value(x))


def order_flow(book: DataFrame, n_levels: int = 5, window: int = 20) -> DataFrame:
    """Level-1 order-flow imbalance between snapshots, depth imbalance, spread, mid, liquidity, tail z-score."""
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    flat = book.select(
        "symbol", "seq",
        bid.price.alias("bp"), bid.qty.alias("bq"), ask.price.alias("ap"), ask.qty.alias("aq"),
        _depth(F.col("bids"), n_levels, lambda x: x.qty).alias("bid_depth"),
        _depth(F.col("asks"), n_levels, lambda x: x.qty).alias("ask_depth"),
        (_depth(F.col("bids"), n_levels, lambda x: x.price * x.qty) + _depth(F.col("asks"), n_levels, lambda x: x.price * x.qty)).alias("liquidity"),
    )

    def flow(w) -> dict[str, Column]:
        was = {c: F.lag(c).over(w) for c in ("bp", "bq", "ap", "aq")}
        up = F.when(F.col("bp") >= was["bp"], F.col("bq")).otherwise(0.0) - F.when(F.col("bp") <= was["bp"], was["bq"]).otherwise(0.0)
        down = F.when(F.col("ap") <= was["ap"], F.col("aq")).otherwise(0.0) - F.when(F.col("ap") >= was["ap"], was["aq"]).otherwise(0.0)
        whole = F.col("bp").isNotNull() & F.col("ap").isNotNull() & was["bp"].isNotNull() & was["ap"].isNotNull()
        return {"ofi": F.when(whole, up - down).otherwise(0.0)}

    two = F.col("bp").isNotNull() & F.col("ap").isNotNull()
    mid = (F.col("bp") + F.col("ap")) / 2
    total = F.col("bid_depth") + F.col("ask_depth")
    out = rolling(flat, ["symbol"], ["seq"], 1, flow, span=10**6).drop("pos").withColumns(
        {
            "depth_imbalance": F.when(total > 0, clip((F.col("bid_depth") - F.col("ask_depth")) / F.when(total > 0, total), -1, 1)).otherwise(0.0),
            "mid": F.when(two, mid).otherwise(0.0),
            "spread_bps": F.when(two & (mid > 0), (F.col("ap") - F.col("bp")) / mid * 1e4).otherwise(0.0),
        }
    )
    return rolling(out, ["symbol"], ["seq"], window, lambda w: {"ofi_z": tail_zscore(F.col("ofi"), window, w)}, span=10**6)


def signed_trades(trades: DataFrame) -> DataFrame:
    """Trades with quote notional and the buyer- and seller-initiated parts of it and of the quantity; bad rows dropped."""
    ok = trades.where("us >= 0 and price > 0 and qty > 0")
    quote = F.col("price") * F.col("qty")
    return ok.withColumns(
        {
            "quote": quote,
            "buy_quote": F.when(~F.col("is_buyer_maker"), quote).otherwise(0.0),
            "sell_quote": F.when(F.col("is_buyer_maker"), quote).otherwise(0.0),
            "buy_base": F.when(~F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0),
            "sell_base": F.when(F.col("is_buyer_maker"), F.col("qty")).otherwise(0.0),
        }
    )


def volume_buckets(trades: DataFrame, buckets: int = 20, capacity: float | None = None, span: int = SPAN, unit: str = "quote") -> DataFrame:
    """Volume-clock buckets per symbol; a trade that crosses a border is split in proportion.

    Volume is quote notional or, by `unit`, base quantity. A trade takes [c0, c1) of its symbol's running volume and bucket
    k is [kV, (k+1)V), with V the capacity or the symbol's total over `buckets`. Incomplete last buckets are
    dropped; without a capacity above 0 there are none. With a capacity there may be many small buckets in a long series, see
    `fixed_buckets`.
    """
    volume = {"quote": "quote", "base": "qty"}[unit]
    if capacity is not None:
        return fixed_buckets(trades, volume, capacity, span)
    t = signed_trades(trades)
    size = t.groupBy("symbol").agg((F.sum(volume) / buckets).alias("V")).where("V > 1e-12")
    run = running_sums(t, ["symbol"], ["us", "trade_id"], {"c1": volume}, span)
    run = run.join(size, "symbol").withColumn("c0", F.col("c1") - F.col(volume))
    v = F.col("V")
    parts = run.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest(F.col("c0"), F.lit(0.0)) / v), F.floor(F.col("c1") / v))))
    k = F.col("bucket")
    take = F.least(F.col("c1"), (k + 1) * v) - F.greatest(F.col("c0"), k * v)
    parts = parts.withColumn("take", take).where("take > 0")
    share = F.col("take") / F.col(volume)
    out = parts.groupBy("symbol", "bucket", "V").agg(
        F.sum(share * F.col(f"buy_{unit}")).alias("buy"), F.sum(share * F.col(f"sell_{unit}")).alias("sell"),
        F.sum("take").alias("total"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
    )
    return out.where(F.col("total") >= F.col("V") * (1 - 1e-9)).withColumn("imbalance", F.abs(F.col("buy") - F.col("sell")))


def fixed_buckets(trades: DataFrame, volume: str, capacity: float, span: int = SPAN) -> DataFrame:
    """Complete buckets of a fixed capacity. Volume is counted in whole units of 1e-9, so that running sums of any length are
    exact and do not depend on their order; sums of doubles would lose complete buckets far on in a series."""
    exact = lambda x: x.cast("decimal(38,0)")
    t = signed_trades(trades).withColumn("_u", F.round(F.col(volume) * UNITS).cast("decimal(28,0)"))
    size = exact(F.lit(round(capacity * UNITS)))
    run = running_sums(t, ["symbol"], ["us", "trade_id"], {"_c1": "_u"}, span).withColumn("_V", size).where("_V > 0")
    run = run.withColumn("_c0", exact(F.col("_c1") - F.col("_u")))
    parts = run.withColumn("bucket", F.explode(F.expr("sequence(_c0 div _V, _c1 div _V)")))
    border = lambda k: exact(k.cast("decimal(19,0)") * F.col("_V"))
    take = F.least(F.col("_c1"), border(F.col("bucket") + 1)) - F.greatest(F.col("_c0"), border(F.col("bucket")))
    parts = parts.withColumn("_take", take.cast("decimal(28,0)")).where("_take > 0")
    of = lambda side: F.coalesce(F.sum(F.when(side, F.col("_take"))), F.lit(0))
    out = parts.groupBy("symbol", "bucket", "_V").agg(
        of(~F.col("is_buyer_maker")).alias("_buy"), of(F.col("is_buyer_maker")).alias("_sell"), F.sum("_take").alias("_total"),
        F.min("us").alias("start_us"), F.max("us").alias("end_us"),
    )
    values = {"V": F.col("_V"), "buy": F.col("_buy"), "sell": F.col("_sell"), "total": F.col("_total"), "imbalance": F.abs(F.col("_buy") - F.col("_sell"))}
    return out.where("_total >= _V").select("symbol", "bucket", *((x.cast("double") / float(UNITS)).alias(n) for n, x in values.items()), "start_us", "end_us")


def vpin(buckets: DataFrame, at_least: int = 5) -> DataFrame:
    """Share of imbalance in the volume of all complete buckets, its lower bound and the last z-score."""
    z = rolling(buckets, ["symbol"], ["bucket"], 50, lambda w: {"z": tail_zscore(F.col("imbalance") / F.col("total"), 50, w)}, span=100_000)
    volume = F.sum("total")
    return z.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.when(F.count(F.lit(1)) >= at_least, clip(F.sum("imbalance") / volume, 0, 1)).alias("vpin"),
        F.when(F.count(F.lit(1)) >= at_least, F.abs(F.sum("buy") - F.sum("sell")) / volume).alias("lower_bound"),
        F.max_by("z", "bucket").alias("vpin_z"),
    )


def minute_bars(trades: DataFrame) -> DataFrame:
    """Minute bars of quote volume and its buyer share; buys lie within [0, total], empty minutes drop."""
    t = signed_trades(trades).groupBy("symbol", (F.floor(F.col("us") / MINUTE) * MINUTE).alias("open_us"))
    m = t.agg(F.sum("quote").alias("quote"), F.sum("buy_quote").alias("buy")).where("quote > 0")
    return m.withColumns({"buy": F.greatest(F.lit(0.0), F.least("buy", "quote")), "close_us": F.col("open_us") + MINUTE})


def full_hours(minutes: DataFrame, per_hour: int = 60) -> DataFrame:
    """Volume of the hours that have all their minutes; labelled by their end."""
    h = minutes.groupBy("symbol", ((F.floor(F.col("open_us") / HOUR) + 1) * HOUR).alias("hour_end_us"))
    return h.agg(F.sum("quote").alias("quote"), F.count(F.lit(1)).alias("minutes")).where(F.col("minutes") >= per_hour)


def missing_minutes(minutes: DataFrame) -> DataFrame:
    m = minutes.select("symbol", "open_us").distinct().groupBy("symbol")
    n = m.agg(F.count(F.lit(1)).alias("n"), ((F.max("open_us") - F.min("open_us")) / MINUTE + 1).cast("long").alias("expected"))
    return n.withColumn("missing_ratio", 1 - F.col("n") / F.col("expected"))


def hourly_capacity(minutes: DataFrame, per_hour: int = 60, buckets: int = 20) -> DataFrame:
    """Bucket capacity per symbol: the median volume of its full hours over the number of buckets."""
    middle = quantiles(full_hours(minutes, per_hour), ["symbol"], "quote", {"_middle": 0.5})
    return middle.select("symbol", (F.col("_middle") / buckets).alias("capacity"))


def vpin_history(minutes: DataFrame, capacities: DataFrame, look_back: int = 7 * DAY, step: int = HOUR, last: int = 20) -> DataFrame:
    """VPIN at checkpoints from the cumulative volume curve, with buckets that start at the window's start.

    For checkpoint T the window is (T - look_back, T]. Instead of re-reading it, the curve of
    cumulative (volume, buys) is looked up at the `last` + 1 borders of its last complete buckets and
    interpolated linearly: an as-of join on cumulative volume. NULL where the series does not reach
    back to the window's start or holds fewer complete buckets, or without a capacity in `capacities`.
    """
    capacity = F.col("capacity")
    curve = materialise(running_sums(minutes, ["symbol"], ["open_us"], {"C": "quote", "B": "buy"}, 7 * DAY), "curve")
    ends = curve.select("symbol", F.col("close_us").alias("at"), "C", "B")
    edge = curve.groupBy("symbol").agg(F.min("open_us").alias("lo"), F.max("close_us").alias("hi"))
    points = edge.select("symbol", "lo", F.explode(F.sequence(F.ceil(F.col("lo") / step) * step, F.floor(F.col("hi") / step) * step, F.lit(step))).alias("T"))
    end = asof_join(points, ends, ["symbol"], "T", "at", prefix="e_")
    both = asof_join(end.withColumn("S", F.col("T") - look_back), ends, ["symbol"], "S", "at", prefix="s_").join(capacities, "symbol", "left")
    c0, c1 = F.coalesce("s_C", F.lit(0.0)), F.coalesce("e_C", F.lit(0.0))
    n = F.floor((c1 - c0) / capacity + 1e-9)
    whole = (F.col("T") - look_back >= F.col("lo") - MINUTE) & (n >= last)
    asked = materialise(both.select("symbol", "T", F.when(whole, n).alias("n"), c0.alias("c0"), "capacity"), "checkpoints")
    # a border's place on the curve as an integer, so that time-like ordering works on volume too
    border = asked.where("n is not null").select("symbol", "T", F.explode(F.sequence(F.col("n") - last, F.col("n"))).alias("k"), "c0", "capacity")
    border = border.withColumn("x", F.col("c0") + F.col("k") * capacity).withColumn("x_key", F.floor(F.col("x") * 1e4).cast("long"))
    w = Window.partitionBy("symbol", F.floor(F.col("open_us") / (7 * DAY))).orderBy("open_us")
    first = curve.groupBy("symbol", F.floor(F.col("open_us") / (7 * DAY)).alias("week")).agg(F.min_by(F.struct("quote", "buy"), "open_us").alias("f"), F.min("open_us").alias("o"))
    following = Window.partitionBy("symbol").orderBy("week")
    first = first.select("symbol", "week", F.lead("f").over(following).alias("nf"))
    steps = curve.withColumn("week", F.floor(F.col("open_us") / (7 * DAY))).withColumn("nxt", F.lead(F.struct("quote", "buy")).over(w))
    steps = steps.join(first, ["symbol", "week"]).withColumn("nxt", F.coalesce("nxt", "nf"))
    origin = curve.groupBy("symbol").agg(F.min_by(F.struct("quote", "buy"), "open_us").alias("nxt"))
    knots = steps.select("symbol", F.floor(F.col("C") * 1e4).cast("long").alias("key"), "C", "B", "nxt").unionByName(
        origin.select("symbol", F.lit(-1).cast("long").alias("key"), F.lit(0.0).alias("C"), F.lit(0.0).alias("B"), "nxt")
    )
    at = asof_join(border, knots, ["symbol"], "x_key", "key", prefix="k_", span=10**11)
    over = F.col("x") - F.col("k_C")
    value = F.col("k_B") + F.when(F.col("k_nxt").isNotNull(), over / F.col("k_nxt.quote") * F.col("k_nxt.buy")).otherwise(0.0)
    at = at.withColumn("buys", value)
    seq = Window.partitionBy("symbol", "T").orderBy("k")
    bucket = at.withColumn("got", F.col("buys") - F.lag("buys").over(seq)).where("got is not null")
    out = bucket.groupBy("symbol", "T").agg(F.avg(F.abs(2 * F.col("got") - capacity) / capacity).alias("vpin"))
    return asked.select("symbol", "T").join(out, ["symbol", "T"], "left").select("symbol", F.col("T").alias("ts_us"), clip(F.col("vpin"), 0, 1).alias("vpin"))


def funding_history(funding: DataFrame, window: int = 90) -> DataFrame:
    """Keep-last funding with z-score of the rows before and a flag for extreme positive rates."""
    one = funding.groupBy("symbol", "settle_us").agg(F.max("funding_rate").alias("funding_rate"))
    out = rolling(one, ["symbol"], ["settle_us"], window, lambda w: {"funding_z": prior_zscore(F.col("funding_rate"), window, w)})
    extreme = (F.col("funding_rate") > 0) & (F.col("funding_z") >= 2)
    return out.withColumn("funding_extreme_pos", F.coalesce(extreme, F.lit(False)).cast("int")).drop("pos")


def flow_row(flow: DataFrame, min_liquidity: float) -> DataFrame:
    """The last order flow of each symbol, also as a share of the best quantities, with counts and the reason where it is not ok."""
    best = F.greatest(F.coalesce("bq", F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce("aq", F.lit(0.0)), F.lit(0.0))
    norm = F.when(best > 1e-12, clip(F.col("ofi") / F.when(best > 1e-12, best), -1, 1)).otherwise(0.0)
    names = ["ofi", "ofi_norm", "ofi_z", "depth_imbalance", "spread_bps", "liquidity"]
    last = flow.withColumn("ofi_norm", norm).groupBy("symbol").agg(F.max_by(F.struct(*names), "seq").alias("x"), F.count(F.lit(1)).alias("snapshots"))
    out = last.select("symbol", "x.*", "snapshots")
    reason = F.when(F.col("liquidity") < min_liquidity, "liquidity_below_min").when(F.col("snapshots") < 2, "few_snapshots")
    return out.withColumn("ok", reason.isNull()).withColumn("reason", reason)


def combined_row(flow: DataFrame, buckets: DataFrame, min_liquidity: float) -> DataFrame:
    """Latest order flow and VPIN per symbol side by side, with reasons for what is missing."""
    latest = flow.groupBy("symbol").agg(F.max_by(F.struct("ofi", "ofi_z", "liquidity", "spread_bps"), "seq").alias("f"), F.count(F.lit(1)).alias("snapshots"))
    both = latest.join(vpin(buckets), "symbol", "full")
    why_flow = F.when(F.coalesce("snapshots", F.lit(0)) < 2, "few_snapshots").when(F.col("f.liquidity") < min_liquidity, "liquidity_below_min")
    why_vpin = F.when(F.col("vpin").isNull(), "no_vpin")
    return both.select(
        "symbol", F.coalesce("f.ofi", F.lit(0.0)).alias("ofi"), F.coalesce("f.ofi_z", F.lit(0.0)).alias("ofi_z"),
        F.coalesce("vpin", F.lit(0.0)).alias("vpin"), (why_flow.isNull() & why_vpin.isNull()).alias("ok"), F.concat_ws(";", why_flow, why_vpin).alias("reason"),
    )
