"""Tables of open positions and equity: valuation, drawdown, circuit breaker, entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY, HOUR, ratio
from tidewater.operators.metrics import peak_so_far
from tidewater.operators.series import asof_join


def valuation(accounts: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """cash, margin, unrealised profit and equity per account; a position without a price counts at its entry.

    `positions` has account, symbol, side, entry, size and margin; `prices` the last price per symbol.
    """
    p = positions.join(prices.select("symbol", "price"), "symbol", "left")
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    gain = (F.coalesce("price", "entry") - F.col("entry")) * F.col("size") * sign
    open_ = p.groupBy("account").agg(F.sum("margin").alias("margin"), F.sum(gain).alias("unrealised"), F.count_if(F.col("price").isNull()).alias("unpriced"))
    out = accounts.join(open_, "account", "left").fillna(0, ["margin", "unrealised", "unpriced"])
    return out.withColumn("equity", F.col("cash") + F.col("margin") + F.col("unrealised"))


def drawdowns(equity: DataFrame, key: str = "symbol", span: int = 30 * DAY) -> DataFrame:
    """Each equity row (key, decision_us, equity) with the peak so far and the share lost from it."""
    out = peak_so_far(equity, [key], "equity", span)
    return out.withColumn("drawdown", F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("peak") - F.col("equity"), F.col("peak")), F.lit(0.0))))


def circuit_breaker(rows: DataFrame, key: str = "symbol", limit: float = 0.10, cooldown: int = 24 * HOUR) -> DataFrame:
    """Marks rows at which trading is paused: a trip is a drawdown of `limit` outside a pause, and pauses for `cooldown`.

    Whether a row trips depends on all trips before it, so the rows of a key pass through one task in
    order; the task keeps one number a key, whatever its length.
    """
    at, drop, who = (rows.columns.index(c) for c in ("decision_us", "drawdown", key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tripped = None, None
        for batch in batches:
            marks = []
            for k, t, d in zip(*(batch.column(i).to_pylist() for i in (who, at, drop)), strict=True):
                if k != now:
                    now, tripped = k, None
                if tripped is not None and t >= tripped + cooldown:
                    tripped = None
                if tripped is None and d is not None and d >= limit:
                    tripped = t
                marks.append(tripped)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "tripped_us"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    out = rows.repartition(key).sortWithinPartitions(key, "decision_us").mapInArrow(run, f"{kinds}, tripped_us long")
    return out.withColumn("paused", F.col("tripped_us").isNotNull())


def entries(orders: DataFrame, regimes: DataFrame, key: str = "symbol") -> DataFrame:
    """New positions with their reward to risk (two digits, 0 without risk) and the regime known at entry."""
    risk, reward = F.abs(F.col("entry") - F.col("stop")), F.abs(F.col("target") - F.col("entry"))
    rr = F.coalesce(F.round(ratio(reward, risk), 2), F.lit(0.0))
    out = asof_join(orders.withColumn("initial_rr", rr), regimes, [key], "open_us", "regime_us", prefix="at_")
    return out


def stop_target(side: Column, entry: Column, swing_low: Column, swing_high: Column, atr: Column, adx: Column) -> tuple[Column, Column]:
    """Stop behind the nearer of the swing and 2.5 ATR, target 2.5, 2 or 1.6 risks away as the trend is strong, middling or weak."""
    stop = F.when(side == "BUY", F.greatest(swing_low * 0.998, entry - 2.5 * atr)).otherwise(F.least(swing_high * 1.002, entry + 2.5 * atr))
    reward = F.when(adx > 40, 2.5).when(adx > 30, 2.0).otherwise(1.6)
    return stop, entry + (entry - stop) * reward
