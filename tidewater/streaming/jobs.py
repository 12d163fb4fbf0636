"""Structured Streaming forms of the live tables; each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.series import rolling

CLOSED_MS, OPEN_MS = 24 * 3_600_000, 30 * 24 * 3_600_000


def closed_bars(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of trades (symbol, ts, price, qty), emitted once their window has closed."""
    t = trades.withWatermark("ts", late) if trades.isStreaming else trades
    return (
        t.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"))
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def distinct_trades(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades without repeats of (symbol, trade_id) that arrive within the watermark."""
    if trades.isStreaming:
        return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "trade_id"])
    return trades.dropDuplicates(["symbol", "trade_id"])


def activity_sessions(trades: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    t = trades.withWatermark("ts", late) if trades.isStreaming else trades
    return t.groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rolling_imbalance(trades: DataFrame, width: str = "60 minutes", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Buy and sell volume share over sliding windows, the streaming proxy of bucketed imbalance."""
    t = trades.withWatermark("ts", late) if trades.isStreaming else trades
    out = t.groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("price") * F.col("qty")).otherwise(0.0)).alias("buy"), F.sum(F.col("price") * F.col("qty")).alias("total")
    )
    return out.select("symbol", F.col("w.start").alias("start"), "buy", "total", (F.abs(2 * F.col("buy") - F.col("total")) / F.col("total")).alias("imbalance"))


STOP_SCHEMA = "position_id string, ts timestamp, price double, event string, stop double"
STOP_STATE = "side double, entry double, risk double, stop double, target double, trailing boolean, closed boolean"


def _step(state: tuple, price: float) -> tuple[tuple, str | None]:
    """One price tick: stop or target, break-even at 1R with a 3R target, then a ratchet 1.5R behind."""
    side, entry, risk, stop, target, trailing, closed = state
    if closed:
        return state, None
    if (price - stop) * side <= 0:
        return (side, entry, risk, stop, target, trailing, True), "SL_trail" if trailing else "SL"
    if (price - target) * side >= 0:
        return (side, entry, risk, stop, target, trailing, True), "TP"
    if not trailing and (price - entry) * side >= risk:
        return (side, entry, risk, entry, price + 3 * risk * side, True, False), "breakeven"
    if trailing:
        tighter = price - 1.5 * risk * side
        if (tighter - stop) * side > 0:
            return (side, entry, risk, tighter, target, True, False), "trail"
    return state, None


def manage_stops(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stop events of positions over price ticks (position_id, ts, side, entry, stop, price).

    Streaming input keeps each position's state between batches; the batch twin replays the ticks of a
    position in order. Both run the same step. Within a batch ticks are put in order; a tick that
    arrives batches late counts when it arrives. A closed position is remembered for CLOSED_MS of event time
    so that late ticks do not open it again, an open one for OPEN_MS after its last tick; then its state goes.
    """

    def replay(pdf: pd.DataFrame, state: tuple | None) -> tuple[list, tuple | None]:
        rows = []
        for t in pdf.sort_values("ts").itertuples():
            if state is None:
                side = 1.0 if t.side == "BUY" else -1.0
                risk = abs(t.entry - t.stop)
                state = (side, t.entry, risk, t.stop, t.entry + 2 * risk * side, False, False)
            state, event = _step(state, t.price)
            if event:
                rows.append((t.position_id, t.ts, t.price, event, state[3]))
        return rows, state

    names = [c.split()[0] for c in STOP_SCHEMA.split(", ")]
    if not ticks.isStreaming:
        def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # many positions a batch; only the open one's state goes from batch to batch
            now, state = None, None
            for batch in batches:
                side = batch.column("side").to_pylist()
                entry, stop, price = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("entry", "stop", "price"))  # NULL as NaN
                rows, at = [], []
                for i, position in enumerate(batch.column("position_id").to_pylist()):
                    if position != now or state is None:
                        long = 1.0 if side[i] == "BUY" else -1.0
                        risk = abs(entry[i] - stop[i])
                        now, state = position, (long, entry[i], risk, stop[i], entry[i] + 2 * risk * long, False, False)
                    if state[-1]:
                        continue
                    state, event = _step(state, price[i])
                    if event:
                        rows.append((event, state[3]))
                        at.append(i)
                found = batch.select(["position_id", "ts", "price"]).take(pa.array(at, pa.int32()))
                events, stops = ([r[k] for r in rows] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(events, pa.string()), pa.array(stops, pa.float64())], names=names)

        numbers = [F.col(c).cast("double").alias(c) for c in ("entry", "stop", "price")]
        dealt = ticks.select("position_id", "ts", "side", *numbers).repartition("position_id").sortWithinPartitions("position_id", F.col("ts").asc_nulls_last())
        return dealt.mapInArrow(ordered, STOP_SCHEMA)

    def stateful(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(pdfs)
        rows, now = replay(pd.concat(parts), state.get if state.exists else None)
        state.update(now)
        seen = max(max(pdf["ts"].max().value // 10**6 for pdf in parts), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(seen + (CLOSED_MS if now[-1] else OPEN_MS))
        yield pd.DataFrame(rows, columns=names)

    marked = ticks.withWatermark("ts", late).groupBy("position_id")
    return marked.applyInPandasWithState(stateful, STOP_SCHEMA, STOP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


FLOW_SCHEMA = "symbol string, seq long, ofi double"
FLOW_STATE = "bp double, bq double, ap double, aq double"


def level_flow(pdf: pd.DataFrame, was: tuple | None) -> tuple[np.ndarray, tuple]:
    """Level-1 order flow of best levels in order, after the levels `was` of the batch before; and the last levels."""
    now = pdf[["bp", "bq", "ap", "aq"]].to_numpy(float)
    before = np.vstack([np.full((1, 4), np.nan) if was is None else np.array([was], float), now[:-1]])
    (bp, bq, ap, aq), (bp0, bq0, ap0, aq0) = now.T, before.T
    up = np.where(bp >= bp0, bq, 0.0) - np.where(bp <= bp0, bq0, 0.0)
    down = np.where(ap <= ap0, aq, 0.0) - np.where(ap >= ap0, aq0, 0.0)
    whole = ~np.isnan(np.column_stack([bp, ap, bp0, ap0])).any(1)
    return np.where(whole, up - down, 0.0), tuple(map(float, now[-1]))


def live_order_flow(levels: DataFrame) -> DataFrame:
    """Order flow of best levels (symbol, seq, bp, bq, ap, aq): the last levels of a symbol are kept between batches.

    The batch twin is a lag over chunks. A symbol's state is four numbers, kept for good.
    """
    if not levels.isStreaming:
        def flow(w) -> dict:
            was = {c: F.lag(c).over(w) for c in ("bp", "bq", "ap", "aq")}
            up = F.when(F.col("bp") >= was["bp"], F.col("bq")).otherwise(0.0) - F.when(F.col("bp") <= was["bp"], was["bq"]).otherwise(0.0)
            down = F.when(F.col("ap") <= was["ap"], F.col("aq")).otherwise(0.0) - F.when(F.col("ap") >= was["ap"], was["aq"]).otherwise(0.0)
            whole = F.col("bp").isNotNull() & F.col("ap").isNotNull() & was["bp"].isNotNull() & was["ap"].isNotNull()
            return {"ofi": F.when(whole, up - down).otherwise(0.0)}

        return rolling(levels, ["symbol"], ["seq"], 1, flow, span=10**6).select("symbol", "seq", "ofi")

    def stateful(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("seq")
        ofi, last = level_flow(pdf, state.get if state.exists else None)
        state.update(last)
        yield pd.DataFrame({"symbol": key[0], "seq": pdf["seq"].to_numpy(), "ofi": ofi})

    return levels.groupBy("symbol").applyInPandasWithState(stateful, FLOW_SCHEMA, FLOW_STATE, "append", GroupStateTimeout.NoTimeout)
