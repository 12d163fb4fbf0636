"""Volume-clock imbalance of live trades: buckets that fill across micro-batches, and the share of the last hour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.microstructure import signed_trades, volume_buckets, vpin
from tidewater.operators.series import rolling

RING = 20
LOOKBACK = 60 * 60 * 1_000_000
MOST_TRADES = 1000
TINY = 1e-9  # of a bucket

BUCKETS = "symbol string, bucket long, buy double, sell double, total double, start_us long, end_us long, imbalance double, vpin double, lower_bound double"
OPEN = "closed long, buy double, sell double, total double, start_us long, ring binary"
SHARES = "symbol string, us long, trades long, buckets long, vpin double, lower_bound double"
HELD = "trades binary"


def fill(buy: np.ndarray, sell: np.ndarray, us: np.ndarray, capacity: float, was: tuple[int, float, float, float, int]) -> tuple[list[np.ndarray], tuple]:
    """Buckets that trades in order close, after an open one; and the bucket that is open then.

    A trade that crosses a border is split in proportion. `was` is (buckets closed, buy, sell, total, start) of the open one.
    """
    closed, open_buy, open_sell, held, start = was
    quote = buy + sell
    ends = held + np.cumsum(quote)
    begins = ends - quote
    border = capacity * (1 - TINY)
    first, last = np.floor((begins + capacity * TINY) / capacity).astype(int), np.floor(np.maximum(ends - capacity * TINY, begins) / capacity).astype(int)
    last = np.maximum(last, first)
    parts = last - first + 1
    trade = np.repeat(np.arange(len(quote)), parts)
    bucket = first[trade] + np.arange(len(trade)) - np.repeat(np.cumsum(parts) - parts, parts)
    take = np.minimum(ends[trade], (bucket + 1) * capacity) - np.maximum(begins[trade], bucket * capacity)
    share = np.maximum(take, 0) / quote[trade]
    n = int(bucket.max(initial=0)) + 1
    sums = [np.bincount(bucket, share * side[trade], n) for side in (buy, sell)]
    sums[0][0] += open_buy
    sums[1][0] += open_sell
    starts, stops = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(starts, bucket, us[trade])
    np.maximum.at(stops, bucket, us[trade])
    if held > 0:
        starts[0] = start
    total = sums[0] + sums[1]
    full = n if total[-1] >= border else n - 1
    rows = [closed + np.arange(full), sums[0][:full], sums[1][:full], total[:full], starts[:full], stops[:full]]
    rest = (closed + full, 0.0, 0.0, 0.0, 0) if full == n else (closed + full, float(sums[0][-1]), float(sums[1][-1]), float(total[-1]), int(starts[-1]))
    return rows, rest


def _in_order(trades: DataFrame) -> DataFrame:
    return signed_trades(trades).select("symbol", "us", "trade_id", "buy_quote", "sell_quote")


def live_buckets(trades: DataFrame, capacity: float, ring: int = RING) -> DataFrame:
    """Complete buckets of `capacity` quote volume, each with the imbalance share of the last `ring` ones.

    Of a stream, a symbol's open bucket and ring are kept between batches: a handful of numbers, for good. Trades of a batch
    are put in order of time and id; a trade that comes batches late fills the bucket that is open then. The batch twin
    is the running sum of `volume_buckets`.
    """
    if not trades.isStreaming:
        out = volume_buckets(trades, capacity=capacity)

        def over(w) -> dict:
            last = w.rowsBetween(-ring + 1, 0)
            volume = F.sum("total").over(last)
            return {"vpin": F.sum("imbalance").over(last) / volume, "lower_bound": F.abs(F.sum("buy").over(last) - F.sum("sell").over(last)) / volume}

        return rolling(out, ["symbol"], ["bucket"], ring, over, span=100_000).select(*(c.split()[0] for c in BUCKETS.split(", ")))

    def stateful(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values(["us", "trade_id"])
        *was, kept = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0, b"")
        rows, now = fill(*(pdf[c].to_numpy() for c in ("buy_quote", "sell_quote", "us")), capacity, tuple(was))
        number, buy, sell, total, start, end = rows
        before = np.frombuffer(kept).reshape(-1, 3)
        every = np.vstack([before, np.column_stack([buy, sell, total])])
        sums = np.vstack([np.zeros((1, 4)), np.cumsum(np.column_stack([np.abs(every[:, 0] - every[:, 1]), every]), axis=0)])
        at = np.arange(len(before), len(every)) + 1
        last = sums[at] - sums[np.maximum(at - ring, 0)]
        state.update((*now, every[-ring:].tobytes()))
        out = {"symbol": key[0], "bucket": number, "buy": buy, "sell": sell, "total": total, "start_us": start, "end_us": end, "imbalance": np.abs(buy - sell)}
        yield pd.DataFrame({**out, "vpin": last[:, 0] / last[:, 3], "lower_bound": np.abs(last[:, 1] - last[:, 2]) / last[:, 3]})

    return _in_order(trades).groupBy("symbol").applyInPandasWithState(stateful, BUCKETS, OPEN, "append", GroupStateTimeout.NoTimeout)


def live_vpin(trades: DataFrame, buckets: int = RING, lookback: int = LOOKBACK, most: int = MOST_TRADES, at_least: int = 5) -> DataFrame:
    """The imbalance share at each symbol's last trade: of the trades of the look-back before it, the last `most` of them,
    in buckets of their volume over `buckets`. NULL with fewer than `at_least` complete buckets.

    Of a stream, a row a symbol and batch; those trades are the state. The batch twin gives one row a symbol.
    """
    if not trades.isStreaming:
        t = trades.where("us >= 0 and price > 0 and qty > 0")
        ends = t.groupBy("symbol").agg(F.max("us").alias("_end"))
        recent = t.join(ends, "symbol").where(F.col("us") > F.col("_end") - lookback)
        w = Window.partitionBy("symbol").orderBy(F.desc("us"), F.desc("trade_id"))  # the trades of one look-back
        last = recent.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
        share = vpin(volume_buckets(last, buckets), at_least).select("symbol", "buckets", "vpin", "lower_bound")
        seen = last.groupBy("symbol").agg(F.max("us").alias("us"), F.count(F.lit(1)).alias("trades"))
        return seen.join(share, "symbol", "left").select("symbol", "us", "trades", F.coalesce("buckets", F.lit(0)).alias("buckets"), "vpin", "lower_bound")

    def stateful(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(pdfs))[["us", "trade_id", "buy_quote", "sell_quote"]].to_numpy(float)
        held = np.frombuffer(state.get[0]).reshape(-1, 4) if state.exists else np.zeros((0, 4))
        every = np.vstack([held, new])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        every = every[every[:, 0] > every[-1, 0] - lookback][-most:]
        state.update((every.tobytes(),))
        us, _, buy, sell = every.T
        rows, _ = fill(buy, sell, us.astype(np.int64), float((buy + sell).sum()) / buckets, (0, 0.0, 0.0, 0.0, 0))
        n, total = len(rows[0]), rows[3].sum()
        enough = n >= at_least
        share = float(np.clip(np.abs(rows[1] - rows[2]).sum() / total, 0, 1)) if enough else None
        low = float(abs(rows[1].sum() - rows[2].sum()) / total) if enough else None
        yield pd.DataFrame({"symbol": [key[0]], "us": [int(us[-1])], "trades": [len(every)], "buckets": [n], "vpin": [share], "lower_bound": [low]})

    return _in_order(trades).groupBy("symbol").applyInPandasWithState(stateful, SHARES, HELD, "append", GroupStateTimeout.NoTimeout)
