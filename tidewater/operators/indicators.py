"""Screener indicators with long exponential memory, and Granger tests from distributed moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import finite
from tidewater.operators.series import ROWS, ordinal, rolling

NAMES = ("ema50", "ema200", "rsi14", "adx14", "atr14", "relative_volume")
HALO = 3000  # (1 - 2/201)^3000 is below 1e-12: what happened before the halo no longer counts


def smoothed(x: np.ndarray, alpha: float, seed: int) -> np.ndarray:
    """Exponential mean that starts with the plain mean of the first `seed` values; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) < seed:
        return out
    value = out[seed - 1] = x[:seed].mean()
    for i in range(seed, len(x)):
        value += alpha * (x[i] - value)
        out[i] = value
    return out


def _of_series(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    n = len(close)
    before = np.concatenate([close[:1], close[:-1]])
    true_range = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    move = close - before
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    wilder = lambda x: smoothed(x, 1 / 14, 14)
    atr = wilder(true_range)
    with np.errstate(invalid="ignore", divide="ignore"):
        gain, loss = wilder(np.maximum(move, 0)), wilder(np.maximum(-move, 0))
        rsi = np.where(gain + loss > 0, 100 * gain / (gain + loss), 50.0)
        p, m = wilder(plus) / atr, wilder(minus) / atr
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), 0.0)
        known = ~np.isnan(atr)
        adx = np.full(n, np.nan)
        adx[known] = smoothed(dx[known], 1 / 14, 14)
        total = np.cumsum(np.concatenate([[0.0], volume]))
        mean20 = np.full(n, np.nan)
        mean20[19:] = (total[20:] - total[:-20]) / 20 if n >= 20 else mean20[19:]
        relative = np.where(mean20 > 0, volume / mean20, np.nan)
    rsi[np.isnan(gain)] = np.nan
    columns = (smoothed(close, 2 / 51, 50), smoothed(close, 2 / 201, 200), rsi, adx, atr, relative)
    return dict(zip(NAMES, columns, strict=True))


def indicators(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """Adds EMA(50), EMA(200), RSI(14), ADX(14), ATR(14) and volume over its 20-bar mean.

    Each chunk of a symbol is one task with a halo of HALO bars before it. Wilder smoothing and the
    exponential means start with a plain mean; until then values are NULL.
    """
    placed = ordinal(bars, ["symbol"], ["open_us"])
    lo, hi = F.floor(F.col("pos") / rows), F.floor((F.col("pos") + HALO) / rows)
    spread = placed.withColumn("_chunk", F.explode(F.sequence(lo, hi)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        got = _of_series(*(table.column(c).to_numpy().astype(float) for c in ("high", "low", "close", "volume")))
        own = table.column("pos").to_numpy() // rows == table.column("_chunk").to_numpy()
        out = table.select(["symbol", "open_us", "pos"])
        for name, values in got.items():
            out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
        return out.filter(pa.array(own))

    schema = "symbol string, open_us long, pos long, " + ", ".join(f"{n} double" for n in NAMES)
    slim = spread.select("symbol", "open_us", F.col("pos").cast("long").alias("pos"), "_chunk", "high", "low", "close", "volume")
    return slim.groupBy("symbol", "_chunk").applyInArrow(run, schema)


def with_defaults(last: DataFrame) -> DataFrame:
    """Indicators of last bars with what stands in for missing ones: RSI 50, ADX 0, relative volume 0, and for a range of 0 or
    none the mean of high - low over 14 bars (`_span`), else half a percent of the close, 1e-6 at least."""
    present = lambda c: F.when(F.col(c) > 1e-9, F.col(c))
    atr = F.coalesce(present("atr14"), present("_span"), F.greatest(F.col("close") * 0.005, F.lit(1e-6)))
    plain = {"rsi14": F.coalesce("rsi14", F.lit(50.0)), "adx14": F.coalesce("adx14", F.lit(0.0)), "relative_volume": F.coalesce("relative_volume", F.lit(0.0))}
    return last.withColumns({**plain, "atr14": atr})


def screened(bars: DataFrame, top: int = 3, at_least: int = 250) -> DataFrame:
    """The symbols of highest relative volume at their last closed bar; the last bar may still be open."""
    last = bars.groupBy("symbol").agg(F.max("open_us").alias("_last"))
    closed = bars.join(last, "symbol").where("open_us < _last").drop("_last")
    got = indicators(closed)
    got = rolling(got.join(closed.select("symbol", "open_us", "high", "low", "close"), ["symbol", "open_us"]).drop("pos"), ["symbol"], ["open_us"], 14, lambda w: {"_span": F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-13, 0))})
    now = got.groupBy("symbol").agg(F.max_by(F.struct("open_us", "close", "_span", *NAMES), "pos").alias("x"), F.count(F.lit(1)).alias("bars"))
    ok = with_defaults(now.where(F.col("bars") >= at_least).select("symbol", "bars", "x.*")).drop("_span")
    return ok.orderBy(F.desc("relative_volume"), "symbol").limit(top)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def granger(bars: DataFrame, x: str, y: str, lags: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(symbol, lag, n, f, p_value): do the last values of x help to predict y beyond y's own?

    All products of lagged columns are summed in one aggregation per symbol; a symbol's moment matrix, of at most
    14 x 14 numbers, is solved in the task that holds its row.
    """
    most = max(lags)

    def columns(w):
        back = {f"y{k}": F.lag(y, k).over(w) for k in range(1, most + 1)}
        return back | {f"x{k}": F.lag(x, k).over(w) for k in range(1, most + 1)}

    lagged = rolling(bars.withColumns({"y0": finite(F.col(y)), x: finite(F.col(x))}), ["symbol"], ["open_us"], most, columns)
    names = ["one", "y0", *(f"y{k}" for k in range(1, most + 1)), *(f"x{k}" for k in range(1, most + 1))]
    whole = lagged.withColumn("one", F.lit(1.0)).dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs))
    sums = whole.groupBy("symbol").agg(moments.alias("moments"))

    def tests(values: list[float]) -> list[tuple[int, int, float, float]]:
        g = dict(zip(pairs, values, strict=True))
        g |= {(b, a): v for (a, b), v in g.items()}

        def residual(used: list[str]) -> float:
            a = np.array([[g[p, q] for q in used] for p in used])
            v = np.array([g[p, "y0"] for p in used])
            return max(g["y0", "y0"] - float(v @ np.linalg.lstsq(a, v, rcond=None)[0]), 0.0)

        n, out = int(g["one", "one"]), []
        for k in lags:
            short = ["one", *(f"y{i}" for i in range(1, k + 1))]
            full = [*short, *(f"x{i}" for i in range(1, k + 1))]
            free = n - len(full)
            rest, more = residual(full), residual(short)
            if free > 0 and rest > 0:
                f = (more - rest) / k / (rest / free)
                out.append((k, n, float(f), incomplete_beta(free / 2, k / 2, free / (free + k * max(f, 0.0)))))
        return out

    def run(batches):
        for batch in batches:
            rows = [(s, *t) for s, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in tests(m)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["symbol", "lag", "n", "f", "p_value"])

    return sums.mapInArrow(run, "symbol string, lag int, n long, f double, p_value double")
