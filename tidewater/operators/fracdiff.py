"""Fixed-width fractional differencing and the features built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.features import back, full, KEYS, legacy_regime_features, ORDER
from tidewater.operators.series import ROWS, ordinal, rolling
from tidewater.sources.store import materialise


def weights(d: float, threshold: float, most: int = 100_000) -> np.ndarray:
    """Weights by age until they fall below `threshold`."""
    w = [1.0]
    while len(w) < most:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return np.array(w)


def _convolved(df: DataFrame, x: str, kernels: dict[float, np.ndarray], rows: int) -> DataFrame:
    """symbol, open_us, _k, d, fd, base: the differences of all orders in `kernels`, each from its full width on.

    Non-null values get ordinals `_k` of their own and are dealt into chunks that carry a halo as
    wide as the widest kernel; each chunk is one convolution for each kernel.
    """
    widest = max(len(w) for w in kernels.values())
    present = ordinal(df.where(F.col(x).isNotNull()).select(*KEYS, *ORDER, x), KEYS, ORDER, "_k")
    lo, hi = F.floor(F.col("_k") / rows), F.floor((F.col("_k") + widest - 1) / rows)
    spread = present.withColumn("_chunk", F.explode(F.sequence(lo, hi)))

    def convolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("_k")
        v = table.column(x).to_numpy()
        k, chunk = table.column("_k").to_numpy(), table.column("_chunk")[0].as_py() if len(v) else 0
        own = (k >= chunk * rows) & (k < (chunk + 1) * rows)
        got = []
        for d, w in kernels.items():
            out = np.convolve(v, w)[: len(v)] if len(v) else v
            keep = np.flatnonzero(own & (np.arange(len(v)) >= len(w) - 1))
            part = table.select([*KEYS, *ORDER, "_k"]).take(pa.array(keep, pa.int64()))
            part = part.append_column("d", pa.array(np.full(len(keep), d), pa.float64()))
            part = part.append_column("fd", pa.array(out[keep], pa.float64()))
            got.append(part.append_column("base", pa.array(v[keep], pa.float64())))
        return pa.concat_tables(got)

    schema = f"symbol {dict(df.dtypes)['symbol']}, open_us long, _k long, d double, fd double, base double"
    return spread.groupBy(*KEYS, "_chunk").applyInArrow(convolve, schema)


def fractional_difference(df: DataFrame, x: str, d: float, threshold: float, name: str, rows: int = ROWS) -> DataFrame:
    """Add `name`: the difference of order d over the non-null values of `x`, NULL before the width is full."""
    got = _convolved(df, x, {d: weights(d, threshold)}, rows)
    return df.join(got.select(*KEYS, *ORDER, F.col("fd").alias(name)), [*KEYS, *ORDER], "left")


def fractional_features(bars: DataFrame, d: float = 0.45, threshold: float = 1e-3) -> DataFrame:
    """Fractional close and volume, fractional return, its deviation and the range, all floored in the log."""
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))
    b = bars.withColumns({"_c": log("close"), "_v": log("volume"), "fd_range": log("high") - log("low")})
    b = fractional_difference(fractional_difference(b, "_c", d, threshold, "fd_close"), "_v", d, threshold, "fd_volume")
    b = rolling(b, KEYS, ORDER, 1, lambda w: {"fd_return": F.col("fd_close") - F.lag("fd_close").over(w)}).drop("pos")

    def statistics(w) -> dict[str, Column]:
        f, g = back(w, 24), back(w, 8)
        r = F.col("fd_return")
        return {"fd_vol": full(r, 24, f, F.stddev_samp(r).over(f)), "fd_trend": full(r, 8, g, F.avg(r).over(g), 3)}

    return rolling(b, KEYS, ORDER, 24, statistics).drop("_c", "_v", "pos")




REGIME_COLUMNS = ("fd_return", "fd_volatility", "fd_log_range", "fd_log_volume", "fd_trend")


def regime_features(bars: DataFrame, d: float = 0.45, threshold: float = 1e-3) -> DataFrame:
    """Complete rows of the five regime features and their mode: `fractional_diff`, or `legacy` for symbols without a single
    complete fractional row, as short series are."""
    named = lambda df, names, mode: df.select(*KEYS, *ORDER, *(F.col(n).alias(c) for n, c in zip(names, REGIME_COLUMNS, strict=True)), F.lit(mode).alias("feature_mode")).dropna()
    fractional = materialise(named(fractional_features(bars, d, threshold), ("fd_return", "fd_vol", "fd_range", "fd_volume", "fd_trend"), "fractional_diff"), "regime_features")
    short = bars.join(fractional.select(*KEYS).distinct(), KEYS, "left_anti")
    return fractional.unionByName(named(legacy_regime_features(short), ("ret", "deviation24", "range", "dvolume", "trend8"), "legacy"))
