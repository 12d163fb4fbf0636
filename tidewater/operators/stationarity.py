"""Augmented Dickey-Fuller tests from summed moment matrices, and the order of differencing they choose."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.features import KEYS
from tidewater.operators.fracdiff import _convolved, weights
from tidewater.operators.series import ROWS
from tidewater.sources.store import materialise

GRID = (0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
# fixed values: MacKinnon's 1994 response surface for one series with a constant
TAU_LOW, TAU_TURN, TAU_HIGH = -18.83, -1.61, 2.74
TAU_SMALL_P = (2.1659, 1.4412, 0.038269)
TAU_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
LEAST_ROWS = 40


def mackinnon_p(stat: float) -> float:
    """p-value of a Dickey-Fuller statistic."""
    if stat >= TAU_HIGH or stat <= TAU_LOW:
        return float(stat >= TAU_HIGH)
    c = TAU_SMALL_P if stat <= TAU_TURN else TAU_LARGE_P
    z = sum(v * stat**i for i, v in enumerate(c))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def design(x: np.ndarray, lags: int) -> np.ndarray:
    """Change, constant, level before it and `lags` earlier changes, for each value of x that has them all."""
    n = len(x) - lags - 1
    if n <= 0:
        return np.zeros((0, lags + 3))
    step = np.diff(x)
    columns = [step[lags:], np.ones(n), x[lags:-1], *(step[lags - j : len(step) - j] for j in range(1, lags + 1))]
    return np.column_stack(columns)


def _regress(moments: np.ndarray, lags: int) -> tuple[float, float]:
    """Residual sum of squares and t-value of the level when the change is regressed on the columns up to `lags`."""
    k = lags + 2
    a, b = moments[1 : 1 + k, 1 : 1 + k], moments[0, 1 : 1 + k]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    rss = max(moments[0, 0] - beta @ b, 0.0)
    error = math.sqrt(max(rss / max(moments[1, 1] - k, 1) * inverse[1, 1], 0.0))
    return rss, beta[1] / error if error > 0 else math.nan


def statistic(moments: np.ndarray, head: np.ndarray) -> tuple[int, float]:
    """Lag of least AIC on the common rows, and the statistic of a fit on all rows that lag leaves.

    `head` holds the first values of the series; their rows are what a shorter lag adds.
    """
    most, n = len(moments) - 3, moments[1, 1]
    fits = [n * math.log(max(_regress(moments, p)[0], 1e-300) / n) + 2 * (p + 2) for p in range(most + 1)]
    lag = int(np.argmin(fits))
    more = design(head, lag)
    return lag, _regress(moments[: lag + 3, : lag + 3] + more.T @ more, lag)[1]


def _most_lags(n: Column) -> Column:
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("long")


def dickey_fuller(series: DataFrame, keys: list[str], x: str, pos: str, rows: int = ROWS) -> DataFrame:
    """keys, n, lag, stat and p_value of each series of non-null values at gapless positions from 0.

    Chunks of positions with a halo of the longest lag give moment matrices, which Spark sums entry
    by entry; the regressions then read one matrix a series. Series of fewer than LEAST_ROWS values
    give no row; those without a statistic (constant ones) have NULL in stat and p_value.
    """
    size = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mean"))
    size = size.where(F.col("n") >= LEAST_ROWS).withColumn("_lags", _most_lags(F.col("n")))
    own = series.select(*keys, F.col(pos).alias("_q"), F.col(x).alias("_x")).join(size, keys)
    own = materialise(own.withColumn("_x", F.col("_x") - F.col("_mean")).drop("_mean"), "levels")
    first = F.floor(F.col("_q") / rows)
    last = F.floor((F.least(F.col("_q") + F.col("_lags") + 1, F.col("n") - 1)) / rows)
    spread = own.withColumn("_chunk", F.explode(F.sequence(first, last)))

    def moments(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_q")
        lags, chunk, q = int(part["_lags"].iloc[0]), key[-1], part["_q"].to_numpy()
        # rows of the chunk start lags + 1 positions after the first value they need
        start = max(chunk * rows, lags + 1) - lags - 1
        z = design(part["_x"].to_numpy()[q >= start], lags)
        return pd.DataFrame([[*key[:-1], (z.T @ z).ravel()]], columns=[*keys, "m"])

    kinds = dict(series.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    parts = spread.groupBy(*keys, "_chunk").applyInPandas(moments, f"{named}, m array<double>")
    cells = parts.select(*keys, F.posexplode("m").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("m"))
    early = own.where("_q <= _lags").groupBy(*keys, "n")
    heads = early.agg(F.transform(F.array_sort(F.collect_list(F.struct("_q", "_x"))), lambda c: c["_x"]).alias("head"))

    def solve(batches):
        for batch in batches:
            got = []
            for m, head in zip(batch["m"], batch["head"], strict=True):
                side = math.isqrt(len(m))
                lag, stat = statistic(np.asarray(m).reshape(side, side), np.asarray(head))
                got.append((lag, stat, mackinnon_p(stat)) if math.isfinite(stat) else (lag, None, None))
            tested = pd.DataFrame(got, columns=["lag", "stat", "p_value"], index=batch.index)
            yield pd.concat([batch[[*keys, "n"]], tested], axis=1)

    return whole.join(heads, keys).mapInPandas(solve, f"{named}, n long, lag int, stat double, p_value double")


def order_selection(
    df: DataFrame,
    x: str,
    grid: tuple[float, ...] = GRID,
    threshold: float = 1e-5,
    most_p: float = 0.05,
    least_corr: float = 0.3,
    fallback: float = 0.45,
    rows: int = ROWS,
) -> DataFrame:
    """symbol, selected_d, p_value, correlation, reason: the smallest order whose difference tests as stationary.

    The difference must keep LEAST_ROWS values and an absolute correlation of `least_corr` with `x`.
    Otherwise `fallback` is chosen. The test of each order reads the whole series.
    """
    kernels = {float(d): weights(d, threshold, 10_000) for d in sorted(set(grid))}
    fd = materialise(_convolved(df, x, kernels, rows), "orders")
    width = F.create_map(*(F.lit(v) for d, w in kernels.items() for v in (d, len(w))))
    placed = fd.withColumn("q", F.col("_k") - F.element_at(width, F.col("d")) + 1)
    # a constant series has no correlation
    spread = F.stddev_pop("base") * F.stddev_pop("fd")
    like = fd.groupBy("symbol", "d").agg(F.try_divide(F.covar_pop("base", "fd"), spread).alias("correlation"))
    tested = dickey_fuller(placed, ["symbol", "d"], "fd", "q", rows).join(like, ["symbol", "d"])
    fit = tested.where((F.abs("correlation") >= least_corr) & (F.col("p_value") <= most_p))
    best = fit.groupBy("symbol").agg(F.min(F.struct("d", "p_value", "correlation")).alias("s"))
    rows_of = df.groupBy(*KEYS).agg(F.count(x).alias("_n"))
    reason = F.when(F.col("_n") < LEAST_ROWS, "too_few_rows").when(F.col("s").isNull(), "no_order_fits").otherwise("selected")
    return rows_of.join(best, "symbol", "left").select(
        "symbol", F.coalesce("s.d", F.lit(fallback)).alias("selected_d"), F.col("s.p_value"), F.col("s.correlation"), reason.alias("reason")
    )
