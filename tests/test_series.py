"""Chunking must change nothing, and no feature may look ahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.operators import features as X
from tidewater.operators import fracdiff as D
from tidewater.operators.series import asof_join, islands, ordinal, rolling, running_sums


def made(spark, n=400, symbols=("a", "b")):
    rng = np.random.default_rng(0)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(n):
            if rng.random() < 0.95:
                c = float(close[i])
                rows.append((s, i * HOUR, c * 0.999, c * 1.01, c * 0.99, c, float(rng.integers(0, 50)), 1, 1.0))
    return spark.createDataFrame(rows, "symbol string, open_us long, open double, high double, low double, close double, volume double, trades long, taker_buy double")


@pytest.mark.parametrize("rows, span", [(7, 5 * HOUR), (50, 40 * HOUR), (10**6, 10**15)])
def test_rolling_is_the_same_for_any_chunking(spark, rows, span):
    b = made(spark)
    cols = lambda w: {"m": F.avg("close").over(w.rowsBetween(-9, 0)), "nxt": F.lead("close", 3).over(w)}
    got = rolling(b, ["symbol"], ["open_us"], 9, cols, ahead=3, rows=rows, span=span).toPandas().sort_values(["symbol", "open_us"])
    p = b.toPandas().sort_values(["symbol", "open_us"])
    assert len(got) == len(p)
    assert np.allclose(got.m, p.groupby("symbol").close.transform(lambda x: x.rolling(10, 1).mean()))
    assert np.allclose(got.nxt, p.groupby("symbol").close.shift(-3), equal_nan=True)
    assert list(got.pos) == list(p.groupby("symbol").cumcount())


def test_running_sums_and_ordinals(spark):
    b = made(spark)
    got = running_sums(ordinal(b, ["symbol"], ["open_us"], span=30 * HOUR), ["symbol"], ["open_us"], {"v": "volume"}, 17 * HOUR).toPandas().sort_values(["symbol", "open_us"])
    p = b.toPandas().sort_values(["symbol", "open_us"])
    assert np.allclose(got.v, p.groupby("symbol").volume.cumsum()) and list(got.pos) == list(p.groupby("symbol").cumcount())


@pytest.mark.parametrize("span", [3 * HOUR, 10**15])
@pytest.mark.parametrize("tolerance", [None, 5 * HOUR])
def test_asof_equals_pandas(spark, span, tolerance):
    left = made(spark).select("symbol", F.col("open_us").alias("t"), "close")
    right = made(spark).where("open_us % 7200000000 = 0 and (open_us < 3600000000 * 50 or open_us > 3600000000 * 90)").select("symbol", F.col("open_us").alias("u"), "volume")
    got = asof_join(left, right, ["symbol"], "t", "u", tolerance, span=span).toPandas().sort_values(["t", "symbol"])
    want = pd.merge_asof(left.toPandas().sort_values(["t", "symbol"]), right.toPandas().sort_values("u"), left_on="t", right_on="u", by="symbol", tolerance=tolerance)
    assert np.array_equal(got.r_u.to_numpy(float), want.u.to_numpy(float), equal_nan=True)
    assert np.array_equal(got.r_volume.to_numpy(float), want.volume.to_numpy(float), equal_nan=True)


def test_islands(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "x", None, None, "y", "x"])], "symbol string, t long, s string")
    got = [(r.island, r.age_rows, r.age) for r in islands(df, ["symbol"], "t", "s").orderBy("t").collect()]
    assert got == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 0)]


def test_ewm_std_equals_pandas(spark):
    b = X.base_features(made(spark)).drop("pos")
    got = X.ewm_std(b, "log_return", 12).toPandas().sort_values(["symbol", "open_us"])
    p = b.toPandas().sort_values(["symbol", "open_us"])
    want = p.groupby("symbol").log_return.transform(lambda x: x.ewm(span=12, adjust=False, min_periods=12).std())
    assert np.allclose(got.ewm_std, want, equal_nan=True, rtol=1e-6)


@pytest.mark.parametrize("rows", [60, 10**6])
def test_fractional_difference_equals_convolution(spark, rows):
    b = made(spark).withColumn("x", F.when(F.col("open_us") % (7 * HOUR) != 0, F.ln("close")))
    got = D.fractional_difference(b, "x", 0.45, 1e-2, "fd", rows=rows).toPandas().sort_values(["symbol", "open_us"])
    w = D.weights(0.45, 1e-2)
    for _, g in got.groupby("symbol"):
        x = g.dropna(subset=["x"])
        want = np.convolve(x.x, w)[: len(x)]
        assert np.isnan(x.fd[: len(w) - 1]).all() and np.allclose(x.fd[len(w) - 1 :], want[len(w) - 1 :])
    assert np.isclose(D.weights(1.0, 1e-9)[1], -1) and len(D.weights(0.45, 1e-3)) == 49


CAUSAL = {
    "base": lambda b: X.base_features(b),
    "rolling": lambda b: X.rolling_statistics(b),
    "distances": lambda b: X.distances(b),
    "ewm": lambda b: X.ewm_std(X.base_features(b).drop("pos"), "log_return", 6),
    "timeframe": lambda b: X.multi_timeframe(b),
    "fractional": lambda b: D.fractional_features(b),
    "regime": lambda b: X.regime_ages(b),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_features_of_a_prefix_are_the_prefix_of_features(spark, name):
    b, cut = made(spark, 160, ("a",)), 100 * HOUR
    whole = CAUSAL[name](b).where(F.col("open_us") < cut)
    part = CAUSAL[name](b.where(F.col("open_us") < cut))
    key = lambda df: df.toPandas().sort_values("open_us").reset_index(drop=True)[sorted(df.columns)]
    pd.testing.assert_frame_equal(key(whole), key(part))


@pytest.mark.parametrize("span", [2, 9])
def test_ewm_blocks_hand_on_their_sums(spark, span):
    rng = np.random.default_rng(12)
    values = [None if i < 3 or 400 <= i < 420 or rng.random() < 0.1 else float(v) for i, v in enumerate(rng.normal(0, 1, 1200))]
    b = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("t", 0, None), ("t", 1, 1.0)], "symbol string, open_us long, x double")
    got = {(r.symbol, r.open_us): r.ewm_std for r in X.ewm_std(b, "x", span).collect()}
    a, w, w2, wx, wxx, n = 2 / (span + 1), 0.0, 0.0, 0.0, 0.0, 0
    for i, v in enumerate(values):
        w, w2, wx, wxx = w * (1 - a), w2 * (1 - a) ** 2, wx * (1 - a), wxx * (1 - a)
        if v is not None:
            c = a if n else 1.0
            w, w2, wx, wxx, n = w + c, w2 + c * c, wx + c * v, wxx + c * v * v, n + 1
        want = None if n < span or w * w <= w2 else max((wxx / w - (wx / w) ** 2) * w * w / (w * w - w2), 0) ** 0.5
        assert (got["s", i] is None) == (want is None) and (want is None or abs(got["s", i] - want) < 1e-7), i
    assert got["t", 1] is None
