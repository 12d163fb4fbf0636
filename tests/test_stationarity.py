"""Dickey-Fuller tests and order selection against direct regressions on whole series."""

import math

import numpy as np
import pytest

from tidewater.functions.columns import HOUR
from tidewater.operators import stationarity as T
from tidewater.operators.fracdiff import weights


def direct(x):
    """Lag, statistic and p-value by least squares on the whole series."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(z):
        beta, *_ = np.linalg.lstsq(z[:, 1:], z[:, 0], rcond=None)
        rest = z[:, 0] - z[:, 1:] @ beta
        return beta, rest @ rest

    whole = T.design(x, most)
    aic = [len(whole) * math.log(fit(whole[:, : p + 3])[1] / len(whole)) + 2 * (p + 2) for p in range(most + 1)]
    lag = int(np.argmin(aic))
    z = T.design(x, lag)
    beta, rss = fit(z)
    error = math.sqrt(rss / (len(z) - lag - 2) * np.linalg.inv(z[:, 1:].T @ z[:, 1:])[1, 1])
    return lag, beta[1] / error, T.mackinnon_p(beta[1] / error)


def made(n=400):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=n)
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.5 * ar[i - 1] + noise[i]
    return {"walk": np.cumsum(noise) + 50, "noise": noise, "ar": ar, "short": noise[:30], "flat": np.full(n, 2.0)}


@pytest.mark.parametrize("rows", [7, 97, 50_000])
def test_chunked_moments_equal_direct_regressions(spark, rows):
    data = [(s, i, float(v)) for s, x in made().items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "symbol string, q long, x double")
    got = {r.symbol: r for r in T.dickey_fuller(df, ["symbol"], "x", "q", rows).collect()}
    assert set(got) == {"walk", "noise", "ar", "flat"} and got["flat"].p_value is None
    for name in ("walk", "noise", "ar"):
        lag, stat, p = direct(made()[name])
        assert got[name].lag == lag
        assert (got[name].stat, got[name].p_value) == pytest.approx((stat, p), rel=1e-6, abs=1e-12)
    assert got["noise"].p_value < 0.01 < 0.05 < got["walk"].p_value


def test_published_critical_values():
    # 1, 5 and 10 percent points of the statistic with a constant, large samples
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.1)):
        assert T.mackinnon_p(stat) == pytest.approx(p, abs=2e-3)
    assert (T.mackinnon_p(-20), T.mackinnon_p(3)) == (0, 1)


def test_smallest_fitting_order(spark):
    series = made()
    data = [(s, i * HOUR, float(v)) for s, x in series.items() for i, v in enumerate(x)] + [("walk", 10**12, None)]
    df = spark.createDataFrame(data, "symbol string, open_us long, x double")
    got = {r.symbol: r for r in T.order_selection(df, "x", threshold=1e-2, rows=53).collect()}
    assert got["short"].reason == "too_few_rows" and got["short"].selected_d == 0.45
    assert got["flat"].reason == "no_order_fits" and got["flat"].p_value is None
    for name in ("walk", "noise", "ar"):
        x, want = series[name], None
        for d in T.GRID:
            w = weights(d, 1e-2)
            fd = np.convolve(x, w)[len(w) - 1 : len(x)]
            c, (_, _, p) = np.corrcoef(x[len(w) - 1 :], fd)[0, 1], direct(fd)
            if abs(c) >= 0.3 and p <= 0.05:
                want = (d, p, c)
                break
        r = got[name]
        if want is None:
            assert (r.selected_d, r.reason) == (0.45, "no_order_fits")
        else:
            assert (r.selected_d, r.p_value, r.correlation) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "symbol string, open_us long, x double")
    assert T.order_selection(df, "x", threshold=1e-2).count() == 0
