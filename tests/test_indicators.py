import numpy as np
import pytest
from test_series import made

from tidewater.functions.columns import HOUR
from tidewater.operators import indicators as I


@pytest.mark.parametrize("rows", [90, 10**6])
def test_indicators_do_not_depend_on_chunks(spark, rows, monkeypatch):
    b = made(spark, 420)
    got = I.indicators(b, rows=rows).toPandas().sort_values(["symbol", "open_us"])
    p = b.toPandas().sort_values(["symbol", "open_us"])
    for s, g in p.groupby("symbol"):
        want = I._of_series(*(g[c].to_numpy() for c in ("high", "low", "close", "volume")))
        for name in I.NAMES:
            assert np.allclose(got[got.symbol == s][name], want[name], equal_nan=True)
    rsi = got.rsi14.dropna()
    assert len(got) == len(p) and ((rsi >= 0) & (rsi <= 100)).all()


def test_smoothing_is_the_recursion():
    x = np.arange(10.0)
    got = I.smoothed(x, 0.5, 3)
    assert np.isnan(got[:2]).all() and got[2] == 1 and got[3] == 2 and got[4] == 3
    e = I._of_series(x + 1, x, x, np.ones(10))
    assert np.isnan(e["relative_volume"]).all()


def test_screener_takes_the_largest_relative_volume(spark):
    got = I.screened(made(spark, 420), 1).collect()
    assert len(got) == 1 and got[0].bars >= 250


def test_incomplete_beta_and_granger(spark):
    assert I.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)  # polynomial case, by hand
    assert I.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.concatenate([[0.0], 0.6 * x[:-1]]) + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame([("s", i * HOUR, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "symbol string, open_us long, a double, b double")
    helps = {r.lag: r.p_value for r in I.granger(df, "a", "b", (1, 2)).collect()}
    other = {r.lag: r.p_value for r in I.granger(df, "b", "a", (1, 2)).collect()}
    assert helps[1] < 1e-6 and helps[2] < 1e-6 and min(other.values()) > 0.01
