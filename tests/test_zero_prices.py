"""Bars that touch or close at a price of 0: queries hold against their SQL, whatever is infinite or missing there."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewater.plans.registry import ORACLES, QUERIES

HOUR = 3_600_000_000
COEFFICIENTS = ["coefficient_p_values", "feature_verdicts", "information_coefficients"]


def written(folder, zeros):
    """Events of two symbols over 120 hours, three to seven an hour; `zeros` names the place of the 0 in every 11th hour."""
    rows, k = [], 0
    for symbol in ("click", "view"):
        for h in range(120):
            n = 3 + (h * 5 + len(symbol)) % 5
            for i in range(n):
                value = float((h * 37 + i * 53 + len(symbol) * 11) % 97 + 1) / 2
                if h % 11 == 4 and ((zeros == "inside" and i == 1) or (zeros == "last" and i == n - 1) or zeros == "all"):
                    value = 0.0
                rows.append((k, 1_704_067_200_000_000 + h * HOUR + i * 60_000_000, k % 5, symbol, value))
                k += 1
    ids, ts, users, kinds, values = zip(*rows, strict=True)
    table = pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": list(kinds), "value": list(values)})
    pq.write_table(table, f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    got, want = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns, names = got.columns, [c[0] for c in want.description]
    show = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    flat = lambda rows, by: sorted(tuple(show(r[by.index(c)]) for c in sorted(columns)) for r in rows)
    assert sorted(columns) == sorted(names)
    return flat([tuple(r) for r in got.collect()], columns), flat(want.fetchall(), names)


def test_matched_states_with_a_price_of_zero(spark, tmp_path):
    """failed by a division by zero."""
    for zeros in ("inside", "last", "all"):
        at = tmp_path / zeros
        at.mkdir()
        rows = QUERIES["matched_states"](spark, written(at, zeros)).collect()
        assert len(rows) == 2 * 3 * len({r.window for r in rows}) and all(r.regime in ("bear", "neutral", "bull") for r in rows)


@pytest.mark.parametrize("zeros", ["inside", "all"])
def test_state_statistics_with_a_price_of_zero(spark, tmp_path, zeros):
    """failed by a division by zero; means over 0 / 0 are NaN and not 0."""
    got, want = both(spark, written(tmp_path, zeros), "state_statistics")
    assert got == want and any("inf" in r or "nan" in r for r in got)


@pytest.mark.parametrize("zeros", ["inside", "last"])
def test_base_features_with_a_price_of_zero(spark, tmp_path, zeros):
    """the SQL gave infinite ranges where NULL is the only missing value."""
    got, want = both(spark, written(tmp_path, zeros), "bars_base_features")
    assert got == want and any("-" in r for r in got)


@pytest.mark.parametrize("zeros", ["inside", "last"])
def test_best_prices_with_a_price_of_zero(spark, tmp_path, zeros):
    """the SQL took a bid of 0 for a bid."""
    got, want = both(spark, written(tmp_path, zeros), "best_prices")
    assert got == want


@pytest.mark.parametrize("name", COEFFICIENTS)
@pytest.mark.parametrize("zeros", ["inside", "last"])
def test_coefficients_with_a_price_of_zero(spark, tmp_path, name, zeros):
    """F5 to F7: the SQL ranked infinite ranges and correlated them."""
    got, want = both(spark, written(tmp_path, zeros), name)
    assert got == want
