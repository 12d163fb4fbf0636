"""F8, F9: buckets of a small capacity in a long series; sums of doubles lose complete buckets there."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidewater.operators import microstructure as B


def test_buckets_stay_exact_after_much_volume(spark):
    n = 4000
    head = [("s", 0, -1, 1.0, 300_000.1, True)]
    rows = head + [("s", i + 1, i, 100.0 + (i % 97) / 10, ((i * 37) % 500 + 1) / 100, i % 2 == 1) for i in range(n)]
    t = spark.createDataFrame(rows, "symbol string, us long, trade_id long, price double, qty double, is_buyer_maker boolean")
    got = B.volume_buckets(t, capacity=0.3, unit="base").where(F.col("start_us") > 0)
    found = {r.bucket: (r.buy, r.sell) for r in got.collect()}
    at, want = Decimal("300000.1"), {}
    v = Decimal("0.3")
    for _, _, i, _, q, sell in rows[1:]:
        end = at + Decimal(str(round(q, 2)))
        k = int(at // v)
        while k * v < end:
            side = want.setdefault(k, [Decimal(0), Decimal(0)])
            side[sell] += min(end, (k + 1) * v) - max(at, k * v)
            k += 1
        at = end
    first = min(want)
    whole = {k: (float(b), float(s)) for k, (b, s) in want.items() if b + s == v and k > first}
    assert whole == {k: x for k, x in found.items() if k > first}
