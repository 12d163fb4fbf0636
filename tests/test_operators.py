"""Hand values."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.operators import cycle as C
from tidewater.operators import labels as L
from tidewater.operators import metrics as M
from tidewater.operators import microstructure as S
from tidewater.operators.regime import fit_hmm
from tidewater.sources import archives as A
from tidewater.streaming import jobs as J


def test_books_are_sorted_and_cleaned(spark):
    rows = [("s", 1, "bid", 100.0, 2.0), ("s", 1, "bid", 101.0, 1.5), ("s", 1, "bid", None, 1.0), ("s", 1, "bid", 99.0, -2.0), ("s", 1, "ask", 103.0, 4.0), ("s", 1, "ask", 102.0, 3.0), ("s", 1, "ask", 0.0, 1.0)]
    b = S.books(spark.createDataFrame(rows, "symbol string, seq long, side string, price double, qty double")).first()
    assert [tuple(x) for x in b.bids] == [(101.0, 1.5), (100.0, 2.0)] and [tuple(x) for x in b.asks] == [(102.0, 3.0), (103.0, 4.0)]


def test_order_flow_cases(spark):
    snaps = [(100.0, 5.0, 101.0, 3.0), (100.5, 6.0, 101.0, 3.0), (100.0, 4.0, 101.0, 3.0), (100.0, 4.0, 100.5, 3.0), (100.0, 4.0, 101.0, 4.0)]
    rows = [("s", i, side, p, q) for i, (bp, bq, ap, aq) in enumerate(snaps) for side, p, q in (("bid", bp, bq), ("ask", ap, aq))]
    f = S.order_flow(S.books(spark.createDataFrame(rows, "symbol string, seq long, side string, price double, qty double")))
    # bid up: its new size; bid down: minus the old size; ask down: minus the new size; ask up: the old size
    assert [r.ofi for r in f.orderBy("seq").collect()] == [0.0, 6.0, -6.0, -3.0, 3.0]
    one = S.order_flow(S.books(spark.createDataFrame([("s", 0, "bid", 100.0, 5.0)], "symbol string, seq long, side string, price double, qty double"))).first()
    assert one.depth_imbalance == 1.0 and one.spread_bps == 0.0
    assert f.where("seq = 0").first().spread_bps == pytest.approx(1 / 100.5 * 1e4)


def test_trades_are_split_between_buckets(spark):
    rows = [("s", 1, 1, 1.0, 60.0, False), ("s", 2, 2, 1.0, 70.0, True), ("s", 3, 3, 1.0, 70.0, True)]
    b = S.volume_buckets(spark.createDataFrame(rows, "symbol string, us long, trade_id long, price double, qty double, is_buyer_maker boolean"), capacity=100.0)
    assert [(r.buy, r.sell, r.imbalance) for r in b.orderBy("bucket").collect()] == [(60.0, 40.0, 20.0), (0.0, 100.0, 100.0)]
    v = S.vpin(b, 2).first()
    assert v.vpin == pytest.approx(0.6) and v.lower_bound == pytest.approx(0.4)


def test_trade_metrics(spark):
    net = [0.01, -0.02, 0.02, -0.01]
    hold = [4, 4, 8, 12]
    rows = [("a", i * HOUR, (i + h) * HOUR, n, int(n > 0)) for i, (n, h) in enumerate(zip(net, hold, strict=True))]
    e = spark.createDataFrame(rows, "symbol string, decision_us long, exit_us long, net double, win int").withColumn("k", F.lit(1))
    m = M.trade_metrics(e, ["k"]).first()
    assert (m.max_drawdown, m.mean_hold, m.median_hold, m.sum_hold, m.expected_shortfall) == pytest.approx((0.02, 7, 6, 28, -0.02))
    assert M.COST == pytest.approx(0.003)


def test_auc_counts_ties_half(spark):
    e = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, y int").withColumn("k", F.lit(1))
    assert M.auc(e, "s", "y", ["k"]).first().auc == pytest.approx(0.875)
    assert M.auc(e.where("y = 1"), "s", "y", ["k"]).first().auc is None


def bars(spark, highs, lows):
    rows = [("s", i * HOUR, 100.0, h, l, 100.0, 0.01) for i, (h, l) in enumerate(zip(highs, lows, strict=True))]
    return spark.createDataFrame(rows, "symbol string, open_us long, open double, high double, low double, close double, vol double")


@pytest.mark.parametrize(
    "highs, lows, event",
    [([100.1] * 8, [99.9] * 8, "vertical"), ([100, 103] + [100] * 6, [99.9] * 8, "pt"), ([100] * 8, [99, 97] + [99] * 6, "sl"), ([100, 103] + [100] * 6, [99, 97] + [99] * 6, "sl")],
)
def test_barriers(spark, highs, lows, event):
    got = L.triple_barrier(bars(spark, map(float, highs), map(float, lows)), "vol", 3).orderBy("open_us").collect()
    assert got[0].tb_event == event and [r.tb_event for r in got[-3:]] == [None] * 3
    both = L.triple_barrier(bars(spark, map(float, highs), map(float, lows)), "vol", 3, both="pt").orderBy("open_us").first()
    assert both.tb_event == ("pt" if event == "sl" and highs[1] == 103 else event)


def test_uniqueness_of_overlapping_labels(spark):
    got = L.uniqueness(L.triple_barrier(bars(spark, [100.1] * 6, [99.9] * 6), "vol", 2)).orderBy("open_us").collect()
    assert [r.tb_uniqueness for r in got] == pytest.approx([0.75, 0.5, 0.5, 0.75])


def test_future_source_is_an_error(spark):
    rows = [("s", 100, 90), ("s", 200, 200), ("s", 300, 301)]
    got = C.look_ahead_audit(spark.createDataFrame(rows, "symbol string, d long, u long"), "d", "u", 50).where("symbol is null").first()
    assert got.future == 1 and got.verdict == "error"


def test_votes_and_confidence(spark):
    texts = ['x {"vote":"buy","confidence":1} y', '<think>{"vote":"SELL","confidence":9}</think>```json\n{"vote": "HOLD", "confidence": 66.5}\n```', "none", '{"vote":"UP","confidence":5}', "{broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [(r.vote, r.confidence, r.valid) for r in C.extracted_votes(df).orderBy("i").collect()]
    assert got == [("BUY", 100, True), ("HOLD", 66, True), (None, None, False), ("UP", 5, False), (None, None, False)]


def test_archives(spark, tmp_path):
    lines = ["open_time,open,high,low,close,volume,close_time,q,n,tb,tq,i"] + [f"{1_700_000_000_000 + 60_000 * i},1,2,0.5,{c},10,0,1,1,1,1,0" for i, c in ((0, 1), (1, 2), (1, 3), (2, "bad"))]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "\n".join(lines))
    (tmp_path / "b.zip").write_bytes(b"no zip")
    raw = A.zip_lines(spark, str(tmp_path))
    assert raw.where("line is null").count() == 1
    got = A.klines(raw).orderBy("open_us").collect()
    assert [(r.open_us, r.close) for r in got] == [(1_700_000_000_000_000, 1.0), (1_700_000_060_000_000, 3.0)]
    manifest = A.file_manifest(spark, str(tmp_path))
    other = manifest.withColumn("sha256", F.when(F.col("file") == "a.zip", "x").otherwise(F.col("sha256"))).where("file != 'b.zip'")
    assert {(r.file, r.change) for r in A.manifest_changes(manifest, other).collect()} == {("a.zip", "changed"), ("b.zip", "removed")}


def test_regimes_of_planted_states():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = np.repeat([0, 2, 1, 2, 0], 60)
    x = np.column_stack([np.array([-2.0, 0, 2.0])[truth] + rng.normal(0, 0.4, 300), rng.normal(0, 1, 300)])
    post, _ = fit_hmm(x)
    assert (post.argmax(1) == truth).mean() > 0.95


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(f"p{i % 3}", f"2024-01-01 00:{i:02d}:00", "BUY", 100.0, 98.0, 100.0 + (i % 7) * (i / 10)) for i in range(50)]
    ticks = spark.createDataFrame(rows, "position_id string, ts string, side string, entry double, stop double, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.repartition(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = J.manage_stops(live).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("stops")) == key(J.manage_stops(ticks)) != []
