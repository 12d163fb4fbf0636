"""Steps that have to stay small on large tables give what their plain forms give."""

import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tidewater.operators import cycle as C
from tidewater.operators import evaluation as E
from tidewater.operators import labels as B
from tidewater.operators import metrics as M
from tidewater.operators import models as L
from tidewater.operators import search as H
from tidewater.operators import selection as P
from tidewater.sources.store import scope
from tidewater.streaming import jobs as J


def test_hash_tables_are_sparks_hash(spark):
    ids, seeds = np.array([0, 1, -5, 2**40, *range(100, 6000)]), np.arange(0, 21)
    want = {(r.s, r.i): r.h for r in spark.createDataFrame([(int(i),) for i in ids], "i long").crossJoin(spark.createDataFrame([(int(s),) for s in seeds], "s int")).select("s", "i", F.xxhash64("s", "i").alias("h")).collect()}
    got = {}
    for a, b, h in (table := M.HashTable(seeds, ids)).tables():
        done = table.finished(h.copy())
        got |= {(int(seeds[a + i]), int(ids[b + j])): int(done[i, j]) for i in range(h.shape[0]) for j in range(h.shape[1])}
    assert got == want


@pytest.mark.parametrize(("chunk", "width"), [(1 << 16, 8.0), (20, 8.0), (20, 0.5)])
def test_draws_of_many_seeds(spark, chunk, width):
    e = spark.range(100).select(F.lit(3).alias("fold"), F.col("id").alias("event_id"), (F.col("id") % 7 / 10.0).alias("net"), F.lit(0).cast("long").alias("decision_us"), (F.col("id") * 3600 * 10**6).alias("exit_us"))
    got = {r.seed: (r.n, round(r.sum_net, 9), round(r.sum_hold, 6)) for r in M.placebo(e, ["fold"], spark.createDataFrame([(3, 9)], "fold int, n long"), 1100, chunk, width).collect()}
    ids = np.arange(100)
    for seed in range(1100):
        took = ids[np.argsort(M.spark_hash(seed, ids))[:9]]
        assert got[seed] == (9, round(float((took % 7 / 10.0).sum()), 9), float(took.sum()))


def test_members_sort_no_repeats(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2)], "s string, f int")
    usable = spark.createDataFrame([("a", 1)] * 5 + [("c", 2), ("c", 3)], "s string, f int")
    got = E.members(rows, usable, ["s", "f"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 1), ("c", 2)]
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()  # the index has a row a key before it is joined


def test_votes_are_parsed_once_a_candidate(spark):
    texts = ['x\n```json\n{"vote": "BUY", "confidence": 70}\n```', '\n\t{"vote": "SELL", "confidence": 60}', 'so {"vote": "HOLD", "confidence": 0.5} {more}', "5", "", None, '{"vote": broken} ```{"vote": "BUY", "confidence": 1}```', "```{no}``` {", "plain"]
    df = C.extracted_votes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = [(r.vote, r.confidence, r.valid) for r in df.orderBy("i").collect()]
    none = (None, None, False)
    assert got == [("BUY", 70, True), ("SELL", 60, True), ("HOLD", 50, True), none, none, none, ("BUY", 100, True), none, none]
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") <= 3


def test_batch_stops_pass_positions_in_order_through_few_calls(spark):
    rows = []
    for p in range(40):
        side, entry, stop = ("BUY", 104.0, 101.0) if p % 2 else ("SELL", 104.0, 107.0)
        rows += [(f"p{p}", 1_000_000 * i, side, entry, stop, None if (p, i) == (3, 2) else 104.0 + (p * 7 + i * i * 3) % 17 - 8.0) for i in range(30)]
    ticks = spark.createDataFrame(rows, "position_id string, us long, side string, entry double, stop double, price double").withColumn("ts", F.timestamp_micros("us")).drop("us")
    want = []
    for p in range(40):
        state = None
        for _, us, side, entry, stop, price in (r for r in rows if r[0] == f"p{p}"):
            sign, risk = (1.0 if side == "BUY" else -1.0), abs(entry - stop)
            state = state or (sign, entry, risk, stop, entry + 2 * risk * sign, False, False)
            state, event = J._step(state, float("nan") if price is None else price)
            if event:
                want.append((f"p{p}", us, price, event, state[3]))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # positions go over the ends of batches
    try:
        df = J.manage_stops(ticks)
        got = [tuple(r) for r in df.select("position_id", F.unix_micros("ts"), "price", "event", "stop").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(want) and len(want) > 40
    assert "GroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()  # no call of Python a position


def test_reliability_ranks_only_rows_at_borders(spark):
    rng = np.random.default_rng(5)
    rows = [("k" + str(i % 3), i, f"s{i % 2}", None if i % 41 == 0 else [0.5, 0.2, float(rng.random())][i % 7 % 3], int(rng.random() < 0.4), float(0.5 + rng.random())) for i in range(400)] + [("few", i, "s", 0.1, 1, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, decision_us long, symbol string, p double, y int, w double")
    got = {(r.k, r.bin): (r.n, r.weight, r.mean_score, r.rate, r.weighted_rate) for r in M.reliability(df, "p", "y", "w", ["k"], 10, span=50).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[3] is not None, r[3] or 0.0, r[1], r[2]))
        for b, at in enumerate(np.array_split(np.arange(len(own)), 10)):
            part = [own[i] for i in at]
            if part:
                known, w = [r[3] for r in part if r[3] is not None], sum(r[5] for r in part)
                want[k, b] = (len(part), w, np.mean(known) if known else None, np.mean([r[4] for r in part]), sum(r[5] * r[4] for r in part) / w)
    assert got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for key in want for a, b in zip(got[key], want[key], strict=True))


def mixed_events(spark, n=1500):
    """Events in three folds with numbers, a category and missing values of both; few distinct values a column."""
    rng, rows = np.random.default_rng(1), []
    for i in range(n):
        a, b, c = int(rng.integers(0, 40)), int(rng.integers(0, 10)), f"k{rng.integers(0, 5)}"
        chance = 1 / (1 + np.exp(-(a / 10 - 2 + (b > 6) - (c == "k2"))))
        rows.append((i, 1 + i * 3 // n, i * 3600 * 10**6, (i + 2) * 3600 * 10**6, float(a) if i % 7 else None, float(b), None if i % 11 == 0 else c, int(rng.random() < chance), 0.5 + float(rng.random())))
    return spark.createDataFrame(rows, "event_id long, fold int, decision_us long, exit_us long, a double, b double, c string, win int, u double").cache()


def count_jobs(spark, run):
    group = f"counted {id(run)} {time.time()}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("others", "")
    return out, n


def test_arms_and_folds_are_fitted_together_like_sparks_trees(spark):
    e = mixed_events(spark)
    frozen = {3: {"depth": 2, "l2": 20, "rate": 0.3, "w": 2, "bag": 0, "trees": 3}}
    arms = [(["a", "b"], ["c"]), (["b"], ["c"]), (["a"], [])]
    run = lambda arms: {(r.event_id, i): p for r in L.walk_forwards(e, arms, "win", "u", [2, 3], 0, 5, 3, frozen).collect() for i, p in enumerate(r._arms)}
    (got, many), (_, one) = count_jobs(spark, lambda: run(arms)), count_jobs(spark, lambda: run(arms[:1]))
    assert many <= one + 3  # all arms share their passes
    for k in (2, 3):
        for i, (numeric, kinds) in enumerate(arms):
            flagged = L._flagged(e, numeric, "win")
            start = flagged.where(F.col("fold") == k).agg(F.min("decision_us")).first()[0]
            train = L._balanced(flagged.where((F.col("fold") < k) & (F.col("exit_us") < start)), "u")
            how = dict(maxIter=3, maxDepth=2, minInstancesPerNode=20, stepSize=0.3) if k == 3 else dict(maxIter=5, maxDepth=3)
            model = Pipeline(stages=[*L._stages(numeric, kinds), GBTClassifier(labelCol="_y", weightCol="_w", seed=7, maxBins=64, **how)]).fit(train)
            for r in model.transform(flagged.where(F.col("fold") == k)).select("event_id", L.probability().alias("p")).collect():
                assert got[r.event_id, i] == pytest.approx(r.p, abs=1e-9)


def test_frozen_trees_may_draw_columns_and_rows(spark):
    e = mixed_events(spark, 900)
    frozen = {3: {"depth": 3, "l2": 3, "rate": 0.3, "w": 1, "bag": 1, "trees": 3}}
    run = lambda df: {r.event_id: r.p for r in L.walk_forward(df, ["a", "b"], ["c"], "win", "u", [3], 0, "p", frozen=frozen).collect()}
    got = run(e)
    assert len(got) == 300 and len(set(got.values())) > 4 and got == run(e.repartition(3, "b"))  # the layout of the table changes nothing


def test_search_fits_all_configurations_together_on_grouped_rows(spark):
    e = mixed_events(spark).withColumn("symbol", F.lit("s"))
    axes = {"depth": [2, 4], "l2": [3, 40], "rate": [0.3], "w": [2], "bag": [0]}

    def run(axes):
        with scope() as written:
            rows = H.nested_search(e, ["b"], ["c"], "win", "u", [2, 3], 0, axes, iterations=5).collect()
        return {(r.fold, r.depth, r.l2): (r.inner_loss, r.trees) for r in rows}, [spark.read.parquet(p).count() for p in written if "binned" in p]

    ((got, sizes), many), (_, one) = count_jobs(spark, lambda: run(axes)), count_jobs(spark, lambda: run(axes | {"depth": [4], "l2": [3]}))
    assert many < 1.5 * one and len(got) == 8  # all configurations share their passes; those that stop early end theirs
    assert sizes and max(sizes) <= 2 * 2 * 2 * 10 * 6  # folds, labels, parts and values; there are 1,500 rows
    for k in (2, 3):
        start = e.where(F.col("fold") == k).agg(F.min("decision_us")).first()[0]
        past = L._flagged(e.where((F.col("fold") < k) & (F.col("exit_us") < start)), ["b"], "win").orderBy("decision_us").toPandas()
        n = len(past) // 4
        begin = past["decision_us"].iloc[-n]
        ids = spark.createDataFrame([(int(i), j >= len(past) - n) for j, (i, x) in enumerate(zip(past["event_id"], past["exit_us"], strict=True)) if j >= len(past) - n or x < begin], "event_id long, _valid boolean")
        rows = L._flagged(e, ["b"], "win").join(ids, "event_id")
        ready = Pipeline(stages=L._stages(["b"], ["c"])).fit(rows.where("not _valid")).transform(rows)
        ready = L._balanced(ready.where("not _valid"), "u").unionByName(ready.where("_valid").withColumn("_w", F.col("u"))).cache()
        for depth in axes["depth"]:
            for least in axes["l2"]:
                model = GBTClassifier(labelCol="_y", weightCol="_w", seed=7, maxBins=64, maxIter=5, maxDepth=depth, minInstancesPerNode=least, stepSize=0.3, validationIndicatorCol="_valid", validationTol=0.0).fit(ready)
                scored = model.transform(ready.where("_valid")).select(L.probability().alias("p"), "_y", "u", F.lit(1).alias("k"))
                loss = M.losses(scored, "p", "_y", "u", ["k"]).first().weighted_log_loss
                assert got[k, depth, least] == (pytest.approx(loss, abs=1e-9), len(model.trees))


@pytest.mark.parametrize("span", [1000, 7])
def test_last_share_ranks_only_the_span_where_it_begins(spark, span):
    rows = [(k, i * 37 % 101 // 2, f"s{i % 3}", i) for k, n in ((1, 60), (2, 7), (3, 1), (4, 3)) for i in range(n)]
    e = spark.createDataFrame(rows, "fold int, decision_us long, symbol string, i long")
    for share, up in ((0.25, False), (0.2, True), (0.0, False), (1.0, False)):
        out = B.last_share(e, share, up=up, span=span)
        got = {k: sorted((r.decision_us, r.symbol) for r in out.collect() if r.fold == k and r.validation) for k in (1, 2, 3, 4)}
        for k in got:
            own = sorted((t, s) for f, t, s, _ in rows if f == k)
            n = int(np.ceil(len(own) * share) if up else len(own) * share)
            assert got[k] == own[len(own) - n :]
        assert out.count() == len(rows) and out.columns == [*e.columns, "validation"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "_before_n" not in plan  # no ranks of all rows


def test_permuted_rows_are_scored_once_and_not_written_for_each_feature(spark):
    e = mixed_events(spark).withColumns({"symbol": F.lit("s"), "d": F.col("event_id") % 13 / 1.0, "f": F.col("event_id") % 5 / 1.0})
    with scope() as written:
        out = P.select_features(e, ["b", "d", "f"], "win", "u", [2, 3])
        assert len(out.collect()) == 3
    tables = {p.rsplit("/", 1)[1].split("-")[0]: spark.read.parquet(p) for p in written}
    assert tables["permuted"].count() == P.REPEATS * tables["parts"].where("part = 'validation'").count()
    kinds = tables["scores"].groupBy("outer", "feature", "repeat", "_s", "_y").count()
    assert kinds.count() == tables["scores"].count() and tables["scores"].agg(F.countDistinct("outer", "feature", "repeat")).first()[0] == 2 * (1 + 3 * P.REPEATS)
    mass = {(r.outer, r.feature, r.repeat): r.u for r in tables["scores"].groupBy("outer", "feature", "repeat").agg(F.sum("_u").alias("u")).collect()}
    assert all(u == pytest.approx(mass[k, -1, 0]) for (k, _, _), u in mass.items())  # every row is scored for every feature and repeat
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()  # areas come from sums, forests score no second time


def test_search_refuses_validation_rows_without_weight(spark):
    e = mixed_events(spark, 300).withColumns({"symbol": F.lit("s"), "u": F.when(F.col("event_id") != 199, F.col("u"))})  # the last before fold 3
    with pytest.raises(ValueError, match="weights"):
        H.nested_search(e, ["b"], [], "win", "u", [3], -48 * 3600 * 10**6, {"depth": [2], "l2": [3], "rate": [0.3], "w": [2], "bag": [0]}, iterations=2)
