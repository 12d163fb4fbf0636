"""Queries without SQL against hand values, brute force and planted effects."""

import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.operators import audits as A
from tidewater.operators import cycle as C
from tidewater.operators import evaluation as E
from tidewater.operators import fracdiff as D
from tidewater.operators import live as P
from tidewater.operators import metrics as M
from tidewater.operators import models as L
from tidewater.operators import regime as G
from tidewater.operators.features import base_features, rolling_statistics, trends
from tidewater.operators.indicators import incomplete_beta, with_defaults
from tidewater.operators.microstructure import volume_buckets
from tidewater.operators import search as H
from tidewater.operators import selection as P0
from tidewater.operators.fits import grouped_logistic, past_maps
from tidewater.operators.series import islands, quantiles, rolling, value_bucket, value_ordinal
from tidewater.sources import sinks as S
from tidewater.streaming import jobs as J
from tidewater.streaming import volume_clock as K

OOF = "event_id long, symbol string, fold int, decision_us long, exit_us long, p_meta double, p_primary double, ret double, uniqueness double"


def planted(spark, n=1500):
    """Events in five folds whose return follows p_meta and not p_primary."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        p, q = rng.random(2)
        ret = 0.01 if rng.random() < p else -0.008
        rows.append((i, f"P{i % 5}", 1 + i * 5 // n, i * HOUR, (i + 5) * HOUR, float(p), float(0.55 + 0.45 * q), ret, 0.5 + 0.5 * float(rng.random())))
    return M.net(spark.createDataFrame(rows, OOF)).coalesce(1).cache()


@pytest.mark.parametrize(("chunk", "width"), [(1 << 16, 8.0), (5, 8.0), (5, 1.0), (5, 0.0)])
def test_placebo_draws_equal_brute_force(spark, chunk, width):
    e = planted(spark, 120)
    sizes = spark.createDataFrame([(f, k) for f, k in zip(range(1, 6), (0, 1, 7, 23, 24), strict=True)], "fold int, n long")
    got = {(r.seed, r.fold): (r.n, round(r.sum_net, 9), round(r.sum_hold, 6)) for r in M.placebo(e, ["fold"], sizes, 5, chunk, width).collect()}
    rows, want = e.collect(), {}

    def place(seed, event):
        h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<q", event), seed=h).intdigest()
        return h - (1 << 64) if h >= 1 << 63 else h

    for seed in range(5):
        for fold, k in ((2, 1), (3, 7), (4, 23), (5, 24)):
            taken = sorted((r for r in rows if r.fold == fold), key=lambda r: place(seed, r.event_id))[:k]
            want[seed, fold] = (len(taken), round(sum(r.net for r in taken), 9), round(sum((r.exit_us - r.decision_us) / 3.6e9 for r in taken), 6))
    assert got == want


def test_learners_find_the_planted_column(spark):
    e = planted(spark)
    by = {r.feature: r for r in P0.select_features(e, ["p_meta", "p_primary"], "win", "uniqueness", [3, 4, 5]).collect()}
    assert by["p_meta"].mean_importance > 0.1 > abs(by["p_primary"].mean_importance) and by["p_meta"].kept and not by["p_primary"].kept
    frozen = {k: {"depth": 3, "l2": 3, "rate": 0.1, "w": 2, "bag": 0, "trees": 5} for k in (4, 5)}
    families = {"micro": ["p_meta"], "base": ["p_primary"], "symbol": ["symbol"]}
    arms = {(r.arm, r.fold): r.auc for r in H.arms_refitted(e, ["base", "no_micro"], families, [], ["symbol"], "win", "uniqueness", [4, 5], 2 * HOUR, frozen).collect()}
    assert min(arms["base", 4], arms["base", 5]) > 0.65 > max(arms["no_micro", 4], arms["no_micro", 5]) - 0.05
    final = L.final_refit(e, ["p_meta", "p_primary"], ["symbol"], "win", "uniqueness").withColumn("k", F.lit(1))
    assert M.auc(final, "p_final", "win", ["k"]).first()["auc"] > 0.7 and final.count() == 1500
    axes = {"depth": [1, 4], "l2": [3], "rate": [0.1], "w": [2], "bag": [0]}
    search = H.nested_search(e, ["p_meta"], [], "win", "uniqueness", [3, 4], 2 * HOUR, axes, iterations=4).collect()
    assert len(search) == 4 and [sum(r.won for r in search if r.fold == k) for k in (3, 4)] == [1, 1] and all(1 <= r.trees <= 4 for r in search)
    for k in (3, 4):
        assert min(r.inner_loss for r in search if r.fold == k) == next(r.inner_loss for r in search if r.won and r.fold == k)
    late = e.withColumn("win", F.when(F.col("fold") >= 4, 1 - F.col("win")).otherwise(F.col("win")))
    again = H.nested_search(late, ["p_meta"], [], "win", "uniqueness", [3, 4], 2 * HOUR, axes, iterations=4).collect()
    assert sorted(r.inner_loss for r in again) == sorted(r.inner_loss for r in search)  # test folds take no part
    assert len(H.configurations(H.SEARCH_AXES)) == 108


def test_calibrators_find_known_maps(spark):
    e = planted(spark).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    got = {(r.seed, r.fold): r for r in L.seed_post_mortem(e, "p_meta", "win", "uniqueness", [2, 3, 4, 5]).collect()}
    assert len(got) == 8 and got[1, 2].reason == "no_past_fold" and got[2, 2].slope is None
    assert all(abs(got[s, k].slope - 1) < 0.3 and got[s, k].trained_on == 300 * (k - 2) for s in (1, 2) for k in (3, 4, 5))
    final = {r.weighted: r for r in L.final_calibrators(planted(spark), "p_meta", "win", "uniqueness").collect()}
    assert abs(final[True].slope - 1) < 0.3 and 0.4 < final[False].base_rate < 0.6
    walk = L.walk_forward_calibration(planted(spark), "p_meta", "win", "uniqueness", [1, 2, 3])
    first = walk.where("fold = 1").first()
    assert first.p_platt == first.p_isotonic == first.p_meta
    later = walk.where("fold = 3").agg(F.min("p_isotonic").alias("a"), F.max("p_platt").alias("b")).first()
    assert 0 <= later.a and later.b <= 1


def test_abstaining_and_forced_thresholds(spark):
    e = planted(spark).withColumn("net", F.lit(-1.0))
    past = E.history_statistics(e, "p_meta", (0.4, 0.6), [2, 3, 4, 5])
    free = {r.fold: (r.threshold, r.reason) for r in E.chosen_thresholds(past, [2, 3, 4, 5]).collect()}
    assert free[2] == (0.55, "first_fold") and {free[k] for k in (3, 4, 5)} == {(1.01, "abstain")}
    forced = {r.fold: r.threshold for r in E.chosen_thresholds(past, [2, 3, 4, 5], forced=True).collect()}
    assert forced[3] == 0.6  # the smallest loss


def test_winner_ties_go_to_the_simpler(spark):
    rows = [(1, "a", 0.5, 4, 3, 0.02, 0, 1), (1, "b", 0.5 + 1e-14, 3, 3, 0.05, 1, 2), (1, "c", 0.5, 3, 9, 0.05, 1, 2), (1, "d", 0.6, 2, 9, 0.01, 0, 1)]
    df = spark.createDataFrame(rows, "fold int, config_id string, loss double, depth int, l2 int, rate double, bag int, w int")
    assert E.winner(df, ["fold"]).first().config_id == "c"


def test_states_are_carried_as_in_a_loop(spark):
    order = ["bear", "neutral", "bull"]
    far, near = [[0.0, 0.0], [5.0, 0.0], [10.0, 0.0]], [[10.1, 0.0], [0.2, 0.0], [5.1, 0.0]]
    rows = [
        ("s", 0, far, [-1.0, 0.0, 1.0], order),  # nothing before: by score
        ("s", 1, near, [-0.1, 0.0, 0.1], order),  # all pair, scores close together: carried
        ("s", 2, far, [-1.0, 0.0, 1.0], order),  # all pair, carried regimes equal the order
        ("s", 3, near, [-1.0, 0.0, 1.0], order),  # all pair, but scores are far apart: by score
        ("s", 4, near, [-0.1, 0.0, 0.1], order),  # carried from the regimes by score of window 3
        ("s", 5, [[9.9, 0.0], [0.1, 0.0], [7.2, 0.0]], [0.0, 0.0, 0.0], order),  # one state beyond 2.0: by score, though two pair
        ("s", 6, [[9.9, 0.0], [0.1, 0.0]], [0.0, 0.1], ["bear", "bull"]),  # another number of states
        ("t", 0, [[1.0, 1.0]], [0.0], ["neutral"]),
    ]
    got = {}
    df = spark.createDataFrame(rows, "symbol string, window long, centers array<array<double>>, scores array<double>, regimes array<string>")
    for r in G.match_states(df).orderBy("symbol", "window", "state").collect():
        got.setdefault((r.symbol, r.window), (r.method, []))[1].append(r.regime)
    carried = ["bull", "bear", "neutral"]
    assert got == {
        ("s", 0): ("score_order", order), ("s", 1): ("matched", carried), ("s", 2): ("matched", order), ("s", 3): ("score_order", order),
        ("s", 4): ("matched", order), ("s", 5): ("score_order", order), ("s", 6): ("score_order", ["bear", "bull"]), ("t", 0): ("score_order", ["neutral"]),
    }


def test_regimes_of_states(spark):
    def stats(*states):
        rows = [("s", 0, k * 10 + i, [1.0 if j == k else 0.0 for j in range(3)], t, r, v, g) for k, (n, t, r, v, g) in enumerate(states) for i in range(n)]
        df = spark.createDataFrame(rows, "symbol string, window long, pos long, post array<double>, trend double, ret double, vol double, range double")
        return {r.state: r for r in G.state_statistics(df).collect()}

    plain = stats((4, 0.3, 0.0, 1.0, 1.0), (3, -0.1, 0.1, 1.0, -2.0), (2, -0.1, -0.1, -3.0, 1.0))
    assert [plain[k].regime for k in range(3)] == ["bull", "neutral", "bear"]
    assert plain[2].mean_vol == 3.0 and plain[1].mean_range == 2.0 and plain[0].persistence == 0.75 and abs(plain[2].occupancy - 2 / 9) < 1e-12 and plain[2].persistence == 1.0
    level = stats((2, 0.1, 0.0, 1.0, 1.0), (3, 0.1, 0.0, 2.0, 1.0), (4, 0.1, 0.0, 1.0, 1.0))
    assert [level[k].regime for k in range(3)] == ["neutral", "bear", "bull"]
    empty = stats((2, 0.1, 0.0, 1.0, 1.0), (0, 0, 0, 0, 0), (4, 0.2, 0.0, 1.0, 1.0))
    assert empty[1].occupancy == empty[1].mean_trend == empty[1].persistence == 0.0 and empty[1].regime == "bear"


def test_policy_and_gate_branches(spark):
    rows = [("bull", 0.6, False, 1), ("bear", 0.6, False, 1), ("neutral", 0.6, False, 1), ("bull", 0.49, False, 5), ("bear", 0.9, True, 1), ("bull", 0.9, True, 2)]
    df = spark.createDataFrame([(*r, 0.2, 0.2, 0.6) for r in rows], "regime string, confidence double, changed boolean, age int, bear double, neutral double, bull double")
    assert [r.policy for r in G.policy(df, changed="changed", age="age").collect()] == ["allow", "block", "caution", "caution", "caution", "allow"]
    cases = [
        ("allow", "bull", "BUY", 0.1, 0.1, 0.0, True, 0, "ok"), ("block", "bull", "SELL", 1.0, 1.0, 1.0, False, 9, "policy"), ("allow", "bear", "BUY", 1.0, 1.0, 1.0, False, 9, "bear_in_spot"),
        ("allow", "bear", "SELL", 0.0, 0.0, 0.0, True, 0, "ok"), ("caution", "bull", "BUY", 0.69, 1.0, 1.0, False, 9, "low_conviction"), ("caution", "bull", "BUY", 0.71, 0.54, 1.0, False, 9, "unstable"),
        ("caution", "bull", "BUY", 0.71, 0.55, 0.09, False, 9, "thin_margin"), ("caution", "bull", "BUY", 0.71, 0.55, 0.1, True, 1, "fresh_switch"), ("caution", "bull", "BUY", 0.81, 0.55, 0.1, True, 1, "ok"),
        ("caution", "bull", "BUY", 0.71, 0.55, 0.1, True, 2, "ok"), (None, "neutral", "SELL", None, 1.0, 1.0, False, 9, "low_conviction"), ("block", "bear", "HOLD", 0.0, 0.0, 0.0, True, 0, "no_order"),
    ]
    df = spark.createDataFrame(cases, "policy string, regime string, side string, c double, p double, m double, changed boolean, age int, want string").coalesce(1)
    c = F.col
    g = C.gate(c("policy"), c("regime"), c("side"), c("c"), F.lit(0.6), c("p"), c("m"), c("changed"), c("age"))
    assert [r[0] for r in df.select(g.reason).collect()] == [x[-1] for x in cases]
    futures = C.gate(c("policy"), c("regime"), c("side"), c("c"), F.lit(0.6), c("p"), c("m"), c("changed"), c("age"), spot=False)
    assert df.select(futures.reason).collect()[2][0] == "ok"


def test_windows_of_a_chunk_are_fitted_as_alone(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.normal(0, 1, (90, 2)), axis=0) * 0.2 + rng.normal(0, 1, (90, 2))
    rows = [("a", i * HOUR, float(u), float(v)) for i, (u, v) in enumerate(x)] + [("b", i * HOUR, float(u), float(v)) for i, (u, v) in enumerate(x[:20])]
    df = spark.createDataFrame(rows, "symbol string, open_us long, u double, v double")
    runs = [{r.open_us: tuple(r) for r in G.walk_forward_regimes(df, ["u", "v"], 40, 1, chunk, at_once).collect()} for chunk, at_once in ((1000, 64), (7, 2))]
    assert runs[0].keys() == runs[1].keys() == {i * HOUR for i in range(39, 90)}
    assert all(np.allclose(runs[0][k][2:5], runs[1][k][2:5], atol=1e-9) for k in runs[0])
    w = np.clip(x[20:60], *np.quantile(x[20:60], [0.01, 0.99], axis=0))
    q1, q2, q3 = np.quantile(w, [0.25, 0.5, 0.75], axis=0)
    post, _ = G.fit_hmm(np.clip((w - q2) / (q3 - q1), -8, 8))
    assert np.allclose(post[-1], runs[0][59 * HOUR][2:5], atol=1e-9)


def test_reconstruction_verdicts(spark):
    def series(symbol, f, n=60):
        return [(symbol, i, 0, float(f(i))) for i in range(n)]

    rng = np.random.default_rng(8)
    noise = rng.normal(0, 1, 60)
    live = series("good", lambda i: i) + series("fair", lambda i: i) + series("bad", lambda i: i) + series("flat", lambda i: 1) + series("few", lambda i: i, 49) + series("alone", lambda i: i) + [("good", 5, 1, 5.5), ("good", 6, 1, None)]
    built = series("good", lambda i: 2 * i) + series("fair", lambda i: i + 25 * noise[i]) + series("bad", lambda i: -i) + series("flat", lambda i: i) + series("few", lambda i: i)
    schema = "symbol string, open_us long, seq int, v double"
    report = {r.symbol: r for r in E.imbalance_report(spark.createDataFrame(live, schema), spark.createDataFrame(built, schema), "v").collect()}
    want = {"good": "approved", "fair": "caution", "bad": "rejected", "flat": "insufficient_variation", "few": "insufficient_overlap", "alone": "insufficient_overlap"}
    assert {k: r.verdict for k, r in report.items()} == want
    assert report["alone"].n == 0 and report["flat"].pearson is None and report["good"].n == 60 and report["good"].median_bias == -29.5
    known = {r.symbol: r.verdict for r in E.imbalance_report(spark.createDataFrame(live, schema), spark.createDataFrame(built, schema), "v", differences=True).collect()}
    assert known["good"] == known["bad"] == "reference_only" and known["few"] == "insufficient_overlap" and known["flat"] == "insufficient_variation"


def test_breaker_trips_again_only_after_its_pause(spark):
    drops = [0.0, 0.2, 0.3, 0.0, 0.0, 0.05, 0.11, 0.0]
    df = spark.createDataFrame([("a", i * HOUR, d) for i, d in enumerate(drops)] + [("b", 0, None)], "symbol string, decision_us long, drawdown double")
    got = {(r.symbol, r.decision_us // HOUR): r.tripped_us for r in P.circuit_breaker(df, cooldown=4 * HOUR).collect()}
    assert [got["a", i] and got["a", i] // HOUR for i in range(8)] == [None, 1, 1, 1, 1, None, 6, 6] and got["b", 0] is None


def test_islands_against_a_loop(spark):
    rng = np.random.default_rng(1)
    states = [None if x == 3 else str(x) for x in rng.integers(0, 4, 300)]
    times = np.cumsum(rng.integers(1, 20, 300)).tolist()
    df = spark.createDataFrame([("k", int(t), s) for t, s in zip(times, states, strict=True)], "k string, t long, s string")
    got = {r.t: (r.island, r.age_rows, r.age) for r in islands(df, ["k"], "t", "s", span=200).collect()}
    island = begin = 0
    for i, (t, s) in enumerate(zip(times, states, strict=True)):
        if i and s != states[i - 1]:
            island, begin = island + 1, i
        assert got[t] == (island, i - begin, t - times[begin])


def test_one_series_spreads_over_tasks(spark):
    df = spark.range(4000).select(F.lit("only").alias("symbol"), F.col("id").alias("us"), (F.hash("id") / 7.0).alias("x"))
    ranked = M.average_ranks(df, ["symbol"], "x", "rank").select("rank", F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        assert ranked.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = np.argsort(np.argsort([r.x for r in df.collect()]))
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, len(order) + 1))
    values, cuts = [-1e300, -3.5, -3.4, 0.0, 0.1, 0.2, 7.0, 1e300], F.array(*map(F.lit, (-3.4, 0.1, 0.2)))
    buckets = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select(value_bucket(F.col("v"), cuts).alias("b")).collect()]
    assert buckets == [0, 0, 1, 2, 3, 5, 6, 6]


def test_crowded_scores_are_cut_by_the_data(spark):
    rng = np.random.default_rng(4)
    scores = np.concatenate([np.full(3000, 0.5), 0.5 + 0.001 * rng.random(6000)])
    rows = [("k", float(v), int(i) * HOUR, f"s{i % 3}", int(rng.random() < v), 1.0) for i, v in enumerate(rng.permutation(scores))]
    e = spark.createDataFrame(rows, "fold string, p double, decision_us long, symbol string, y int, w double").repartition(3).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = value_ordinal(e, ["fold"], ["p", "decision_us", "symbol"], "rank").select("p", "decision_us", "symbol", "rank", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.rank for r in sorted(ranked, key=lambda r: (r.p, r.decision_us, r.symbol))] == list(range(9000))
    shares = [sum(r.part == k for r in ranked) for k in range(4)]
    assert max(shares) < 4500  # neither the crowd nor the third of equal scores is in one task
    x, y = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
    more = (x[y == 1][:, None] > x[y == 0]).mean() + (x[y == 1][:, None] == x[y == 0]).mean() / 2
    assert abs(M.auc(e, "p", "y", ["fold"]).first()["auc"] - more) < 1e-12
    assert abs(M.weighted_auc(e, "p", "y", "w", ["fold"]).first()["auc"] - more) < 1e-12
    q = quantiles(e, ["fold"], "p", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.913, "e": 1.0}).first()
    assert np.allclose([q[n] for n in "abcde"], np.quantile(x, [0.0, 0.3, 0.5, 0.913, 1.0]), atol=1e-15)


def test_test_folds_take_no_part_in_selection(spark):
    e = planted(spark)
    flip = lambda k: e.withColumns({"win": F.when(F.col("fold") >= k, 1 - F.col("win")).otherwise(F.col("win")), "p_meta": F.when(F.col("fold") >= k, 0.5).otherwise(F.col("p_meta"))})
    chosen = lambda df, folds: sorted((r.feature, round(r.mean_importance, 9), r.kept) for r in P0.select_features(df, ["p_meta", "p_primary"], "win", "uniqueness", folds, 2 * HOUR).collect())
    assert chosen(e, [2, 3, 4, 5]) == chosen(flip(5), [2, 3, 4, 5])
    assert chosen(e, [3]) == chosen(flip(3), [3]) != chosen(flip(2), [3])
    rows = P0.selection_rows(e, [2, 3, 4, 5], 2 * HOUR).collect()
    starts = {k: min(r.decision_us for r in e.collect() if r.fold == k) for k in range(1, 6)}
    for k in (2, 3, 4, 5):
        mine = [r for r in rows if r.outer == k]
        valid = [r for r in mine if r.part == "validation"]
        assert len(valid) == -(-len(mine) // 5) and max(r.fold for r in mine) < k and max(r.exit_us for r in mine) < starts[k] - 2 * HOUR
        begin = min(r.decision_us for r in valid)
        assert all((r.part == "train") == (r.exit_us < begin) for r in mine if r.part != "validation") and any(r.part == "purged" for r in mine)


def test_permuted_rows_are_permutations(spark):
    rows = spark.createDataFrame([(o, "validation", i, [float(i), -float(i)], float(i % 2), 1.0) for o in (1, 2) for i in range(40)], "outer int, part string, event_id long, _x array<double>, _y double, _u double")
    got = P0.permuted(rows, 2, 3, 5).collect()
    assert len(got) == 80 * (2 * 3 + 1)
    for o in (1, 2):
        for f in (0, 1):
            for k in (1, 2, 3):
                mine = [r for r in got if (r.outer, r.feature, r.repeat) == (o, f, k)]
                assert sorted(abs(r._x[f]) for r in mine) == list(map(float, range(40))) and len({abs(r._x[1 - f]) for r in mine}) == 40
                assert sum(r._x[0] == -r._x[1] for r in mine) < 20


def closed_logistic(x, y, w):
    a, b = 0.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (q - y) * x).sum() + 1e-6 * a, (w * (q - y)).sum()])
        c = w * q * (1 - q)
        a, b = np.array([a, b]) - np.linalg.solve([[(c * x * x).sum() + 1e-6, (c * x).sum()], [(c * x).sum(), c.sum()]], g)
    return a, b


def test_grouped_maps_equal_single_fits(spark):
    e = planted(spark)
    rows = e.collect()
    for r in past_maps(e, "p_meta", "win", "uniqueness", [2, 3, 4, 5]).collect():
        mine = [x for x in rows if 2 <= x.fold < r.fold]
        p = np.clip([x.p_meta for x in mine], 1e-6, 1 - 1e-6)
        a, b = closed_logistic(np.log(p / (1 - p)), np.array([x.win for x in mine], float), np.array([x.uniqueness for x in mine]))
        assert abs(r.slope - a) < 1e-6 and abs(r.intercept - b) < 1e-6 and r.method == "platt" and r.n == len(mine)
    odd = [("one", 0.2, 1, 1.0), ("one", 0.7, 1, 1.0), ("few", 0.4, 1, 1.0), ("down", 0.2, 1, 1.0), ("down", 0.8, 0, 1.0), ("down", 0.3, 0, 0.5), ("down", 0.7, 1, 0.5)]
    odd += [("apart", 0.1, 0, 1.0), ("apart", 0.2, 0, 1.0), ("apart", 0.8, 1, 1.0), ("apart", 0.9, 1, 1.0), ("zero", 0.4, 1, 0.0), ("zero", 0.4, 0, 0.0)]
    got = {r.k: r for r in grouped_logistic(spark.createDataFrame(odd, "k string, p double, y int, w double"), ["k"], "p", "y", "w").collect()}
    assert {k: r.reason for k, r in got.items()} == {"one": "one_class", "few": "too_few", "down": "slope_not_positive", "apart": None, "zero": "no_weight"}
    assert got["apart"].slope > 5
    assert grouped_logistic(spark.createDataFrame([], "k string, p double, y int, w double"), ["k"], "p", "y", "w").count() == 0


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
    rows = [("s", i * HOUR, float(c), float(c * 1.01), float(c * 0.99), float(c), float(10 + i % 7), 5, 4.0) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, open_us long, open double, high double, low double, close double, volume double, trades int, taker_buy double")
    for make in (base_features, rolling_statistics, trends):
        whole, part = make(bars), make(bars.where(F.col("open_us") < 120 * HOUR))
        assert part.exceptAll(whole.where(F.col("open_us") < 120 * HOUR)).count() == 0 and part.count() == 120


def test_p_values():
    # two-sided p of Student's t: t = 2.228, 10 degrees gives 0.05
    t, free = 2.228139, 10
    r2 = t * t / (t * t + free)
    assert incomplete_beta(free / 2, 0.5, 1 - r2) == pytest.approx(0.05, abs=1e-6)


def test_maps_mark_what_they_cannot_map(spark):
    df = spark.createDataFrame([(0.5,), (None,), (float("nan"),), (1.2,)], "p double")
    got = L.apply_map(df, "p", "identity", None, "q").collect()
    assert [r.q for r in got] == [0.5, None, None, None] and [r.violation for r in got] == [False, True, True, True]
    with pytest.raises(ValueError):
        L.apply_map(df, "p", "other", None, "q")


def test_written_tables_are_refused_where_they_break_rules(spark, tmp_path):
    rows = [("a", 1, 2, 1, 0.6, 0.1, 1.0), ("a", 1, 2, 1, 0.7, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, decision_us long, exit_us long, fold int, p_primary double, ret double, uniqueness double")
    with pytest.raises(ValueError, match="unique"):
        S.write_oof(df, f"{tmp_path}/oof")
    S.write_oof(df.limit(1), f"{tmp_path}/oof")
    assert spark.read.parquet(f"{tmp_path}/oof").count() == 1
    S.write_dataset(df.withColumnRenamed("decision_us", "open_us"), f"{tmp_path}/set")
    with pytest.raises(ValueError, match="twice"):
        S.read_dataset(spark, f"{tmp_path}/set")
    history = spark.createDataFrame([("a", '{"x":1}')], "symbol string, line string")
    history.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(history.schema).parquet(f"{tmp_path}/in")
    query = S.append_stream_history(live, f"{tmp_path}/history", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert [r.value for r in spark.read.text(f"{tmp_path}/history").collect()] == ['{"x":1}']


def streamed(spark, df, tmp_path, name, job, files=3, key="ts"):
    """What a job gives for the rows of `df` as a stream of some files in order."""
    rows = df.orderBy(key).collect()
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    q = job(live).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def ticks(spark):
    rows = [("a" if i % 2 else "b", i, f"2024-01-01 {i // 30:02d}:{2 * i % 60:02d}:00", 100.0 + i % 11, 1.0 + i % 3, i % 4 == 0) for i in range(150)]
    rows.append(("z", 999, "2024-02-01 00:00:00", 1.0, 1.0, True))  # moves the watermark past all others
    df = spark.createDataFrame(rows, "symbol string, trade_id long, ts string, price double, qty double, is_buyer_maker boolean")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("job", [J.closed_bars, J.activity_sessions, J.rolling_imbalance])
def test_window_streams_equal_their_batch_twins(spark, tmp_path, job):
    df = ticks(spark)
    got = streamed(spark, df, tmp_path, job.__name__, job)
    same = lambda x: sorted(map(tuple, x.where("symbol != 'z'").collect()))
    assert same(got) == same(job(df)) != []


def test_stream_drops_repeats(spark, tmp_path):
    df = ticks(spark).where("symbol != 'z'")
    got = streamed(spark, df.unionByName(df.where("trade_id % 3 = 0")), tmp_path, "repeats", J.distinct_trades)
    assert sorted(r.trade_id for r in got.collect()) == sorted(r.trade_id for r in df.collect())


def test_stream_keeps_the_last_levels(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], i, *(None if i % 17 == 0 and c == 0 else float(x) for c, x in enumerate(rng.integers(95, 105, 4)))) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, seq long, bp double, bq double, ap double, aq double")
    got = streamed(spark, df, tmp_path, "flow", J.live_order_flow, key="seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.live_order_flow(df).collect()))


@pytest.mark.parametrize("files", [1, 4, 9])
def test_volume_clock_runs_on_across_batches(spark, tmp_path, files):
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 3 == 0], i, 60_000_000 * (i // 2), float(100 + rng.integers(0, 9)), float(rng.integers(1, 40)) * (60 if i % 97 == 0 else 1), bool(rng.random() < 0.5)) for i in range(400)]
    t = spark.createDataFrame(rows, "symbol string, trade_id long, us long, price double, qty double, is_buyer_maker boolean")
    ordered = lambda df: sorted(tuple(r) for r in df.collect())
    for capacity, ring in ((7000.0, 20), (500.0, 3)):
        want = ordered(K.live_buckets(t, capacity, ring))
        got = ordered(streamed(spark, t, tmp_path, f"clock_{files}_{ring}", lambda x: K.live_buckets(x, capacity, ring), files, "trade_id"))  # noqa: B023
        assert len(got) == len(want) > 100
        for g, w in zip(got, want, strict=True):
            assert g[:2] == w[:2] and g[5:7] == w[5:7] and np.allclose(g[2:5] + g[7:], w[2:5] + w[7:], rtol=1e-9)
    shares = streamed(spark, t, tmp_path, f"share_{files}", lambda x: K.live_vpin(x, most=50), files, "trade_id").collect()
    for w in K.live_vpin(t, most=50).collect():
        g = max((r for r in shares if r.symbol == w.symbol), key=lambda r: r.us)
        assert (g.us, g.trades, g.buckets) == (w.us, w.trades, w.buckets) and np.allclose([g.vpin, g.lower_bound], [w.vpin, w.lower_bound])


def test_buckets_of_base_volume_and_without_capacity(spark):
    t = spark.createDataFrame([("a", i, i, 10.0 * (i + 1), 4.0, i % 2 == 0) for i in range(5)], "symbol string, trade_id long, us long, price double, qty double, is_buyer_maker boolean")
    got = [(r.bucket, r.buy, r.sell, r.total) for r in volume_buckets(t, capacity=6.0, unit="base").orderBy("bucket").collect()]
    assert got == [(0, 2.0, 4.0, 6.0), (1, 2.0, 4.0, 6.0), (2, 4.0, 2.0, 6.0)]
    assert volume_buckets(t, capacity=0.0).count() == 0


def test_last_bars_have_stand_ins(spark):
    rows = [("a", 0.0, 100.0, 3.0, None, None, None), ("b", None, 100.0, 0.0, 10.0, 20.0, 1.5), ("c", 2.0, 100.0, 3.0, 10.0, 20.0, 1.5), ("d", None, 0.0, None, 10.0, 20.0, 1.5)]
    got = {r.symbol: r for r in with_defaults(spark.createDataFrame(rows, "symbol string, atr14 double, close double, _span double, rsi14 double, adx14 double, relative_volume double")).collect()}
    assert [got[k].atr14 for k in "abcd"] == [3.0, 0.5, 2.0, 1e-6] and (got["a"].rsi14, got["a"].adx14, got["a"].relative_volume) == (50.0, 0.0, 0.0)


def test_votes_are_graded_by_outcome(spark):
    closed = spark.createDataFrame([("w", "BUY", "win", 1.0), ("l", "SELL", "loss", -1.0), ("f", "BUY", "flat", 0.0)], "position_id string, side string, outcome string, r_multiple double")
    votes = spark.createDataFrame([(p, v, v) for p in "wlf" for v in ("BUY", "SELL", "HOLD")] + [("w", "none", None)], "position_id string, voter string, vote string")
    got = {(r.position_id, r.voter): (r.aligned, r.right) for r in C.graded_votes(closed, votes).collect()}
    assert got["w", "BUY"] == (True, True) and got["w", "SELL"] == (False, False) and got["l", "SELL"] == (True, False) and got["l", "BUY"] == (False, True)
    assert got["f", "BUY"] == (True, None) and got["w", "HOLD"] == got["w", "none"] == (False, None)


def test_anchors_count_what_is_missing(spark):
    e = spark.createDataFrame([(2, 1, 1.0), (2, 0, 3.0), (3, None, 1.0), (3, 1, float("nan")), (1, 1, 9.0)], "fold int, y int, w double")
    got = {r.metric: r.value for r in M.anchors(e, "y", "w", [2, 3]).collect()}
    assert got == {"rows": 4.0, "base_rate": 2 / 3, "weighted_base_rate": 0.25, "missing_labels": 1.0, "bad_weights": 1.0, "rows_fold_2": 2.0, "rows_fold_3": 2.0}


def test_short_series_fall_back_to_plain_features(spark):
    rng = np.random.default_rng(11)
    rows = [(k, i * HOUR, 1.0, float(c * 1.01), float(c * 0.99), float(c), float(10 + i % 7)) for k, n in (("long", 120), ("short", 60)) for i, c in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))))]
    bars = spark.createDataFrame(rows, "symbol string, open_us long, open double, high double, low double, close double, volume double")
    got = D.regime_features(bars).toPandas()
    assert 36 < len(D.weights(0.45, 1e-3)) < 60  # with 24 rows of deviation more than the short series has
    assert got.groupby("symbol").feature_mode.unique().map(list).to_dict() == {"long": ["fractional_diff"], "short": ["legacy"]}
    assert not got.isna().any().any()


def test_features_that_look_ahead_are_told(spark):
    bars = spark.createDataFrame([("s", i, float(i * i % 7)) for i in range(20)], "symbol string, open_us long, close double")
    lag = lambda b: rolling(b, ["symbol"], ["open_us"], 2, lambda w: {"x": F.lag("close").over(w)})
    lead = lambda b: rolling(b, ["symbol"], ["open_us"], 0, lambda w: {"x": F.lead("close").over(w)}, ahead=1)
    assert tuple(A.prefix_differences(bars, lag, 9).first()) == (10, 0) and tuple(A.prefix_differences(bars, lead, 9).first()) == (10, 1)
