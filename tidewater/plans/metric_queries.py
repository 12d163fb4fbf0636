"""Registered queries over scored events, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import rounded as r
from tidewater.operators import metrics as M
from tidewater.operators.features import base_features
from tidewater.operators.series import rolling
from tidewater.plans.sqlviews import over, tails
from tidewater.sources import views as V

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


def ev(s, d):
    return M.net(V.oof(s, d))


def big(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def rr(*cols, digits=6):
    return [r(F.col(c), digits).alias(c) for c in cols]


NET = ", e as (select *, ret - 0.003 as net, cast(ret - 0.003 > 0 as int) as win from oof)"
SC = """, sc as (select 'fold_' || k as scope, k as fold from range(2, 6) t(k) union all select 'folds_2_4', k from range(2, 5) t(k) union all select 'folds_2_5', k from range(2, 6) t(k))"""
TAUS = (0.55, 0.65, 0.75, 0.85)
TH = ", th as (select * from (values (0.55), (0.65), (0.75), (0.85)) t(threshold))"
TS = NET + TH + """, ts as (select fold, threshold, count(*) filter (where p_primary >= threshold) as n, avg(win) filter (where p_primary >= threshold) as win_rate,
  avg(net) filter (where p_primary >= threshold) as mean_net, sum(net) filter (where p_primary >= threshold) as sum_net from e, (select cast(threshold as double) as threshold from th) group by 1, 2)"""

add(
    "threshold_statistics",
    lambda s, d: M.threshold_statistics(ev(s, d), "p_primary", TAUS).select(*big("fold", "n"), *rr("threshold", "win_rate", "mean_net", "sum_net")),
    over("oof", TS + " select cast(fold as bigint) as fold, n, round(threshold, 6) + 0e0 as threshold, round(win_rate, 6) + 0e0 as win_rate, round(mean_net, 6) + 0e0 as mean_net, round(sum_net, 6) + 0e0 as sum_net from ts"),
)
add(
    "threshold_choice",
    lambda s, d: M.pick_thresholds(M.threshold_statistics(ev(s, d), "p_primary", TAUS), [1, 2, 3, 4, 5]).select(*big("fold"), *rr("threshold")),
    over("oof", TS + """, f as (select k as fold from range(1, 6) t(k)), p as (select f.fold, threshold, sum(n) as n, sum(coalesce(sum_net, 0)) as s from ts join f on ts.fold < f.fold group by 1, 2),
      b as (select *, row_number() over (partition by fold order by round(s, 12) desc, threshold desc, n) as k from p where n >= 30)
      select cast(f.fold as bigint) as fold, round(case when f.fold = 1 then 0.55 else coalesce(b.threshold, 1.01) end, 6) + 0e0 as threshold from f left join b on b.fold = f.fold and b.k = 1"""),
)
add(
    "trade_metrics_by_scope",
    lambda s, d: M.trade_metrics(ev(s, d).join(M.scopes(s), "fold"), ["scope"]).select("scope", "n", *rr("sum_net", "mean_net", "win_rate", "mean_hold", "median_hold", "expected_shortfall", "max_drawdown"), r(F.col("sum_hold"), 2).alias("sum_hold")),
    over("oof", NET + SC + """, x as (select e.*, scope, (exit_us - decision_us) / 3.6e9 as hold from e join sc using (fold)),
      c as (select scope, decision_us, symbol, sum(net) over (partition by scope order by decision_us, symbol) as eq from x),
      dd as (select scope, max(pk - eq) as dd from (select *, max(eq) over (partition by scope order by decision_us, symbol) as pk from c) group by 1),
      es as (select scope, avg(net) as es from (select *, row_number() over (partition by scope order by net) as k, count(*) over (partition by scope) as n from x) where k <= greatest(ceil(n * 0.05), 1) group by 1)
      select scope, count(*) as n, round(sum(net), 6) + 0e0 as sum_net, round(avg(net), 6) + 0e0 as mean_net, round(avg(win), 6) + 0e0 as win_rate, round(avg(hold), 6) + 0e0 as mean_hold,
      round(median(hold), 6) + 0e0 as median_hold, round(max(es), 6) + 0e0 as expected_shortfall, round(max(dd), 6) + 0e0 as max_drawdown, round(sum(hold), 2) + 0e0 as sum_hold from x join dd using (scope) join es using (scope) group by 1"""),
)
add(
    "auc_by_fold",
    lambda s, d: M.auc(ev(s, d), "p_meta", "win", ["fold"]).select(*big("fold"), *rr("auc"), "positives", "negatives"),
    over("oof", NET + """, k as (select *, rank() over (partition by fold order by p_meta) + (count(*) over (partition by fold, p_meta) - 1) / 2e0 as rk from e)
      select cast(fold as bigint) as fold, round((sum(rk) filter (where win = 1) - sum(win) * (sum(win) + 1) / 2e0) / (sum(win) * (count(*) - sum(win))), 6) + 0e0 as auc, cast(sum(win) as bigint) as positives, cast(count(*) - sum(win) as bigint) as negatives from k group by 1"""),
)
add(
    "probability_losses",
    lambda s, d: M.losses(ev(s, d), "p_meta", "win", "uniqueness", ["fold"]).select(*big("fold"), *rr("brier", "weighted_brier", "log_loss", "weighted_log_loss")),
    over("oof", NET + """, l as (select *, (p_meta - win) * (p_meta - win) as b, -(win * ln(q) + (1 - win) * ln(1 - q)) as l from (select *, greatest(1e-15, least(1 - 1e-15, p_meta)) as q from e))
      select cast(fold as bigint) as fold, round(avg(b), 6) + 0e0 as brier, round(sum(uniqueness * b) / sum(uniqueness), 6) + 0e0 as weighted_brier, round(avg(l), 6) + 0e0 as log_loss, round(sum(uniqueness * l) / sum(uniqueness), 6) + 0e0 as weighted_log_loss from l group by 1"""),
)
REL = NET + """, b as (select *, ntile(10) over (partition by fold order by p_meta, decision_us, symbol) - 1 as bin from e),
  rel as (select fold, bin, count(*) as n, sum(uniqueness) as weight, avg(p_meta) as ms, avg(win) as rt, sum(uniqueness * p_meta) / sum(uniqueness) as ws, sum(uniqueness * win) / sum(uniqueness) as wr from b group by 1, 2)"""
add(
    "reliability_bins",
    lambda s, d: M.reliability(ev(s, d), "p_meta", "win", "uniqueness", ["fold"]).select(*big("fold", "bin"), "n", *rr("mean_score", "rate", "weighted_score", "weighted_rate")),
    over("oof", REL + " select cast(fold as bigint) as fold, cast(bin as bigint) as bin, n, round(ms, 6) + 0e0 as mean_score, round(rt, 6) + 0e0 as rate, round(ws, 6) + 0e0 as weighted_score, round(wr, 6) + 0e0 as weighted_rate from rel"),
)
add(
    "calibration_error",
    lambda s, d: M.calibration_error(M.reliability(ev(s, d), "p_meta", "win", "uniqueness", ["fold"]), ["fold"]).select(*big("fold"), *rr("ece", "weighted_ece")),
    over("oof", REL + " select cast(fold as bigint) as fold, round(sum(n * abs(ms - rt)) / sum(n), 6) + 0e0 as ece, round(sum(weight * abs(ws - wr)) / sum(weight), 6) + 0e0 as weighted_ece from rel group by 1"),
)
add(
    "score_dispersion",
    lambda s, d: M.dispersion(ev(s, d), "p_meta", ["fold"]).select(*big("fold", "distinct"), *rr("lowest", "highest", "mean", "deviation")),
    over("oof", "select cast(fold as bigint) as fold, count(distinct p_meta) as distinct, round(min(p_meta), 6) + 0e0 as lowest, round(max(p_meta), 6) + 0e0 as highest, round(avg(p_meta), 6) + 0e0 as mean, round(stddev_pop(p_meta), 6) + 0e0 as deviation from oof group by 1"),
)


def sizes(e):
    return e.groupBy("fold").agg(F.count_if(F.col("p_primary") >= 0.9).alias("n"))


SZ = NET + ", sz as (select fold, count(*) filter (where p_primary >= 0.9) as n from e group by 1)"
TOP = SZ + """, a as (select * from (select e.*, sz.n, row_number() over (partition by e.fold order by p_primary desc, decision_us, symbol) as k from e join sz using (fold)) where k <= n),
  b as (select * from (select e.*, sz.n, row_number() over (partition by e.fold order by p_meta desc, decision_us, symbol) as k from e join sz using (fold)) where k <= n)"""
add(
    "top_n_events",
    lambda s, d: M.top_n(ev(s, d), "p_meta", sizes(ev(s, d))).select("event_id", *big("fold"), *rr("net")),
    over("oof", TOP + " select event_id, cast(fold as bigint) as fold, round(net, 6) + 0e0 as net from b"),
)
add(
    "equal_n_comparison",
    lambda s, d: M.equal_n(ev(s, d), "p_primary", "p_meta", sizes(ev(s, d))).select(*big("fold", "n", "overlap"), *rr("sum_a", "win_a", "sum_b", "win_b", "difference")),
    over("oof", TOP + """, x as (select a.fold, count(*) as n, sum(a.net) as sa, avg(a.win) as wa, count(b.event_id) as o from a left join b using (event_id) group by 1), y as (select fold, sum(net) as sb, avg(win) as wb from b group by 1)
      select cast(fold as bigint) as fold, n, o as overlap, round(sa, 6) + 0e0 as sum_a, round(wa, 6) + 0e0 as win_a, round(sb, 6) + 0e0 as sum_b, round(wb, 6) + 0e0 as win_b, round(sa - sb, 6) + 0e0 as difference from x join y using (fold)"""),
)
add(
    "overlap_regions",
    lambda s, d: M.overlap_regions(ev(s, d).join(M.scopes(s), "fold"), F.col("p_meta") >= 0.6, F.col("p_primary") >= 0.8, ["scope"]).select("scope", "region", "n", *rr("sum_net", "mean_net")),
    over("oof", NET + SC + """ select scope, case when p_meta >= 0.6 and p_primary >= 0.8 then 'common' when p_meta >= 0.6 then 'a_only' else 'b_only' end as region, count(*) as n, round(sum(net), 6) + 0e0 as sum_net, round(avg(net), 6) + 0e0 as mean_net
      from e join sc using (fold) where p_meta >= 0.6 or p_primary >= 0.8 group by 1, 2"""),
)
CUBE = "coalesce(symbol, '*') as symbol, coalesce(cast(fold as bigint), 0) as fold"
add(
    "coverage_cube",
    lambda s, d: M.coverage(ev(s, d).withColumns({"f1": F.when(F.col("event_id") % 3 != 0, F.col("p_meta")), "f2": F.when(F.col("event_id") % 5 != 0, F.col("ret")), "m": F.col("event_id") % 7 != 0}), ["f1", "f2"], "m").select(
        F.coalesce("symbol", F.lit("*")).alias("symbol"), F.coalesce(F.col("fold").cast("bigint"), F.lit(0)).alias("fold"), "rows", *rr("match_rate", "usable_f1", "usable_f2", "all_usable")),
    over("oof", f"""select {CUBE}, count(*) as rows, round(avg((event_id % 7 <> 0)::int), 6) + 0e0 as match_rate, round(avg((event_id % 3 <> 0)::int), 6) + 0e0 as usable_f1,
      round(avg((event_id % 5 <> 0)::int), 6) + 0e0 as usable_f2, round(avg((event_id % 3 <> 0 and event_id % 5 <> 0)::int), 6) + 0e0 as all_usable from oof group by cube (symbol, fold)"""),
)
add(
    "label_reconciliation",
    lambda s, d: M.reconciliation(ev(s, d).withColumn("y", (F.col("ret") > 0).cast("int")), "y").select(F.coalesce("symbol", F.lit("*")).alias("symbol"), F.coalesce(F.col("fold").cast("bigint"), F.lit(0)).alias("fold"), "y0_win0", "y0_win1", "y1_win0", "y1_win1"),
    over("oof", NET + f" select {CUBE}, " + ", ".join(f"count(*) filter (where (ret > 0)::int = {i} and win = {j}) as y{i}_win{j}" for i in (0, 1) for j in (0, 1)) + " from e group by cube (symbol, fold)"),
)
add(
    "class_weights",
    lambda s, d: M.class_weights(ev(s, d), "win", "uniqueness", ["fold"]).select(*big("fold"), *rr("negative_mass", "positive_mass", "scale_pos_weight")),
    over("oof", NET + """ select cast(fold as bigint) as fold, round(sum(case when win = 0 then uniqueness else 0 end), 6) + 0e0 as negative_mass, round(sum(case when win = 1 then uniqueness else 0 end), 6) + 0e0 as positive_mass,
      round(sum(case when win = 0 then uniqueness else 0 end) / sum(case when win = 1 then uniqueness else 0 end), 6) + 0e0 as scale_pos_weight from e group by 1"""),
)
FEATS = ("log_range", "taker_ratio", "volume", "trades")


def ic(s, d):
    b = base_features(V.bars(s, d)).drop("pos")
    b = rolling(b, ["symbol"], ["open_us"], 0, lambda w: {"fwd": F.lead("log_return").over(w)}, ahead=1)
    return M.information_coefficients(b, FEATS, ("log_return", "fwd"))


IC = """, b as (select *, ln(high / low) as log_range, case when volume > 0 then greatest(0, least(1, taker_buy / volume)) else 0.5 end as taker_ratio, ln(close / lag(close) over (partition by symbol order by open_us)) as log_return from bars),
  f as (select *, lead(log_return) over (partition by symbol order by open_us) as fwd from b),
  l as (""" + " union all ".join(f"select '{x}' as feature, '{y}' as label, cast({x} as double) as x, {y} as y from f where {x} is not null and {y} is not null" for x in FEATS for y in ("log_return", "fwd")) + """),
  k as (select *, rank() over (partition by feature, label order by x) + (count(*) over (partition by feature, label, x) - 1) / 2e0 as rx, rank() over (partition by feature, label order by y) + (count(*) over (partition by feature, label, y) - 1) / 2e0 as ry from l),
  i as (select feature, label, count(*) as n, corr(x, y) as pearson, corr(rx, ry) as spearman from k group by 1, 2)"""
# as IC, by the rules of the query: a log of what is not above 0 is missing, and so is a coefficient that is not finite or of fewer than 10 rows
IC_KNOWN = (
    IC.replace("ln(high / low)", "case when high / nullif(low, 0) > 0 then ln(high / nullif(low, 0)) end")
    .replace("ln(close / lag(close) over (partition by symbol order by open_us)) as log_return from bars)", "case when c1 > 0 and close > 0 then ln(close / c1) end as log_return from (select *, lag(close) over (partition by symbol order by open_us) as c1 from bars))")
    .replace("corr(x, y) as pearson, corr(rx, ry) as spearman", "case when count(*) >= 10 and isfinite(corr(x, y)) then corr(x, y) end as pearson, case when count(*) >= 10 and isfinite(corr(rx, ry)) then corr(rx, ry) end as spearman")
)
add(
    "information_coefficients",
    lambda s, d: ic(s, d).select("feature", "label", "n", *rr("pearson", "spearman"), "status"),
    over("bars", IC_KNOWN + " select feature, label, n, round(pearson, 6) + 0e0 as pearson, round(spearman, 6) + 0e0 as spearman, case when n < 10 then 'insufficient' else 'ok' end as status from i"),
)
add(
    "feature_verdicts",
    lambda s, d: M.feature_verdicts(ic(s, d), V.bars(s, d).agg(F.count(F.lit(1)).alias("rows"))).select("feature", *rr("strength"), "n", "verdict"),
    over("bars", IC_KNOWN + """ select feature, round(max(abs(spearman)), 6) + 0e0 as strength, max(n) as n, case when max(n) / (select count(*) from bars) < 0.2 then 'skipped' when max(n) < 50 then 'insufficient' when max(abs(spearman)) >= 0.05 then 'useful' else 'weak' end as verdict from i group by 1"""),
)
add(
    "strongest_coefficients",
    lambda s, d: ic(s, d).orderBy(F.abs("spearman").desc(), "feature", "label").limit(5).select("feature", "label", *rr("spearman")),
    over("bars", IC + " select feature, label, round(spearman, 6) + 0e0 as spearman from i order by abs(spearman) desc, feature, label limit 5"),
)
SEEDS = 10_000
add("placebo_draws", lambda s, d: M.placebo(ev(s, d), ["fold"], sizes(ev(s, d)), SEEDS).select("seed", *big("fold"), "n", *rr("sum_net", "sum_hold")))
add(
    "coefficient_p_values",
    lambda s, d: M.correlation_p_values(ic(s, d)).select("feature", "label", *rr("p_pearson", "p_spearman")),
    over("bars", IC_KNOWN + ", c as (select feature, label, what, n - 2 as free, 1 as k, v * v as u from (select feature, label, n, unnest(['p', 's']) as what, unnest([pearson, spearman]) as v from i) where v is not null and n >= 3)" + tails("c", "feature, label, what") + """
      select feature, label, round(max(p) filter (where what = 'p'), 6) + 0e0 as p_pearson, round(max(p) filter (where what = 's'), 6) + 0e0 as p_spearman from i left join tl using (feature, label) group by 1, 2"""),
)
add(
    "vertical_rates",
    lambda s, d: M.threshold_statistics(ev(s, d), "p_primary", TAUS, vertical=F.col("event_id") % 92 > 80).select(*big("fold", "n"), *rr("threshold", "vertical_rate")),
    over("oof", NET + TH + " select cast(fold as bigint) as fold, count(*) filter (where p_primary >= threshold) as n, round(cast(threshold as double), 6) + 0e0 as threshold, round(avg((event_id % 92 > 80)::int) filter (where p_primary >= threshold), 6) + 0e0 as vertical_rate from e, th group by fold, threshold"),
)
add(
    "hold_percentiles",
    lambda s, d: M.exposure(ev(s, d).select(((F.col("exit_us") - F.col("decision_us")) / 3.6e9).alias("hold")), "hold").select(*rr("p5", "p50", "p95")),
    over("oof", " select " + ", ".join(f"round(quantile_cont((exit_us - decision_us) / 3.6e9, {q}), 6) + 0e0 as p{n}" for q, n in ((0.05, 5), (0.5, 50), (0.95, 95))) + " from oof"),
)
add(
    "placebo_mid_rank",
    lambda s, d: M.mid_rank(ev(s, d).groupBy("symbol").agg(F.sum("net").alias("v")), "v", 0.0).select(*rr("percentile", "p_value")),
    over("oof", NET + ", g as (select symbol, sum(net) as v from e group by 1) select round((count(*) filter (where v < 0) + 0.5 * count(*) filter (where v = 0)) / count(*) * 100, 6) + 0e0 as percentile, round((1 + count(*) filter (where v >= 0)) / (count(*) + 1), 6) + 0e0 as p_value from g"),
)
AXES = {"depth": [3, 4, 6], "rate": [0.02, 0.03, 0.05], "l2": [3, 6, 9], "bag": [0, 1], "w": [1, 2]}
add(
    "config_block_losses",
    lambda s, d: M.block_matrix(
        ev(s, d).crossJoin(F.broadcast(M.catalog(s, AXES))).withColumn("block", F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string"))).withColumn("p", (F.col("p_meta") * F.col("depth") + F.col("l2") * 0.01) / 7),
        "config_id", "block", ["b0", "b1", "b2", "b3"], r(F.avg((F.col("p") - F.col("win")) * (F.col("p") - F.col("win"))))),
    over("oof", NET + """, c as (select 'cfg_' || lpad(cast((((d.i * 3 + ra.i) * 3 + l.i) * 2 + b.i) * 2 + w.i as varchar), 3, '0') as config_id, d.v as depth, l.v as l2 from (values (0, 3), (1, 4), (2, 6)) d(i, v), (values (0), (1), (2)) ra(i), (values (0, 3), (1, 6), (2, 9)) l(i, v), (values (0), (1)) b(i), (values (0), (1)) w(i)),
      x as (select config_id, event_id % 4 as k, ((p_meta * depth + l2 * 1e-2) / 7 - win) as g from e, c)
      select config_id, """ + ", ".join(f"round(avg(g * g) filter (where k = {k}), 6) + 0e0 as b{k}" for k in range(4)) + " from x group by 1"),
)
add(
    "population_anchors",
    lambda s, d: M.expectation_gaps(
        M.anchors(ev(s, d).withColumn("win", F.when(F.col("event_id") % 31 != 0, F.col("win"))), "win", "uniqueness", [2, 3, 4, 5]),
        s.createDataFrame([("base_rate", 0.4, 0.05), ("weighted_base_rate", 0.4, 0.05), ("missing_labels", 0.0, 0.0), ("bad_weights", 0.0, 0.0), ("rows_fold_2", 1e4, 1e4), ("absent", 1.0, 0.1)], "metric string, value double, tolerance double")).select("metric", *rr("observed", "expected", "gap"), "ok"),
    over("oof", NET + """, q as (select *, case when event_id % 31 <> 0 then win end as y from e), o as (select 'rows' as metric, cast(count(*) as double) as v from q where fold between 2 and 5 union all select 'base_rate', avg(y) from q where fold between 2 and 5
        union all select 'weighted_base_rate', sum(y * uniqueness) / sum(case when y is not null then uniqueness end) from q where fold between 2 and 5 union all select 'missing_labels', count(*) filter (where y is null) from q where fold between 2 and 5 union all select 'bad_weights', 0 union all select 'rows_fold_' || fold, count(*) from q where fold between 2 and 5 group by fold),
      x as (select * from (values ('base_rate', 0.4e0, 0.05e0), ('weighted_base_rate', 0.4e0, 0.05e0), ('missing_labels', 0e0, 0e0), ('bad_weights', 0e0, 0e0), ('rows_fold_2', 1e4, 1e4), ('absent', 1e0, 0.1e0)) t(metric, expected, tolerance))
      select metric, round(v, 6) + 0e0 as observed, round(expected, 6) + 0e0 as expected, round(abs(v - expected), 6) + 0e0 as gap, coalesce(abs(v - expected) <= tolerance, false) as ok from x full join o using (metric)"""),
)
