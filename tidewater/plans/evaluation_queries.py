"""Registered queries of walk-forward evaluation, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.functions.columns import rounded as r
from tidewater.operators import evaluation as E
from tidewater.operators.fits import past_maps, usable
from tidewater.operators import metrics as M
from tidewater.operators import models as L
from tidewater.plans.metric_queries import AXES, NET, REL, SC, TAUS, big, ev, rr, sizes
from tidewater.plans.sqlviews import over
from tidewater.sources import views as V
from tidewater.sources.store import materialise

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


FOLDS = [2, 3, 4, 5]
META = (0.4, 0.6, 0.8)


def events(s, d):
    """The scored events, written once: several steps read them."""
    return materialise(ev(s, d), "events")


def values(rows):
    return ", ".join("(" + ", ".join(f"{x!r}e0" if isinstance(x, float) else repr(x) for x in row) + ")" for row in rows)


def history(name, score, taus, rows="e"):
    """CTEs h_<name> and t_<name>: history sums and the chosen thresholds, free and forced."""
    return f""", h_{name} as (select k as fold, threshold, count(*) filter (where {score} >= threshold) as n, coalesce(sum(net) filter (where {score} >= threshold), 0) as s
        from range(2, 6) f(k), (values {values((t,) for t in taus)}) t(threshold), {rows} e where e.fold between 2 and k - 1 group by 1, 2),
      b_{name} as (select *, row_number() over (partition by fold order by round(s, 12) desc, threshold desc, n) as r from h_{name} where n >= 30),
      t_{name} as (select k as fold, case when k = 2 then 0.55e0 when round(s, 12) > 0 then threshold else 1.01e0 end as tau, case when k = 2 then 0.55e0 else coalesce(threshold, 0.55e0) end as forced,
        case when k = 2 then 'first_fold' when threshold is null then 'none_eligible' when round(s, 12) > 0 then 'best_eligible' else 'abstain' end as reason
        from range(2, 6) f(k) left join b_{name} b on b.fold = k and b.r = 1)"""


FLAGS = NET + history("meta", "p_meta", META) + history("base", "p_primary", TAUS) + """,
  fl as (select e.*, m.tau as tau_meta, b.tau as tau_baseline, p_meta >= m.tau as f_meta, p_primary >= b.tau as f_baseline, p_meta >= m.forced as f_meta_forced, p_primary >= b.forced as f_baseline_forced,
    case when b.tau > 1 then p_primary >= b.forced else p_primary >= b.tau end as f_reference from e join t_meta m using (fold) join t_base b using (fold)),
  sz as (select fold, count(*) filter (where f_reference) as n from fl group by 1),
  fa as (select fl.*, row_number() over (partition by fl.fold order by p_meta desc, decision_us, symbol) <= sz.n as f_matched from fl join sz using (fold))"""


def flagged(s, d):
    return E.arms(events(s, d), FOLDS, META, TAUS)


add(
    "arm_flags",
    lambda s, d: flagged(s, d).select("event_id", *big("fold"), *rr("tau_meta", "tau_baseline"), *(F.col(f"traded_{a}") for a in E.ARMS)),
    over("oof", FLAGS + " select event_id, cast(fold as bigint) as fold, round(tau_meta, 6) + 0e0 as tau_meta, round(tau_baseline, 6) + 0e0 as tau_baseline, " + ", ".join(f"f_{a} as traded_{a}" for a in E.ARMS) + " from fa"),
)
add(
    "arm_report",
    lambda s, d: E.arm_report(flagged(s, d), M.scopes(s)).select("scope", "arm", "n", *rr("pt_hit", "win_rate", "mean_bps", "sum_net", "effective_n", digits=5)),
    over("oof", FLAGS + SC + ", l as (" + " union all ".join(f"select scope, '{a}' as arm, ret, net, win, uniqueness from fa join sc using (fold) where f_{a}" for a in E.ARMS) + """)
      select scope, arm, count(*) as n, round(avg((ret > 0)::int), 5) + 0e0 as pt_hit, round(avg(win), 5) + 0e0 as win_rate, round(avg(net) * 1e4, 5) + 0e0 as mean_bps, round(sum(net), 5) + 0e0 as sum_net, round(sum(uniqueness), 5) + 0e0 as effective_n from l group by 1, 2"""),
)
add(
    "arm_thresholds",
    lambda s, d: E.chosen_thresholds(E.history_statistics(events(s, d), "p_primary", TAUS, FOLDS), FOLDS).select(*big("fold"), *rr("threshold"), "reason"),
    over("oof", NET + history("base", "p_primary", TAUS) + " select cast(fold as bigint) as fold, round(tau, 6) + 0e0 as threshold, reason from t_base"),
)
add(
    "entry_rates",
    lambda s, d: E.entry_rate(ev(s, d), F.col("p_meta") >= 0.6, M.scopes(s)).select("scope", "events", "trades", *rr("entry_rate")),
    over("oof", NET + SC + " select scope, count(*) as events, count(*) filter (where p_meta >= 0.6) as trades, round(avg((p_meta >= 0.6)::int), 6) + 0e0 as entry_rate from e join sc using (fold) group by 1"),
)
VERSIONS = ["identity", "platt", "isotonic"]


def versions(s, d):
    """A raw score with a logistic map of it and a step map of it."""
    e = L.apply_platt(ev(s, d), "p_meta", 0.8, -0.3, "platt")
    return e.withColumns({"identity": F.col("p_meta"), "isotonic": F.floor(F.col("p_meta") * 5) / 5.0 + 0.05})


VER = NET + """, v0 as (select *, greatest(1e-6, least(1 - 1e-6, p_meta)) as q from e),
  ve as (""" + " union all ".join(f"select fold, decision_us, symbol, win, uniqueness, '{n}' as version, {x} as score from v0" for n, x in (("identity", "p_meta"), ("platt", "1 / (1 + exp(-(0.8e0 * ln(q / (1 - q)) - 0.3e0)))"), ("isotonic", "floor(p_meta * 5) / 5e0 + 0.05e0"))) + """),
  vl as (select fold, version, avg(b) as brier, sum(uniqueness * b) / sum(uniqueness) as weighted_brier, avg(l) as log_loss, sum(uniqueness * l) / sum(uniqueness) as weighted_log_loss from (select *, (score - win) * (score - win) as b, -(win * ln(c) + (1 - win) * ln(1 - c)) as l
    from (select *, greatest(1e-15, least(1 - 1e-15, score)) as c from ve)) group by 1, 2),
  vr as (select *, rank() over (partition by fold, version order by round(score, 12)) + (count(*) over (partition by fold, version, round(score, 12)) - 1) / 2e0 as rk from ve),
  va as (select fold, version, (sum(rk) filter (where win = 1) - sum(win) * (sum(win) + 1) / 2e0) / (sum(win) * (count(*) - sum(win))) as auc from vr group by 1, 2),
  vb as (select *, ntile(10) over (partition by fold, version order by score, decision_us, symbol) as bin from ve),
  vg as (select fold, version, bin, count(*) as n, sum(uniqueness) as w, avg(score) as ms, avg(win) as rt, sum(uniqueness * score) / sum(uniqueness) as ws, sum(uniqueness * win) / sum(uniqueness) as wr from vb group by 1, 2, 3),
  vc as (select fold, version, sum(n * abs(ms - rt)) / sum(n) as ece, sum(w * abs(ws - wr)) / sum(w) as weighted_ece from vg group by 1, 2)"""
FIG = ["auc", "brier", "weighted_brier", "log_loss", "weighted_log_loss", "ece", "weighted_ece"]


def calibrations(s, d):
    return E.calibration_table(materialise(versions(s, d), "versions"), VERSIONS, "win", "uniqueness")


add(
    "calibration_versions",
    lambda s, d: calibrations(s, d).select(*big("fold"), "version", *rr(*FIG)),
    over("oof", VER + " select cast(fold as bigint) as fold, version, " + ", ".join(f"round({f}, 6) + 0e0 as {f}" for f in FIG) + " from vl join va using (fold, version) join vc using (fold, version)"),
)
add(
    "auc_invariance",
    lambda s, d: E.auc_invariance(materialise(calibrations(s, d), "calibrations"), "identity", {"platt": "monotone", "isotonic": "step"}).select(*big("fold"), "version", *rr("raw_auc", "auc", "delta"), "passed"),
    over("oof", VER + """ select cast(x.fold as bigint) as fold, x.version, round(y.auc, 6) + 0e0 as raw_auc, round(x.auc, 6) + 0e0 as auc, round(x.auc - y.auc, 6) + 0e0 as delta, case when x.version = 'platt' then abs(x.auc - y.auc) <= 1e-9 end as passed
      from va x join va y on x.fold = y.fold and y.version = 'identity' where x.version <> 'identity'"""),
)
add(
    "calibration_method",
    lambda s, d: E.chosen_method(calibrations(s, d).groupBy("fold").pivot("version", VERSIONS).agg(F.first("weighted_brier"))).select(*big("fold"), "method", *rr("gain"), "demonstrated"),
    over("oof", VER + """, p as (select fold, max(weighted_brier) filter (where version = 'identity') as i, max(weighted_brier) filter (where version = 'platt') as p, max(weighted_brier) filter (where version = 'isotonic') as s from vl group by 1),
      m as (select *, case when p <= least(i, p, s) + 0.001 then 'platt' when i <= least(i, p, s) + 0.001 then 'identity' else 'isotonic' end as method from p)
      select cast(fold as bigint) as fold, method, round(i - case method when 'platt' then p when 'identity' then i else s end, 6) + 0e0 as gain, i - case method when 'platt' then p when 'identity' then i else s end > 0.001 as demonstrated from m"""),
)
def newton(history, keys, at_least):
    """CTEs nt and mp: logistic maps of x and y with weight w for each key of `history`, 30 Newton steps from slope 0."""
    k = ", ".join(keys)
    return f""", nt as (select {k}, 0 as i, cast(0 as double) as a, ln(sum(w * y) / (sum(w) - sum(w * y))) as b from {history} group by {k} having count(*) >= {at_least} and min(y) < max(y)
      union all
      select {k}, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from (
        select {k}, i, a, b, sum(w * (q - y) * x) + 1e-6 * a as ga, sum(w * (q - y)) as gb, sum(w * q * (1 - q) * x * x) + 1e-6 as haa, sum(w * q * (1 - q) * x) as hab, sum(w * q * (1 - q)) as hbb
        from (select nt.*, x, y, w, 1 / (1 + exp(-(a * x + b))) as q from nt join {history} using ({k}) where i < 30) group by {k}, i, a, b)),
      mp as (select {k}, a as slope, b as icpt from nt where i = 30 and a > 0)"""


HISTORY = """, cl as (select *, greatest(1e-6, least(1 - 1e-6, p_meta)) as q from e),
  hx as (select k as fold, ln(q / (1 - q)) as x, cast(win as double) as y, uniqueness as w from range(3, 6) f(k) join cl on cl.fold between 2 and k - 1)"""
MAPPED = HISTORY + newton("hx", ["fold"], 300) + f""",
  hs as (select k as for_fold, c.*, case when k = 2 or slope is null then p_meta else 1 / (1 + exp(-(slope * ln(q / (1 - q)) + icpt))) end as s from range(2, 6) f(k) join cl c on c.fold between 2 and k left join mp on mp.fold = k),
  hh as (select for_fold as fold, threshold, count(*) filter (where s >= threshold) as n, coalesce(sum(net) filter (where s >= threshold), 0) as sn from hs, (values {values((t,) for t in META)}) t(threshold) where hs.fold < for_fold group by 1, 2),
  hb as (select *, row_number() over (partition by fold order by round(sn, 12) desc, threshold desc, n) as r from hh where n >= 30),
  ht as (select k as fold, case when k = 2 then 0.55e0 when round(sn, 12) > 0 then threshold else 1.01e0 end as tau, case when k = 2 then 'first_fold' when threshold is null then 'none_eligible' when round(sn, 12) > 0 then 'best_eligible' else 'abstain' end as reason
    from range(2, 6) f(k) left join hb on hb.fold = k and r = 1)"""


def recursive(views, sql):
    return over(views, sql).replace("with ", "with recursive ", 1)


def replay(e):
    return E.replayed(e, "p_meta", FOLDS, META, materialise(maps(e), "maps"))


def chain(e):
    return E.chained(e, "p_meta", FOLDS, META, materialise(maps(e), "maps"))


def maps(events):
    return usable(past_maps(events, "p_meta", "win", "uniqueness", FOLDS))


add(
    "fitted_maps",
    lambda s, d: past_maps(events(s, d), "p_meta", "win", "uniqueness", FOLDS).where("method = 'platt'").select(*big("fold"), *rr("slope", "intercept"), "n"),
    recursive("oof", NET + HISTORY + newton("hx", ["fold"], 300) + ", z as (select fold, count(*) as n from hx group by 1) select cast(fold as bigint) as fold, round(slope, 6) + 0e0 as slope, round(icpt, 6) + 0e0 as intercept, n from mp join z using (fold)"),
)
add(
    "threshold_replay",
    lambda s, d: replay(events(s, d)).select(*big("fold"), *rr("threshold"), "reason", "n", *rr("sum_net")),
    recursive("oof", NET + MAPPED + " select cast(ht.fold as bigint) as fold, round(tau, 6) + 0e0 as threshold, reason, count(*) filter (where s >= tau) as n, round(coalesce(sum(net) filter (where s >= tau), 0), 6) + 0e0 as sum_net from hs join ht on ht.fold = for_fold and hs.fold = for_fold group by 1, 2, 3"),
)
add(
    "threshold_replay_raw",
    lambda s, d: E.replayed(events(s, d), "p_meta", FOLDS, META).select(*big("fold"), *rr("threshold"), "n", *rr("sum_net")),
    over("oof", NET + history("meta", "p_meta", META) + " select cast(fold as bigint) as fold, round(tau, 6) + 0e0 as threshold, count(*) filter (where p_meta >= tau) as n, round(coalesce(sum(net) filter (where p_meta >= tau), 0), 6) + 0e0 as sum_net from e join t_meta using (fold) group by 1, 2"),
)
add(
    "chained_scores",
    lambda s, d: chain(events(s, d)).select("event_id", *big("fold"), *rr("effective", "threshold"), "traded"),
    recursive("oof", NET + MAPPED + " select event_id, cast(for_fold as bigint) as fold, round(s, 6) + 0e0 as effective, round(tau, 6) + 0e0 as threshold, s >= tau as traded from hs join ht on ht.fold = for_fold where hs.fold = for_fold"),
)


def rebuilt(s, d):
    e = events(s, d)
    found = materialise(maps(e), "maps")
    return E.reconstruction_gaps(E.chained(e, "p_meta", FOLDS, META, found), E.replayed(e, "p_meta", FOLDS, META, found))


add(
    "chain_reconstruction",
    lambda s, d: rebuilt(s, d).select(*big("fold"), "n", *rr("sum_net"), "ok"),
    recursive("oof", NET + MAPPED + " select cast(ht.fold as bigint) as fold, count(*) filter (where s >= tau) as n, round(coalesce(sum(net) filter (where s >= tau), 0), 6) + 0e0 as sum_net, true as ok from hs join ht on ht.fold = for_fold and hs.fold = for_fold group by 1"),
)
SZ = ", sz as (select fold, count(*) filter (where p_primary >= 0.9) as n from e group by 1)"
add(
    "additivity_gate",
    lambda s, d: E.additivity_gate(events(s, d), FOLDS, "win", sizes(ev(s, d))).select(*rr("auc_p_meta", "auc_p_primary", "sum_p_meta", "sum_p_primary"), "verdict"),
    over("oof", NET + SZ + ", x as (select * from e where fold between 2 and 5)" + "".join(f""", k_{c} as (select *, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as rk, row_number() over (partition by fold order by {c} desc, decision_us, symbol) as nth from x),
      a_{c} as (select (sum(rk) filter (where win = 1) - sum(win) * (sum(win) + 1) / 2e0) / (sum(win) * (count(*) - sum(win))) as auc, sum(net) filter (where nth <= (select n from sz where sz.fold = k_{c}.fold)) as s from k_{c})""" for c in ("p_meta", "p_primary"))
      + """ select round(m.auc, 6) + 0e0 as auc_p_meta, round(p.auc, 6) + 0e0 as auc_p_primary, round(m.s, 6) + 0e0 as sum_p_meta, round(p.s, 6) + 0e0 as sum_p_primary,
        case when m.auc > p.auc and m.s > p.s then 'pass' when m.auc <= p.auc and m.s <= p.s then 'not_demonstrated' else 'mixed' end as verdict from a_p_meta m, a_p_primary p"""),
)
add(
    "score_displacement",
    lambda s, d: E.displacement(events(s, d), "p_primary", "p_meta", sizes(ev(s, d))).select(*big("fold"), "n", "overlap", "displaced", "identical", *rr("sum_a", "sum_b", "change")),
    over("oof", NET + SZ + """, a as (select * from (select e.*, n, row_number() over (partition by e.fold order by p_primary desc, decision_us, symbol) as k from e join sz using (fold)) where k <= n),
      b as (select * from (select e.*, n, row_number() over (partition by e.fold order by p_meta desc, decision_us, symbol) as k from e join sz using (fold)) where k <= n)
      select cast(fold as bigint) as fold, count(a.event_id) as n, count(*) filter (where a.event_id is not null and b.event_id is not null) as overlap, count(*) filter (where b.event_id is null) as displaced,
        count(*) filter (where b.event_id is null or a.event_id is null) = 0 as identical, round(coalesce(sum(a.net), 0), 6) + 0e0 as sum_a, round(coalesce(sum(b.net), 0), 6) + 0e0 as sum_b, round(coalesce(sum(b.net), 0) - coalesce(sum(a.net), 0), 6) + 0e0 as change
      from a full join b using (fold, event_id) group by 1"""),
)
CW = NET + """, cw as (select fold, sum(case when win = 0 then uniqueness else 0 end) / sum(case when win = 1 then uniqueness else 0 end) as spw from e group by 1)"""
add(
    "scaled_log_loss",
    lambda s, d: E.scaled_log_loss(ev(s, d), "p_meta", "win", "uniqueness", M.class_weights(ev(s, d), "win", "uniqueness", ["fold"])).select(*big("fold"), *rr("scaled_log_loss")),
    over("oof", CW + """, l as (select *, uniqueness * case when win = 1 then spw else 1 end as w, greatest(1e-15, least(1 - 1e-15, p_meta)) as q from e join cw using (fold))
      select cast(fold as bigint) as fold, round(sum(w * -(win * ln(q) + (1 - win) * ln(1 - q))) / sum(w), 6) + 0e0 as scaled_log_loss from l group by 1"""),
)
EVR = NET + """, m as (select k as fold, avg(net) filter (where net > 0) as mw, avg(net) filter (where net <= 0) as ml from range(2, 6) f(k) join e on e.fold < k group by 1), x as (select e.*, mw, ml, p_meta * mw + (1 - p_meta) * ml as v from e join m using (fold))"""
add(
    "expected_value_trades",
    lambda s, d: E.expected_value_rule(ev(s, d), "p_meta", FOLDS).groupBy("fold").agg(F.first("mean_win").alias("mean_win"), F.first("mean_loss").alias("mean_loss"), F.count_if("traded").alias("trades"), F.avg("expected_value").alias("mean_value")).select(*big("fold"), "trades", *rr("mean_win", "mean_loss", "mean_value", digits=7)),
    over("oof", EVR + " select cast(fold as bigint) as fold, count(*) filter (where v > 0) as trades, round(max(mw), 7) + 0e0 as mean_win, round(max(ml), 7) + 0e0 as mean_loss, round(avg(v), 7) + 0e0 as mean_value from x group by 1"),
)


def pooled(s, d):
    return E.pools(flagged(s, d), "traded_meta_forced", "traded_baseline_forced")


PL = FLAGS + ", pl as (select *, f_meta_forced or f_baseline_forced as informed, f_meta_forced and not f_baseline_forced as uniq from fa)"
add(
    "placebo_pools",
    lambda s, d: E.pool_contract(pooled(s, d), "pool_primary_informed", "traded_meta_forced", ["p_meta", "p_primary"]).select(*big("fold"), "pool", "arm", "outside", "unscored", "ok"),
    over("oof", PL + " select cast(fold as bigint) as fold, count(*) filter (where informed) as pool, count(*) filter (where f_meta_forced) as arm, 0 as outside, 0 as unscored, true as ok from pl group by 1"),
)
add(
    "placebo_pool_composition",
    lambda s, d: E.pool_composition(pooled(s, d), "pool_primary_informed", F.col("traded_meta_forced") & ~F.col("traded_baseline_forced")).select(*big("fold"), "pool_size", "removed", *rr("mean_net", "median_net", "mean_without_unique")),
    over("oof", PL + " select cast(fold as bigint) as fold, count(*) as pool_size, count(*) filter (where uniq) as removed, round(avg(net), 6) + 0e0 as mean_net, round(median(net), 6) + 0e0 as median_net, round(avg(net) filter (where not uniq), 6) + 0e0 as mean_without_unique from pl where informed group by 1"),
)
add(
    "placebo_plan",
    lambda s, d: E.sampling_plan(pooled(s, d), "pool_primary_informed", "traded_meta_forced", ["fold", "symbol"]).select(*big("fold"), "symbol", "pool", "k", "feasible"),
    over("oof", PL + " select cast(fold as bigint) as fold, symbol, count(*) filter (where informed) as pool, count(*) filter (where f_meta_forced) as k, true as feasible from pl group by 1, 2 having k > 0"),
)


def config_losses(s, d):
    """Brier score of every catalogue configuration per fold, on a stand-in score; the catalogue has 108 rows."""
    p = (F.col("p_meta") * F.col("depth") + F.col("l2") * 0.01 + F.col("rate")) / 7
    gap = (p - F.col("win")) * (p - F.col("win"))
    return ev(s, d).crossJoin(F.broadcast(M.catalog(s, AXES))).groupBy("fold", "config_id", "depth", "rate", "l2", "bag", "w").agg(F.avg(gap).alias("loss"))


CFG = NET + """, c as (select 'cfg_' || lpad(cast((((d.i * 3 + ra.i) * 3 + l.i) * 2 + b.i) * 2 + w.i as varchar), 3, '0') as config_id, d.v as depth, ra.v as rate, l.v as l2, b.i as bag, w.i + 1 as w
    from (values (0, 3), (1, 4), (2, 6)) d(i, v), (values (0, 0.02e0), (1, 0.03e0), (2, 0.05e0)) ra(i, v), (values (0, 3), (1, 6), (2, 9)) l(i, v), (values (0), (1)) b(i), (values (0), (1)) w(i)),
  g as (select fold, config_id, depth, rate, l2, bag, w, avg(((p_meta * depth + l2 * 1e-2 + rate) / 7 - win) * ((p_meta * depth + l2 * 1e-2 + rate) / 7 - win)) as loss from e, c group by all)"""
add(
    "winner_configs",
    lambda s, d: E.winner(config_losses(s, d), ["fold"]).select(*big("fold"), "config_id", *rr("least_loss")),
    over("oof", CFG + ", k as (select *, row_number() over (partition by fold order by round(loss, 12), depth, -l2, rate, bag, w, config_id) as r, min(loss) over (partition by fold) as m from g) select cast(fold as bigint) as fold, config_id, round(m, 6) + 0e0 as least_loss from k where r = 1"),
)


def importances(s, d):
    """Absolute correlation of each column with winning, by symbol, as importance."""
    cols = ["p_primary", "p_meta", "uniqueness", "ret"]
    each = ev(s, d).groupBy("symbol").agg(*(F.round(F.abs(F.corr(c, "win")), 9).alias(c) for c in cols))
    return each.unpivot(["symbol"], cols, "feature", "importance")


IMP = NET + ", i as (" + " union all ".join(f"select symbol, '{c}' as feature, round(abs(corr({c}, win)), 9) as importance from e group by 1" for c in ("p_primary", "p_meta", "uniqueness", "ret")) + """),
  k as (select *, rank() over (partition by symbol order by importance desc) + (count(*) over (partition by symbol, importance) - 1) / 2e0 as rk from i), a as (select feature, avg(importance) as mi, avg(rk) as mr from k group by 1)"""
add(
    "feature_importance_summary",
    lambda s, d: E.importance_summary(importances(s, d)).select("feature", *rr("mean_importance", "mean_rank"), *big("place"), "kept"),
    over("oof", IMP + " select feature, round(mi, 6) + 0e0 as mean_importance, round(mr, 6) + 0e0 as mean_rank, row_number() over (order by mi desc, feature) as place, row_number() over (order by mi desc, feature) <= 2 as kept from a"),
)


def dirty(s, d):
    return ev(s, d).withColumns({"tb_label": F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 3 - 1), "f1": F.when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("p_meta")), "f2": F.when(F.col("event_id") % 7 != 0, F.col("p_primary"))})


add(
    "feature_rows",
    lambda s, d: E.feature_rows(dirty(s, d), ["f1", "f2"], "tb_label", "uniqueness", "ret").groupBy("valid", "y").agg(F.count(F.lit(1)).alias("n"), r(F.sum("f1")).alias("sum_f1")).select("valid", *big("y"), "n", "sum_f1"),
    over("oof", NET + """, x as (select *, event_id % 3 - 1 as lab, case when event_id % 5 <> 0 then p_meta end as f1, case when event_id % 7 <> 0 then p_primary end as f2 from e where event_id % 11 <> 0)
      select f1 is not null and f2 is not null as valid, cast((lab = 1)::int as bigint) as y, count(*) as n, round(sum(f1), 6) + 0e0 as sum_f1 from x group by 1, 2"""),
)
FAMILIES = {"calendar": ["hour", "weekday"], "micro": ["taker_ratio"], "symbol": ["symbol_code"], "regime": ["direction"], "base": ["p_primary", "p_meta"]}


def arm_frame(s, d):
    at = F.floor(F.col("decision_us") / HOUR)
    return ev(s, d).withColumns({
        "hour": F.pmod(at, F.lit(24)), "weekday": F.pmod(F.floor(at / 24) + 3, F.lit(7)), "taker_ratio": F.col("uniqueness"), "symbol_code": F.substring("symbol", 2, 1).cast("bigint"),
        "direction": F.signum("ret"), "session": F.floor(F.pmod(at, F.lit(24)) / 8), "extra_a": F.col("ret"), "extra_b": F.col("event_id")})


def arm_sums(s, d):
    """Every arm's exact feature columns with their sums over all events."""
    out, frame = None, materialise(arm_frame(s, d), "arm-frame")
    for arm in E.ARM_CHANGES:
        part = E.project(frame, arm, FAMILIES, [], ["extra_a", "extra_b"])
        one = part.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in part.columns)).unpivot([], part.columns, "feature", "total")
        one = one.select(F.lit(arm).alias("arm"), "feature", r(F.col("total"), 3).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


ARM_SQL = {"hour": "(decision_us // 3600000000) % 24", "weekday": "(decision_us // 86400000000 + 3) % 7", "taker_ratio": "uniqueness", "symbol_code": "cast(substr(symbol, 2, 1) as bigint)", "direction": "sign(ret)", "session": "(decision_us // 3600000000) % 24 // 8", "extra_a": "ret", "extra_b": "event_id", "p_primary": "p_primary", "p_meta": "p_meta"}
add(
    "arm_projections",
    arm_sums,
    over("oof", " union all ".join(f"select '{arm}' as arm, '{c}' as feature, round(sum(cast({ARM_SQL[c]} as double)), 3) + 0e0 as total from oof" for arm in E.ARM_CHANGES for c in E.arm_columns(arm, FAMILIES, ["extra_a", "extra_b"]))),
)


def joined_sides(s, d):
    e = V.oof(s, d)
    left = e.select("symbol", "decision_us", "event_id")
    right = e.where("event_id % 9 != 0").select("symbol", "decision_us", F.when(F.col("event_id") % 13 != 0, F.col("decision_us") + (F.col("event_id") % 100) * HOUR).alias("exit_us"))
    return left, right.unionByName(right.where("decision_us % 7 = 0"))


add(
    "one_to_one_matches",
    lambda s, d: E.one_to_one(*joined_sides(s, d), ["symbol", "decision_us"]).groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")),
    over("oof", """, x as (select *, case when event_id % 9 <> 0 and decision_us % 7 = 0 then 'repeated' when event_id % 9 = 0 then 'unmatched' when event_id % 13 = 0 then 'no_exit' when event_id % 100 not between 4 and 96 then 'exit_outside' else 'ok' end as v from oof)
      select v as violation, count(*) as n, cast(sum(event_id) as bigint) as ids from x group by 1"""),
)


def predictions(s, d):
    p = V.oof(s, d).where("event_id % 10 != 0").select("symbol", "decision_us", "fold", (F.col("p_meta") * 0.5).alias("p_new"))
    return p.unionByName(p.where("decision_us % 11 = 0"))


add(
    "attached_predictions",
    lambda s, d: E.attach_predictions(V.oof(s, d), predictions(s, d), ["symbol", "decision_us", "fold"], "p_new").groupBy("fold", "prediction").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p_new")).alias("total")).select(*big("fold"), "prediction", "n", "total"),
    over("oof", """, x as (select *, case when event_id % 10 = 0 then 'missing' when decision_us % 11 = 0 then 'repeated' else 'ok' end as v from oof)
      select cast(fold as bigint) as fold, v as prediction, count(*) as n, round(sum(case when v = 'ok' then p_meta * 0.5 end), 6) + 0e0 as total from x group by 1, 2"""),
)
add(
    "usable_members",
    lambda s, d: E.members(V.oof(s, d), V.oof(s, d).where("p_meta > 0.5").select("symbol", "fold").union(V.oof(s, d).where("p_meta > 0.9").select("symbol", "fold")), ["symbol", "fold"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    over("oof", " select symbol, count(*) as n from oof where (symbol, fold) in (select (symbol, fold) from oof where p_meta > 0.5) group by 1"),
)
add(
    "aligned_features",
    lambda s, d: E.aligned(V.bars(s, d), V.bars(s, d).where("trades % 2 = 0").select("symbol", "open_us", (F.col("taker_buy") / F.col("volume")).alias("share")), ["symbol", "open_us"]).select("symbol", "open_us", *rr("close", "m_share")),
    over("bars", " select symbol, open_us, round(close, 6) + 0e0 as close, round(case when trades % 2 = 0 then taker_buy / volume end, 6) + 0e0 as m_share from bars"),
)
add(
    "event_sets",
    lambda s, d: E.set_sizes(V.oof(s, d).where("p_meta >= 0.6"), V.oof(s, d).where("p_primary >= 0.8"), ["symbol", "decision_us"]),
    over("oof", " select 'both' as part, count(*) as n from oof where p_meta >= 0.6 and p_primary >= 0.8 union all select 'left_only', count(*) from oof where p_meta >= 0.6 and p_primary < 0.8 union all select 'right_only', count(*) from oof where p_meta < 0.6 and p_primary >= 0.8"),
)
add(
    "signal_overlap",
    lambda s, d: E.signal_overlap(V.oof(s, d).withColumn("decision_us", F.floor(F.col("decision_us") / (24 * HOUR)) * 24 * HOUR), "P0").select(*big("fold"), "events", *rr("benchmark_share"), "shared_times", "most_at_once"),
    over("oof", ", g as (select fold, decision_us // 86400000000 as t, count(*) as n, count(*) filter (where symbol = 'P0') as b from oof group by 1, 2) select cast(fold as bigint) as fold, cast(sum(n) as bigint) as events, round(sum(b) / sum(n), 6) + 0e0 as benchmark_share, count(*) filter (where n > 1) as shared_times, max(n) as most_at_once from g group by 1"),
)
add(
    "threshold_diagnostic",
    lambda s, d: E.threshold_diagnostic(M.threshold_statistics(ev(s, d), "p_primary", TAUS)).select(*rr("threshold"), "n", *rr("sum_net")),
    over("oof", NET + f", h as (select threshold, count(*) filter (where p_primary >= threshold) as n, sum(net) filter (where p_primary >= threshold) as s from e, (values {values((t,) for t in TAUS)}) t(threshold) group by 1) select round(threshold, 6) + 0e0 as threshold, n, round(s, 6) + 0e0 as sum_net from h order by round(s, 12) desc, threshold desc limit 1"),
)


def live_and_rebuilt(s, d):
    t = V.bars(s, d).withColumn("seq", F.lit(0))
    live = t.select("symbol", "open_us", "seq", (F.col("taker_buy") / F.col("volume")).alias("v"))
    again = live.withColumns({"seq": F.lit(1), "v": F.col("v") * 0.9}).where("open_us % 7200000000 = 0")
    return live.unionByName(again), t.select("symbol", "open_us", "seq", (F.col("close") / F.col("high")).alias("v"))


add(
    "imbalance_report",
    lambda s, d: E.imbalance_report(*live_and_rebuilt(s, d), "v").select("symbol", "n", *rr("pearson", "spearman", "median_bias"), "verdict"),
    over("bars", """, p as (select symbol, taker_buy / volume * case when open_us % 7200000000 = 0 then 0.9e0 else 1e0 end as x, close / high as y from bars),
      k as (select *, rank() over (partition by symbol order by x) + (count(*) over (partition by symbol, x) - 1) / 2e0 as rx, rank() over (partition by symbol order by y) + (count(*) over (partition by symbol, y) - 1) / 2e0 as ry from p),
      a as (select symbol, count(*) as n, corr(x, y) as pe, corr(rx, ry) as sp, quantile_cont(x - y, 0.5) as b from k group by 1)
      select symbol, n, round(pe, 6) + 0e0 as pearson, round(sp, 6) + 0e0 as spearman, round(b, 6) + 0e0 as median_bias, case when n < 50 then 'insufficient_overlap' when pe >= 0.7 then 'approved' when pe >= 0.4 then 'caution' else 'rejected' end as verdict from a"""),
)
