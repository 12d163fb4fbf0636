"""Registered queries of audits, sinks, live tables and regime tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import DAY, HOUR, quotient
from tidewater.functions.columns import rounded as r
from tidewater.operators import audits as A
from tidewater.operators import features as X
from tidewater.operators import live as P
from tidewater.operators import metrics as M
from tidewater.operators import regime as G
from tidewater.operators.series import asof_join, rolling, running_sums
from tidewater.plans.metric_queries import NET, big, ev, rr
from tidewater.plans.sqlviews import over
from tidewater.sources import archives as R
from tidewater.sources import sinks as S
from tidewater.sources import views as V
from tidewater.sources.store import materialise, new_path

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


add(
    "distinct_rows",
    lambda s, d: A.distinct_rows(V.table(s, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus", "l_discount"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
    "select l_returnflag, count(*) as n from (select distinct l_orderkey, l_returnflag, l_linestatus, l_discount from lineitem) group by 1",
)


def written_times(s, d):
    """Event times written in several ways, some of them broken."""
    t = F.timestamp_micros(F.floor(F.col("us") / 60_000_000) * 60_000_000)
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k == 3, F.concat(F.lit(" "), F.date_format(t, "yyyy/MM/dd HH:mm"))).when(k == 4, F.date_format(t, "yyyy-MM-dd")).otherwise("soon")
    )
    return V.events(s, d).select("event_id", text.alias("written"))


TIMES = "with t as (select event_id, case when event_id % 6 < 4 then epoch_us(date_trunc('minute', ts)) when event_id % 6 = 4 then epoch_us(cast(date_trunc('day', ts) as timestamp)) end as us from events)"
add("mixed_times", lambda s, d: A.parsed_times(written_times(s, d), "written").select("event_id", "us"), TIMES + " select event_id, us from t")
add(
    "mixed_times_report",
    lambda s, d: A.parse_report(written_times(s, d), "written"),
    TIMES + " select count(*) as rows, count(us) as parsed, count(*) filter (where us is null) as invalid, min(us) as first_us, max(us) as last_us from t",
)
add(
    "claimed_rows",
    lambda s, d: A.claims(V.oof(s, d), V.oof(s, d).where("fold < 5").groupBy("symbol", "fold").agg((F.count(F.lit(1)) + F.when(F.col("symbol") == "P3", 1).otherwise(0)).alias("claimed")), ["symbol", "fold"]).select("symbol", *big("fold", "claimed", "observed"), "agrees"),
    over("oof", ", o as (select symbol, fold, count(*) as n from oof group by 1, 2) select symbol, cast(fold as bigint) as fold, case when fold < 5 then n + (symbol = 'P3')::int else 0 end as claimed, n as observed, fold < 5 and symbol <> 'P3' as agrees from o"),
)
add(
    "repeated_keys",
    lambda s, d: A.repeated_keys({"a": V.oof(s, d).where("event_id % 2 = 0"), "b": V.oof(s, d).where("event_id % 3 = 0")}, ["symbol", "decision_us"]).groupBy("inputs").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")),
    over("oof", " select 'a,b' as inputs, count(*) as keys, cast(2 * count(*) as bigint) as n from oof where event_id % 6 = 0"),
)
CUBE = "coalesce(symbol, '*') as symbol, coalesce(cast(fold as bigint), -1) as fold"


def funding_matches(s, d):
    j = asof_join(V.decisions(s, d), V.funding(s, d), ["symbol"], "decision_us", "settle_us", 6 * HOUR).withColumn("fold", F.col("event_id") % 4)
    return A.failed_matches(j, F.col("r_settle_us").isNotNull(), F.coalesce(F.col("r_funding_rate") > 0, F.lit(False)), "decision_us")


add(
    "failed_matches",
    lambda s, d: funding_matches(s, d).select(F.coalesce("symbol", F.lit("*")).alias("symbol"), F.coalesce("fold", F.lit(-1)).alias("fold"), "rows", "unmatched", "unusable", "first_us", "last_us"),
    over("decisions funding", f""", j as (select d.symbol, d.decision_us, d.event_id % 4 as fold, case when d.decision_us - f.settle_us <= 21600000000 then f.settle_us end as src, case when d.decision_us - f.settle_us <= 21600000000 then f.funding_rate end as rate
        from decisions d asof left join funding f on d.symbol = f.symbol and d.decision_us >= f.settle_us)
      select {CUBE}, count(*) as rows, count(*) filter (where src is null) as unmatched, count(*) filter (where src is not null) as unusable, min(decision_us) as first_us, max(decision_us) as last_us from j where src is null or not rate > 0 group by cube (symbol, fold)"""),
)
CONFIGS = [f"c{i}" for i in range(5)]


def panel(s, d):
    """Predictions of four of five configurations, with gaps, repeats and strangers."""
    p = V.oof(s, d).select("symbol", "decision_us", "event_id", F.explode(F.array(*map(F.lit, CONFIGS[:4]))).alias("config_id"))
    p = p.where("config_id != 'c1' or event_id % 5 != 0")
    return p.unionByName(p.where("config_id = 'c2' and event_id % 7 = 0")).withColumn("symbol", F.when((F.col("config_id") == "c3") & (F.col("event_id") % 50 == 0), "PX").otherwise(F.col("symbol")))


add(
    "panel_completeness",
    lambda s, d: A.panel_gaps(panel(s, d), V.oof(s, d), s.createDataFrame([(c,) for c in CONFIGS], "config_id string"), ["symbol", "decision_us"]).select("config_id", *big("predicted", "repeated", "unexpected", "missing"), "complete"),
    over("oof", """, n as (select count(*) as n, count(*) filter (where event_id % 5 = 0) as f, count(*) filter (where event_id % 7 = 0) as v, count(*) filter (where event_id % 50 = 0) as x from oof)
      select 'c0' as config_id, n as predicted, 0 as repeated, 0 as unexpected, 0 as missing, true as complete from n union all select 'c1', n - f, 0, 0, f, false from n union all select 'c2', n, v, 0, 0, false from n
      union all select 'c3', n, 0, x, x, false from n union all select 'c4', 0, 0, 0, n, false from n"""),
)
add(
    "affected_signature",
    lambda s, d: A.signature(V.oof(s, d).where("fold = 5 and event_id % 3 = 0"), "decision_us"),
    over("oof", """, a as (select * from oof where fold = 5 and event_id % 3 = 0) select 'rows' as part, 'all' as key, count(*) as value from a union all select 'time', 'first', min(decision_us) from a union all select 'time', 'last', max(decision_us) from a
      union all select 'symbol', symbol, count(*) from a group by 2 union all select 'fold', cast(fold as varchar), count(*) from a group by 2"""),
)
add(
    "signature_gaps",
    lambda s, d: A.signature_gaps(A.signature(V.oof(s, d).where("fold = 5"), "decision_us"), A.signature(V.oof(s, d).where("fold = 5 and symbol != 'P2'"), "decision_us").where("part in ('rows', 'symbol')")).where("part in ('rows', 'symbol')"),
    over("oof", """, a as (select * from oof where fold = 5) select 'rows' as part, 'all' as key, count(*) as observed, count(*) filter (where symbol <> 'P2') as expected from a having count(*) filter (where symbol = 'P2') > 0
      union all select 'symbol', 'P2', count(*), null from a where symbol = 'P2' having count(*) > 0"""),
)


def uses(s, d):
    k = F.col("l_partkey") % 50
    return V.table(s, d, "lineitem").select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("required_by"),
        (k * 10 + F.when(F.col("l_orderkey") % 997 == 0, 1).otherwise(0)).alias("size"), F.sha2(k.cast("string"), 256).alias("sha256"),
    )


add(
    "input_lineage",
    lambda s, d: A.lineage(uses(s, d)),
    """select 'f' || cast(l_partkey % 50 as varchar) as path, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as roles, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') as required_by, count(*) as uses,
      count(distinct case when l_orderkey % 997 = 0 then 1 else 0 end) > 1 as conflict from lineitem group by 1""",
)
add(
    "archive_completeness",
    lambda s, d: A.archive_completeness(V.table(s, d, "orders").select(F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"), F.date_format("o_orderdate", "yyyy-MM").alias("file")), s.createDataFrame([(f"P{i}", 80) for i in range(8)], "symbol string, expected int")).select("symbol", *big("files", "expected"), "complete"),
    """with h as (select 'P' || cast(o_custkey % 7 as varchar) as symbol, count(distinct strftime(o_orderdate, '%Y-%m')) as n from orders group by 1), e as (select 'P' || cast(i as varchar) as symbol from range(8) t(i))
      select symbol, coalesce(n, 0) as files, 80 as expected, coalesce(n, 0) = 80 as complete from e left join h using (symbol)""",
)
add(
    "column_mismatches",
    lambda s, d: A.column_mismatches(V.bars(s, d), V.bars(s, d).where("trades > 1").withColumns({"volume": F.when(F.col("trades") % 3 != 0, F.col("volume")), "close": F.col("close")}), ["symbol", "open_us"], ["open", "close", "volume"]).select("rows", "column", "mismatches"),
    over("bars", """, b as (select * from bars where trades > 1) select count(*) as rows, 'open' as "column", 0 as mismatches from b union all select count(*), 'close', 0 from b union all select count(*), 'volume', count(*) filter (where trades % 3 = 0) from b"""),
)
add(
    "off_calendar",
    lambda s, d: A.off_calendar(V.oof(s, d), "decision_us", 4 * HOUR, ["P0", "P1", "P2", "P3", "P4", "P5"]),
    over("oof", " select symbol, count(*) as rows, count(*) filter (where decision_us % 14400000000 <> 0) as off_grid, symbol <> 'P6' as known from oof group by 1"),
)
add(
    "source_diagnostics",
    lambda s, d: A.source_report(V.funding(s, d).withColumns({"t": F.when(F.col("settle_us") % 7 != 0, F.floor(F.col("settle_us") / HOUR)), "funding_rate": F.when(F.col("settle_us") % 5 == 0, float("inf")).otherwise(F.col("funding_rate"))}), F.col("t"), ["symbol"], ["funding_rate"]),
    over("funding", """, x as (select symbol, case when settle_us % 7 <> 0 then settle_us // 3600000000 end as t, settle_us % 5 = 0 as bad from funding)
      select count(*) as rows, count(*) filter (where t is null) as bad_times, count(*) filter (where bad) as not_finite_funding_rate, (select coalesce(cast(sum(n - 1) as bigint), 0) from (select count(*) as n from x where t is not null group by symbol, t)) as repeated from x"""),
)


def regime_rows(s, d):
    """Bars dressed as a regime file: most rows ok, some broken in each way."""
    k = F.col("trades") % 12
    bull = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("close") / (F.col("close") + F.col("open"))))
    return V.bars(s, d).select(
        "symbol", F.col("open_us").alias("us"), F.when(k == 0, "no").otherwise(" True").alias("ok"), F.when(k == 1, "sideways").when(F.col("close") > F.col("open"), "BULL").otherwise("bear").alias("regime"),
        F.when(k == 2, "maybe").otherwise("Allow").alias("policy"), bull.alias("bull"), F.when(k == 3, 2.0).otherwise(0.0).alias("neutral"), F.when(k == 4, F.lit(1.2) - bull).otherwise(1 - bull).alias("bear"), F.lit(0.7).alias("confidence"),
    )


add(
    "regime_source",
    lambda s, d: A.regime_source(regime_rows(s, d)).groupBy("ok", "regime", F.coalesce("violation", F.lit("-")).alias("violation")).agg(F.count(F.lit(1)).alias("n"), F.count("policy_code").alias("policies"), r(F.sum("bull"), 4).alias("bull")),
    over("bars", """, x as (select trades % 12 as k, close > open as up, greatest(0, least(1, close / (close + open))) as b from bars)
      select k <> 0 as ok, case when k = 0 then 'missing' when k = 1 then 'sideways' when up then 'bull' else 'bear' end as regime,
        case when k = 1 then 'regime' when k = 2 then 'policy' when k = 3 or (k = 4 and 1.2e0 - b > 1) then 'probability' when k = 4 then 'sum' else '-' end as violation,
        count(*) as n, count(*) filter (where k not in (0, 2)) as policies, round(sum(case when k <> 0 then b end), 4) + 0e0 as bull from x group by 1, 2, 3"""),
)
add(
    "source_cadence",
    lambda s, d: A.cadence(rolling(V.bars(s, d), ["symbol"], ["open_us"], 1, lambda w: {"gap": F.col("open_us") - F.lag("open_us").over(w)}), "gap"),
    over("bars", ", g as (select symbol, open_us - lag(open_us) over (partition by symbol order by open_us) as g from bars), c as (select symbol, g, count(*) as n from g where g is not null group by 1, 2) select symbol, g as cadence from (select *, row_number() over (partition by symbol order by n desc, g) as k from c) where k = 1"),
)


def archive_files(s, d):
    o = V.table(s, d, "orders").select(F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
    monthly = o.where("month(day) % 4 != 0").select("symbol", F.lit("monthly").alias("kind"), F.trunc("day", "month").alias("day"))
    return monthly.unionByName(o.select("symbol", F.lit("daily").alias("kind"), "day")).distinct()


add(
    "chosen_files",
    lambda s, d: R.chosen_files(archive_files(s, d), "1993-02-10", "1996-08-20").select("symbol", "kind", F.date_format("day", "yyyy-MM-dd").alias("day")),
    """with o as (select distinct 'P' || cast(o_custkey % 7 as varchar) as symbol, cast(o_orderdate as date) as day from orders), m as (select distinct symbol, cast(date_trunc('month', day) as date) as day from o where month(day) % 4 <> 0)
      select symbol, 'monthly' as kind, strftime(day, '%Y-%m-%d') as day from m where day between date '1993-02-01' and date '1996-08-20'
      union all select symbol, 'daily', strftime(day, '%Y-%m-%d') from o where day between date '1993-02-10' and date '1996-08-20' and (symbol, cast(date_trunc('month', day) as date)) not in (select (symbol, day) from m)""",
)
add(
    "sane_bars",
    lambda s, d: X.sane_bars(V.bars(s, d).withColumns({"volume": F.when(F.col("trades") % 5 == 0, -1.0).otherwise(F.col("volume")), "high": F.when(F.col("trades") % 7 == 0, float("inf")).otherwise(F.col("high"))})).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum("volume"), 3).alias("volume")),
    over("bars", " select symbol, count(*) as n, round(sum(volume), 3) + 0e0 as volume from bars where trades % 5 <> 0 and trades % 7 <> 0 and close > 0 and low > 0 group by 1"),
)
add(
    "legacy_regime_features",
    lambda s, d: X.legacy_regime_features(V.bars(s, d)).select("symbol", "open_us", *rr("ret", "range", "dvolume", "deviation24", "trend8")),
    over("bars", """, f as (select symbol, open_us, ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) over w as ret, ln(greatest(high, 1e-12)) - ln(greatest(low, 1e-12)) as rg, ln(greatest(volume, 1e-12)) - lag(ln(greatest(volume, 1e-12))) over w as dv from bars window w as (partition by symbol order by open_us))
      select symbol, open_us, round(ret, 6) + 0e0 as ret, round(rg, 6) + 0e0 as range, round(dv, 6) + 0e0 as dvolume, round(case when count(ret) over a = 24 then stddev_samp(ret) over a end, 6) + 0e0 as deviation24, round(case when count(ret) over b = 8 then avg(ret) over b end, 6) + 0e0 as trend8
      from f window a as (partition by symbol order by open_us rows 23 preceding), b as (partition by symbol order by open_us rows 7 preceding)"""),
)

# sinks: written to the shared folder and read back


def dataset_back(s, d):
    path = new_path(s, "dataset")
    S.write_dataset(V.bars(s, d), path)
    return S.read_dataset(s, path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(F.sum("close"), 4).alias("close"))


add("dataset_round_trip", dataset_back, over("bars", " select symbol, count(*) as n, round(sum(close), 4) + 0e0 as close from bars group by 1"))


def labelled_bars(s, d):
    k = F.col("trades") % 4
    return V.bars(s, d).withColumns({"tb_label": F.when(k < 3, k - 1), "tb_uniqueness": F.when(k < 3, 1.0 / F.col("trades")), "f": F.when(F.col("trades") % 6 == 0, float("nan")).otherwise(F.col("close"))})


add(
    "dataset_metadata",
    lambda s, d: S.dataset_metadata(labelled_bars(s, d), ["f", "volume"]).select("symbol", "rows", "events", "profits", "stops", "neither", *rr("mean_uniqueness", "coverage")),
    over("bars", """ select symbol, count(*) as rows, count(*) filter (where trades % 4 < 3) as events, count(*) filter (where trades % 4 = 2) as profits, count(*) filter (where trades % 4 = 0) as stops, count(*) filter (where trades % 4 = 1) as neither,
      round(avg(case when trades % 4 < 3 then 1e0 / trades end), 6) + 0e0 as mean_uniqueness, round(avg((trades % 6 <> 0)::int), 6) + 0e0 as coverage from bars group by 1"""),
)


def oof_back(s, d):
    path = new_path(s, "oof")
    S.write_oof(V.oof(s, d).dropDuplicates(["symbol", "decision_us"]), path)
    return S.fired(s.read.parquet(path), 0.9).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p_primary"), 4).alias("p")).select(*big("fold"), "n", "p")


add("oof_round_trip", oof_back, over("oof", " select cast(fold as bigint) as fold, count(*) as n, round(sum(p_primary), 4) + 0e0 as p from oof where p_primary >= 0.9 group by 1"))
add(
    "oof_violations",
    lambda s, d: S.oof_violations(V.oof(s, d).withColumns({"fold": F.col("fold") + F.when(F.col("event_id") % 9 == 0, 0.5).otherwise(0.0), "p_primary": F.when(F.col("event_id") % 4 == 0, 1.5).otherwise(F.col("p_primary")), "ret": F.when(F.col("event_id") % 8 != 0, F.col("ret"))})),
    over("oof", """ select 'null:ret' as "check", count(*) as violations from oof where event_id % 8 = 0 union all select 'range:p_primary', count(*) from oof where event_id % 4 = 0 union all select 'domain:_fold', count(*) from oof where event_id % 9 = 0"""),
)


def history(s, d):
    e = V.events(s, d).withColumns({"symbol": F.upper("event_type"), "a": F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")), "b": F.when(F.col("event_id") % 2 == 0, F.col("user_id"))})
    return S.history_rows(e, ["a", "b"], F.when(F.col("event_id") % 5 != 0, F.col("us")), F.lit(1_700_000_000_000_000))


def history_back(s, d):
    path = new_path(s, "history")
    S.append_history(history(s, d).where("us % 2000 < 1000"), path)
    S.append_history(history(s, d).where("us % 2000 >= 1000"), path)
    v = s.read.text(path).withColumn("_v", F.try_parse_json("value"))
    get = lambda k, t: F.try_variant_get("_v", k, t)
    return v.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(get("$.features.a", "double")).alias("a"), r(F.sum(get("$.features.b", "double")), 3).alias("b"), F.max(get("$.ts", "long")).alias("last_ms"))


add(
    "history_round_trip",
    history_back,
    """select upper(event_type) as symbol, count(*) as n, count(*) filter (where event_id % 3 <> 0) as a, round(sum(case when event_id % 2 = 0 then cast(user_id as double) end), 3) + 0e0 as b,
      max(case when event_id % 5 <> 0 then epoch_us(ts) // 1000 else 1700000000000 end) as last_ms from events where event_id % 3 <> 0 or event_id % 2 = 0 group by 1""",
)
add(
    "report_rows",
    lambda s, d: S.report({"dispersion": M.dispersion(ev(s, d), "p_meta", ["fold"]), "weights": M.class_weights(ev(s, d), "win", "uniqueness", ["symbol"])}, {"dispersion": ["fold"], "weights": ["symbol"]}).select("report", "key", "metric", r(F.col("value"), 5).alias("value")),
    over("oof", NET + ", a as (select fold, " + ", ".join(f"{x} as {n}" for n, x in (("lowest", "min(p_meta)"), ("highest", "max(p_meta)"), ("mean", "avg(p_meta)"), ("deviation", "stddev_pop(p_meta)"), ("distinct_", "count(distinct p_meta)")))
      + " from e group by 1), b as (select symbol, sum(case when win = 0 then uniqueness else 0 end) as n, sum(case when win = 1 then uniqueness else 0 end) as p from e group by 1) "
      + " union all ".join([f"select 'dispersion' as report, cast(fold as varchar) as key, '{m.rstrip('_')}' as metric, round(cast({m} as double), 5) + 0e0 as value from a" for m in ("lowest", "highest", "mean", "deviation", "distinct_")] + [f"select 'weights', symbol, '{m}', round({x}, 5) + 0e0 from b" for m, x in (("negative_mass", "n"), ("positive_mass", "p"), ("scale_pos_weight", "n / p"))])),
)


def ledger_back(s, d):
    path = new_path(s, "ledger")
    stats = M.threshold_statistics(ev(s, d), "p_primary", (0.55, 0.75)).select("fold", "threshold", F.col("n").alias("trades"))
    S.append_ledger(stats, path, "run-1")
    S.append_ledger(stats.where("fold > 2").withColumn("trades", F.col("trades") + 1), path, "run-2")
    return S.latest_entries(s.read.parquet(path), ["fold", "threshold"]).select(*big("fold"), *rr("threshold"), "trades", "run")


add(
    "ledger_latest",
    ledger_back,
    over("oof", " select cast(fold as bigint) as fold, round(threshold, 6) + 0e0 as threshold, count(*) filter (where p_primary >= threshold) + max((fold > 2)::int) as trades, case when max(fold) > 2 then 'run-2' else 'run-1' end as run from oof, (values (0.55e0), (0.75e0)) t(threshold) group by fold, threshold"),
)

# live tables


def book(s, d):
    accounts = V.table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").cast("double").alias("cash"))
    k = F.col("o_orderkey")
    positions = V.table(s, d, "orders").select(
        F.col("o_custkey").alias("account"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("symbol"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (100 + k % 13).cast("double").alias("entry"), (1 + k % 3).cast("double").alias("size"), F.lit(10.0).alias("margin"))
    prices = s.createDataFrame([(f"S{i}", 100.0 + i) for i in range(4)], "symbol string, price double")
    return accounts, positions, prices


add(
    "account_values",
    lambda s, d: P.valuation(*book(s, d)).select("account", *rr("cash", "margin", "unrealised", "equity", digits=4), "unpriced"),
    """with p as (select o_custkey as account, o_orderkey % 5 as k, case when o_orderkey % 2 = 0 then 1 else -1 end as sg, 100 + o_orderkey % 13 as entry, 1 + o_orderkey % 3 as size from orders),
      g as (select account, count(*) * 10e0 as margin, sum(case when k < 4 then (100e0 + k - entry) * size * sg else 0 end) as u, count(*) filter (where k = 4) as n from p group by 1)
      select c_custkey as account, round(cast(c_acctbal as double), 4) + 0e0 as cash, round(coalesce(margin, 0), 4) + 0e0 as margin, round(coalesce(u, 0), 4) + 0e0 as unrealised, round(cast(c_acctbal as double) + coalesce(margin, 0) + coalesce(u, 0), 4) + 0e0 as equity, coalesce(n, 0) as unpriced from customer left join g on account = c_custkey""",
)


def equity(s, d):
    run = running_sums(ev(s, d), ["symbol"], ["decision_us"], {"sum": "net"})
    return P.drawdowns(run.select("symbol", "decision_us", (10 + F.col("sum")).alias("equity")))


EQ = NET + """, q as (select symbol, decision_us, 10 + sum(net) over (partition by symbol order by decision_us) as eq from e), dd as (select *, greatest(0, (max(eq) over (partition by symbol order by decision_us) - eq) / max(eq) over (partition by symbol order by decision_us)) as dd from q)"""
add("equity_drawdowns", lambda s, d: equity(s, d).select("symbol", "decision_us", *rr("equity", "drawdown", digits=5)), over("oof", EQ + " select symbol, decision_us, round(eq, 5) + 0e0 as equity, round(dd, 5) + 0e0 as drawdown from dd"))
add(
    "circuit_breaker",
    lambda s, d: P.circuit_breaker(equity(s, d), limit=0.02, cooldown=40 * HOUR).groupBy("symbol").agg(F.count_if("paused").alias("paused"), F.countDistinct("tripped_us").alias("trips"), F.max("tripped_us").alias("last_trip")),
    over("oof", "").replace("with ", "with recursive ") + EQ + """, h as (select symbol, decision_us from dd where dd >= 0.02),
      c as (select symbol, min(decision_us) as t from h group by 1 union all select c.symbol, (select min(h.decision_us) from h where h.symbol = c.symbol and h.decision_us >= c.t + 144000000000) from c where c.t is not null),
      t as (select symbol, t from c where t is not null)
      select d.symbol, count(distinct d.decision_us) filter (where t.t is not null) as paused, count(distinct t.t) as trips, max(t.t) as last_trip from (select distinct symbol, decision_us from dd) d left join t on t.symbol = d.symbol and d.decision_us >= t.t and d.decision_us < t.t + 144000000000 group by 1""",
)


def entries(s, d):
    b = V.bars(s, d).where("trades % 2 = 0").select("symbol", "open_us", F.col("close").alias("entry"), (F.col("low") * 0.99).alias("stop"), (F.col("high") * 1.05).alias("target"))
    g = V.bars(s, d).where("trades % 3 = 0").select("symbol", F.col("open_us").alias("regime_us"), F.when(F.col("close") > F.col("open"), "bull").otherwise("bear").alias("regime"))
    return P.entries(b, g)


add(
    "opened_positions",
    lambda s, d: entries(s, d).select("symbol", "open_us", *rr("initial_rr"), "at_regime", "at_regime_us"),
    over("bars", """, b as (select symbol, open_us, close as entry, low * 0.99e0 as stop, high * 1.05e0 as target from bars where trades % 2 = 0), g as (select symbol, open_us as regime_us, case when close > open then 'bull' else 'bear' end as regime from bars where trades % 3 = 0)
      select b.symbol, b.open_us, coalesce(round(round(abs(target - entry) / nullif(abs(entry - stop), 0), 2), 6), 0) + 0e0 as initial_rr, g.regime as at_regime, g.regime_us as at_regime_us from b asof left join g on b.symbol = g.symbol and b.open_us >= g.regime_us"""),
)


def stops(s, d):
    def columns(w):
        return {"atr": F.avg(F.col("high") - F.col("low")).over(X.back(w, 14)), "lo": F.min("low").over(X.back(w, 12)), "hi": F.max("high").over(X.back(w, 12))}

    b = rolling(V.bars(s, d), X.KEYS, X.ORDER, 14, columns).withColumn("side", F.when(F.col("trades") % 2 == 0, "BUY").otherwise("SELL"))
    stop, target = P.stop_target(F.col("side"), F.col("close"), F.col("lo"), F.col("hi"), F.col("atr"), (F.col("trades") * 7 % 50).cast("double"))
    return b.select("symbol", "open_us", "side", r(stop).alias("stop"), r(target).alias("target"))


add(
    "stops_and_targets",
    stops,
    over("bars", """, a as (select *, avg(high - low) over (partition by symbol order by open_us rows 13 preceding) as atr, min(low) over (partition by symbol order by open_us rows 11 preceding) as lo, max(high) over (partition by symbol order by open_us rows 11 preceding) as hi, trades * 7 % 50 as adx from bars),
      s as (select *, case when trades % 2 = 0 then greatest(lo * 0.998, close - 2.5 * atr) else least(hi * 1.002, close + 2.5 * atr) end as stop from a)
      select symbol, open_us, case when trades % 2 = 0 then 'BUY' else 'SELL' end as side, round(stop, 6) + 0e0 as stop, round(close + (close - stop) * case when adx > 40 then 2.5 when adx > 30 then 2.0 else 1.6 end, 6) + 0e0 as target from s"""),
)

# regime tables


def state_rows(s, d):
    b = V.bars(s, d)
    up = F.col("close") / (F.col("close") + F.col("open"))
    return b.select("symbol", "open_us", F.explode(F.array(*(F.struct(F.lit(n).alias("state_regime"), p.alias("p")) for n, p in (("bull", up / 2), ("bear", 1 - up), ("bull", F.when(F.col("trades") % 5 == 0, 0.0).otherwise(up / 4)), ("neutral", F.lit(0.1)))))).alias("x")).select("symbol", "open_us", F.col("x.state_regime").alias("state_regime"), F.when(F.col("open_us") % (7 * HOUR) != 0, F.col("x.p")).otherwise(0.0).alias("p"))


add(
    "regime_probabilities",
    lambda s, d: G.regime_probabilities(state_rows(s, d)).select("symbol", "open_us", *rr("bear", "neutral", "bull")),
    over("bars", """, x as (select symbol, open_us, open_us % 25200000000 = 0 as none, close / (close + open) as up, trades from bars), y as (select *, up / 2 + case when trades % 5 = 0 then 0 else up / 4 end as bu, 1 - up as be, 0.1e0 as ne from x)
      select symbol, open_us, round(case when none then 0 else be / (bu + be + ne) end, 6) + 0e0 as bear, round(case when none then 1 else ne / (bu + be + ne) end, 6) + 0e0 as neutral, round(case when none then 0 else bu / (bu + be + ne) end, 6) + 0e0 as bull from y"""),
)


def posterior_rows(s, d):
    """State probabilities of bars; quotients of prices that are 0 are infinite or NaN, as in the SQL."""
    x = quotient(F.col("close"), F.col("close") + F.col("open"))
    return V.bars(s, d).select("symbol", F.floor(F.col("open_us") / (4 * DAY)).alias("window"), F.col("open_us").alias("pos"), F.array(1 - x, x / 2, x / 2 * F.lit(1.0)).alias("post"), F.ln(quotient(F.col("close"), F.col("open"))).alias("trend"), (F.col("trades") / 10.0).alias("ret"), F.col("volume").alias("vol"), F.ln(quotient(F.col("high"), F.col("low"))).alias("range"))


add(
    "state_statistics",
    lambda s, d: G.state_statistics(posterior_rows(s, d)).select("symbol", "window", *big("state"), *rr("occupancy", "mean_trend", "mean_ret", "mean_vol", "mean_range", "persistence", digits=5), "regime"),
    over("bars", """, x as (select symbol, open_us // 345600000000 as win, open_us, close / (close + open) as x, ln(close / open) as tr, trades / 1e1 as rt, volume as vl, ln(high / low) as rg from bars),
      h as (select *, case when 1 - x >= x / 2 then 0 else 1 end as st from x),
      n as (select *, lead(st) over (partition by symbol, win order by open_us) as nx, count(*) over (partition by symbol, win) as rows from h),
      g as (select symbol, win, st, count(*) / any_value(rows) as oc, avg(tr) as mt, avg(rt) as mr, abs(avg(vl)) as mv, abs(avg(rg)) as mg, avg(cast(nx = st as int)) as pe from n group by 1, 2, 3),
      f as (select k.symbol, k.win, t.st, coalesce(oc, 0) as oc, coalesce(mt, 0) as mt, coalesce(mr, 0) as mr, coalesce(mv, 0) as mv, coalesce(mg, 0) as mg, coalesce(pe, 0) as pe, coalesce(mt + 0.5e0 * mr, 0) as sc
        from (select distinct symbol, win from x) k join range(3) t(st) on true left join g on g.symbol = k.symbol and g.win = k.win and g.st = t.st),
      o as (select *, row_number() over (partition by symbol, win order by sc, st) as lo, row_number() over (partition by symbol, win order by sc desc, st desc) as hi, row_number() over (partition by symbol, win order by mv + mg desc, st) as rk,
        max(sc) over (partition by symbol, win) - min(sc) over (partition by symbol, win) as sp from f),
      q as (select *, row_number() over (partition by symbol, win order by rk = 1, oc desc, st) as re from o)
      select symbol, win as window, st as state, round(oc, 5) + 0e0 as occupancy, round(mt, 5) + 0e0 as mean_trend, round(mr, 5) + 0e0 as mean_ret, round(mv, 5) + 0e0 as mean_vol, round(mg, 5) + 0e0 as mean_range, round(pe, 5) + 0e0 as persistence,
        case when sp <= 1e-8 then case when rk = 1 then 'bear' when re = 1 then 'bull' else 'neutral' end when lo = 1 then 'bear' when hi = 1 then 'bull' else 'neutral' end as regime from q"""),
)


def centred(s, d):
    """Centres, scores and regimes of the states of each window of `state_statistics`, the return in hundredths."""
    st = G.state_statistics(posterior_rows(s, d))
    each = F.array_sort(F.collect_list(F.struct("state", "mean_trend", "mean_ret", "score", "regime")))
    rows = st.groupBy("symbol", "window").agg(each.alias("r"))
    return rows.select("symbol", "window", F.transform("r", lambda x: F.array(x["mean_trend"], x["mean_ret"] / 100)).alias("centers"), F.col("r.score").alias("scores"), F.col("r.regime").alias("regimes"))


add("matched_states", lambda s, d: G.match_states(centred(s, d)).select("symbol", "window", *big("state"), "regime", "method", *rr("distance")))


def report_rows(s, d):
    def columns(w):
        x = F.when(F.col("close") > F.col("open") * 1.2, "bull").when(F.col("close") < F.col("open") * 0.8, "bear").otherwise("neutral")
        ok = F.col("trades") % 4 != 0
        return {"regime": x, "ok": ok, "previous": F.lag(F.when(ok, x)).over(w), "fwd": F.ln(F.lead("close").over(w) / F.col("close"))}

    return rolling(V.bars(s, d), ["symbol"], ["open_us"], 1, columns, ahead=1)


SUMS = ["ok_rate", "bear_share", "neutral_share", "bull_share", "bear_fwd", "neutral_fwd", "bull_fwd", "bear_hits", "bull_hits", "spread"]
add(
    "regime_report",
    lambda s, d: G.regime_report(report_rows(s, d)).select("symbol", "rows", "switches", *rr(*SUMS)),
    over("bars", """, x as (select *, case when close > open * 1.2e0 then 'bull' when close < open * 0.8e0 then 'bear' else 'neutral' end as g, trades % 4 <> 0 as ok from bars),
      y as (select *, lag(case when ok then g end) over w as pv, ln(lead(close) over w / close) as fwd from x window w as (partition by symbol order by open_us)),
      z as (select symbol, count(*) as rows, count(*) filter (where ok and pv <> g) as switches, avg(ok::int) as ok_rate, """ + ", ".join(f"count(*) filter (where ok and g = '{n}') / count(*) filter (where ok) as {n}_share, avg(fwd) filter (where ok and g = '{n}') as {n}_fwd" for n in ("bear", "neutral", "bull"))
      + ", avg((fwd < 0)::int) filter (where ok and g = 'bear') as bear_hits, avg((fwd > 0)::int) filter (where ok and g = 'bull') as bull_hits from y group by 1), q as (select *, bull_fwd - bear_fwd as spread from z) select symbol, rows, switches, " + ", ".join(f"round({c}, 6) + 0e0 as {c}" for c in SUMS) + " from q"),
)
CAUSAL = {"base": X.base_features, "rolling": X.rolling_statistics, "trends": X.trends, "distances": X.distances, "deviation": lambda b: X.ewm_std(X.base_features(b).drop("pos"), "log_return", 6), "ages": X.regime_ages}


def look_ahead(s, d):
    """Every causal feature set on all bars against the same on the first half of the time."""
    bars = materialise(V.bars(s, d), "bars")
    cut = bars.agg(F.floor((F.min("open_us") + F.max("open_us")) / 2)).first()[0]
    out = None
    for name, make in CAUSAL.items():
        part = A.prefix_differences(bars, make, cut).select(F.lit(name).alias("feature_set"), "rows", "differing")
        out = part if out is None else out.unionByName(part)
    return out


add(
    "prefix_invariance",
    look_ahead,
    over("bars", ", n as (select count(*) as rows from bars where open_us <= (select (min(open_us) + max(open_us)) // 2 from bars)) " + " union all ".join(f"select '{name}' as feature_set, rows, 0 as differing from n" for name in CAUSAL)),
)
