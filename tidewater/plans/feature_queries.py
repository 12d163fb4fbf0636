"""Registered queries over bars, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.functions.columns import rounded as r
from tidewater.operators import features as X
from tidewater.operators.series import asof_join, running_sums
from tidewater.plans.sqlviews import over
from tidewater.sources import views as V

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


W = "(partition by symbol order by open_us)"
RET = """, r as (select *, ln(close / lag(close) over (partition by symbol order by open_us)) as x from bars)"""

add(
    "bars_resample_4h",
    lambda s, d: X.resample(V.bars(s, d)).select("symbol", "open_us", *(r(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "taker_buy")), "trades", "n_bars"),
    over("bars", """select symbol, (open_us // 14400000000) * 14400000000 as open_us,
      round(min_by(open, open_us), 6) + 0e0 as open, round(max(high), 6) + 0e0 as high, round(min(low), 6) + 0e0 as low,
      round(max_by(close, open_us), 6) + 0e0 as close, round(sum(volume), 6) + 0e0 as volume, round(sum(taker_buy), 6) + 0e0 as taker_buy,
      cast(sum(trades) as bigint) as trades, count(*) as n_bars from bars group by 1, 2"""),
)
add(
    "bars_base_features",
    lambda s, d: X.base_features(V.bars(s, d)).select(
        "symbol", "open_us", *(r(F.col(c)).alias(c) for c in ("pct_return", "log_return", "log_range", "volume_change", "taker_ratio", "flow_imbalance")), "hour", "weekday"),
    over("bars", f""", q as (select *, close / nullif(lag(close) over {W}, 0) as rc, high / nullif(low, 0) as rr from bars)
      select symbol, open_us, round(rc - 1, 6) + 0e0 as pct_return,
      round(case when rc > 0 then ln(rc) end, 6) + 0e0 as log_return, round(case when rr > 0 then ln(rr) end, 6) + 0e0 as log_range,
      round(case when volume > 0 and lag(volume) over w > 0 then ln(volume / lag(volume) over w) end, 6) + 0e0 as volume_change,
      round(case when volume > 0 then greatest(0, least(1, taker_buy / volume)) else 0.5 end, 6) + 0e0 as taker_ratio,
      round(2 * case when volume > 0 then greatest(0, least(1, taker_buy / volume)) else 0.5 end - 1, 6) + 0e0 as flow_imbalance,
      cast(extract(hour from make_timestamp(open_us)) as bigint) as hour, cast(extract(isodow from make_timestamp(open_us)) - 1 as bigint) as weekday
      from q window w as {W}"""),
)
add(
    "bars_trends",
    lambda s, d: X.trends(V.bars(s, d)).select("symbol", "open_us", *(r(F.col(f"trend_{k}")).alias(f"trend_{k}") for k in (1, 7, 12, 24))),
    over("bars", "select symbol, open_us, " + ", ".join(f"round(ln(close / lag(close, {k}) over w), 6) + 0e0 as trend_{k}" for k in (1, 7, 12, 24)) + f" from bars window w as {W}"),
)
add(
    "bars_rolling_statistics",
    lambda s, d: X.rolling_statistics(V.bars(s, d)).select(
        "symbol", "open_us", *(r(F.col(c)).alias(c) for c in ("volume_z20", "volume_z50", "prior_z50", "tail_z20", "std_pop20", "std_samp24", "autocorr24", "mean8"))),
    over("bars", RET + """, p as (select *, lag(x) over (partition by symbol order by open_us) as x1 from r)
      select symbol, open_us,
      round(case when count(volume) over f20 = 20 then (volume - avg(volume) over f20) / nullif(stddev_pop(volume) over f20, 0) end, 6) + 0e0 as volume_z20,
      round(case when count(volume) over f50 = 50 then (volume - avg(volume) over f50) / nullif(stddev_pop(volume) over f50, 0) end, 6) + 0e0 as volume_z50,
      round(case when count(volume) over q50 = 50 then (volume - avg(volume) over q50) / nullif(stddev_pop(volume) over q50, 0) end, 6) + 0e0 as prior_z50,
      round(case when count(volume) over f20 >= 2 and stddev_pop(volume) over f20 > 1e-12 then (volume - avg(volume) over f20) / stddev_pop(volume) over f20 else 0 end, 6) + 0e0 as tail_z20,
      round(case when count(x) over f20 = 20 then stddev_pop(x) over f20 end, 6) + 0e0 as std_pop20,
      round(case when count(x) over f24 = 24 then stddev_samp(x) over f24 end, 6) + 0e0 as std_samp24,
      round(case when count(x) over f24 = 24 then corr(x, x1) over f23 end, 6) + 0e0 as autocorr24,
      round(case when count(x) over f8 >= 3 then avg(x) over f8 end, 6) + 0e0 as mean8
      from p window f20 as (partition by symbol order by open_us rows 19 preceding), f50 as (partition by symbol order by open_us rows 49 preceding),
      q50 as (partition by symbol order by open_us rows between 50 preceding and 1 preceding),
      f24 as (partition by symbol order by open_us rows 23 preceding), f23 as (partition by symbol order by open_us rows 22 preceding),
      f8 as (partition by symbol order by open_us rows 7 preceding)"""),
)
add(
    "bars_distances",
    lambda s, d: X.distances(V.bars(s, d)).select("symbol", "open_us", *(r(F.col(c)).alias(c) for c in ("from_high", "from_low", "swing_low", "swing_high"))),
    over("bars", """select symbol, open_us, round(ln(close / max(close) over f), 6) + 0e0 as from_high, round(ln(close / min(close) over f), 6) + 0e0 as from_low,
      round(min(low) over s, 6) + 0e0 as swing_low, round(max(high) over s, 6) + 0e0 as swing_high from bars
      window f as (partition by symbol order by open_us rows 167 preceding), s as (partition by symbol order by open_us rows 11 preceding)"""),
)
add(
    "bars_ewm_std",
    lambda s, d: X.ewm_std(X.base_features(V.bars(s, d)), "log_return", 6).select("symbol", "open_us", r(F.col("ewm_std")).alias("ewm_std")),
    over("bars", RET + """, n as (select symbol, open_us, x, row_number() over (partition by symbol order by open_us) - 1 as pos from r),
      b as (select symbol, min(pos) as first from n where x is not null group by 1),
      w as (select a.symbol, a.open_us, p.x, pow(5e0 / 7, a.pos - p.pos) * case when p.pos = greatest(b.first, a.pos - 76) then 1 else 2e0 / 7 end as w
            from n a join b using (symbol) join n p on p.symbol = a.symbol and p.pos between a.pos - 76 and a.pos and p.x is not null),
      s as (select symbol, open_us, count(*) as k, sum(w) as w, sum(w * w) as w2, sum(w * x) as wx, sum(w * x * x) as wxx from w group by 1, 2)
      select n.symbol, n.open_us, round(case when k >= 6 then sqrt(greatest((wxx / w - (wx / w) * (wx / w)) * (w * w / nullif(w * w - w2, 0)), 0)) end, 6) + 0e0 as ewm_std
      from n left join s using (symbol, open_us)"""),
)
add(
    "bars_forward_labels",
    lambda s, d: X.forward_labels(V.bars(s, d)).select("symbol", "open_us", r(F.col("fwd_return")).alias("fwd_return"), F.col("jump").cast("bigint").alias("jump")),
    over("bars", """, f as (select *, ln(lead(close, 5) over (partition by symbol order by open_us) / close) as x from bars),
      q as (select symbol, quantile_cont(abs(x), 0.9) as q from f group by 1),
      t as (select *, case when count(x) over v >= 25 then quantile_cont(abs(x), 0.9) over v end as own from f
            window v as (partition by symbol order by open_us rows between 50 preceding and 1 preceding))
      select t.symbol, open_us, round(x, 6) + 0e0 as fwd_return, cast(case when x is not null then abs(x) >= coalesce(own, q) end as bigint) as jump
      from t join q using (symbol)"""),
)
add(
    "bars_multi_timeframe",
    lambda s, d: X.multi_timeframe(V.bars(s, d)).select("symbol", "open_us", "d_close_us", r(F.col("d_close")).alias("d_close"), r(F.col("d_volume")).alias("d_volume")),
    over("bars", """, h as (select symbol, (open_us // 86400000000) * 86400000000 + 86400000000 as close_us, max_by(close, open_us) as c, sum(volume) as v from bars group by 1, 2)
      select b.symbol, b.open_us, h.close_us as d_close_us, round(h.c, 6) + 0e0 as d_close, round(h.v, 6) + 0e0 as d_volume
      from (select *, open_us + 3600000000 as k from bars) b asof left join h on b.symbol = h.symbol and b.k >= h.close_us"""),
)
add(
    "bars_relative_strength",
    lambda s, d: X.relative_strength(V.bars(s, d), "click").select("symbol", "open_us", r(F.col("relative")).alias("relative")),
    over("bars", f""", t as (select symbol, open_us, ln(close / lag(close, 12) over {W}) as t from bars)
      select a.symbol, a.open_us, round(a.t - b.t, 6) + 0e0 as relative from t a left join t b on b.symbol = 'click' and a.open_us = b.open_us"""),
)
add(
    "bars_return_correlations",
    lambda s, d: X.return_correlations(V.bars(s, d)).select("a", "b", "n", r(F.col("correlation")).alias("correlation")),
    over("bars", f""", t as (select symbol, open_us, close / lag(close) over {W} - 1 as x from bars)
      select a.symbol as a, b.symbol as b, count(*) as n, round(case when count(*) >= 100 then corr(a.x, b.x) end, 6) + 0e0 as correlation
      from t a join t b on a.open_us = b.open_us and a.symbol < b.symbol where a.x is not null and b.x is not null group by 1, 2"""),
)
add(
    "bars_momentum_rule",
    lambda s, d: X.momentum(V.bars(s, d)).select("symbol", "open_us", "vote", F.col("confidence").cast("bigint").alias("confidence")),
    over("bars", """, n as (select *, row_number() over (partition by symbol order by open_us desc) as k, lag(close, 24) over (partition by symbol order by open_us) as past from bars)
      select symbol, open_us, case when past > 0 and close > 0 and ln(close / past) > 0 then 'BUY' else 'HOLD' end as vote,
      cast(case when past > 0 and close > 0 and ln(close / past) > 0 then 68 else 60 end as bigint) as confidence from n where k = 2"""),
)
add(
    "bars_regime_ages",
    lambda s, d: X.regime_ages(V.bars(s, d)).select("symbol", "open_us", "regime", F.col("island").cast("bigint").alias("island"), F.col("age_rows").cast("bigint").alias("age_rows"), "age"),
    over("bars", """, g as (select *, case when close > open then 'bull' when close < open then 'bear' else 'neutral' end as regime from bars),
      c as (select *, coalesce(cast(regime <> lag(regime) over w as int), 0) as ch from g window w as (partition by symbol order by open_us)),
      i as (select *, sum(ch) over (partition by symbol order by open_us) as island from c)
      select symbol, open_us, regime, cast(island as bigint) as island, row_number() over v - 1 as age_rows, open_us - min(open_us) over (partition by symbol, island) as age
      from i window v as (partition by symbol, island order by open_us)"""),
)
add(
    "bars_winsorised",
    lambda s, d: X.winsorised(V.bars(s, d), "volume").select("symbol", "open_us", r(F.col("scaled")).alias("scaled")),
    over("bars", """, q as (select symbol, quantile_cont(volume, 0.01) as lo, quantile_cont(volume, 0.99) as hi from bars group by 1),
      c as (select b.*, greatest(lo, least(hi, volume)) as x from bars b join q using (symbol)),
      p as (select symbol, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as m, quantile_cont(x, 0.75) as b, stddev_pop(x) as sd from c group by 1)
      select c.symbol, open_us, round(greatest(-8, least(8, (x - m) / case when b - a > 1e-12 then b - a when sd > 1e-12 then sd else 1 end)), 6) + 0e0 as scaled from c join p using (symbol)"""),
)
add(
    "windows_winsorised",
    lambda s, d: X.winsorised(V.bars(s, d).withColumn("window", F.floor(F.col("open_us") / 864000000000)), "volume", keys=("symbol", "window")).select("symbol", "open_us", r(F.col("scaled")).alias("scaled")),
    over("bars", """, b as (select *, open_us // 864000000000 as win from bars), q as (select symbol, win, quantile_cont(volume, 0.01) as lo, quantile_cont(volume, 0.99) as hi from b group by 1, 2),
      c as (select b.*, greatest(lo, least(hi, volume)) as x from b join q using (symbol, win)),
      p as (select symbol, win, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as m, quantile_cont(x, 0.75) as b, stddev_pop(x) as sd from c group by 1, 2)
      select c.symbol, open_us, round(greatest(-8, least(8, (x - m) / case when b - a > 1e-12 then b - a when sd > 1e-12 then sd else 1 end)), 6) + 0e0 as scaled from c join p using (symbol, win)"""),
)
add(
    "bars_off_session",
    lambda s, d: X.off_session(X.base_features(V.bars(s, d))),
    over("bars", " select symbol, count(*) as rows, count(*) filter (where (open_us // 3600000000) % 4 <> 0) as off_session from bars group by 1"),
)
add(
    "bars_sessions",
    lambda s, d: X.resample(V.bars(s, d)).groupBy("symbol", X.session_of(F.pmod(F.floor(F.col("open_us") / HOUR), F.lit(24))).alias("session")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("volume")).alias("volume")),
    over("bars", """, h as (select symbol, (open_us // 14400000000) * 4 % 24 as h, sum(volume) as volume from bars group by symbol, open_us // 14400000000)
      select symbol, case when h < 8 then 'asia' when h < 16 then 'europe' else 'america' end as session, count(*) as n, round(sum(volume), 6) + 0e0 as volume from h group by 1, 2"""),
)
add(
    "bars_running_volume",
    lambda s, d: running_sums(V.bars(s, d), ["symbol"], ["open_us"], {"volume_so_far": "volume"}, 7 * 24 * HOUR).select("symbol", "open_us", r(F.col("volume_so_far"), 4).alias("volume_so_far")),
    over("bars", f"select symbol, open_us, round(sum(volume) over {W}, 4) + 0e0 as volume_so_far from bars"),
)
add(
    "asof_funding",
    lambda s, d: asof_join(V.decisions(s, d), V.funding(s, d), ["symbol"], "decision_us", "settle_us", 8 * HOUR + HOUR // 60).select(
        "symbol", "decision_us", "event_id", F.col("r_settle_us").alias("source_us"), r(F.col("r_funding_rate"), 8).alias("funding_rate"), F.col("r_settle_us").isNotNull().alias("matched")),
    over("decisions funding", """, j as (select d.symbol, d.decision_us, d.event_id, f.settle_us, f.funding_rate from decisions d asof left join funding f on d.symbol = f.symbol and d.decision_us >= f.settle_us)
      select symbol, decision_us, event_id, case when decision_us - settle_us <= 28860000000 then settle_us end as source_us,
      round(case when decision_us - settle_us <= 28860000000 then funding_rate end, 8) + 0e0 as funding_rate, coalesce(decision_us - settle_us <= 28860000000, false) as matched from j"""),
)
