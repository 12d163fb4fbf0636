"""Registered queries of kernels, regimes, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR
from tidewater.functions.columns import rounded as r
from tidewater.operators import cycle as C
from tidewater.operators import fracdiff as D
from tidewater.operators import indicators as I
from tidewater.operators import metrics as M
from tidewater.operators import microstructure as B
from tidewater.operators import models as L
from tidewater.operators import regime as G
from tidewater.operators import search as H
from tidewater.operators import selection as P
from tidewater.operators.evaluation import ARM_CHANGES
from tidewater.operators import stationarity as T
from tidewater.operators.features import base_features
from tidewater.operators.labels import quarantine_violations
from tidewater.plans.evaluation_queries import newton
from tidewater.plans.metric_queries import NET
from tidewater.plans.micro_queries import BOOK
from tidewater.plans.sqlviews import over, tails
from tidewater.sources import archives as A
from tidewater.sources import views as V
from tidewater.sources.store import materialise
from tidewater.streaming import jobs as S

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


def rr(*cols, digits=6):
    return [r(F.col(c), digits).alias(c) for c in cols]


W = D.weights(0.45, 1e-2)
add(
    "fractional_difference",
    lambda s, d: D.fractional_difference(V.bars(s, d).withColumn("x", F.ln("close")), "x", 0.45, 1e-2, "fd").select("symbol", "open_us", *rr("fd")),
    over("bars", ", x as (select symbol, open_us, ln(close) as x, row_number() over (partition by symbol order by open_us) as k from bars), w as (select * from (values "
      + ", ".join(f"({i}, {float(v)!r}e0)" for i, v in enumerate(W)) + f""") t(i, w)),
      s as (select a.symbol, a.open_us, sum(w * b.x) as fd from x a join w on true join x b on a.symbol = b.symbol and b.k = a.k - w.i group by 1, 2 having count(*) = {len(W)})
      select x.symbol, x.open_us, round(fd, 6) + 0e0 as fd from x left join s using (symbol, open_us)"""),
)
FD_SQL = """, x as (select *, ln(greatest(close, 1e-12)) as c, ln(greatest(volume, 1e-12)) as v, row_number() over (partition by symbol order by open_us) as k from bars), w as (select * from (values """ + ", ".join(f"({i}, {float(v)!r}e0)" if "e" not in repr(float(v)) else f"({i}, {float(v)!r})" for i, v in enumerate(D.weights(0.45, 1e-3))) + f""") t(i, w)),
  s as (select a.symbol, a.open_us, sum(w * b.c) as fc, sum(w * b.v) as fv from x a join w on true join x b on a.symbol = b.symbol and b.k = a.k - w.i group by 1, 2 having count(*) = {len(D.weights(0.45, 1e-3))}),
  g as (select symbol, open_us, fc, fv, ln(greatest(high, 1e-12)) - ln(greatest(low, 1e-12)) as fr, fc - lag(fc) over (partition by symbol order by open_us) as ret from x left join s using (symbol, open_us)),
  ff as (select *, case when count(ret) over f = 24 then stddev_samp(ret) over f end as vol, case when count(ret) over h >= 3 then avg(ret) over h end as trend
    from g window f as (partition by symbol order by open_us rows 23 preceding), h as (partition by symbol order by open_us rows 7 preceding))"""
LEGACY_SQL = """, l as (select symbol, open_us, ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) over w as ret, ln(greatest(high, 1e-12)) - ln(greatest(low, 1e-12)) as rg, ln(greatest(volume, 1e-12)) - lag(ln(greatest(volume, 1e-12))) over w as dv from bars window w as (partition by symbol order by open_us)),
  ll as (select *, case when count(ret) over a = 24 then stddev_samp(ret) over a end as d24, case when count(ret) over b = 8 then avg(ret) over b end as t8
    from l window a as (partition by symbol order by open_us rows 23 preceding), b as (partition by symbol order by open_us rows 7 preceding))"""
add(
    "fractional_features",
    lambda s, d: D.fractional_features(V.bars(s, d)).select("symbol", "open_us", *rr("fd_close", "fd_volume", "fd_range", "fd_return", "fd_vol", "fd_trend")),
    over("bars", FD_SQL + """ select symbol, open_us, round(fc, 6) + 0e0 as fd_close, round(fv, 6) + 0e0 as fd_volume, round(fr, 6) + 0e0 as fd_range, round(ret, 6) + 0e0 as fd_return, round(vol, 6) + 0e0 as fd_vol, round(trend, 6) + 0e0 as fd_trend from ff"""),
)
add(
    "regime_features",
    lambda s, d: D.regime_features(V.bars(s, d)).select("symbol", "open_us", *rr(*D.REGIME_COLUMNS), "feature_mode"),
    over("bars", FD_SQL + LEGACY_SQL + """, ok as (select * from ff where ret + vol + fr + fv + trend is not null),
      un as (select symbol, open_us, ret, vol, fr, fv, trend, 'fractional_diff' as feature_mode from ok
        union all select symbol, open_us, ret, d24, rg, dv, t8, 'legacy' from ll where ret + d24 + rg + dv + t8 is not null and symbol not in (select symbol from ok))
      select symbol, open_us, round(ret, 6) + 0e0 as fd_return, round(vol, 6) + 0e0 as fd_volatility, round(fr, 6) + 0e0 as fd_log_range, round(fv, 6) + 0e0 as fd_log_volume, round(trend, 6) + 0e0 as fd_trend, feature_mode from un"""),
)
add("fractional_order_selection", lambda s, d: T.order_selection(V.bars(s, d).withColumn("x", F.ln("close")), "x", threshold=1e-2).select("symbol", "selected_d", *rr("p_value", "correlation"), "reason"))


def regimes(s, d):
    f = base_features(V.bars(s, d)).drop("pos")
    return G.policy(G.walk_forward_regimes(f, ["log_return", "log_range", "volume_change"]))


add("walk_forward_regimes", lambda s, d: regimes(s, d).select("symbol", "open_us", *rr("bear", "neutral", "bull", "margin", "entropy"), "regime", "policy"))
add("regime_summary", lambda s, d: G.regime_summary(regimes(s, d)).select("symbol", "regime", "n", *rr("mean_confidence", "share")))
add("anchored_regimes", lambda s, d: G.anchored(materialise(regimes(s, d), "regimes")).select("symbol", "open_us", "accepted", "previous", "changed", "age_bars", *rr("switch_margin"), "policy"))


def proposals(s, d):
    state = F.when(F.col("close") > F.col("open") * 1.2, "bull").when(F.col("close") < F.col("open") * 0.8, "bear").otherwise("neutral")
    return materialise(V.bars(s, d).select("symbol", "open_us", state.alias("state")), "proposals")


add(
    "confirmed_switches",
    lambda s, d: G.confirm_switches(proposals(s, d), "symbol", "open_us", "state").select("symbol", "open_us", "state", "accepted", "previous", "changed", "age_bars"),
    over("bars", """, p as (select symbol, open_us, case when close > open * 1.2e0 then 'bull' when close < open * 0.8e0 then 'bear' else 'neutral' end as state,
        row_number() over (partition by symbol order by open_us) as k from bars),
      f as (select *, case when k = 1 or state = lag(state) over (partition by symbol order by k) then state end as sure from p),
      a as (select *, last_value(sure ignore nulls) over (partition by symbol order by k rows between unbounded preceding and current row) as accepted from f),
      c as (select *, lag(accepted) over (partition by symbol order by k) as previous from a),
      g as (select *, max(case when previous is null or previous <> accepted then k end) over (partition by symbol order by k rows between unbounded preceding and current row) as start from c)
      select symbol, open_us, state, accepted, previous, coalesce(previous <> accepted, false) as changed, k - start + 1 as age_bars from g"""),
)


def events(s, d):
    return materialise(M.net(V.oof(s, d)), "events")


add("walk_forward_trees", lambda s, d: L.walk_forward(events(s, d), ["p_primary", "p_meta", "uniqueness"], ["symbol"], "win", "uniqueness", [2, 3, 4, 5], 96 * HOUR).select("event_id", "fold", *rr("p_model")))
add("walk_forward_calibration", lambda s, d: L.walk_forward_calibration(events(s, d), "p_meta", "win", "uniqueness", [1, 2, 3, 4, 5]).select("event_id", "fold", *rr("p_platt", "p_isotonic")))
add(
    "platt_applied",
    lambda s, d: L.apply_platt(V.oof(s, d), "p_meta", 0.8, -0.3, "p").select("event_id", *rr("p")),
    over("oof", """, c as (select event_id, greatest(1e-6, least(1 - 1e-6, p_meta)) as q from oof)
      select event_id, round(1 / (1 + exp(-(0.8e0 * ln(q / (1 - q)) - 0.3e0))), 6) + 0e0 as p from c"""),
)


def ticks(s, d):
    return V.trades(s, d).withColumn("ts", F.timestamp_micros("us"))


add(
    "stream_closed_bars",
    lambda s, d: S.closed_bars(ticks(s, d)).select("symbol", F.unix_seconds("open_time").alias("open_s"), *rr("open", "high", "low", "close", digits=4), r(F.col("volume"), 4).alias("volume")),
    over("trades", """select symbol, (us // 3600000000) * 3600 as open_s, round(min_by(price, us), 4) + 0e0 as open, round(max(price), 4) + 0e0 as high, round(min(price), 4) + 0e0 as low, round(max_by(price, us), 4) + 0e0 as close, round(sum(qty), 4) + 0e0 as volume from trades group by 1, 2"""),
)
add(
    "stream_sessions",
    lambda s, d: S.activity_sessions(ticks(s, d)).select("symbol", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"),
    over("trades", """, g as (select *, coalesce(cast(us - lag(us) over (partition by symbol order by us) >= 3600000000 as int), 0) as b from trades), i as (select *, sum(b) over (partition by symbol order by us) as k from g)
      select symbol, min(us) as start_us, max(us) + 3600000000 as end_us, count(*) as n from i group by symbol, k"""),
)
add(
    "stream_distinct_trades",
    lambda s, d: S.distinct_trades(ticks(s, d).unionByName(ticks(s, d).where("trade_id % 3 = 0"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    over("trades", "select symbol, count(*) as n from trades group by 1"),
)
add(
    "stream_rolling_imbalance",
    lambda s, d: S.rolling_imbalance(ticks(s, d)).select("symbol", F.unix_seconds("start").alias("start_s"), r(F.col("total"), 3).alias("total"), *rr("imbalance")),
    over("trades", """, w as (select symbol, (us // 900000000 - k) * 900 as start_s, price * qty as q, case when is_buyer_maker then 0 else price * qty end as b from trades, range(0, 4) t(k))
      select symbol, start_s, round(sum(q), 3) + 0e0 as total, round(abs(2 * sum(b) - sum(q)) / sum(q), 6) + 0e0 as imbalance from w group by 1, 2"""),
)


def stop_ticks(s, d):
    """Each symbol's trades as ticks of positions opened every 200 trades."""
    t = ticks(s, d).withColumn("position_id", F.concat_ws(":", "symbol", F.floor(F.col("trade_id") / 200).cast("string")))
    side = F.when(F.floor(F.col("trade_id") / 200) % 2 == 0, "BUY").otherwise("SELL")
    stop = F.when(side == "BUY", 101.0).otherwise(107.0)
    return t.select("position_id", "ts", side.alias("side"), F.lit(104.0).alias("entry"), stop.alias("stop"), "price")


add(
    "stop_management",
    lambda s, d: S.manage_stops(stop_ticks(s, d)).select("position_id", F.unix_micros("ts").alias("us"), "event", *rr("price", "stop")),
    over("trades", """, tk as (select symbol || ':' || cast(trade_id // 200 as varchar) as id, us, price, case when (trade_id // 200) % 2 = 0 then 1 else -1 end as side from trades),
      nk as (select *, row_number() over (partition by id order by us) as k from tk),
      st(id, us, k, side, risk, stop, target, trails, event, price) as (
        select id, us, 0::bigint, side, abs(104e0 - case when side = 1 then 101e0 else 107e0 end), case when side = 1 then 101e0 else 107e0 end, 104e0 + 6e0 * side, false, '', price from nk where k = 1
        union all select id, us, k, side, risk, case event when 'breakeven' then 104e0 when 'trail' then price - 1.5 * risk * side else stop end,
          case when event = 'breakeven' then price + 3 * risk * side else target end, trails or event = 'breakeven', event, price
        from (select o.id, n.us, n.k, o.side, o.risk, o.stop, o.target, o.trails, n.price, case
            when (n.price - o.stop) * o.side <= 0 then case when o.trails then 'SL_trail' else 'SL' end
            when (n.price - o.target) * o.side >= 0 then 'TP' when not o.trails and (n.price - 104) * o.side >= o.risk then 'breakeven'
            when o.trails and (n.price - 1.5 * o.risk * o.side - o.stop) * o.side > 0 then 'trail' else '' end as event
          from st o join nk n on n.id = o.id and n.k = o.k + 1 where o.event not in ('TP', 'SL', 'SL_trail')))
      select id as position_id, us, event, round(price, 6) + 0e0 as price, round(stop, 6) + 0e0 as stop from st where event <> ''""").replace("with ", "with recursive ", 1),
)
# an exponential mean in closed form: faded seed and faded sum of what follows
SCREEN_SQL = """, t as (select *, row_number() over w - 1 as k, coalesce(lag(close) over w, close) as c1, coalesce(lag(high) over w, high) as h1, coalesce(lag(low) over w, low) as l1 from src window w as (partition by symbol order by open_us)),
  mv as (select symbol, open_us, k, close, volume, greatest(high - low, abs(high - c1), abs(low - c1)) as tr, close - c1 as move, high - h1 as up, l1 - low as down from t),
  ser as (select symbol, k, name, x, n, a from (select symbol, k, unnest(['ema50', 'ema200', 'gain', 'loss', 'tr', 'plus', 'minus']) as name,
      unnest([close, close, greatest(move, 0), greatest(-move, 0), tr, case when up > down and up > 0 then up else 0 end, case when down > up and down > 0 then down else 0 end]) as x from mv)
    join (values ('ema50', 50, 2 / 51e0), ('ema200', 200, 2 / 201e0), ('gain', 14, 1 / 14e0), ('loss', 14, 1 / 14e0), ('tr', 14, 1 / 14e0), ('plus', 14, 1 / 14e0), ('minus', 14, 1 / 14e0)) p(name, n, a) using (name)),
  sm as (select symbol, k, name, case when k >= n - 1 then pow(1 - a, k - n + 1) * (sum(case when k < n then x end) over (partition by symbol, name)) / n + a * sum(case when k >= n then x * pow(1 - a, -k) else 0 end) over (partition by symbol, name order by k) * pow(1 - a, k) end as v from ser),
  wide as (select symbol, k, max(v) filter (where name = 'ema50') as ema50, max(v) filter (where name = 'ema200') as ema200, max(v) filter (where name = 'gain') as g, max(v) filter (where name = 'loss') as l, max(v) filter (where name = 'tr') as atr, max(v) filter (where name = 'plus') as p, max(v) filter (where name = 'minus') as m from sm group by 1, 2),
  dx as (select symbol, k - 13 as k, case when p + m > 0 then 100 * abs(p - m) / (p + m) else 0 end as x from wide where atr is not null),
  ax as (select symbol, k + 13 as k, case when k >= 13 then pow(13 / 14e0, k - 13) * (sum(case when k < 14 then x end) over (partition by symbol)) / 14 + sum(case when k >= 14 then x * pow(13 / 14e0, -k) else 0 end) over (partition by symbol order by k) * pow(13 / 14e0, k) / 14 end as adx from dx),
  vol as (select symbol, open_us, k, volume / case when k >= 19 then avg(volume) over (partition by symbol order by k rows 19 preceding) end as rv from mv),
  ind as (select symbol, open_us, k, ema50, ema200, case when g is null then null when g + l > 0 then 100 * g / (g + l) else 50 end as rsi, adx, atr, rv from vol join wide using (symbol, k) left join ax using (symbol, k))"""
add(
    "screener_indicators",
    lambda s, d: I.indicators(V.bars(s, d)).select("symbol", "open_us", *rr(*I.NAMES)),
    over("bars", ", src as (select * from bars)" + SCREEN_SQL + " select symbol, open_us, round(ema50, 6) + 0e0 as ema50, round(ema200, 6) + 0e0 as ema200, round(rsi, 6) + 0e0 as rsi14, round(adx, 6) + 0e0 as adx14, round(atr, 6) + 0e0 as atr14, round(rv, 6) + 0e0 as relative_volume from ind"),
)
add(
    "screener_top",
    lambda s, d: I.screened(V.bars(s, d), 3, 100).select("symbol", "bars", *rr("relative_volume", "rsi14")),
    over("bars", ", src as (select * from bars where open_us < (select max(o.open_us) from bars o where o.symbol = bars.symbol))" + SCREEN_SQL + """, z as (select symbol, count(*) as bars, coalesce(max_by(rv, k), 0) as rv, coalesce(max_by(rsi, k), 50) as rsi from ind group by 1)
      select symbol, bars, round(rv, 6) + 0e0 as relative_volume, round(rsi, 6) + 0e0 as rsi14 from z where bars >= 100 order by rv desc, symbol limit 3"""),
)
# residuals by elimination in the order constant, own lags, other's lags: after own lags the short model's, at the end the full one's
GRANGER_SQL = """, f as (select symbol, open_us, ln(close / lag(close) over w) as y, case when volume > 0 and lag(volume) over w > 0 then ln(volume / lag(volume) over w) end as x from bars window w as (partition by symbol order by open_us)),
  l as (select symbol, open_us, [1e0, """ + ", ".join(f"lag({c}, {k}) over w" for c in "yx" for k in range(1, 7)) + """, y] as z from f window w as (partition by symbol order by open_us)),
  h as (select symbol, open_us, unnest(range(0, 14)) as i, unnest(z) as v from l where list_aggregate(z, 'count') = 14),
  mo as (select a.symbol, a.i as a, b.i as b, sum(a.v * b.v) as v, count(*) as n from h a join h b on a.symbol = b.symbol and a.open_us = b.open_us group by 1, 2, 3),
  pl as (select k, i, case when i = 0 then 0 when i = 13 then 2 * k + 1 when i <= 6 then i else k + i - 6 end as q from range(1, 7) kk(k), range(0, 14) ii(i) where i in (0, 13) or i between 1 and k or i between 7 and 6 + k),
  el(p, symbol, k, i, j, v) as (select 0::bigint, symbol, pa.k, pa.q, pb.q, v from mo join pl pa on pa.i = a join pl pb on pb.i = b and pb.k = pa.k
    union all select e.p + 1, e.symbol, e.k, e.i, e.j, e.v - r.v * c.v / d.v from el e join el r on r.symbol = e.symbol and r.k = e.k and r.i = e.i and r.j = e.p
      join el c on c.symbol = e.symbol and c.k = e.k and c.i = e.p and c.j = e.j join el d on d.symbol = e.symbol and d.k = e.k and d.i = e.p and d.j = e.p where e.i > e.p and e.j > e.p),
  rs as (select symbol, k, max(v) filter (where p = k + 1) as short, max(v) filter (where p = 2 * k + 1) as rest from el where i = 2 * k + 1 and j = i group by 1, 2),
  st as (select symbol, k, m.n, m.n - 2 * k - 1 as free, greatest(short, 0) as short, greatest(rest, 0) as rest from rs join (select symbol, n from mo where a = 0 and b = 0) m using (symbol)),
  fs as (select *, (short - rest) / k / (rest / free) as f from st where free > 0 and rest > 0), src as (select symbol, k, free, n, f, k * greatest(f, 0) / (free + k * greatest(f, 0)) as u from fs)"""
add(
    "granger_volume_to_return",
    lambda s, d: I.granger(base_features(V.bars(s, d)).drop("pos"), "volume_change", "log_return").select("symbol", "lag", "n", *rr("f", "p_value")),
    over("bars", GRANGER_SQL + tails("src", "symbol, k, free") + " select symbol, cast(k as int) as lag, n, round(f, 6) + 0e0 as f, round(p, 6) + 0e0 as p_value from src join tl using (symbol, k)").replace("with ", "with recursive ", 1),
)


def levels(s, d):
    """Best bid and ask of every book snapshot."""
    b = B.books(V.depth_rows(s, d))
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    return b.select("symbol", "seq", bid.price.alias("bp"), bid.qty.alias("bq"), ask.price.alias("ap"), ask.qty.alias("aq"))


add(
    "stream_order_flow",
    lambda s, d: S.live_order_flow(levels(s, d)).select("symbol", "seq", *rr("ofi")),
    over("depth", BOOK + " select symbol, seq, round(ofi, 6) + 0e0 as ofi from f"),
)
KNOTS = [(0.1, 0.3), (0.4, 0.35), (0.7, 0.6), (0.9, 0.8)]
add(
    "isotonic_applied",
    lambda s, d: L.apply_map(V.oof(s, d).withColumn("p_meta", F.when(F.col("event_id") % 17 == 0, 1.5).otherwise(F.col("p_meta"))), "p_meta", "isotonic", KNOTS, "p").select("event_id", *rr("p"), "violation"),
    over("oof", """, x as (select event_id, case when event_id % 17 = 0 then 1.5e0 else p_meta end as p from oof)
      select event_id, round(case when p > 1 then null when p <= 0.1 then 0.3e0 when p <= 0.4 then 0.3e0 + (p - 0.1e0) / 0.3e0 * 0.05e0 when p <= 0.7 then 0.35e0 + (p - 0.4e0) / 0.3e0 * 0.25e0 when p <= 0.9 then 0.6e0 + (p - 0.7e0) / 0.2e0 * 0.2e0 else 0.8e0 end, 6) + 0e0 as p, p > 1 as violation from x"""),
)


def wide(s, d):
    """Events whose win depends on two of three columns."""
    e = V.oof(s, d)
    noise = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0
    won = F.col("p_meta") + 0.4 * F.col("p_primary") + 0.3 * noise
    return materialise(e.withColumns({"noise": noise, "win": (won > 0.95).cast("int")}), "wide")


FEATURES = ["p_meta", "p_primary", "noise"]
add("permutation_importance", lambda s, d: P.permutation_importance(wide(s, d), FEATURES, "win", "uniqueness").select("feature", *rr("importance", digits=4)))
add("selected_features", lambda s, d: P.select_features(wide(s, d), FEATURES, "win", "uniqueness", [2, 3, 4, 5], 96 * HOUR).select("feature", *rr("mean_importance", digits=4), "place", "kept", "positive"))
SELECTION = """, st as (select fold as k, min(decision_us) as starts from oof where fold between 2 and 5 group by 1),
  sp as (select k, o.*, row_number() over (partition by k order by decision_us desc, symbol desc) as back, count(*) over (partition by k) as n from st join oof o on o.fold < k and o.exit_us < starts - 345600000000),
  sv as (select k, min(decision_us) as begins from sp where back <= ceil(n * 0.2e0) group by 1),
  sr as (select k, fold, event_id, case when back <= ceil(n * 0.2e0) then 'validation' when exit_us < begins then 'train' else 'purged' end as part from sp join sv using (k))"""
add(
    "selection_rows",
    lambda s, d: P.selection_rows(V.oof(s, d), [2, 3, 4, 5], 96 * HOUR).groupBy(F.col("outer").cast("long").alias("outer"), "part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max("fold").cast("long").alias("last_fold")),
    over("oof", SELECTION + " select cast(k as bigint) as outer, part, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(max(fold) as bigint) as last_fold from sr group by 1, 2"),
)
add(
    "selection_quarantine",
    lambda s, d: quarantine_violations(P.selection_rows(V.oof(s, d), [2, 3, 4, 5], 96 * HOUR).select(F.lit("selection").alias("role"), "fold", F.col("fold").alias("source_fold"))).select("quarantined_used"),
    over("oof", SELECTION + " select count(*) filter (where fold = 5) as quarantined_used from sr"),
)
add("final_refit", lambda s, d: L.final_refit(wide(s, d), FEATURES, [], "win", "uniqueness").select("event_id", *rr("p_final", digits=4)))
FAMILIES = {"calendar": ["hour", "weekday"], "micro": ["flow"], "symbol": ["symbol"], "regime": ["state"], "base": ["p_primary", "p_meta"]}
FROZEN = {k: {"depth": 3, "l2": 10, "rate": 0.05, "w": 2, "bag": 0, "trees": 6} for k in (2, 3, 4, 5)}


def arm_rows(s, d):
    """Events with columns of every family; the win follows the hour, the state and the score."""
    at, noise = F.floor(F.col("decision_us") / HOUR), lambda salt: F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(1000)) / 1000.0
    hour = F.pmod(at, F.lit(24))
    state = F.element_at(F.array(*map(F.lit, G.NAMES)), (F.pmod(F.floor(at / 37), F.lit(3)) + 1).cast("int"))
    chance = F.col("p_meta") + F.when(hour < 8, 0.2).otherwise(0.0) + F.when(state == "bull", 0.2).when(state == "bear", -0.2).otherwise(0.0) + 0.4 * noise(1)
    return materialise(V.oof(s, d).withColumns({
        "hour": hour, "weekday": F.pmod(F.floor(at / 24) + 3, F.lit(7)), "flow": noise(2), "state": state, "session": F.element_at(F.array(*map(F.lit, ("asia", "europe", "america"))), (F.floor(hour / 8) + 1).cast("int")),
        "extra_a": noise(3), "extra_b": noise(4), "win": (chance > 0.75).cast("int")}), "arms")


add(
    "ablation_arms",
    lambda s, d: H.arms_refitted(arm_rows(s, d), ["base", *ARM_CHANGES], FAMILIES, ["extra_a", "extra_b"], ["symbol", "state", "session"], "win", "uniqueness", [2, 3, 4, 5], 96 * HOUR, FROZEN).select("arm", "fold", "n", *rr("auc", "weighted_log_loss", digits=4)),
)
add("nested_search", lambda s, d: H.nested_search(wide(s, d), FEATURES, [], "win", "uniqueness", [2, 3, 4, 5], 96 * HOUR, patience=50).select("fold", "config_id", *rr("inner_loss", digits=4), "trees", "won"))
add(
    "final_calibrators",
    lambda s, d: L.final_calibrators(M.net(V.oof(s, d)), "p_meta", "win", "uniqueness", [2, 3, 4, 5]).select("weighted", *rr("slope", "intercept", digits=5), "n", *rr("base_rate")),
    over("oof", NET + """, b as (select e.*, weighted, case when weighted then uniqueness else 1 end as u from e, (values (true), (false)) t(weighted) where fold between 2 and 5),
      hx as (select weighted, ln(greatest(1e-6, least(1 - 1e-6, p_meta)) / (1 - greatest(1e-6, least(1 - 1e-6, p_meta)))) as x, cast(win as double) as y, u as w from b)""" + newton("hx", ["weighted"], 2).replace("and a > 0", "") + """, z as (select weighted, count(*) as n, sum(y * w) / sum(w) as br from hx group by 1)
      select weighted, round(slope, 5) + 0e0 as slope, round(icpt, 5) + 0e0 as intercept, n, round(br, 6) + 0e0 as base_rate from mp join z using (weighted)""").replace("with ", "with recursive ", 1),
)
SEEDS = (42, 0, 1)
SEED_SQL = NET + f""", se as (select e.* exclude (p_meta), seed, p_meta + seed * 0.137e0 - floor(p_meta + seed * 0.137e0) as p from e, (values {", ".join(f"({x})" for x in SEEDS)}) t(seed) where fold between 2 and 5),
  hx as (select seed, k as fold, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) as x, cast(win as double) as y, uniqueness as w from range(3, 6) f(k) join se on se.fold between 2 and k - 1)""" + newton("hx", ["seed", "fold"], 2) + """,
  rk as (select *, rank() over (partition by seed, fold order by p) + (count(*) over (partition by seed, fold, p) - 1) / 2e0 as rk, greatest(1e-15, least(1 - 1e-15, p)) as q from se),
  ms as (select seed, fold, count(*) as rows, (sum(rk) filter (where win = 1) - sum(win) * (sum(win) + 1) / 2e0) / (sum(win) * (count(*) - sum(win))) as auc, sum(uniqueness * -(win * ln(q) + (1 - win) * ln(1 - q))) / sum(uniqueness) as loss, stddev_pop(p) as sd from rk group by 1, 2),
  tr as (select seed, fold, count(*) as n from hx group by 1, 2)"""
add(
    "seed_post_mortem",
    lambda s, d: L.seed_post_mortem(ev_scores(s, d), "p", "win", "uniqueness", [2, 3, 4, 5]).select(
        F.col("seed").cast("long").alias("seed"), F.col("fold").cast("long").alias("fold"), "rows", *rr("auc", "weighted_log_loss", "deviation"), *(r(F.when(F.col("method") == "platt", F.col(c)), 5).alias(c) for c in ("slope", "intercept")), "trained_on", "reason"
    ),
    over("oof", SEED_SQL + """ select cast(ms.seed as bigint) as seed, cast(ms.fold as bigint) as fold, rows, round(auc, 6) + 0e0 as auc, round(loss, 6) + 0e0 as weighted_log_loss, round(sd, 6) + 0e0 as deviation, round(slope, 5) + 0e0 as slope, round(icpt, 5) + 0e0 as intercept, tr.n as trained_on,
      case when tr.n is null then 'no_past_fold' when slope is null then 'slope_not_positive' end as reason from ms left join mp on mp.seed = ms.seed and mp.fold = ms.fold left join tr on tr.seed = ms.seed and tr.fold = ms.fold""").replace("with ", "with recursive ", 1),
)


def ev_scores(s, d):
    """Scores of three seeds: the model's, moved round by a step a seed."""
    e = M.net(V.oof(s, d)).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    moved = F.col("p_meta") + F.col("seed") * 0.137
    return materialise(e.withColumn("p", moved - F.floor(moved)), "seeds")


add(
    "agg_trade_lines",
    lambda s, d: A.agg_trades(trade_lines(s, d)).groupBy("is_buyer_maker").agg(F.count(F.lit(1)).alias("n"), F.sum("trade_id").alias("ids"), r(F.sum("qty"), 3).alias("qty"), F.max("us").alias("last_us")),
    "select event_id % 2 = 1 as is_buyer_maker, count(*) as n, cast(sum(event_id) as bigint) as ids, round(sum(round(value, 4)), 3) + 0e0 as qty, max(epoch_us(ts) // 1000 * 1000) as last_us from events where event_id % 13 <> 0 group by 1",
)
add(
    "funding_lines",
    lambda s, d: A.funding_rates(funding_lines(s, d)).select("settle_us", *rr("funding_rate", digits=8)),
    over("funding", " select settle_us // 1000 * 1000 as settle_us, round(max(round(funding_rate, 8)), 8) + 0e0 as funding_rate from funding where symbol = 's1' group by 1"),
)
add(
    "kline_lines",
    lambda s, d: A.klines(kline_lines(s, d)).select("open_us", *rr("open", "high", "low", "close", "volume", digits=4), "trades"),
    over("bars", " select open_us, round(open, 4) + 0e0 as open, round(high, 4) + 0e0 as high, round(low, 4) + 0e0 as low, round(close, 4) + 0e0 as close, round(volume, 4) + 0e0 as volume, trades from bars where symbol = 'click' and trades % 6 <> 0"),
)


def text(*columns):
    return F.concat_ws(",", *(c.cast("string") for c in columns))


def trade_lines(s, d):
    """Events written as lines of a trade archive, every 13th without a price."""
    e = V.events(s, d)
    price = F.when(F.col("event_id") % 13 != 0, F.lit("101.5")).otherwise("")
    line = text(F.col("event_id"), price, F.round("value", 4), F.lit(1), F.lit(2), F.floor(F.col("us") / 1000), F.when(F.col("event_id") % 2 == 1, "True").otherwise("false"), F.lit("True"))
    return e.select(F.lit("f").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


def funding_lines(s, d):
    f = V.funding(s, d).where("symbol = 's1'").groupBy("settle_us").agg(F.max("funding_rate").alias("x"))
    rows = f.select(F.lit("f").alias("file"), F.col("settle_us").alias("line_no"), text(F.floor(F.col("settle_us") / 1000), F.lit(8), F.format_string("%.8f", F.round("x", 8))).alias("line"))
    return rows.unionByName(s.createDataFrame([("f", -1, "calc_time,interval,rate")], "file string, line_no long, line string"))


def kline_lines(s, d):
    b = V.bars(s, d).where("symbol = 'click'")
    close = F.when(F.col("trades") % 6 != 0, F.col("close").cast("string")).otherwise("none")
    line = text(F.floor(F.col("open_us") / 1000), F.col("open"), F.col("high"), F.col("low"), close, F.col("volume"), F.lit(0), F.lit(1), F.col("trades"), F.lit(1), F.lit(1), F.lit(0))
    return b.select(F.lit("f").alias("file"), F.col("open_us").alias("line_no"), line.alias("line"))


add(
    "best_prices",
    lambda s, d: C.best_price(quotes(s, d)).select("symbol", "open_us", *rr("price")),
    over("bars", """ select symbol, open_us, round(case when trades % 3 > 0 and low > 0 and trades % 4 > 0 and high > 0 then (low + high) / 2 when trades % 3 > 0 and low > 0 then low when trades % 4 > 0 and high > 0 then high when trades % 5 > 0 and open > 0 then open when close > 0 then close end, 6) + 0e0 as price from bars"""),
)


def quotes(s, d):
    return V.bars(s, d).select("symbol", "open_us", F.when(F.col("trades") % 3 > 0, F.col("low")).alias("bid"), F.when(F.col("trades") % 4 > 0, F.col("high")).otherwise(-1.0).alias("ask"), F.when(F.col("trades") % 5 > 0, F.col("open")).alias("last"), "close")


def dated(s, d):
    """Graded votes of trades closed over sixty days before a fixed time."""
    k = F.col("l_orderkey") % 60
    return V.table(s, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("voter"), ((k - 30) / 20.0).alias("r_multiple"), (F.col("l_orderkey") % 3 != 0).alias("right"), (F.lit(NOW) - k * 86_400_000_000).alias("closed_us"))


NOW = 1_700_000_000_000_000
add(
    "recent_voter_weights",
    lambda s, d: C.recent_voter_weights(dated(s, d), s.createDataFrame([(f"v{i}",) for i in range(1, 10)], "voter string"), NOW).select("voter", *rr("score", "weight")),
    """with g as (select 'v' || cast(l_linenumber as varchar) as voter, (l_orderkey % 60 - 30) / 2e1 as rm, l_orderkey % 3 <> 0 as ok from lineitem where l_orderkey % 60 < 30),
      n as (select 'v' || cast(i as varchar) as voter from range(1, 10) t(i)), p as (select voter, coalesce(sum(case when abs(rm) >= 0.11 then case when ok then abs(rm) else -abs(rm) end end), 0) as score from n left join g using (voter) group by 1)
      select voter, round(score, 6) + 0e0 as score, round(greatest(0.2, least(2, 1 + score / (select max(abs(score)) from p))), 6) + 0e0 as weight from p""",
)
add(
    "votes_nested",
    lambda s, d: C.extracted_votes(responses(s, d)).groupBy("vote", "valid").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total")),
    over("votes", """, x as (select vote, round_even(least(100, case when confidence <= 1 then confidence * 100 else confidence end), 0) as c from votes)
      select vote, true as valid, count(*) as n, cast(sum(c) as bigint) as total from x group by 1"""),
)
add(
    "debate_votes",
    lambda s, d: C.extracted_votes(V.votes(s, d).withColumn("text", F.concat(F.lit('<THINK>x</THINK> {"final_vote":"'), "vote", F.lit('","final_confidence":'), F.col("confidence").cast("string"), F.when(F.col("cycle_id") % 2 == 0, ',"changed_opinion":true}').otherwise("}"))), debate=True).groupBy("vote", "changed", "valid").agg(F.count(F.lit(1)).alias("n")),
    over("votes", " select vote, cycle_id % 2 = 0 as changed, true as valid, count(*) as n from votes group by 1, 2"),
)


def responses(s, d):
    """Responses with nested objects: in a fence, as the whole text, within prose."""
    body = F.concat(F.lit('{"vote": "'), "vote", F.lit('", "levels": {"a": [{"x": 1}], "s": "}"}, "confidence": '), F.col("confidence").cast("string"), F.lit("}"))
    k = F.col("cycle_id") % 3
    return V.votes(s, d).withColumn("text", F.when(k == 0, F.concat(F.lit("so\n```json\n"), body, F.lit("\n```"))).when(k == 1, body).otherwise(F.concat(F.lit("I say "), body, F.lit(" and {more}"))))
