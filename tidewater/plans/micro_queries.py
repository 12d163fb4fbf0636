"""Registered queries over books, trades, funding and barrier labels, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import rounded as r
from tidewater.operators import features as X
from tidewater.operators import labels as L
from tidewater.operators import microstructure as M
from tidewater.plans.sqlviews import over
from tidewater.sources import views as V
from tidewater.streaming import volume_clock as S
from tidewater.sources.store import materialise

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


BOOK = """, lv as (select *, row_number() over (partition by symbol, seq, side order by case side when 'bid' then -price else price end, case side when 'bid' then -qty else qty end) as k from depth where price > 0 and qty >= 0),
  b as (select symbol, seq, max(case when side = 'bid' and k = 1 then price end) as bp, max(case when side = 'bid' and k = 1 then qty end) as bq,
    max(case when side = 'ask' and k = 1 then price end) as ap, max(case when side = 'ask' and k = 1 then qty end) as aq,
    coalesce(sum(case when side = 'bid' and k <= 5 then qty end), 0) as bd, coalesce(sum(case when side = 'ask' and k <= 5 then qty end), 0) as ad,
    coalesce(sum(case when k <= 5 then price * qty end), 0) as liq from lv group by 1, 2),
  f as (select *, case when bp is not null and ap is not null and lag(bp) over w is not null and lag(ap) over w is not null then
    (case when bp >= lag(bp) over w then bq else 0 end) - (case when bp <= lag(bp) over w then lag(bq) over w else 0 end)
    - ((case when ap <= lag(ap) over w then aq else 0 end) - (case when ap >= lag(ap) over w then lag(aq) over w else 0 end)) else 0 end as ofi
    from b window w as (partition by symbol order by seq))"""

add(
    "book_order_flow",
    lambda s, d: M.order_flow(M.books(V.depth_rows(s, d))).select("symbol", "seq", *(r(F.col(c)).alias(c) for c in ("ofi", "depth_imbalance", "mid", "spread_bps", "ofi_z")), r(F.col("liquidity"), 3).alias("liquidity")),
    over("depth", BOOK + """ select symbol, seq, round(ofi, 6) + 0e0 as ofi, round(case when bd + ad > 0 then (bd - ad) / (bd + ad) else 0 end, 6) + 0e0 as depth_imbalance,
      round(case when bp is not null and ap is not null then (bp + ap) / 2 else 0 end, 6) + 0e0 as mid,
      round(case when bp is not null and ap is not null then (ap - bp) / ((bp + ap) / 2) * 1e4 else 0 end, 6) + 0e0 as spread_bps,
      round(case when count(ofi) over z >= 2 and stddev_pop(ofi) over z > 1e-12 then (ofi - avg(ofi) over z) / stddev_pop(ofi) over z else 0 end, 6) + 0e0 as ofi_z,
      round(liq, 3) + 0e0 as liquidity from f window z as (partition by symbol order by seq rows 19 preceding)"""),
)
TR = """, t as (select *, price * qty as q, case when not is_buyer_maker then price * qty else 0 end as bq from trades where price > 0 and qty > 0)"""
BUCKET = TR + """, v as (select symbol, sum(q) / 20 as v from t group by 1),
  c as (select t.*, sum(q) over (partition by symbol order by us, trade_id) as c1 from t),
  p as (select c.symbol, v.v, unnest(range(cast(floor(greatest(c1 - q, 0) / v.v) as bigint), cast(floor(c1 / v.v) as bigint) + 1)) as k, c1 - q as c0, c1, q, bq from c join v using (symbol)),
  k as (select *, least(c1, (k + 1) * v) - greatest(c0, k * v) as take from p),
  u as (select symbol, k as bucket, v, sum(take / q * bq) as buy, sum(take / q * (q - bq)) as sell, sum(take) as total from k where take > 0 group by 1, 2, 3),
  g as (select *, abs(buy - sell) as imb from u where total >= v * (1 - 1e-9))"""
add(
    "volume_clock_buckets",
    lambda s, d: M.volume_buckets(V.trades(s, d)).select("symbol", "bucket", *(r(F.col(c), 3).alias(c) for c in ("buy", "sell", "total", "imbalance"))),
    over("trades", BUCKET + " select symbol, bucket, round(buy, 3) + 0e0 as buy, round(sell, 3) + 0e0 as sell, round(total, 3) + 0e0 as total, round(imb, 3) + 0e0 as imbalance from g"),
)
add(
    "vpin_per_symbol",
    lambda s, d: M.vpin(M.volume_buckets(V.trades(s, d))).select("symbol", "buckets", *(r(F.col(c)).alias(c) for c in ("vpin", "lower_bound", "vpin_z"))),
    over("trades", BUCKET + """, z as (select *, case when count(*) over w >= 2 and stddev_pop(imb / total) over w > 1e-12 then (imb / total - avg(imb / total) over w) / stddev_pop(imb / total) over w else 0 end as z
      from g window w as (partition by symbol order by bucket rows 49 preceding))
      select symbol, count(*) as buckets, round(least(1, sum(imb) / sum(total)), 6) + 0e0 as vpin, round(abs(sum(buy) - sum(sell)) / sum(total), 6) + 0e0 as lower_bound, round(max_by(z, bucket), 6) + 0e0 as vpin_z from z group by 1"""),
)


def fixed_clock(volume, capacity):
    """CTE g of buckets of a fixed capacity, counted in whole units of 1e-9 as the query does, so that long sums are exact."""
    v = f"{round(capacity * M.UNITS)}::hugeint"
    return f""", n as (select *, cast(round({volume} * 1e9) as hugeint) as u from trades where us >= 0 and price > 0 and qty > 0),
  c as (select *, sum(u) over (partition by symbol order by us, trade_id) as c1 from n),
  p as (select *, c1 - u as c0, unnest(range(cast((c1 - u) // {v} as bigint), cast(c1 // {v} as bigint) + 1)) as k from c),
  k as (select *, least(c1, (k + 1) * {v}) - greatest(c0, k * {v}) as take from p),
  w as (select symbol, k as bucket, sum(case when is_buyer_maker then 0 else take end) as b, sum(case when is_buyer_maker then take else 0 end) as s, sum(take) as t from k where take > 0 group by 1, 2),
  g as (select symbol, bucket, b / 1e9 as buy, s / 1e9 as sell, t / 1e9 as total, abs(b - s) / 1e9 as imb from w where t >= {v})"""


BASE = fixed_clock("qty", 60)
add(
    "volume_clock_base",
    lambda s, d: M.volume_buckets(V.trades(s, d), capacity=60.0, unit="base").select("symbol", "bucket", *(r(F.col(c), 3).alias(c) for c in ("buy", "sell", "total", "imbalance"))),
    over("trades", BASE + " select symbol, bucket, round(buy, 3) + 0e0 as buy, round(sell, 3) + 0e0 as sell, round(total, 3) + 0e0 as total, round(imb, 3) + 0e0 as imbalance from g"),
)
FIXED = fixed_clock("price * qty", 9000)
add(
    "stream_volume_clock",
    lambda s, d: S.live_buckets(V.trades(s, d), 9000.0).select("symbol", "bucket", *(r(F.col(c), 3).alias(c) for c in ("buy", "sell", "imbalance")), *(r(F.col(c), 9).alias(c) for c in ("vpin", "lower_bound"))),
    over("trades", FIXED + """ select symbol, bucket, round(buy, 3) + 0e0 as buy, round(sell, 3) + 0e0 as sell, round(imb, 3) + 0e0 as imbalance, round(sum(imb) over w / sum(total) over w, 9) + 0e0 as vpin, round(abs(sum(buy) over w - sum(sell) over w) / sum(total) over w, 9) + 0e0 as lower_bound
      from g window w as (partition by symbol order by bucket rows 19 preceding)"""),
)
LAST = TR.replace("where price > 0 and qty > 0", "where price > 0 and qty > 0 qualify us > max(us) over (partition by symbol) - 3600000000 * 12") + """, t2 as (select * from t qualify row_number() over (partition by symbol order by us desc, trade_id desc) <= 1000)"""
add(
    "stream_imbalance_share",
    lambda s, d: S.live_vpin(V.trades(s, d), lookback=12 * 3_600_000_000).select("symbol", "us", "trades", "buckets", *(r(F.col(c)).alias(c) for c in ("vpin", "lower_bound"))),
    over("trades", LAST + BUCKET.replace(TR, "").replace("from t group", "from t2 group").replace("from t)", "from t2)").replace("select t.*", "select t2.*") + """, z as (select symbol, max(us) as us, count(*) as trades from t2 group by 1), y as (select symbol, count(*) as n, sum(imb) / sum(total) as p, abs(sum(buy) - sum(sell)) / sum(total) as l from g group by 1)
      select z.symbol, us, trades, coalesce(n, 0) as buckets, round(case when n >= 5 then p end, 6) + 0e0 as vpin, round(case when n >= 5 then l end, 6) + 0e0 as lower_bound from z left join y using (symbol)"""),
)
add(
    "trades_signed",
    lambda s, d: M.signed_trades(V.trades(s, d)).select("symbol", "trade_id", r(F.col("quote")).alias("quote"), r(F.col("buy_quote")).alias("buy_quote"), r(F.col("sell_quote")).alias("sell_quote")),
    over("trades", TR + " select symbol, trade_id, round(q, 6) + 0e0 as quote, round(bq, 6) + 0e0 as buy_quote, round(q - bq, 6) + 0e0 as sell_quote from t"),
)
MIN = TR + """, m as (select symbol, (us // 60000000) * 60000000 as open_us, sum(q) as quote, greatest(0, least(sum(bq), sum(q))) as buy from t group by 1, 2)"""
add(
    "minute_bars",
    lambda s, d: M.minute_bars(V.trades(s, d)).select("symbol", "open_us", "close_us", r(F.col("quote"), 4).alias("quote"), r(F.col("buy"), 4).alias("buy")),
    over("trades", MIN + " select symbol, open_us, open_us + 60000000 as close_us, round(quote, 4) + 0e0 as quote, round(buy, 4) + 0e0 as buy from m where quote > 0"),
)
add(
    "hours_with_minutes",
    lambda s, d: M.full_hours(M.minute_bars(V.trades(s, d)), 2).select("symbol", "hour_end_us", "minutes", r(F.col("quote"), 4).alias("quote")),
    over("trades", MIN + " select symbol, (open_us // 3600000000 + 1) * 3600000000 as hour_end_us, count(*) as minutes, round(sum(quote), 4) + 0e0 as quote from m group by 1, 2 having count(*) >= 2"),
)
add(
    "minutes_missing",
    lambda s, d: M.missing_minutes(M.minute_bars(V.trades(s, d))).select("symbol", "n", "expected", r(F.col("missing_ratio")).alias("missing_ratio")),
    over("trades", MIN + " select symbol, count(*) as n, (max(open_us) - min(open_us)) // 60000000 + 1 as expected, round(1 - count(*) / ((max(open_us) - min(open_us)) // 60000000 + 1), 6) + 0e0 as missing_ratio from m group by 1"),
)


def vpin_history(s, d):
    """Hourly checkpoints over seven days; hours of two minutes with trades are full, as trades are sparse."""
    m = materialise(M.minute_bars(V.trades(s, d)), "minutes")
    return M.vpin_history(m, M.hourly_capacity(m, 2))


add(
    "vpin_checkpoints",
    lambda s, d: vpin_history(s, d).select("symbol", "ts_us", r(F.col("vpin"), 5).alias("vpin")),
    over("trades", MIN + """, c as (select *, open_us + 60000000 as x_us, sum(quote) over w as C, sum(buy) over w as B from m window w as (partition by symbol order by open_us)),
      e as (select symbol, min(open_us) as lo, max(x_us) as hi from c group by 1),
      hr as (select symbol, open_us // 3600000000 as h, sum(quote) as q from m group by 1, 2 having count(*) >= 2), cp as (select symbol, median(q) / 20 as cap from hr group by 1),
      p as (select symbol, lo, unnest(range(cast(ceil(lo / 3600000000) as bigint), hi // 3600000000 + 1)) * 3600000000 as T from e),
      p0 as (select p.symbol, p.lo, p.T, coalesce(c.C, 0) as c1 from p asof left join c on c.symbol = p.symbol and c.x_us <= p.T),
      w as (select p0.symbol, p0.lo, p0.T, p0.c1, coalesce(c.C, 0) as c0 from (select *, T - 604800000000 as S from p0) p0 asof left join c on c.symbol = p0.symbol and c.x_us <= p0.S),
      n as (select w.*, cap, cast(floor((c1 - c0) / cap + 1e-9) as bigint) as n from w left join cp using (symbol)),
      k as (select symbol, T, c0, cap, unnest(range(n - 20, n)) as k from n where T - 604800000000 >= lo - 60000000 and n >= 20),
      o as (select k.symbol, k.T, k.k, k.cap, sum(c.buy * greatest(0, least(c.C, c0 + (k + 1) * cap) - greatest(c.C - c.quote, c0 + k * cap)) / c.quote) as buy
            from k join c on c.symbol = k.symbol and c.C > c0 + k * cap and c.C - c.quote < c0 + (k + 1) * cap group by 1, 2, 3, 4),
      v as (select symbol, T, avg(abs(2 * buy - cap) / cap) as vpin from o group by 1, 2)
      select p.symbol, p.T as ts_us, round(case when vpin is not null then greatest(0, least(1, vpin)) end, 5) + 0e0 as vpin from p left join v using (symbol, T)"""),
)
add(
    "funding_history",
    lambda s, d: M.funding_history(V.funding(s, d)).select("symbol", "settle_us", r(F.col("funding_rate"), 8).alias("funding_rate"), r(F.col("funding_z")).alias("funding_z"), F.col("funding_extreme_pos").cast("bigint").alias("funding_extreme_pos")),
    over("funding", """, u as (select symbol, settle_us, max(funding_rate) as x from funding group by 1, 2),
      z as (select *, case when count(x) over q = 90 then (x - avg(x) over q) / nullif(stddev_pop(x) over q, 0) end as z from u window q as (partition by symbol order by settle_us rows between 90 preceding and 1 preceding))
      select symbol, settle_us, round(x, 8) + 0e0 as funding_rate, round(z, 6) + 0e0 as funding_z, cast(coalesce(x > 0 and z >= 2, false) as bigint) as funding_extreme_pos from z"""),
)


def labelled(s, d):
    """Barrier labels on six-bar exponential volatility, written once: several steps read them."""
    vol = X.ewm_std(X.base_features(V.bars(s, d)).drop("pos"), "log_return", 6).drop("pos")
    return materialise(L.triple_barrier(vol, "ewm_std", horizon=6, up=1.0, down=1.0), "labels")


EWM = """, r as (select *, ln(close / lag(close) over (partition by symbol order by open_us)) as x, row_number() over (partition by symbol order by open_us) - 1 as pos from bars),
  b0 as (select symbol, min(pos) as first from r where x is not null group by 1),
  w as (select a.symbol, a.pos, p.x, pow(5e0 / 7, a.pos - p.pos) * case when p.pos = greatest(b0.first, a.pos - 76) then 1 else 2e0 / 7 end as w
        from r a join b0 using (symbol) join r p on p.symbol = a.symbol and p.pos between a.pos - 76 and a.pos and p.x is not null),
  s as (select symbol, pos, count(*) as k, sum(w) as w, sum(w * w) as w2, sum(w * x) as wx, sum(w * x * x) as wxx from w group by 1, 2),
  v as (select r.*, case when k >= 6 then greatest(sqrt(greatest((wxx / w - (wx / w) * (wx / w)) * (w * w / nullif(w * w - w2, 0)), 0)), 1e-6) end as vol, max(r.pos) over (partition by symbol) as last from r left join s using (symbol, pos)),
  h as (select v.symbol, v.pos, v.open_us, v.close, v.close * (1 + v.vol) as top, v.close * (1 - v.vol) as bottom, a.pos as apos, a.open_us as x_us, a.high as ah, a.low as al
        from v join bars_pos a on a.symbol = v.symbol and a.pos between v.pos + 1 and v.pos + 6 where v.vol is not null and v.pos + 6 <= v.last),
  t as (select symbol, pos, min(case when ah >= top or al <= bottom then apos end) as hit from h group by 1, 2),
  e as (select h.symbol, h.pos, h.open_us, h.close, h.top, h.bottom, h.x_us, a6.close as end_close, a6.open_us as end_us, t.hit, h.apos, h.ah, h.al from h join t using (symbol, pos) join bars_pos a6 on a6.symbol = h.symbol and a6.pos = h.pos + 6
        where h.apos = coalesce(t.hit, h.pos + 6)),
  lab as (select symbol, pos, open_us, close, case when hit is null then 'vertical' when ah >= top and al <= bottom then 'sl' when ah >= top then 'pt' else 'sl' end as tb_event, top, bottom, end_close, case when hit is null then end_us else x_us end as exit_us, coalesce(hit, pos + 6) as exit_pos from e),
  tb as (select *, case tb_event when 'pt' then 1 when 'sl' then -1 else 0 end as tb_label, ln(case tb_event when 'pt' then top when 'sl' then bottom else end_close end / close) as tb_return from lab)"""
BP = ", bars_pos as (select *, row_number() over (partition by symbol order by open_us) - 1 as pos from bars)"
add(
    "triple_barrier",
    lambda s, d: labelled(s, d).where("tb_event is not null").select("symbol", "open_us", "tb_event", F.col("tb_label").cast("bigint").alias("tb_label"), r(F.col("tb_return")).alias("tb_return"), "tb_exit_us"),
    over("bars", BP + EWM + " select symbol, open_us, tb_event, cast(tb_label as bigint) as tb_label, round(tb_return, 6) + 0e0 as tb_return, exit_us as tb_exit_us from tb"),
)
add(
    "label_uniqueness",
    lambda s, d: L.uniqueness(labelled(s, d)).select("symbol", "open_us", "concurrency", r(F.col("tb_uniqueness")).alias("tb_uniqueness")),
    over("bars", BP + EWM + """, c as (select b.symbol, b.pos, count(tb.pos) as c from bars_pos b left join tb on tb.symbol = b.symbol and b.pos > tb.pos and b.pos <= tb.exit_pos group by 1, 2)
      select tb.symbol, tb.open_us, max(case when c.pos = tb.pos then c.c end) as concurrency, round(sum(case when c.pos > tb.pos then 1e0 / c.c end) / max(tb.exit_pos - tb.pos), 6) + 0e0 as tb_uniqueness
      from tb join c on c.symbol = tb.symbol and c.pos between tb.pos and tb.exit_pos group by 1, 2"""),
)
add(
    "label_distribution",
    lambda s, d: labelled(s, d).where("tb_event is not null").groupBy("tb_event").agg(F.count(F.lit(1)).alias("n"), r(F.avg("tb_return")).alias("mean_return"), *(r(F.percentile("tb_return", q)).alias(f"q{int(q * 100)}") for q in (0.0, 0.25, 0.5, 0.75, 1.0))),
    over("bars", BP + EWM + " select tb_event, count(*) as n, round(avg(tb_return), 6) + 0e0 as mean_return, " + ", ".join(f"round(quantile_cont(tb_return, {q}), 6) + 0e0 as q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " from tb group by 1"),
)


def event_bars(s, d):
    e = labelled(s, d)
    ends = e.select("symbol", F.col("open_us").alias("tb_exit_us"), F.col("pos").alias("exit_pos"))
    return e.where("tb_event is not null").join(ends, ["symbol", "tb_exit_us"]).select("symbol", "open_us", "pos", "exit_pos")


add(
    "purged_folds",
    lambda s, d: L.purged_folds(event_bars(s, d)).groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")),
    over("bars", BP + EWM + """, p as (select symbol, pos, exit_pos, ntile(6) over (partition by symbol order by open_us) - 1 as part from tb),
      b as (select symbol, part as fold, min(pos) - 4 as bound from p where part >= 1 group by 1, 2),
      a as (select symbol, part as fold, 'test' as role, pos from p where part >= 1 union all
            select p.symbol, b.fold, 'train', p.pos from p join b on p.symbol = b.symbol and p.part < b.fold and p.exit_pos < b.bound)
      select symbol, fold, role, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from a group by 1, 2, 3"""),
)
add(
    "purged_training_pooled",
    lambda s, d: L.purged_training(V.oof(s, d)).select(F.col("fold").cast("bigint").alias("fold"), "kept", "removed"),
    over("oof", """, s as (select fold, min(decision_us) as start from oof group by 1)
      select cast(s.fold as bigint) as fold, count(*) filter (where exit_us + 14400000000 < start - 345600000000) as kept, count(*) filter (where exit_us + 14400000000 >= start - 345600000000) as removed
      from oof o join s on o.fold < s.fold group by 1"""),
)
add(
    "inner_validation_split",
    lambda s, d: L.last_share(V.oof(s, d), 0.25).groupBy("fold").agg(F.count_if("validation").alias("validation_rows"), F.min(F.when(F.col("validation"), F.col("decision_us"))).alias("from_us")).withColumn("fold", F.col("fold").cast("bigint")),
    over("oof", """, n as (select *, row_number() over (partition by fold order by decision_us, symbol) - 1 as k, count(*) over (partition by fold) as n from oof)
      select cast(fold as bigint) as fold, count(*) filter (where k >= n - floor(n * 0.25)) as validation_rows, min(decision_us) filter (where k >= n - floor(n * 0.25)) as from_us from n group by 1"""),
)
add(
    "time_blocks",
    lambda s, d: L.time_blocks(V.oof(s, d)).groupBy("fold", "block").agg(F.sum("n").alias("n"), F.min("decision_us").alias("from_us")).select(F.col("fold").cast("bigint").alias("fold"), F.col("block").cast("bigint").alias("block"), "n", "from_us"),
    over("oof", """, g as (select fold, decision_us, count(*) as n from oof group by 1, 2),
      c as (select *, sum(n) over (partition by fold order by decision_us) - n as before, sum(n) over (partition by fold) as total from g)
      select cast(fold as bigint) as fold, cast(1 + (4 * before >= total)::int + (4 * before >= 2 * total)::int + (4 * before >= 3 * total)::int as bigint) as block, cast(sum(n) as bigint) as n, min(decision_us) as from_us from c group by 1, 2"""),
)
add(
    "concurrent_positions",
    lambda s, d: L.concurrent_positions(V.oof(s, d), ["symbol"]),
    over("oof", """, x as (select symbol, decision_us as t, 0 as late, 1 as d from oof union all select symbol, exit_us + 14400000000, 1, -1 from oof),
      c as (select symbol, sum(d) over (partition by symbol order by t, late range unbounded preceding) as open from (select symbol, t, late, sum(d) as d from x group by 1, 2, 3))
      select symbol, cast(max(open) as bigint) as most_open from c group by 1""".replace(" range unbounded preceding", "")),
)
add(
    "swing_stops",
    lambda s, d: L.swing_stops(X.rolling(V.bars(s, d), X.KEYS, X.ORDER, 14, lambda w: {"atr": F.avg(F.col("high") - F.col("low")).over(X.back(w, 14))}).drop("pos"), "atr").select("symbol", "open_us", r(F.col("stop")).alias("stop"), r(F.col("target")).alias("target")),
    over("bars", """, a as (select *, avg(high - low) over (partition by symbol order by open_us rows 13 preceding) as atr, min(low) over (partition by symbol order by open_us rows 11 preceding) as sw from bars)
      select symbol, open_us, round(greatest(sw * 0.998, close - 2.5 * atr), 6) + 0e0 as stop, round(close + 2 * (close - greatest(sw * 0.998, close - 2.5 * atr)), 6) + 0e0 as target from a"""),
)
add(
    "hourly_capacity",
    lambda s, d: M.hourly_capacity(M.minute_bars(V.trades(s, d)), 2).select("symbol", r(F.col("capacity"), 4).alias("capacity")),
    over("trades", MIN + ", h as (select symbol, open_us // 3600000000 as h, sum(quote) as q from m group by 1, 2 having count(*) >= 2) select symbol, round(median(q) / 20, 4) + 0e0 as capacity from h group by 1"),
)
add(
    "combined_rows",
    lambda s, d: M.combined_row(M.order_flow(M.books(V.depth_rows(s, d).withColumn("symbol", F.when(F.col("symbol") == "S1", "click").otherwise(F.col("symbol"))))), M.volume_buckets(V.trades(s, d)), 5000.0).select("symbol", *(r(F.col(c)).alias(c) for c in ("ofi", "ofi_z", "vpin")), "ok", "reason"),
    over("depth trades", BOOK.replace("from depth", "from (select * replace (case symbol when 'S1' then 'click' else symbol end as symbol) from depth)") + BUCKET + """, fz as (select *, case when count(ofi) over z >= 2 and stddev_pop(ofi) over z > 1e-12 then (ofi - avg(ofi) over z) / stddev_pop(ofi) over z else 0 end as ofi_z from f window z as (partition by symbol order by seq rows 19 preceding)),
      fl as (select symbol, max_by(ofi, seq) as ofi, max_by(ofi_z, seq) as oz, max_by(liq, seq) as liq, count(*) as n from fz group by 1),
      vp as (select symbol, case when count(*) >= 5 then least(1, sum(imb) / sum(total)) end as vpin from g group by 1),
      j as (select symbol, fl.*exclude(symbol), vp.vpin, case when coalesce(n, 0) < 2 then 'few_snapshots' when liq < 5000 then 'liquidity_below_min' end as a, case when vpin is null then 'no_vpin' end as b from fl full join vp using (symbol))
      select symbol, round(coalesce(ofi, 0), 6) + 0e0 as ofi, round(coalesce(oz, 0), 6) + 0e0 as ofi_z, round(coalesce(vpin, 0), 6) + 0e0 as vpin, a is null and b is null as ok, concat_ws(';', a, b) as reason from j"""),
)
add(
    "flow_rows",
    lambda s, d: M.flow_row(M.order_flow(M.books(V.depth_rows(s, d))), 5000.0).select("symbol", *(r(F.col(c)).alias(c) for c in ("ofi", "ofi_norm", "ofi_z", "depth_imbalance", "spread_bps")), r(F.col("liquidity"), 3).alias("liquidity"), "snapshots", "ok", "reason"),
    over("depth", BOOK + """, fz as (select *, case when count(ofi) over z >= 2 and stddev_pop(ofi) over z > 1e-12 then (ofi - avg(ofi) over z) / stddev_pop(ofi) over z else 0 end as ofi_z, row_number() over (partition by symbol order by seq desc) as nth, count(*) over (partition by symbol) as n
        from f window z as (partition by symbol order by seq rows 19 preceding))
      select symbol, round(ofi, 6) + 0e0 as ofi, round(case when coalesce(bq, 0) + coalesce(aq, 0) > 1e-12 then greatest(-1, least(1, ofi / (coalesce(bq, 0) + coalesce(aq, 0)))) else 0 end, 6) + 0e0 as ofi_norm, round(ofi_z, 6) + 0e0 as ofi_z,
        round(case when bd + ad > 0 then (bd - ad) / (bd + ad) else 0 end, 6) + 0e0 as depth_imbalance, round(case when bp is not null and ap is not null then (ap - bp) / ((bp + ap) / 2) * 1e4 else 0 end, 6) + 0e0 as spread_bps, round(liq, 3) + 0e0 as liquidity,
        n as snapshots, n >= 2 and liq >= 5000 as ok, case when liq < 5000 then 'liquidity_below_min' when n < 2 then 'few_snapshots' end as reason from fz where nth = 1"""),
)
add(
    "quarantine_violations",
    lambda s, d: L.quarantine_violations(V.oof(s, d).select("fold", F.when(F.col("event_id") % 2 == 0, "train").otherwise("selection").alias("role"), (F.col("fold") - F.col("event_id") % 3).alias("source_fold"))),
    over("oof", " select count(*) filter (where event_id % 2 <> 0 and fold = 5) as quarantined_used, count(*) filter (where event_id % 2 = 0 and event_id % 3 = 0) as not_earlier from oof"),
)
add(
    "selection_split",
    lambda s, d: L.selection_split(V.oof(s, d)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("fold").cast("bigint").alias("fold"), "part", "n"),
    over("oof", """, n as (select *, row_number() over (partition by fold order by decision_us, symbol) - 1 as k, count(*) over (partition by fold) as n from oof), v as (select *, k >= n - ceil(n * 0.2) as val from n),
      s as (select fold, min(decision_us) as start from v where val group by 1) select cast(fold as bigint) as fold, case when val then 'validation' when exit_us < start then 'train' else 'purged' end as part, count(*) as n from v join s using (fold) group by 1, 2"""),
)
