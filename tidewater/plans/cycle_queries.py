"""Registered queries over votes, contracts, audits, histories and streams, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR, norm_symbol
from tidewater.functions.columns import rounded as r
from tidewater.operators import cycle as C
from tidewater.operators import features as X
from tidewater.operators.series import asof_join
from tidewater.plans.sqlviews import over
from tidewater.sources import archives as A
from tidewater.sources import views as V

Q, O = {}, {}


def add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


def rr(*cols, digits=6):
    return [r(F.col(c), digits).alias(c) for c in cols]


def graded(s, d):
    """Votes graded by whether the line was returned late enough to count as right."""
    return V.table(s, d, "lineitem").select(
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("voter"),
        ((F.col("l_orderkey") % 60 - 30) / 20.0).alias("r_multiple"), (F.col("l_orderkey") % 3 != 0).alias("right"))


GR = """, g as (select 'v' || cast(l_linenumber as varchar) as voter, (l_orderkey % 60 - 30) / 2e1 as rm, l_orderkey % 3 <> 0 as ok from lineitem),
  p as (select voter, sum(case when abs(rm) >= 0.11 then case when ok then abs(rm) else -abs(rm) end else 0 end) as score from g group by 1),
  w as (select voter, score, greatest(0.2, least(2, 1 + case when (select max(abs(score)) from p) > 0 then score / (select max(abs(score)) from p) else 0 end)) as weight from p)"""
add(
    "voter_weights",
    lambda s, d: C.voter_weights(graded(s, d)).select("voter", *rr("score", "weight")),
    over("votes", GR + " select voter, round(score, 6) + 0e0 as score, round(weight, 6) + 0e0 as weight from w"),
)
add(
    "vote_consensus",
    lambda s, d: C.consensus(V.votes(s, d), C.voter_weights(graded(s, d)).select("voter", "weight")).select("cycle_id", *rr("buy_share", "sell_share"), "decision"),
    over("votes", GR + """, c as (select cycle_id, sum(case when vote = 'BUY' and confidence >= 65 then weight else 0 end) / sum(weight) as b, sum(case when vote = 'SELL' and confidence >= 65 then weight else 0 end) / sum(weight) as s from votes join w using (voter) group by 1)
      select cycle_id, round(b, 6) + 0e0 as buy_share, round(s, 6) + 0e0 as sell_share, case when b >= 0.61 then 'BUY' when s >= 0.61 then 'SELL' else 'HOLD' end as decision from c"""),
)
add(
    "confidence_normalised",
    lambda s, d: V.votes(s, d).groupBy(C.normalised_confidence(F.when(F.col("cycle_id") % 2 == 0, F.col("confidence") / 100).otherwise(F.col("confidence"))).alias("confidence")).agg(F.count(F.lit(1)).alias("n")),
    over("votes", """, x as (select case when cycle_id % 2 = 0 then confidence / 100 else confidence end as c from votes)
      select cast(round_even(greatest(0, least(100, case when c <= 1 then c * 100 else c end)), 0) as bigint) as confidence, count(*) as n from x group by 1"""),
)
add(
    "votes_extracted",
    lambda s, d: C.extracted_votes(V.votes(s, d).withColumn("text", F.concat(F.lit('<think>{"vote":"SELL"}</think> so\n```json\n{"vote": "'), F.lower("vote"), F.lit('", "confidence": '), F.col("confidence").cast("string"), F.lit("}\n``` done")))).groupBy("vote", "valid").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total")),
    over("votes", "select vote, true as valid, count(*) as n, cast(sum(round_even(least(100, case when confidence <= 1 then confidence * 100 else confidence end), 0)) as bigint) as total from votes group by 1"),
)
add(
    "votes_in_conversations",
    lambda s, d: C.extracted_votes(V.table(s, d, "conversations")).groupBy("valid").agg(F.count(F.lit(1)).alias("n")),
    "select false as valid, count(*) as n from conversations",
)
add(
    "oof_contract",
    lambda s, d: C.contract(V.oof(s, d), ["symbol", "decision_us"], ["symbol", "p_primary"], {"p_meta": (0.1, 0.9), "p_primary": (0, 1)}, {"symbol": ["P0", "P1", "P2", "P3", "P4", "P5"]}),
    over("oof", """select 'null:symbol' as "check", count(*) filter (where symbol is null) as violations from oof union all select 'null:p_primary', count(*) filter (where p_primary is null) from oof
      union all select 'range:p_meta', count(*) filter (where p_meta not between 0.1 and 0.9) from oof union all select 'range:p_primary', count(*) filter (where p_primary not between 0 and 1) from oof
      union all select 'domain:symbol', count(*) filter (where symbol not in ('P0', 'P1', 'P2', 'P3', 'P4', 'P5')) from oof union all select 'unique:symbol,decision_us', count(*) from (select 1 from oof group by symbol, decision_us having count(*) > 1)"""),
)
add(
    "look_ahead_audit",
    lambda s, d: C.look_ahead_audit(asof_join(V.decisions(s, d), V.funding(s, d), ["symbol"], "decision_us", "settle_us"), "decision_us", "r_settle_us", 6 * HOUR).withColumn("symbol", F.coalesce("symbol", F.lit("*"))),
    over("decisions funding", """, j as (select d.symbol, d.decision_us - f.settle_us as l from decisions d asof left join funding f on d.symbol = f.symbol and d.decision_us >= f.settle_us)
      select coalesce(symbol, '*') as symbol, count(*) as rows, count(*) filter (where l < 0) as future, count(*) filter (where l > 21600000000) as stale, count(*) filter (where l is null) as unmatched, min(l) as least_lag, max(l) as most_lag,
      case when count(*) filter (where l < 0) > 0 then 'error' when count(*) filter (where l > 21600000000) > 0 then 'warning' else 'ok' end as verdict from j group by rollup (symbol)"""),
)
add(
    "coverage_match",
    lambda s, d: C.coverage_match(V.bars(s, d).where("trades > 2"), V.bars(s, d).where("volume < 100"), ["symbol", "open_us"]),
    over("bars", """, a as (select symbol, open_us from bars where trades > 2), b as (select symbol, open_us from bars where volume < 100)
      select case when a.symbol is null then 'right_only' when b.symbol is null then 'left_only' else 'both' end as side, count(*) as n from a full join b on a.symbol = b.symbol and a.open_us = b.open_us group by 1"""),
)
add(
    "stored_against_rebuilt",
    lambda s, d: C.rebuilt_gaps(V.bars(s, d), V.bars(s, d).withColumn("volume", F.round("volume", 2)), ["symbol", "open_us"], "volume").select("met", *rr("largest_gap")),
    over("bars", "select count(*) as met, round(max(abs(volume - round(volume, 2))), 6) + 0e0 as largest_gap from bars"),
)
add(
    "history_lines",
    lambda s, d: A.history_lines(
        V.events(s, d).select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 11 == 0, "{broken").when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"symbol":"'), "event_type", F.lit('","ts":'), F.floor(F.col("us") / 1000).cast("string"), F.lit(',"features":'), F.col("props"), F.lit("}"))).otherwise(F.concat(F.lit('{"symbol":" '), F.upper("event_type"), F.lit('/","ts":'), F.floor(F.col("us") / 1000000).cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))).alias("line")),
        ["k"], ["CLICK", "VIEW"]).select("line_no", "symbol", "us", "k"),
    """with l as (select event_id as line_no, upper(event_type) as symbol, case when event_id % 2 = 0 then (epoch_us(ts) // 1000) * 1000 else (epoch_us(ts) // 1000000) * 1000000 end as us, cast(json_extract(props, '$.k') as double) as k from events where event_id % 11 <> 0 and event_type in ('click', 'view'))
      select line_no, symbol, us, k from (select *, row_number() over (partition by symbol, us order by line_no desc) as n from l where k is not null) where n = 1""",
)
add(
    "candle_rows",
    lambda s, d: A.candle_rows(V.bars(s, d).groupBy("symbol").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("open_us", "open", "high", "low", "close", "volume"))), lambda b: F.array(b.open_us.cast("string"), b.open.cast("string"), b.high.cast("string"), b.low.cast("string"), b.close.cast("string"), b.volume.cast("string")))).alias("rows")).withColumn("line_no", F.lit(0))).select("symbol", "open_us", *rr("open", "close", "volume")),
    over("bars", "select symbol, open_us, round(open, 6) + 0e0 as open, round(close, 6) + 0e0 as close, round(volume, 6) + 0e0 as volume from bars"),
)
add(
    "symbols_normalised",
    lambda s, d: V.events(s, d).select(norm_symbol(F.concat(F.lit(" "), F.col("event_type"), F.lit("/x-"))).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
    "select upper(event_type) || 'X' as symbol, count(*) as n from events group by 1",
)
add(
    "archive_gaps",
    lambda s, d: A.month_gaps(V.table(s, d, "orders").select(F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"), F.col("o_orderdate").cast("date").alias("day")).where("month(day) % 5 != 0"), "1992-01-01", "1998-12-01").select("symbol", F.date_format("month", "yyyy-MM").alias("month")),
    """with p as (select distinct 'P' || cast(o_custkey % 7 as varchar) as symbol, strftime(o_orderdate, '%Y-%m') as month from orders where month(o_orderdate) % 5 <> 0),
      c as (select symbol, strftime(m, '%Y-%m') as month from (select distinct symbol from p), (select unnest(generate_series(timestamp '1992-01-01', timestamp '1998-12-01', interval 1 month)) as m))
      select symbol, month from c anti join p using (symbol, month)""",
)
add(
    "keep_last_orders",
    lambda s, d: A.keep_last(V.table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", *rr("o_totalprice", digits=2)),
    "select o_custkey, max(o_orderkey) as o_orderkey, round(cast(max_by(o_totalprice, o_orderkey) as double), 2) + 0e0 as o_totalprice from orders group by 1",
)
def gated(s, d):
    """Events with a regime's policy and numbers around every border of the gate."""
    k = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.floor(k / n) % len(names) + 1).cast("int"))
    g = C.gate(pick(("allow", "caution", "block", None), 1), pick(("bull", "neutral", "bear"), 4), pick(("BUY", "SELL", "HOLD"), 12), F.col("p_meta"), F.lit(0.6), F.col("uniqueness"), F.col("p_primary") - F.lit(0.5), k % 10 < 5, k % 4)
    return V.oof(s, d).withColumn("g", g)


add(
    "decision_funnel",
    lambda s, d: C.funnel(gated(s, d), F.col("g.decision"), F.col("g.reason")),
    over("oof", """, i as (select *, event_id % 4 as po, (event_id // 4) % 3 as re, (event_id // 12) % 3 as si from oof),
      g as (select case when si = 2 then 'no_order' when po = 2 then 'policy' when si = 0 and re = 2 then 'bear_in_spot' when po = 0 then 'ok' when p_meta < least(0.95e0, 0.6e0 + 0.10e0) then 'low_conviction'
          when uniqueness < 0.55e0 then 'unstable' when p_primary - 0.5e0 < 0.10e0 then 'thin_margin' when event_id % 10 < 5 and event_id % 4 < 2 and p_meta < least(0.99e0, least(0.95e0, 0.6e0 + 0.10e0) + 0.10e0) then 'fresh_switch' else 'ok' end as reason from i)
      select case when reason in ('ok', 'no_order') then 'pass' else 'block' end as status, reason, count(*) as n from g group by 1, 2"""),
)
add(
    "positions_sized",
    lambda s, d: C.sized(V.bars(s, d).select("symbol", "open_us", F.lit(1000.0).alias("equity"), (F.lit(300.0) - F.col("trades")).alias("free_cash"), F.col("close").alias("entry"), (F.col("low") * 0.99).alias("stop"))).select("symbol", "open_us", *rr("wanted", "value", digits=4), "scaled_down", "rejected"),
    over("bars", """, w as (select symbol, open_us, 10 / nullif(abs(close - low * 0.99e0) / close, 0) as wanted, trades from bars), v as (select *, least(wanted, 330, 300 - trades) as value from w)
      select symbol, open_us, round(wanted, 4) + 0e0 as wanted, round(value, 4) + 0e0 as value, value < wanted - 1e-12 as scaled_down, coalesce(value < 10, true) as rejected from v"""),
)
def closed_trades(s, d):
    position = F.concat_ws(":", "symbol", F.col("open_us").cast("string")).alias("position_id")
    exits = X.trends(V.bars(s, d), (1,)).select(position, F.when(F.col("trades") % 11 == 0, F.col("open")).otherwise(F.col("close")).alias("exit"))
    opened = V.bars(s, d).select(position, F.when(F.col("trades") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("open").alias("entry"), (F.col("low") * 0.9).alias("stop"), F.lit(2.0).alias("qty"))
    return C.ledger(exits, opened)


def position_votes(s, d):
    """Four votes on every position."""
    vote = lambda i: F.element_at(F.array(*map(F.lit, ("BUY", "SELL", "HOLD"))), ((F.col("trades") + i) % 3 + 1).cast("int"))
    each = F.explode(F.array(*(F.struct(F.lit(f"v{i}").alias("voter"), vote(i).alias("vote")) for i in range(4)))).alias("x")
    return V.bars(s, d).select(F.concat_ws(":", "symbol", F.col("open_us").cast("string")).alias("position_id"), each).select("position_id", "x.*")


add(
    "graded_votes",
    lambda s, d: C.graded_votes(closed_trades(s, d), position_votes(s, d)).groupBy("voter", "vote").agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("aligned"), F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong")),
    over("bars", """, p as (select *, case when trades % 2 = 0 then 'BUY' else 'SELL' end as side, case when trades % 11 = 0 then 0 when trades % 2 = 0 then close - open else open - close end as m from bars),
      v as (select 'v' || cast(i as varchar) as voter, ['BUY', 'SELL', 'HOLD'][cast((trades + i) % 3 as int) + 1] as vote, side, m from p, range(4) t(i))
      select voter, vote, count(*) as n, count(*) filter (where vote = side) as aligned, count(*) filter (where vote <> 'HOLD' and (m > 0 and vote = side or m < 0 and vote <> side)) as right, count(*) filter (where vote <> 'HOLD' and (m > 0 and vote <> side or m < 0 and vote = side)) as wrong from v group by 1, 2"""),
)
add(
    "trade_ledger",
    lambda s, d: C.ledger(
        X.trends(V.bars(s, d), (1,)).select(F.concat_ws(":", "symbol", F.col("open_us").cast("string")).alias("position_id"), F.col("close").alias("exit")),
        V.bars(s, d).select(F.concat_ws(":", "symbol", F.col("open_us").cast("string")).alias("position_id"), F.when(F.col("trades") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("open").alias("entry"), (F.col("low") * 0.9).alias("stop"), F.lit(2.0).alias("qty"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), r(F.sum("pnl"), 4).alias("pnl"), r(F.avg("r_multiple")).alias("mean_r")),
    over("bars", """, p as (select case when trades % 2 = 0 then close - open else open - close end as m, abs(open - low * 0.9e0) as risk from bars)
      select case when m * 2 > 0 then 'win' when m * 2 < 0 then 'loss' else 'flat' end as outcome, count(*) as n, round(sum(m * 2), 4) + 0e0 as pnl, round(avg(m / nullif(risk, 0)), 6) + 0e0 as mean_r from p group by 1"""),
)
