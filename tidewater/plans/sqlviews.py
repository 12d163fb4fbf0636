"""DuckDB text of the derived tables, for the oracle queries."""

from __future__ import annotations

VIEWS = {
    "bars": """bars as (select event_type as symbol, (epoch_us(ts) // 3600000000) * 3600000000 as open_us,
        min_by(value, ts) as open, max(value) as high, min(value) as low, max_by(value, ts) as close,
        sum(value) as volume, count(*) as trades,
        sum(case when event_id % 2 = 0 then value else 0e0 end) as taker_buy
        from events group by 1, 2)""",
    "trades": """trades as (select event_type as symbol, epoch_us(ts) as us, event_id as trade_id,
        1e2 + (event_id % 97) / 1e1 as price, value as qty, (event_id % 2 = 1) as is_buyer_maker from events)""",
    "depth": """depth as (select 'S' || cast(l_orderkey % 5 as varchar) as symbol, l_orderkey as seq,
        case when l_linenumber % 2 = 1 then 'bid' else 'ask' end as side,
        case when l_linenumber % 2 = 1 then 1e2 - l_linenumber * 1e-2 - cast(l_discount as double)
             else 1e2 + l_linenumber * 1e-2 + cast(l_discount as double) end as price,
        cast(l_quantity as double) as qty, l_linenumber as lvl from lineitem)""",
    "funding": """funding as (select 's' || cast(user_id % 4 as varchar) as symbol, epoch_us(ts) as settle_us,
        (value - 2e1) / 1e4 as funding_rate from events where event_type = 'purchase')""",
    "decisions": """decisions as (select 's' || cast(user_id % 4 as varchar) as symbol, epoch_us(ts) as decision_us,
        event_id from events where event_type = 'click')""",
    "oof": """oof as (select 'P' || cast(o_custkey % 7 as varchar) as symbol,
        1577836800000000 + o_orderkey * 3600000000 as decision_us,
        1577836800000000 + (o_orderkey + 4 + o_orderkey % 92) * 3600000000 as exit_us,
        cast((o_orderkey * 5) // ((select max(o_orderkey) from orders) + 1) + 1 as int) as fold,
        5.5e-1 + (o_orderkey * 7919 % 4501) / 1e4 as p_primary, (o_orderkey * 104729 % 9973) / 9973e0 as p_meta,
        (o_custkey % 41 - 20) / 1e3 as ret, 5e-1 + (o_orderkey % 50) / 1e2 as uniqueness, o_orderkey as event_id
        from orders)""",
    "votes": """votes as (select l_orderkey as cycle_id, 'v' || cast(l_linenumber as varchar) as voter,
        case l_returnflag when 'A' then 'BUY' when 'R' then 'SELL' else 'HOLD' end as vote,
        cast(l_quantity as double) * 2e0 as confidence from lineitem)""",
}


def over(views: str, sql: str) -> str:
    """`sql` after a WITH list of the named views; further CTEs in `sql` start with a comma."""
    head = "with " + ", ".join(VIEWS[v] for v in views.split())
    return f"{head} {sql}" if views else sql


def tails(source: str, keys: str, name: str = "tl") -> str:
    """A further CTE `name` (keys, p): two-sided chances of F statistics of `source`.

    `source` has the keys, `free` (degrees of freedom below), `k` (above) and `u`, the share k f / (free + k f). The chance is the
    integral of cos(t)^(free - 1) sin(t)^(k - 1) from asin(sqrt(u)) on over that from 0 on, by Simpson's rule.
    """
    part = lambda lo: f"((pi() / 2 - {lo}) * sum(w * pow(cos({lo} + (pi() / 2 - {lo}) * i / 4000), free - 1) * pow(sin({lo} + (pi() / 2 - {lo}) * i / 4000), k - 1)))"
    return f""", {name} as (select {keys}, {part("lo")} / {part("0")} as p
      from (select *, asin(sqrt(least(1, u))) as lo from {source}), (select i, case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end as w from range(0, 4001) q(i)) group by {keys}, lo)"""
