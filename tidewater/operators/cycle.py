"""Decision-cycle tables: votes, consensus, gates, sizing, ledger, equity, contracts and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY, clip


def normalised_confidence(x: Column) -> Column:
    """0..100; values up to 1 are fractions, so 1 means 100. Halves round to even."""
    scaled = F.when(x <= 1, x * 100).otherwise(x)
    return F.bround(clip(scaled, 0, 100)).cast("long")


def _object(depth: int) -> str:
    """Pattern of a brace-balanced object with up to `depth` levels inside; braces in strings count as text."""
    inner = r'(?:[^{}"]|"(?:[^"\\]|\\.)*")'
    pattern = rf"\{{{inner}*+\}}"
    for _ in range(depth):
        pattern = rf"\{{(?:{inner}|{pattern})*+\}}"
    return pattern


OBJECT = rf"(?s)({_object(4)})"


def _read(candidate: Column) -> Column:
    """The object in a text that starts with a brace; NULL for an empty text or one that does not parse."""
    return F.try_parse_json(F.when(F.length(candidate) > 0, candidate))


def extracted_votes(responses: DataFrame, text: str = "text", debate: bool = False) -> DataFrame:
    """Vote and confidence out of response texts: a fenced JSON object, else the whole text, else the first object in it.

    Thoughts between <think> marks do not count. In a debate the keys are final_vote and
    final_confidence, and `changed` tells whether the opinion did. A row is valid if the vote is BUY,
    SELL or HOLD and the confidence a number.
    """
    t = F.trim(F.regexp_replace(F.col(text), "(?is)<think>.*?</think>", ""))
    # each step looks only at texts that no step before it could read, and only at what starts as an object does: a text that
    # does not parse costs much more than one that does, and a bare number or string is no object
    staged = responses.withColumn("_t", t)
    fenced = F.when(F.contains("_t", F.lit("```")), F.regexp_extract("_t", r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1))
    whole = F.when(F.col("_v").isNull() & F.startswith(F.ltrim("_t", F.lit(" \t\r\n")), F.lit("{")), F.col("_t"))
    within = F.when(F.col("_v").isNull() & F.contains("_t", F.lit("{")), F.regexp_extract("_t", OBJECT, 1))
    staged = staged.withColumn("_v", _read(fenced))
    staged = staged.withColumn("_v", F.coalesce("_v", _read(whole)))
    out = staged.withColumn("_v", F.coalesce("_v", _read(within)))
    keys = ("final_vote", "final_confidence") if debate else ("vote", "confidence")
    out = out.withColumns({"vote": F.upper(F.try_variant_get("_v", f"$.{keys[0]}", "string")), "_c": F.try_variant_get("_v", f"$.{keys[1]}", "double")})
    if debate:
        out = out.withColumn("changed", F.coalesce(F.try_variant_get("_v", "$.changed_opinion", "boolean"), F.lit(False)))
    ok = F.col("vote").isin("BUY", "SELL", "HOLD") & F.col("_c").isNotNull()
    return out.withColumns({"valid": F.coalesce(ok, F.lit(False)), "confidence": normalised_confidence(F.col("_c"))}).drop("_c", "_v", "_t")


def consensus(votes: DataFrame, weights: DataFrame, keys: Sequence[str] = ("cycle_id",), sure: float = 65.0, threshold: float = 0.61) -> DataFrame:
    """Weighted share of confident votes per side; BUY is looked at first."""
    v = votes.join(weights, "voter", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    side = lambda s: F.sum(F.when((F.col("vote") == s) & (F.col("confidence") >= sure), F.col("w")).otherwise(0.0)) / F.sum("w")
    out = v.groupBy(*keys).agg(side("BUY").alias("buy_share"), side("SELL").alias("sell_share"))
    return out.withColumn("decision", F.when(F.col("buy_share") >= threshold, "BUY").when(F.col("sell_share") >= threshold, "SELL").otherwise("HOLD"))


def voter_weights(graded: DataFrame, floor: float = 0.11) -> DataFrame:
    """Weight per voter from graded trades: +-|R| where |R| is large enough, scaled, within [0.2, 2]."""
    size = F.abs("r_multiple")
    score = F.when(size >= floor, F.when(F.col("right"), size).otherwise(-size)).otherwise(0.0)
    per = graded.groupBy("voter").agg(F.sum(score).alias("score"))
    top = per.agg(F.max(F.abs("score")).alias("top"))
    return per.join(F.broadcast(top)).select("voter", "score", clip(1 + F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0), 0.2, 2).alias("weight"))


def recent_voter_weights(graded: DataFrame, voters: DataFrame, now: int, days: int = 30) -> DataFrame:
    """`voter_weights` of the trades closed in the last `days`; everybody weighs 1 until the first trade is that old.

    `graded` has closed_us besides voter, r_multiple and right; voters without a recent trade score 0.
    """
    since = now - days * DAY
    old_enough = graded.agg((F.min("closed_us") <= since).alias("_ready"))
    recent = graded.where(F.col("closed_us") > since).select("voter", "r_multiple", "right")
    every = voters.select("voter", F.lit(0.0).alias("r_multiple"), F.lit(True).alias("right"))
    weights = voter_weights(recent.join(voters.select("voter"), "voter", "left_semi").unionByName(every)).join(old_enough)
    return weights.select("voter", "score", F.when(F.coalesce("_ready", F.lit(False)), F.col("weight")).otherwise(1.0).alias("weight"))


def gate(policy: Column, regime: Column, side: Column, conviction: Column, threshold: Column, persistence: Column, margin: Column, changed: Column, age: Column, spot: bool = True) -> Column:
    """(decision, reason) of the regime gate for a BUY or SELL, first matching rule; other decisions are no orders.

    Policy `block` stops every order and, in spot, a bear stops a BUY. Only under `caution`, which also stands for a missing
    policy, does an order need conviction, persistence, margin and no switch within two bars; an exceptional conviction
    passes a fresh switch. Missing numbers count as 0.
    """
    number = lambda c: F.coalesce(c, F.lit(0.0))
    strict = F.least(F.lit(0.95), threshold + 0.10)
    strong = number(conviction) >= F.least(F.lit(0.99), strict + 0.10)
    careful = F.coalesce(F.lower(policy), F.lit("caution")) == "caution"
    rules = [
        (~F.coalesce(side.isin("BUY", "SELL"), F.lit(False)), "pass", "no_order"),
        (F.lower(policy) == "block", "block", "policy"),
        (F.lit(spot) & (side == "BUY") & (F.lower(regime) == "bear"), "block", "bear_in_spot"),
        (careful & (number(conviction) < strict), "block", "low_conviction"),
        (careful & (number(persistence) < 0.55), "block", "unstable"),
        (careful & (number(margin) < 0.10), "block", "thin_margin"),
        (careful & F.coalesce(changed, F.lit(False)) & (F.coalesce(age, F.lit(0)) < 2) & ~strong, "block", "fresh_switch"),
    ]
    out = F.struct(F.lit("pass").alias("decision"), F.lit("ok").alias("reason"))
    for test, decision, reason in reversed(rules):
        out = F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def sized(orders: DataFrame, risk: float = 0.01, margin_cap: float = 0.33, least: float = 10.0) -> DataFrame:
    """Position value from risk per stop distance, capped by margin share and free cash."""
    wanted = F.col("equity") * risk / F.when(F.col("entry") != F.col("stop"), F.abs(F.col("entry") - F.col("stop")) / F.col("entry"))
    value = F.least(wanted, F.col("equity") * margin_cap, F.col("free_cash"))
    out = orders.withColumns({"wanted": wanted, "value": value})
    return out.withColumns({"scaled_down": F.col("value") < F.col("wanted") - 1e-12, "rejected": F.coalesce(F.col("value") < least, F.lit(True))})


def ledger(closes: DataFrame, positions: DataFrame) -> DataFrame:
    """Profit, realised R and outcome of closed positions."""
    j = closes.join(positions, "position_id")
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    move = (F.col("exit") - F.col("entry")) * sign
    risk = F.abs(F.col("entry") - F.col("stop"))
    out = j.withColumns({"pnl": move * F.col("qty"), "r_multiple": move / F.when(risk > 0, risk)})
    return out.withColumn("outcome", F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("flat"))


def graded_votes(closed: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes (position_id, voter, vote) on closed positions (position_id, side, outcome, r_multiple): aligned with the trade, and
    right or wrong by its outcome. A HOLD and a vote on a flat trade are neither."""
    j = votes.join(closed.select("position_id", "side", "outcome", "r_multiple"), "position_id")
    aligned = F.coalesce(F.col("vote") == F.col("side"), F.lit(False))
    right = F.when(~F.coalesce(F.col("vote").isin("BUY", "SELL"), F.lit(False)), None).when(F.col("outcome") == "win", aligned).when(F.col("outcome") == "loss", ~aligned)
    return j.withColumns({"aligned": aligned, "right": right})


def best_price(quotes: DataFrame) -> DataFrame:
    """Mid of the best bid and ask, else bid, else ask, else last trade, else last close."""
    ok = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("bid", "ask", "last", "close")}
    return quotes.withColumn("price", F.coalesce((ok["bid"] + ok["ask"]) / 2, ok["bid"], ok["ask"], ok["last"], ok["close"]))


def funnel(rows: DataFrame, status: Column, reason: Column) -> DataFrame:
    return rows.groupBy(status.alias("status"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def contract(df: DataFrame, key: Sequence[str], not_null: Sequence[str] = (), within: dict[str, tuple[float, float]] | None = None, domain: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(check, violations) of a table's contract: one pass for values, one count for the key."""
    checks = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    checks |= {f"range:{c}": F.count_if(~F.col(c).between(a, b)) for c, (a, b) in (within or {}).items()}
    checks |= {f"domain:{c}": F.count_if(~F.col(c).isin(list(v))) for c, v in (domain or {}).items()}
    one = df.agg(*(v.alias(k) for k, v in checks.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("violations")) for k in checks)))
    keys = df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("unique:" + ",".join(key)).alias("check"), "violations")
    return one.select(pairs.alias("x")).select("x.*").unionByName(keys)


def look_ahead_audit(joined: DataFrame, decision: str, source: str, stale: int) -> DataFrame:
    """Per symbol and overall: future, stale, unmatched rows and the range of lags of an as-of join."""
    lag = F.col(decision) - F.col(source)
    out = joined.rollup("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(lag < 0).alias("future"), F.count_if(lag > stale).alias("stale"),
        F.count_if(F.col(source).isNull()).alias("unmatched"), F.min(lag).alias("least_lag"), F.max(lag).alias("most_lag"),
    )
    return out.withColumn("verdict", F.when(F.col("future") > 0, "error").when(F.col("stale") > 0, "warning").otherwise("ok"))


def coverage_match(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in both, left only and right only, by key."""
    both = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), list(keys), "full")
    where = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return both.groupBy(where.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def rebuilt_gaps(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest absolute difference of a stored and a rebuilt column, and how many rows met."""
    j = a.select(*keys, F.col(value).alias("_x")).join(b.select(*keys, F.col(value).alias("_y")), list(keys))
    return j.agg(F.count(F.lit(1)).alias("met"), F.max(F.abs(F.col("_x") - F.col("_y"))).alias("largest_gap"))
