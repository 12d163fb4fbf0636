"""Audits of tables: claims, completeness, failed matches, lineage, signatures, timestamps, dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import finite, number

# Timestamp texts that are understood, besides epoch numbers.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd", "yyyy/MM/dd HH:mm"]
# end of fixed values


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of each set of rows that agree in `columns` (all of them by default)."""
    return df.dropDuplicates(list(columns) if columns else None)


def mixed_time(text: Column) -> Column:
    """Microseconds of a time written in any of TIME_FORMATS, in UTC where no zone is given; NULL where none fits."""
    parsed = F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS))
    return F.unix_micros(parsed)


def parsed_times(df: DataFrame, column: str, name: str = "us") -> DataFrame:
    return df.withColumn(name, mixed_time(F.col(column)))


def parse_report(df: DataFrame, column: str) -> DataFrame:
    """Rows, parsed rows and invalid rows of a text column of times."""
    at = mixed_time(F.col(column))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(at).alias("parsed"), F.count_if(at.isNull()).alias("invalid"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))


def claims(observed: DataFrame, claimed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claimed against observed row counts of each key; a key on one side only counts 0 on the other."""
    keys = list(keys)
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    both = claimed.select(*keys, "claimed").join(seen, keys, "full").fillna(0, ["claimed", "observed"])
    return both.withColumn("agrees", F.col("claimed") == F.col("observed"))


def repeated_keys(inputs: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once over all inputs, with the inputs that hold them."""
    keys = list(keys)
    parts = [df.select(*keys, F.lit(n).alias("_input")) for n, df in inputs.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("_input")).alias("inputs"))
    return out.where("n > 1").withColumn("inputs", F.array_join("inputs", ","))


def failed_matches(joined: DataFrame, matched: Column, usable: Column, time: str) -> DataFrame:
    """Where matches failed: rows overall, by symbol, by fold and by both, unmatched, matched but unusable, first and last time."""
    bad = ~matched | ~usable
    out = joined.where(bad).cube("symbol", "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~matched).alias("unmatched"), F.count_if(matched & ~usable).alias("unusable"),
        F.min(time).alias("first_us"), F.max(time).alias("last_us"),
    )
    return out


def panel_gaps(predictions: DataFrame, expected: DataFrame, configs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per configuration: distinct keys predicted, repeated ones, expected keys missing and keys not expected.

    `expected` is counted once; each prediction is looked up in it, so no grid of configurations and keys is made.
    """
    keys = list(keys)
    total = expected.select(*keys).distinct()
    per_key = predictions.groupBy("config_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    known = per_key.join(total.withColumn("_known", F.lit(1)), keys, "left")
    each = known.groupBy("config_id").agg(F.count(F.lit(1)).alias("predicted"), F.count_if(F.col("n") > 1).alias("repeated"), F.count("_known").alias("_met"), F.count_if(F.col("_known").isNull()).alias("unexpected"))
    size = total.agg(F.count(F.lit(1)).alias("_size"))
    out = configs.select("config_id").join(each, "config_id", "left").fillna(0, ["predicted", "repeated", "_met", "unexpected"]).join(size)
    out = out.withColumn("missing", F.col("_size") - F.col("_met")).drop("_size", "_met")
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("unexpected") == 0))


def signature(rows: DataFrame, time: str) -> DataFrame:
    """(part, key, value): number and time range of affected rows, and their counts by symbol and by fold."""
    def line(part: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("long").alias("value"))

    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    out = whole.select(F.inline(F.array(line("rows", F.lit("all"), F.col("n")), line("time", F.lit("first"), F.col("a")), line("time", F.lit("last"), F.col("b")))))
    for key in ("symbol", "fold"):
        each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(each.select(F.inline(F.array(line(key, F.col(key), F.col("n"))))))
    return out


def signature_gaps(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Lines of the observed and the expected signature that differ or stand on one side only."""
    both = observed.withColumnRenamed("value", "observed").join(expected.withColumnRenamed("value", "expected"), ["part", "key"], "full")
    return both.where(~F.col("observed").eqNullSafe(F.col("expected")))


def lineage(uses: DataFrame) -> DataFrame:
    """One row per file: merged roles and requirers, conflict where size or hash differ between its uses."""
    return uses.groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.array_join(F.array_sort(F.collect_set("required_by")), ",").alias("required_by"),
        F.count(F.lit(1)).alias("uses"), ((F.countDistinct("size") > 1) | (F.countDistinct("sha256") > 1)).alias("conflict"),
    )


def archive_completeness(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files per symbol against the expected number; symbols on either side only are incomplete."""
    have = files.groupBy("symbol").agg(F.countDistinct("file").alias("files"))
    both = expected.select("symbol", "expected").join(have, "symbol", "full").fillna(0, ["files", "expected"])
    return both.withColumn("complete", F.col("files") == F.col("expected"))


def column_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column, rows of common keys whose values differ (NULL equals NULL)."""
    keys = list(keys)
    j = a.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns)).join(b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns)), keys)
    one = j.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(c) for c in columns))
    return one.unpivot(["rows"], list(columns), "column", "mismatches")


def off_calendar(df: DataFrame, time: str, step: int, symbols: Sequence[str]) -> DataFrame:
    """Per symbol: rows, rows off the time grid, and whether the symbol belongs to the domain."""
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(time) % step != 0).alias("off_grid"))
    return out.withColumn("known", F.col("symbol").isin(list(symbols)))


def source_report(df: DataFrame, time: Column, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Diagnostics of a feature source: bad times, repeated times, and values that are not finite, by column."""
    t = df.withColumn("_t", time)
    value = {c: F.col(c).cast("double") for c in columns}
    one = t.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_t").isNull()).alias("bad_times"),
        *(F.count_if(v.isNotNull() & finite(v).isNull()).alias(f"not_finite_{c}") for c, v in value.items()),
    )
    twice = t.where("_t is not null").groupBy(*key, "_t").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    return one.join(twice)


# What a regime source may hold.
REGIMES, POLICIES = ["bull", "neutral", "bear"], {"allow": 2, "caution": 1, "block": 0}
# end of fixed values


def regime_source(df: DataFrame) -> DataFrame:
    """Regime rows (symbol, us, ok, regime, policy, bull, neutral, bear, confidence) with a violation where an ok row breaks the contract.

    Only ok rows are checked: known regime and policy, probabilities in [0, 1] that sum to 1 within
    1e-3. Rows that are not ok keep their time, with regime `missing` and nothing else.
    """
    ok = F.lower(F.trim(F.col("ok").cast("string"))).isin("true", "1", "yes")
    names = ["bull", "neutral", "bear", "confidence"]
    p = {n: number(F.col(n)) for n in names}
    total = p["bull"] + p["neutral"] + p["bear"]
    inside = F.lit(True)
    for x in p.values():
        inside &= F.coalesce(x.between(0, 1), F.lit(False))
    regime, policy = F.lower("regime"), F.lower("policy")
    violation = (
        F.when(~F.coalesce(regime.isin(REGIMES), F.lit(False)), "regime").when(~F.coalesce(policy.isin(list(POLICIES)), F.lit(False)), "policy")
        .when(~inside, "probability").when(F.abs(total - 1) > 1e-3, "sum")
    )
    code = F.create_map(*(F.lit(x) for kv in POLICIES.items() for x in kv))
    return df.select(
        "symbol", "us", ok.alias("ok"), F.when(ok, regime).otherwise("missing").alias("regime"), F.when(ok, F.try_element_at(code, policy)).alias("policy_code"),
        *(F.when(ok, p[n]).alias(n) for n in names), F.when(ok, violation).alias("violation"),
    )


def cadence(df: DataFrame, lagged: str) -> DataFrame:
    """Most frequent distance between following rows of a symbol, the smaller one on ties."""
    each = df.where(F.col(lagged).isNotNull()).groupBy("symbol", lagged).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy("symbol").agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col(lagged).alias("v"))).alias("x")).select("symbol", F.col("x.v").alias("cadence"))


def prefix_differences(bars: DataFrame, make: Callable[[DataFrame], DataFrame], cut: int, keys: Sequence[str] = ("symbol", "open_us")) -> DataFrame:
    """(rows, differing): rows up to a time whose features change when all later rows are taken away. Features that look ahead differ."""
    keys = list(keys)
    whole, alone = make(bars).where(F.col(keys[-1]) <= cut), make(bars.where(F.col(keys[-1]) <= cut))
    made = [c for c in whole.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*(F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else c for c in made)).alias(name))
    both = pack(whole, "_whole").join(pack(alone, "_alone"), keys, "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_whole").eqNullSafe(F.col("_alone"))).alias("differing"))
