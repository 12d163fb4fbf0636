"""Written results: datasets, out-of-fold tables, histories, reports and ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.columns import finite
from tidewater.operators.cycle import contract


def write_dataset(df: DataFrame, path: str) -> None:
    """A labelled dataset, one folder a symbol; reading the root gives the combined table."""
    df.write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_dataset(spark: SparkSession, path: str, time: str = "open_us", symbol: str | None = None) -> DataFrame:
    """The dataset of one symbol or of all; times that stand twice for a symbol are refused, with three of them named."""
    df = spark.read.parquet(path)
    df = df if symbol is None else df.where(F.col("symbol") == symbol)
    twice = df.groupBy("symbol", time).count().where("count > 1").orderBy("symbol", time).limit(3).collect()
    if twice:
        raise ValueError(f"times that stand twice: {[(r['symbol'], r[time]) for r in twice]}")
    return df


def dataset_metadata(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per symbol: rows, events, events by label, mean uniqueness and the share of rows that have every feature."""
    label = F.col("tb_label")
    whole = reduce(lambda a, b: a & b, (finite(F.col(c).cast("double")).isNotNull() for c in features))
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count(label).alias("events"), *(F.count_if(label == v).alias(n) for v, n in ((1, "profits"), (-1, "stops"), (0, "neither"))),
        F.avg("tb_uniqueness").alias("mean_uniqueness"), F.avg(whole.cast("int")).alias("coverage"),
    )


OOF = ["symbol", "decision_us", "exit_us", "fold", "p_primary", "ret", "uniqueness"]


def oof_violations(df: DataFrame, folds: int = 5) -> DataFrame:
    """Broken rules of an out-of-fold table: missing values, probabilities outside [0, 1], folds that are no whole number from 1, repeated keys."""
    if missing := [c for c in OOF if c not in df.columns]:
        raise ValueError(f"out-of-fold table without {missing}")
    fold = F.col("fold").cast("double")
    marked = df.withColumn("_fold", F.when((fold == F.floor(fold)) & fold.between(1, folds), "whole").otherwise("other"))
    out = contract(marked, ["symbol", "decision_us"], OOF, {"p_primary": (0, 1)}, {"_fold": ["whole"]})
    return out.where("violations > 0")


def write_oof(df: DataFrame, path: str, folds: int = 5) -> None:
    """Write an out-of-fold table that keeps every rule; a broken one is refused by name."""
    broken = [r["check"] for r in oof_violations(df, folds).collect()]  # one row a rule
    if broken:
        raise ValueError(f"out-of-fold table breaks {broken}")
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def fired(oof: DataFrame, at_least: float = 0.55) -> DataFrame:
    """Events whose primary probability reaches the firing threshold."""
    return oof.where(F.col("p_primary") >= at_least)


def history_rows(rows: DataFrame, features: Sequence[str], last_trade: Column, now: Column) -> DataFrame:
    """symbol, us and line: JSON of the finite features of each row, timed by its last trade or else by `now`; rows without any drop."""
    entry = F.array(*(F.struct(F.lit(f).alias("k"), finite(F.col(f).cast("double")).alias("v")) for f in features))
    have = F.map_from_entries(F.filter(entry, lambda e: e["v"].isNotNull()))
    at = F.coalesce(last_trade, now)
    out = rows.select("symbol", at.alias("us"), have.alias("_have")).where(F.size("_have") > 0)
    return out.select("symbol", "us", F.to_json(F.struct("symbol", F.floor(F.col("us") / 1000).alias("ts"), F.col("_have").alias("features"))).alias("line"))


def append_history(rows: DataFrame, path: str) -> None:
    """Append history lines as text files, one folder a symbol."""
    rows.select("symbol", "line").write.mode("append").partitionBy("symbol").text(path)


def append_stream_history(rows: DataFrame, path: str, checkpoint: str):
    """The same for a stream of history rows; gives the started query."""
    return rows.select("symbol", "line").writeStream.format("text").partitionBy("symbol").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def report(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Report tables in one long form: (report, key, metric, value); keys are joined by a bar, NULL keys read `*`."""
    parts = []
    for name, df in tables.items():
        by = list(keys[name])
        values = [c for c, t in df.dtypes if c not in by and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("*")) for k in by))
        wide = df.select(key.alias("key"), *(F.col(v).cast("double").alias(v) for v in values))
        parts.append(wide.unpivot(["key"], values, "metric", "value").select(F.lit(name).alias("report"), "key", "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def append_ledger(entries: DataFrame, path: str, run: str) -> None:
    """Add a run's thresholds or configurations to a ledger; earlier runs stay as they are."""
    entries.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def latest_entries(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The entry of the last run (by name) for each key."""
    best = ledger.groupBy(*keys).agg(F.max_by(F.struct(*ledger.columns), "run").alias("_r"))
    return best.select("_r.*")
