"""Market-shaped tables derived from the generic event, order and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import HOUR, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", micros(F.col("ts")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type: symbol, open_us, open, high, low, close, volume, trades, taker_buy."""
    e = events(spark, sf_dir).withColumn("open_us", F.floor(F.col("us") / HOUR) * HOUR)
    return e.groupBy(F.col("event_type").alias("symbol"), "open_us").agg(
        F.min_by("value", "us").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "us").alias("close"),
        F.sum("value").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("taker_buy"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("symbol"),
        "us",
        F.col("event_id").alias("trade_id"),
        (F.lit(100.0) + (F.col("event_id") % 97) / F.lit(10.0)).alias("price"),
        F.col("value").alias("qty"),
        (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
    )


def depth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("l_linenumber") % 2 == 1
    disc = F.col("l_discount").cast("double")
    step = F.col("l_linenumber") * F.lit(0.01)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 5).cast("string")).alias("symbol"),
        F.col("l_orderkey").alias("seq"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, F.lit(100.0) - step - disc).otherwise(F.lit(100.0) + step + disc).alias("price"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_linenumber").alias("lvl"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        F.col("us").alias("settle_us"),
        ((F.col("value") - 20.0) / 10000.0).alias("funding_rate"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'click'")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("us").alias("decision_us"), "event_id"
    )


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold event table; folds are fifths of the order key range."""
    o = table(spark, sf_dir, "orders")
    start = 1_577_836_800_000_000  # 2020-01-01
    top = o.agg(F.max("o_orderkey").alias("top"))
    return o.join(F.broadcast(top)).select(
        F.concat(F.lit("P"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"),
        (F.lit(start) + F.col("o_orderkey") * HOUR).alias("decision_us"),
        (F.lit(start) + (F.col("o_orderkey") + 4 + F.col("o_orderkey") % 92) * HOUR).alias("exit_us"),
        (F.floor(F.col("o_orderkey") * 5 / (F.col("top") + 1)) + 1).cast("int").alias("fold"),
        (F.lit(0.55) + (F.col("o_orderkey") * 7919 % 4501) / F.lit(10000.0)).alias("p_primary"),
        ((F.col("o_orderkey") * 104729 % 9973) / F.lit(9973.0)).alias("p_meta"),
        ((F.col("o_custkey") % 41 - 20) / F.lit(1000.0)).alias("ret"),
        (F.lit(0.5) + (F.col("o_orderkey") % 50) / F.lit(100.0)).alias("uniqueness"),
        F.col("o_orderkey").alias("event_id"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cycle_id"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("voter"),
        F.when(flag == "A", "BUY").when(flag == "R", "SELL").otherwise("HOLD").alias("vote"),
        (F.col("l_quantity").cast("double") * 2.0).alias("confidence"),
    )
