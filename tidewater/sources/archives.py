"""Scans of archived candles, trades, funding and history lines, with coercion and keep-last dedup."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import epoch_micros, norm_symbol, number

# Column order of the archives.
KLINES = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore"]
AGG_TRADES = ["trade_id", "price", "quantity", "first_id", "last_id", "time", "is_buyer_maker", "is_best_match"]
FUNDING = ["settlement_time", "interval_hours", "funding_rate"]
# end of fixed values


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the text members of zip files; unreadable files give one NULL line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                        lines = [x.decode("utf-8", "replace").rstrip("\r\n") for m in z.namelist() for x in z.open(m)]
                except zipfile.BadZipFile:
                    lines = [None]
                for at in range(0, len(lines), 10_000):
                    part = lines[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())],
                        names=["file", "line_no", "line"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, line_no long, line string")


def fields(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Comma-separated lines as named text columns; a header line, whose first field is no number, drops."""
    parts = F.split("line", ",")
    out = lines.where("line is not null").select("file", "line_no", *(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    return out.where(number(F.col(names[0])).isNotNull())


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in input order, given by explicit ordinals."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def klines(lines: DataFrame) -> DataFrame:
    f = fields(lines, KLINES)
    typed = f.select(
        "file", "line_no", epoch_micros(number(F.col("open_time"))).alias("open_us"),
        *(number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_base", "taker_quote")),
        number(F.col("trades")).cast("long").alias("trades"),
    )
    whole = typed.dropna(subset=["open_us", "open", "high", "low", "close", "volume"])
    return keep_last(whole, ["open_us"], ["file", "line_no"])


def boolean(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).isin("true", "1"), True).when(F.lower(F.trim(x)).isin("false", "0"), False)


def agg_trades(lines: DataFrame) -> DataFrame:
    f = fields(lines, AGG_TRADES)
    out = f.select(
        number(F.col("trade_id")).cast("long").alias("trade_id"), epoch_micros(number(F.col("time"))).alias("us"),
        number(F.col("price")).alias("price"), number(F.col("quantity")).alias("qty"), boolean(F.col("is_buyer_maker")).alias("is_buyer_maker"),
    )
    return out.dropna(subset=["us", "price", "qty"])


def funding_rates(lines: DataFrame) -> DataFrame:
    f = fields(lines, FUNDING)
    out = f.select("file", "line_no", epoch_micros(number(F.col("settlement_time"))).alias("settle_us"), number(F.col("funding_rate")).alias("funding_rate"))
    return keep_last(out.dropna(), ["settle_us"], ["file", "line_no"])


def history_lines(lines: DataFrame, features: Sequence[str], symbols: Sequence[str]) -> DataFrame:
    """Append-only JSON history: keys at the top or in known sections, all features finite, last one kept.

    `lines` has line and line_no; malformed lines are skipped.
    """
    sections = ["", "market_data.", "microstructure.", "features.", "data.", "payload."]
    v = lines.withColumn("_v", F.try_parse_json("line")).where("_v is not null")

    def looked_up(key: str) -> Column:
        return F.coalesce(*(F.try_variant_get("_v", f"$.{s}{key}", "string") for s in sections))

    # text first, numbers after: each lookup is evaluated once
    found = v.select("line_no", looked_up("symbol").alias("_symbol"), looked_up("ts").alias("_ts"), *(looked_up(f).alias(f"_{f}") for f in features))
    typed = found.select("line_no", "_symbol", number(F.col("_ts")).alias("_ts"), *(number(F.col(f"_{f}")).alias(f) for f in features))
    out = typed.select("line_no", norm_symbol(F.col("_symbol")).alias("symbol"), epoch_micros(F.col("_ts")).alias("us"), *features)
    out = out.dropna().where(F.col("symbol").isin(list(symbols)))
    return keep_last(out, ["symbol", "us"], ["line_no"])


def candle_rows(json_rows: DataFrame) -> DataFrame:
    """Arrays of candle arrays in JSON text, exploded and typed; partial rows drop, the last per time stays."""
    rows = json_rows.select("symbol", "line_no", F.posexplode(F.from_json("rows", "array<array<string>>")).alias("k", "r"))
    get = lambda i: F.try_element_at("r", F.lit(i))
    typed = rows.select("symbol", "line_no", "k", epoch_micros(number(get(1))).alias("open_us"), *(number(get(i + 2)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))))
    return keep_last(typed.dropna(), ["symbol", "open_us"], ["line_no", "k"])


def month_gaps(present: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, month) of the calendar without an archived month or day."""
    calendar = present.select("symbol").distinct().select("symbol", F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 month)")).alias("month"))
    have = present.select("symbol", F.trunc("day", "month").alias("month")).distinct()
    return calendar.join(have, ["symbol", "month"], "left_anti")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of every file under `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed and changed files between two manifests."""
    b = before.select("file", F.col("sha256").alias("old"))
    both = b.join(after.select("file", F.col("sha256").alias("new")), "file", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def last_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def chosen_files(files: DataFrame, start: str, end: str) -> DataFrame:
    """Archive files (symbol, kind, day) of a range: the monthly file of a month where there is one, else its daily files.

    `day` is a day of the file's month or the file's day; daily files outside [start, end] drop.
    """
    month = F.trunc("day", "month")
    f = files.withColumn("month", month).where((month >= F.trunc(F.lit(start).cast("date"), "month")) & (month <= F.lit(end).cast("date")))
    whole = f.where("kind = 'monthly'").select("symbol", "month").distinct()
    days = f.where("kind = 'daily'").where(F.col("day").between(start, end)).join(whole, ["symbol", "month"], "left_anti")
    return f.where("kind = 'monthly'").unionByName(days.select(*f.columns)).dropDuplicates(["symbol", "kind", "day"])
