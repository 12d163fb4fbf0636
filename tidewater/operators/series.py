"""Foundations for ordered data: ordinals, chunks with halos, running sums, as-of joins, islands.

A window partitioned by symbol alone has as many tasks as there are symbols. Everything here cuts
a series into chunks, so that a long series of one symbol spreads over many tasks; what crosses a
chunk's border is either a bounded halo of rows or one carried row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.columns import DAY

SPAN = 30 * DAY  # time span of a chunk
ROWS = 50_000  # rows of a chunk cut by position
PARTS = 512  # ranges of values of a key
SALTS = 64


def _bucket(ts: str, span: int) -> Column:
    return F.floor(F.col(ts) / span)


def value_cuts(df: DataFrame, keys: Sequence[str], value: str, parts: int = PARTS) -> DataFrame:
    """(keys, _cuts): approximate quantiles of each key's values, ascending and distinct: a row a key of at most `parts` numbers."""
    marks = [i / parts for i in range(1, parts)]
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, marks, 20 * parts))).alias("_cuts"))


def _with_cuts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`df` with its key's `_cuts`, joined by key and a salt, so that a key with many rows is not one task."""
    cuts = value_cuts(df, keys, value).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(cuts, [*keys, "_salt"]).drop("_salt")


def value_bucket(x: Column, cuts: Column) -> Column:
    """A number that rises with `x`: twice the cuts below it, and one more where it is a cut itself.

    So ranges follow the data, and a value that holds many rows has a bucket of its own. 0 for NULL.
    """
    size = F.size(cuts)
    rise = lambda at, step: F.when((at + step <= size) & (F.try_element_at(cuts, at + step) < x), at + step).otherwise(at)
    below = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(PARTS.bit_length())))), F.lit(0), rise)
    return 2 * below + F.coalesce((F.try_element_at(cuts, below + 1) == x).cast("int"), F.lit(0))


def _totals(df: DataFrame, keys: Sequence[str], bucket: Column, aggs: dict[str, Column]) -> DataFrame:
    """Sums before each bucket of a key. The table has one row per key and bucket."""
    each = df.groupBy(*keys, bucket.alias("_bucket")).agg(*(a.alias(n) for n, a in aggs.items()))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in aggs]
    return each.select(*keys, "_bucket", *sums)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", span: int = SPAN) -> DataFrame:
    """Position from 0 of each row within its key, ordered by `order`; the first is a time."""
    ts = order[0]
    totals = _totals(df, keys, _bucket(ts, span), {"n": F.count(F.lit(1))})
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = df.withColumn("_bucket", _bucket(ts, span)).join(totals, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_before_n") + F.row_number().over(own) - 1).drop("_bucket", "_before_n")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    ahead: int = 0,
    rows: int = ROWS,
    span: int = SPAN,
) -> DataFrame:
    """Add window columns that look at most `back` rows back and `ahead` rows forward.

    `columns` gets a window ordered by position within a chunk of a key; `pos` is added too. Each
    chunk carries a halo of rows of its neighbours, dropped at the end.
    """
    placed = ordinal(df, keys, order, "pos", span)
    chunk = F.floor(F.col("pos") / rows)
    lo, hi = F.floor((F.col("pos") - ahead) / rows), F.floor((F.col("pos") + back) / rows)
    spread = placed.withColumn("_chunk", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
    w = Window.partitionBy(*keys, "_chunk").orderBy("pos")
    return spread.withColumns(columns(w)).where(F.col("_chunk") == chunk).drop("_chunk")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], span: int = SPAN, by_value: bool = False
) -> DataFrame:
    """Running sums (new name -> column) up to and with each row, in two passes without a global sort.

    Rows are cut into buckets of `span` by the first column of `order`, or at approximate quantiles
    of each key where it is no time (`by_value`).
    """
    ts = order[0]
    if by_value:
        cut = _with_cuts(df, keys, ts)
        df = cut.withColumn("_bucket", value_bucket(F.col(ts), F.col("_cuts"))).drop("_cuts").repartition(*keys, "_bucket")
        bucket = F.col("_bucket")
    else:
        bucket = _bucket(ts, span)
    totals = _totals(df, keys, bucket, {n: F.sum(c) for n, c in sums.items()})
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_bucket", bucket).join(totals, [*keys, "_bucket"])
    out = out.withColumns({n: F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    return out.drop("_bucket", *(f"_before_{n}" for n in sums))


def value_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", span: int = SPAN) -> DataFrame:
    """Position from 0 of each row within its key, ordered by `order`: a number, then a time, then others.

    Ranges follow the data; rows of a value that is a cut, so of every value held by many rows, are cut by time again.
    """
    value, ts = order[:2]
    cut = _with_cuts(df, keys, value)
    number = value_bucket(F.col(value), F.col("_cuts"))
    bucket = F.struct(number.alias("value"), F.when(number % 2 == 1, F.floor(F.col(ts) / span)).otherwise(0).alias("time"))
    dealt = cut.withColumn("_bucket", bucket).drop("_cuts").repartition(*keys, "_bucket")
    totals = _totals(dealt, keys, F.col("_bucket"), {"n": F.count(F.lit(1))})
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = dealt.join(totals, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_before_n") + F.row_number().over(own) - 1).drop("_bucket", "_before_n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key (name -> share), linear between neighbours; NULLs take no part.

    Rows are counted per distinct value and their running counts give the rows of a rank, so no group is
    sorted or held in one task.
    """
    keys = list(keys)
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    size = each.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    run = running_sums(each, keys, ["_v"], {"_upto": "_c"}, by_value=True).join(size, keys)
    out = {}
    for name, share in at.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(place)
        part = place - low
        held = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
        share_low, share_high = F.when(held(low), 1 - part).otherwise(0.0), F.when(held(low + 1), part).otherwise(0.0)
        out[name] = F.sum(F.col("_v") * (share_low + share_high))
    return run.groupBy(*keys).agg(*(v.alias(n) for n, v in out.items()))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance: int | None = None,
    prefix: str = "r_",
    span: int = SPAN,
) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Right columns get `prefix`; `{prefix}{right_ts}` is the source time, and all are NULL where nothing
    matches within `tolerance`. Rows are dealt by key and time bucket; a bucket that starts without
    a right row takes the last one of the buckets before it from a table of one row per bucket.
    """
    values = [c for c in right.columns if c not in keys]
    pack = F.struct(*values)
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), pack.alias("_right"))
    own = [c for c in left.columns if c not in keys]
    lt = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    both = lt.unionByName(r, allowMissingColumns=True).withColumn("_bucket", _bucket("_ts", span))
    last = Window.partitionBy(*keys, "_bucket").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_match", F.last("_right", True).over(last)).where("_side = 1")
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_end", True).over(before).alias("_carried"))
    match = F.coalesce("_match", "_carried")
    out = here.join(carried, [*keys, "_bucket"], "left").withColumn("_m", match)
    near = F.lit(True) if tolerance is None else F.col("_ts") - F.col(f"_m.{right_ts}") <= tolerance
    return out.select(
        *keys, *(F.col(f"_left.{c}").alias(c) for c in own), *(F.when(near, F.col(f"_m.{c}")).alias(prefix + c) for c in values)
    )


def islands(df: DataFrame, keys: Sequence[str], order: str, state: str, span: int = SPAN) -> DataFrame:
    """Add `island` (runs of equal `state`, from 0), `age_rows` and `age` (time since the run began).

    Changes are marked against the row before, islands are a running sum of the marks, and a row's
    run began at the last mark at or before it: an as-of lookup. Times are distinct within a key.
    """

    def marks(w: WindowSpec) -> dict[str, Column]:
        return {"_changed": F.when(F.col("pos") == 0, 0).otherwise((~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int"))}

    marked = running_sums(rolling(df, keys, [order], 1, marks, span=span), keys, [order], {"island": "_changed"}, span)
    starts = marked.where("_changed = 1 or pos = 0").select(*keys, F.col(order).alias("at"), F.col("pos").alias("start"))
    out = asof_join(marked, starts, keys, order, "at", prefix="_run_", span=span)
    out = out.withColumns({"age_rows": F.col("pos") - F.col("_run_start"), "age": F.col(order) - F.col("_run_at")})
    return out.drop("_changed", "pos", "_run_at", "_run_start")
