"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size byte blocks. The distinct blocks of the corpus are sorted and
numbered; the numbers of adjacent blocks form pairs, the distinct pairs are sorted and
numbered again, and so on until one number per document is left. Two documents of the same
byte length carry the same number exactly if their texts are identical: no step trusts a
hash, so no collision can merge two texts.

Only the base level handles text. It orders blocks by (64-bit fingerprint, bytes): the
fingerprint routes, the bytes decide. Each block's text crosses the network once, to count
the distinct blocks behind each fingerprint. Fingerprints with a single block behind them
(all of them, in practice) are named directly, and occurrences find their name through the
fingerprint alone; for the others the names belong to (fingerprint, bytes) and occurrences
carry the bytes into the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.tables import materialise

BLOCK_BYTES = 4096


def _fingerprint(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def _blocks(body: Column, size: int) -> Column:
    """Array of the fixed-size blocks; an empty text has one empty block."""
    last = F.greatest(F.floor((F.octet_length(body) - 1) / size), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(body, i * size + 1, F.lit(size))
    )


def _numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Give the rows of `distinct` integer names in the order of `keys`.

    Range partitioning puts the keys in order over the partitions, and the row number within
    a partition follows the partition number, so names ascend with the keys and no single
    task sees them all.
    """
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def block_names(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint_bits: int = 64,
) -> DataFrame:
    """One row per input row: rid, doc_id, n_bytes, text_sha256, name.

    Equal (n_bytes, name) means equal texts and nothing else does. `rid` numbers the rows, so
    repeated rows and repeated or null ids are told apart. Null texts count as empty.
    `fingerprint_bits` below 64 provokes collisions and is there for tests.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    body = F.col("text").cast("binary")
    parts = source.select(F.explode(_blocks(body, block_bytes)).alias("block"))
    parts = parts.select(_fingerprint(F.col("block"), fingerprint_bits).alias("h"), "block")
    behind = materialise(
        parts.distinct().select("h").groupBy("h").agg(F.count("*").alias("n_blocks_behind")),
        "block-fingerprints",
    )
    shared = behind.where("n_blocks_behind > 1").select("h")
    plain = _numbered(behind.where("n_blocks_behind = 1").select("h"), ["h"], "names")

    rows = source.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("text_sha256"),
        _blocks(body, block_bytes).alias("blocks"),
    )
    prints = F.transform("blocks", lambda b: _fingerprint(b, fingerprint_bits))
    if not shared.take(1):
        rows = materialise(rows.select(*rows.columns[:-1], prints.alias("hs")), "rows")
        # a text of one block has its name at once, the others of each of their blocks
        alone = rows.where("size(hs) = 1").select("rid", F.get("hs", F.lit(0)).alias("h")).join(plain, "h")
        done = [alone.select("rid", "name")]
        at = rows.where("size(hs) > 1").select("rid", F.size("hs").alias("width"), F.posexplode("hs").alias("pos", "h"))
        named = at.join(plain, "h").select("rid", "width", "pos", "name")
    else:
        rows = materialise(rows, "rows")
        at = rows.select("rid", F.size("blocks").alias("width"), F.posexplode("blocks").alias("pos", "block"))
        at = at.select("rid", "width", "pos", _fingerprint(F.col("block"), fingerprint_bits).alias("h"), "block")
        both = _numbered(
            at.join(shared, "h", "left_semi").select("h", "block").distinct(), ["h", "block"], "names-shared"
        )
        named = at.join(plain, "h").select("rid", "width", "pos", "name").unionByName(
            # odd and even numbers keep the two name ranges apart
            at.join(both, ["h", "block"]).select("rid", "width", "pos", (-F.col("name") - 1).alias("name"))
        )
        named = materialise(named, "level")
        done = [named.where("width = 1").select("rid", "name")]
        named = named.where("width > 1")

    longest = rows.agg(F.max("n_bytes")).first()[0] or 0
    width = max(1, -(-longest // block_bytes))
    if width > 1:
        named = materialise(named, "level")
    while width > 1:
        pairs = named.groupBy("rid", ((F.col("width") + 1) / 2).cast("int").alias("width"), F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
        )
        # a tail without a partner pairs with its own marker
        pairs = materialise(
            pairs.select("rid", "width", "pos", "a", F.col("b").isNull().alias("tail"), F.coalesce("b", F.lit(0)).alias("b")),
            "pairs",
        )
        keys = ["a", "b", "tail"]
        named = pairs.join(_numbered(pairs.select(*keys).distinct(), keys, "names"), keys)
        named = materialise(named.select("rid", "width", "pos", "name"), "level")
        # what has one name left is named; texts of equal length are done in the same round
        done.append(named.where("width = 1").select("rid", "name"))
        named = named.where("width > 1")
        width = (width + 1) // 2
    names = done[0]
    for part in done[1:]:
        names = names.unionByName(part)
    return rows.select("rid", "doc_id", "n_bytes", "text_sha256").join(names, "rid")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint_bits: int = 64,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, group_name for every row of `docs`.

    Of equal texts the row with the largest id stays (a null id counts as smaller than any
    other). Of repeated rows with that id one stays. Null text equals empty text. An empty
    table gives an empty result; columns other than id and text are not read, whatever their
    names.
    """
    named = materialise(block_names(docs, id_col, text_col, block_bytes, fingerprint_bits), "identities")
    keys = ["n_bytes", "name"]
    groups = materialise(
        named.groupBy(*keys).agg(
            F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    return named.join(groups, keys).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without all but one row of each group of equal texts, all columns kept.

    Rows are numbered in a written copy and the decision is joined back by that number, so ids may
    be repeated or null. The column name `__row` is taken by the operator.
    """
    row = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"))
    numbered = materialise(docs.withColumn("__row", row), "numbered")
    lost = exact_dedup(numbered, "__row", text_col).where("not kept").select(F.col("doc_id.n").alias("__n"))
    kept = numbered.join(lost, F.col("__row.n") == F.col("__n"), "left_anti")
    return kept.select(*docs.columns)
