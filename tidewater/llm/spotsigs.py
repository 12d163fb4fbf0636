"""Document fingerprints from spot signatures: chains of content words that follow common words.

A text is read as lower-case words (letters and digits). Where a common word stands right before a
content word, that common word and the next CHAIN content words, common words between them skipped, are
a signature. Running prose has such spots every few words, while menus, tables and other repeated
furniture have few, so the set of signatures follows the prose. A text without any spot has one
signature of all its words, and a text without words one of itself.

Everything is DataFrame functions: two replacements, one extraction with look-ahead, hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 3
DIGITS = 16
NEAR = 0.8
BUCKET_ROWS = 64  # neighbouring ids of a bucket, of so many buckets at most
MOST_BUCKETS = 8192

#: Common words of English, French, German and Spanish prose.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is",
    "it", "not", "of", "on", "or", "she", "that", "the", "their", "there", "they", "this", "to", "was", "were", "which", "with", "you",
    "au", "aux", "avec", "ce", "ces", "dans", "du", "elle", "est", "et", "il", "ils", "je", "la", "le", "les", "mais", "ne", "nous", "ou",
    "par", "pas", "pour", "que", "qui", "se", "son", "sont", "sur", "une", "vous",
    "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "er", "es", "für", "ich", "im",
    "ist", "mit", "nicht", "sich", "sie", "sind", "und", "von", "war", "wie", "wir", "zu", "zum", "zur",
    "al", "como", "con", "del", "el", "ella", "ellos", "entre", "era", "esta", "este", "fue", "los", "las", "más", "muy", "para", "pero",
    "por", "sin", "sobre", "su", "sus", "también", "un", "una", "unos", "y",
)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of these words that reads shared beginnings once."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    each = "|".join(re.escape(c) + _any_of(r) for c, r in rest.items())
    return f"(?:{each})" + ("?" if "" in words else "") if each else ""


def signatures(text: Column, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The distinct signatures of a text, ascending, one at least: 16 hexadecimal digits of their MD5.

    A null text reads as empty.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), rf" (?={_any_of(anchors)} )", " ~")
    content = r" [^~ ][^ ]*+"
    spot = rf"~(?=([^ ]++{content}(?:(?: ~[^ ]++)*+{content}){{{chain - 1}}}))"
    found = F.regexp_extract_all(marked, F.lit(spot), F.lit(1))
    digest = lambda s: F.left(F.md5(s), F.lit(DIGITS))
    hashed = F.array_sort(F.array_distinct(F.transform(found, lambda s: digest(F.regexp_replace(s, " ~[^ ]+", "")))))
    whole = F.array(digest(F.when(words != "", words).otherwise(text)))
    return F.get(F.filter(F.array(hashed, whole), lambda s: F.size(s) > 0), F.lit(0))  # names `hashed` once, so that it is computed once


def spelled(signatures: Column) -> Column:
    """A fingerprint: the signatures one after the other."""
    return F.array_join(signatures, "")


def partition_of(size: Column, threshold: float = NEAR) -> Column:
    """Number of the length partition of a set: sets more than one partition apart cannot reach `threshold`."""
    return F.floor(F.log(size.cast("double")) / math.log(1 / threshold)).cast("int")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where the sizes alone keep it below `at_least`."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    exact = both / (na + nb - both)
    if at_least <= 0:
        return exact
    apart = (F.abs(partition_of(na, at_least) - partition_of(nb, at_least)) > 1) | (F.least(na, nb) < at_least * F.greatest(na, nb))
    return F.when(apart, 0.0).otherwise(exact)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below `key`, by bisection; 0 for a null key."""
    if not bounds:
        return F.lit(0)
    ladder = F.array(*(F.lit(b) for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    rise = lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(ladder, at + step) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), rise)


def with_next(docs: DataFrame, order: str, carried: list[str], made: dict[str, Column], bounds: int | None = None) -> DataFrame:
    """Add `next`, a struct of the `carried` columns of the row after, in descending `order`; the last row
    has the first row's. Rows without a value come last, equal ones are ordered by `tie`.

    Rows are cut into `bounds` buckets (by their number, if not given) at approximate quantiles of `order`; each bucket's first row
    is copied behind the last row of the bucket before. Only the bounds and a row a bucket leave the tasks.
    Columns in `made` are added once rows are dealt, so they are not shuffled.
    """
    bounds = bounds or min(max(docs.count() // BUCKET_ROWS, 1), MOST_BUCKETS)
    spread = docs.select(F.percentile_approx(order, [(i + 1) / bounds for i in range(bounds - 1)], 10 * bounds)).first()[0]
    dealt = docs.withColumn("_bucket", _bucket(F.col(order), sorted(set(spread or []))))
    heads = dealt.groupBy("_bucket").agg(F.max(F.struct(order, "tie")).alias("_head"))
    down = Window.orderBy(F.desc("_bucket"))  # one row a bucket
    before = F.coalesce(F.lag("_bucket").over(down), F.min("_bucket").over(down.rowsBetween(0, Window.unboundedFollowing)))
    marked = dealt.join(F.broadcast(heads.withColumn("_before", before)), "_bucket")
    here = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("copy"))
    there = F.struct(F.col("_before").alias("at"), F.lit(True).alias("copy"))
    places = F.when(F.struct(order, "tie").eqNullSafe(F.col("_head")), F.array(here, there)).otherwise(F.array(here))
    placed = marked.withColumn("_place", F.explode(places)).drop("_bucket", "_head", "_before").select("*", "_place.*").drop("_place")
    w = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last(order), F.desc("tie"))
    out = placed.repartition("at").withColumns(made).withColumn("next", F.lead(F.struct(*carried)).over(w))
    return out.where("not copy").drop("at", "copy")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, bounds: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit: its last half replaced by the start of the next document.

    The last floor(n_chars / 2) code points give way to the first as many, or all, of the document with the
    next smaller id (after the last one: the first). Null texts are empty, rows without an id come last,
    rows of one id follow each other in the order of a hash of their text, and repeated rows are documents of
    their own. A single document is its own next one; an empty table gives no rows; other columns are not read.
    Rows of one id lie in one bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.withColumns({"tie": F.xxhash64("text"), "n_chars": F.length("text").cast("long")})
    paired = with_next(own, "doc_id", ["text", "signatures"], {"signatures": signatures(F.col("text"), chain)}, bounds)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edit = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next.text", half))
    edited = paired.select("doc_id", "n_chars", "signatures", F.col("next.signatures").alias("next"), edit.alias("edited"))
    both = edited.withColumn("edited_signatures", signatures(F.col("edited"), chain))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("signatures")).alias("fingerprint"),
        spelled(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next")).alias("near_next"),
        F.size("signatures").alias("n_signatures"),
        partition_of(F.size("signatures")).alias("length_partition"),
    )
