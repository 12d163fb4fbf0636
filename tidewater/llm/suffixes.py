"""Repeated passages through sparse suffix arrays.

A passage repeats if `words` (50) consecutive words of one document stand in another document too;
A-Z read as a-z, words are runs of characters other than ASCII white space. Of all suffixes only
those at content-selected minimiser positions are kept: of every `head` (27) consecutive words the
place of the smallest hash of SHINGLE (5) words, the leftmost of equal ones. Equal windows of
`words` words select the same place from their first `head` words, so each window belongs to exactly
one kept suffix, at the same distance in every document; and the first `head` words of that suffix
lie in the window.

* The kept suffixes are sorted over the cluster by their first `head` words (as a 64-bit print) and by
  the extension below; neighbours are compared, and a suffix whose neighbours both begin
  otherwise is dropped. The document is the last sort key, so a passage that a third of all
  documents hold is cut over many partitions.
* A match is extended left and right as far as the windows of its suffix reach: from the first word
  of the first window to the last word of the last one. If all suffixes of one head are extended by
  the same words, all their windows repeat.
* Otherwise the windows are told apart one by one, once for each different extension and not for
  each document: a window repeats if two documents have it, in whatever extensions.

Prints of heads and extensions have 64 bits each, of windows 96, and every match needs a head and an
extension or window to agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shingles import mix, word_hashes
from tidewater.llm.tables import materialise

WORDS, SHINGLE = 50, 5
_RADIX, _OTHER_RADIX = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SUFFIX = "head long, ext long, who long, doc_id {id}, at int, n int"


class _Prefix:
    """Hashes of any run of words, by polynomial prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray, radix: int = _RADIX):
        n = len(words) + 1
        up, down = np.full(n, radix, np.uint64), np.full(n, pow(radix, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        self.down = np.cumprod(down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int, salt: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start], salt)


def kept_suffixes(words: np.ndarray, window: int = WORDS) -> tuple[_Prefix, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Prefix hashes and, of each kept suffix, its head, extension, place, first window and number of windows."""
    last = len(words) - window  # start of the last window
    if last < 0:
        return None
    # a place is at most head - SHINGLE words after the start of its window
    run, head = _Prefix(words), (window + SHINGLE) // 2
    grams = run(np.arange(last + head - SHINGLE + 1), SHINGLE, SHINGLE)
    near = np.lib.stride_tricks.sliding_window_view(grams, head - SHINGLE + 1)
    place = np.arange(last + 1) + near.argmin(1)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    n = np.diff(first, append=last + 1)
    place = place[first]
    # the extension also tells where in it the suffix begins
    ext = mix(run(first, n + window - 1, 9) + ((place - first) * window + n).astype(np.uint64), 10)
    return run, run(place, head, 8), ext, place, first, n


def _suffixes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source = []
            for i, text in enumerate(batch.column(2)):
                found = kept_suffixes(word_hashes(text.as_py() or ""), window)
                if found:
                    rows.append(found[1:])
                    source.append(np.full(len(found[1]), i))
            if not rows:
                continue
            head, ext, _, first, n = (np.concatenate(c) for c in zip(*rows, strict=True))
            back = pa.array(np.concatenate(source))
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.view(np.int64)), pa.array(ext.view(np.int64)), batch.column(1).take(back), batch.column(0).take(back), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["head", "ext", "who", "doc_id", "at", "n"],
            )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that share their head with a neighbour, and the first and last of each partition."""
    held, same_before = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        head = batch.column(0).to_numpy()
        equal = head[1:] == head[:-1]
        keep = np.zeros(len(head), bool)
        keep[1:], keep[0] = equal, same_before
        keep[:-1] |= equal
        held, same_before = batch.slice(len(head) - 1), bool(keep[-1])
        yield batch.slice(0, len(head) - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held


def _who(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Number of a document: its integer id, a hash of any other id, of the text where the id is null."""
    kind = dict(docs.dtypes)[id_col]
    number = F.col(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(id_col)
    return F.coalesce(number, F.xxhash64(text_col))


def _windows(window: int):
    """From texts with their wanted extensions the windows of each: w, v, head, ext, bit, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                found = kept_suffixes(hashes := word_hashes(text.as_py() or ""), window)
                if not found:
                    continue
                prefix, head, ext, _, first, n = found
                prints = (prefix, _Prefix(hashes, _OTHER_RADIX))
                asked = {(x["head"], x["ext"]): (x["lo"], x["hi"]) for x in wanted.as_py()}
                head, ext = head.view(np.int64), ext.view(np.int64)
                for i in range(len(head)):
                    about = asked.pop((int(head[i]), int(ext[i])), None)
                    if about:
                        bit = np.arange(n[i], dtype=np.int32)
                        w, v = (p(first[i] + bit, window, 50).view(np.int64) for p in prints)
                        out.append((w, (v >> np.int64(32)).astype(np.int32), bit, *(np.full(n[i], x, np.int64) for x in (head[i], ext[i], *about))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["w", "v", "bit", "head", "ext", "lo", "hi"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching runs of words of one document as spans."""
    for batch in batches:
        back, start, size = [], [], []
        for i, runs in enumerate(batch.column(2)):
            part = runs.values
            a, b = (part.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            cut = np.concatenate([[0], np.flatnonzero(a[1:] > b[:-1]) + 1])
            end = np.concatenate([b[cut[1:] - 1], b[-1:]])
            back += [i] * len(cut)
            start += a[cut].tolist()
            size += (end - a[cut]).tolist()
        take = pa.array(back, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "later", "start_word", "n_words"]
        )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, later, start_word, n_words: the spans of each document that also stand in another one.

    `later` spans are made of windows that a document with a smaller id holds too, the others of
    windows whose first holder is this document; spans of both kinds may overlap. Windows that
    overlap or touch are one span. Rows of one id count as one document, and so do rows without an
    id that have equal texts; ids that are no integers are ordered by their hash. Null and empty
    texts and texts of fewer than `words` words have no spans, nor has an empty table. Other
    columns are not read. `words` is at least SHINGLE.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), _who(docs, id_col, text_col).alias("who"), F.col(text_col).alias("text"))
    suffix = materialise(source.mapInArrow(_suffixes(words), SUFFIX.format(id=kind)), "suffixes")
    order = ["head", "ext", "who", "at"]
    near = suffix.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, suffix.schema)
    near = materialise(near, "neighbours")

    keys = ["head", "ext"]
    extensions = near.groupBy(*keys).agg(F.min("who").alias("lo"), F.max("who").alias("hi"), F.max("n").alias("n"))
    extensions = materialise(extensions, "extensions")
    heads = extensions.groupBy("head").agg(F.min("lo").alias("h_lo"), F.max("hi").alias("h_hi"), F.count("*").alias("kinds"))
    heads = materialise(heads.where("h_lo != h_hi").select("head", "kinds"), "heads")
    shared = materialise(extensions.join(heads, "head"), "shared")

    asked = shared.where("kinds > 1").select(F.col("lo").alias("who"), F.struct(*keys, "lo", "hi").alias("x"))
    asked = asked.groupBy("who").agg(F.collect_list("x").alias("wanted"))  # a document's own suffixes
    window = source.join(asked, "who").select("text", "wanted")
    window = window.mapInArrow(_windows(words), "w long, v int, bit int, head long, ext long, lo long, hi long")
    window = materialise(window.dropDuplicates([*keys, "bit"]), "windows")
    repeated = window.groupBy("w", "v").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first != last")
    bits = window.select("w", "v", *keys, "bit").join(repeated.select("w", "v", "first"), ["w", "v"])
    bits = bits.groupBy(*keys).agg(F.collect_list(F.struct("bit", "first")).alias("bits"))  # at most words / 2 windows each
    plain = shared.where("kinds = 1").select(*keys, F.lit(None).cast("array<struct<bit:int,first:bigint>>").alias("bits"), "lo")
    found = plain.unionByName(bits.select(*keys, "bits", F.lit(None).cast("long").alias("lo")))

    held = near.select(*keys, "who", "doc_id", "at", "n").join(materialise(found, "repeats"), keys)
    all_of_it = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + words).alias("end"), (F.col("who") > F.col("lo")).alias("later")))
    some = F.transform("bits", lambda b: F.struct((F.col("at") + b["bit"]).alias("start"), (F.col("at") + b["bit"] + words).alias("end"), (F.col("who") > b["first"]).alias("later")))
    runs = held.select("who", "doc_id", F.inline(F.coalesce(some, all_of_it))).distinct()
    each = runs.groupBy("who", "doc_id", "later").agg(F.collect_list(F.struct("start", "end")).alias("runs"))  # of one document
    return each.select("doc_id", "later", "runs").mapInArrow(_spans, f"doc_id {kind}, later boolean, start_word long, n_words long")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """`docs` with every passage but its first copy cut out of the text, white space around cuts kept.

    Each row is a document of its own: rows are numbered in the order of their ids, null ids last, and a passage stays in
    the row of the smallest number, so rows of one id or without one lose only what an earlier row holds. Rows without such
    passages stay as they are. The column names `__row` and `__cut` are taken by the operator.
    """
    order = F.asc_nulls_last(id_col)
    numbered = docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    numbered = materialise(numbered, "numbered")
    spans = repeated_passages(numbered.select("__row", text_col), "__row", text_col, words).where("later")
    cuts = spans.groupBy(F.col("doc_id").alias("__row")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cut"))
    joined = numbered.join(cuts, "__row", "left").select(*docs.columns, "__cut")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                if text and cut.is_valid:
                    ends = [m.span() for m in _WORD.finditer(text)]
                    out, last = [], 0
                    for s in sorted((c["start_word"], c["n_words"]) for c in cut.as_py()):
                        out.append(text[last : ends[s[0]][0]])
                        last = ends[s[0] + s[1] - 1][1]
                    text = "".join(out) + text[last:]
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
