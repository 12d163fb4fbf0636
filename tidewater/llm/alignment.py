"""Alignment of two tokenizations of the same bytes, and corpus-wide counts of aligned id pairs.

Both tokenizers cut the bytes of space + text. Where tokens of both end at the same byte, the text is
cut into groups: the shorter list of token ends drives a galloping search (doubling steps, then
bisection) into the longer one, the indices of the common ends slice both lists into groups, and
differences of these ranks are the ranges of tokens that overlap.

Corpus counts need every id pair of every document once. A task takes documents in batches of bounded
text, numbers the distinct pairs of a batch, and writes one row a batch: the pairs, how many of the
batch's documents hold each, and every document's links as numbers of pairs. So what Spark sums, joins
and sends back is a pair a batch instead of a pair a document, a frequent pair weighs no more than any
other, and texts are read and cut only once.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.tables import materialise

BATCH_BYTES = 1 << 23  # text of a batch of documents
ENCODE_BYTES = 1 << 20  # text given to the tokenizers at once
BLOCK = 256  # token ends that drive the search at once
FLAT_LINKS = 4096  # groups of more links are counted through their distinct ids

_DOC = {"n_a": np.int64, "n_b": np.int64, "n_groups": np.int64, "n_links": np.int64}
GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
BATCHES = (
    "batch string, pairs array<long>, docs array<int>, doc_ids array<long>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, shas array<string>, held array<int>, links binary"
)
DIGEST = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: visible bytes are their own
    symbols, all others follow from code point 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side(NamedTuple):
    """One tokenizer: texts -> ids, and each id's bytes."""

    encode: object
    token_bytes: list[bytes]
    lengths: np.ndarray


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str | None = None) -> Side:
    """A byte-level BPE, reading space + text; strings of special tokens are plain text.

    From a tokenizer file, or with the `pattern` of its words from the ranks of the same vocabulary, which give the same
    ids at a fifth of the cost.
    """
    if pattern is not None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        return Side(lambda texts: [coder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], table, np.array([len(t) for t in table], np.int64))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    of, ids = byte_of_symbol(), coder.get_vocab(with_added_tokens=True)
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        got = coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [g.ids for g in got]

    return Side(encode, table, np.array([len(t) for t in table], np.int64))


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A piece model, which puts the space before the text itself; <0xHH> stands for a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [
        bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names
    ]
    return Side(lambda t: model.encode(t, num_threads=1), table, np.array([len(t) for t in table], np.int64))


def gallop(short: np.ndarray, long: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values that two ascending lists share, in either list.

    The shorter list drives in blocks: doubling steps from the last hit and a bisection find where a block's last value
    lies in the longer list, and every value of the block is bisected within that range.
    """
    found, places, at, n = [], [], 0, len(long)
    for i in range(0, len(short), block):
        if at == n:
            break
        part = short[i : i + block]
        low, reach, step = at, at + len(part), len(part)
        while reach < n and long[reach] < part[-1]:
            low = reach + 1
            reach += step
            step += step
        end = low + int(np.searchsorted(long[low : min(reach, n)], part[-1]))
        place = at + np.searchsorted(long[at : end + 1], part)
        hit = np.flatnonzero(long[np.minimum(place, n - 1)] == part)
        found.append(i + hit)
        places.append(place[hit])
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *places])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of either side that end where one of the other side ends."""
    if len(b) < len(a):
        j, i = gallop(b, a)
        return i, j
    return gallop(a, b)


def aligned(a: Side, b: Side, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
    """(ids, ids, last tokens of groups, last tokens of groups) of each text.

    None for an empty text and for one whose tokens do not join to the bytes of space + text.
    """
    for text, ids_a, ids_b in zip(texts, a.encode(texts), b.encode(texts), strict=True):
        whole = (" " + text).encode() if text else b""
        na, nb = np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(a.lengths[na]), np.cumsum(b.lengths[nb])
        # a byte-level vocabulary gives every byte back, so its length tells
        if not text or ends_a[-1] != len(whole) or not len(nb) or ends_b[-1] != len(whole) or b"".join(map(b.token_bytes.__getitem__, ids_b)) != whole:
            yield None
        else:
            yield na, nb, *common_ends(ends_a, ends_b)


def group_links(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs (a << 32 | b) of a text, ascending, and how often each is linked."""
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    n = na * nb
    first_a, first_b = last_a - na + 1, last_b - nb + 1
    flat = n <= FLAT_LINKS
    size = n[flat]
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    width = np.repeat(nb[flat], size)
    ia, ib = np.repeat(first_a[flat], size) + nth // width, np.repeat(first_b[flat], size) + nth % width
    pairs, times = np.unique(a[ia] << 32 | b[ib], return_counts=True)
    for g in np.flatnonzero(~flat):
        ua, ca = np.unique(a[first_a[g] : last_a[g] + 1], return_counts=True)
        ub, cb = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
        more = np.concatenate([pairs, (ua[:, None] << 32 | ub).ravel()])
        counts = np.concatenate([times, np.outer(ca, cb).ravel()])
        pairs, at = np.unique(more, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, at, counts)
    return pairs, times


class _Speller:
    """Groups as `a1,a2|b1;a3|b2,b3`: each token's number with the mark that follows it, out of one table of bytes."""

    def __init__(self, n_a: int, n_b: int):
        words = [f"{i}{mark}".encode() for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
        width = max(map(len, words))
        self.table = np.frombuffer(b"".join(w.ljust(width, b" ") for w in words), np.uint8).reshape(-1, width)
        self.n_a, self.n_b = n_a, n_b

    def spell(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        word_a, word_b = a.copy(), b + 2 * self.n_a
        word_a[last_a] += self.n_a
        word_b[last_b] += self.n_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = word_a
        out[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = word_b
        spelled = self.table[out]
        return spelled[spelled != 32].tobytes()[:-1]


@lru_cache(maxsize=2)
def _speller(n_a: int, n_b: int) -> _Speller:
    return _Speller(n_a, n_b)


def _documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in lists of about `most` bytes."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= most:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def align(docs: DataFrame, byte_level_file: str, piece_model: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids by both tokenizers, and how many tokens of either lie before each group's end.

    Null and empty texts, and texts that a tokenizer does not give back, have empty lists. Every row is a
    document of its own, whatever its id; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(byte_level_file, pattern), pieces(piece_model)
        for ids, texts in _documents(batches, ENCODE_BYTES):
            none = (np.zeros(0, np.int64),) * 4
            found = [g or none for g in aligned(a, b, texts)]
            lists = [[(g[k] + (k > 1)).tolist() for g in found] for k in range(4)]
            kind = pa.list_(pa.int32())
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, kind) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in GROUPS.split(", ")])

    return _input(docs, id_col, text_col).mapInArrow(run, GROUPS)


def link_batches(
    docs: DataFrame,
    byte_level_file: str,
    piece_model: str,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row for each batch of documents, see above; `links` packs the numbers and times of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = byte_level(byte_level_file, pattern), pieces(piece_model)
        speller = _speller(len(a.token_bytes), len(b.token_bytes))
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        rows: list[tuple] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            pairs, at, docs = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True, return_counts=True)
            held = np.array([len(p) for p, _ in links])
            times = np.concatenate([t for _, t in links])
            packed = zstandard.compress(np.concatenate([at.astype("<i8"), times.astype("<i8")]).tobytes(), 3)
            lists = [pairs, docs, ids, *map(list, zip(*rows, strict=True)), held]
            columns = [f"{part}-{number}", *lists, packed]
            schema = _arrow(BATCHES)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for got, texts in _documents(batches, ENCODE_BYTES):
            for doc_id, text, g in zip(got, texts, aligned(a, b, texts), strict=True):
                ids.append(doc_id)
                size += len(text) + 64
                if g is None:
                    rows.append((0, 0, 0, 0, ""))
                    links.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                else:
                    found = group_links(*g)
                    digest = hashlib.sha256(speller.spell(*g)).hexdigest()
                    rows.append((len(g[0]), len(g[1]), len(g[2]), int(found[1].sum()), digest))
                    links.append(found)
                if size >= batch_bytes:
                    yield closed()
                    ids, rows, links, size, number = [], [], [], 0, number + 1
        if ids:
            yield closed()

    return _input(docs, id_col, text_col).mapInArrow(run, BATCHES)


def _arrow(schema: str) -> pa.Schema:
    """The Arrow form of the few types used here."""
    of = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = []
    for column in schema.split(", "):
        name, kind = column.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(of[inner]) if kind != inner else of[inner]))
    return pa.schema(fields)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether no pair of its first id has more."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
    counted = each.agg(F.sum("x.docs").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most a row for each id of the other side
    return counted.withColumn("best", F.col("n") == top)


def alignment_digests(
    docs: DataFrame,
    byte_level_file: str,
    piece_model: str,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Per document its numbers of tokens, groups and links, of links whose pair is its first id's most
    frequent (ties included), the sum of the counts over its links, and the digest of its groups.

    A pair's count is the number of rows of `docs` that hold it linked; repeated rows count as often as they
    stand, a null id stays null. Documents without tokens (see `align`) have zeros and an empty digest.
    An empty table gives no rows. A task holds one batch of documents: about `batch_bytes` of text or a
    single longer document.
    """
    batches = materialise(link_batches(docs, byte_level_file, piece_model, pattern, id_col, text_col, batch_bytes), "links")
    wanted = batches.select("batch", F.posexplode("pairs").alias("number", "pair"))
    found = wanted.join(pair_counts(batches), "pair").select("batch", "number", "n", "best")
    rows = batches.drop("pairs", "docs").withColumnRenamed("batch", "own")
    schema = _arrow(DIGEST)

    def run(own: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        number = counts.column("number").to_numpy()
        n, best = np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        n[number], best[number] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        for row in own.to_pylist():
            packed = np.frombuffer(zstandard.decompress(row["links"]), "<i8")
            at, times = packed[: len(packed) // 2], packed[len(packed) // 2 :]
            ends = np.concatenate([[0], np.cumsum(row["held"])])
            n_best = np.diff(np.concatenate([[0], np.cumsum(times * best[at])])[ends])
            total = np.diff(np.concatenate([[0], np.cumsum(times * n[at])])[ends])
            lists = [row["doc_ids"], *(row[c] for c in _DOC), n_best, total, row["shas"]]
            out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(lists, schema.types, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return rows.groupBy("own").cogroup(found.groupBy("batch")).applyInArrow(run, DIGEST)
