"""Byte-level BPE as a monoid: encode halves, join them by re-encoding growing windows.

Two joins are needed, and both are exact.

*Segments.* A text is the concatenation of its pattern matches. The pattern reads left to right
and never looks behind, so from any position on the matches depend on the suffix alone: as soon
as a match of the joined text starts where a match of the right half starts, all later matches
are those of the right half. A match of the left half is final once two further matches follow it
inside the half: a match's end is decided by the white space run it stands in and at most two
characters more. The join re-reads from the third match before the seam and stops at the first
common start; the window grows match by match until then.

*Tokens of one match.* Tokens t1..tn are the BPE encoding of their bytes exactly if every
adjacent pair encodes to itself: merges within two different tokens do not interact before one
crosses their border, and the first merge to cross a border would cross it in the pair alone. The
join therefore re-encodes k tokens on either side of the seam and tests the two pairs at the
window's edges; if both encode to themselves nothing outside can change, else k doubles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF_CHARS = 512
LEAF_BYTES = 48
CACHE_MATCHES = 1 << 17
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Encoder and decoder over a rank table and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        self.bytes_of = {i: b for b, i in ranks.items()}
        # only the merge loop for one short leaf is taken from the library
        self.merge = tiktoken.Encoding(
            "leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )._encode_single_piece
        self.matches = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 8), max(leaf_bytes, 1)
        self.known = _Known(self.encode_match)

    # one match

    def encode_match(self, match: str) -> list[int]:
        return self.encode_bytes(match.encode("utf-8"))

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data) if data else []
        half = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        of, k = self.bytes_of, 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            inner = self.merge(b"".join(of[t] for t in chain(left[a:], right[:b])))
            if (not a or self.stands(left[a - 1], inner[0])) and (
                b == len(right) or self.stands(inner[-1], right[b])
            ):
                return left[:a] + inner + right[b:]
            k *= 2

    def stands(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    # a text

    def segments(self, text: str) -> list[str]:
        """The pattern's matches in `text`."""
        if len(text) <= self.leaf_chars:
            return self.matches.findall(text)
        half = len(text) // 2
        return self.join_segments(self.segments(text[:half]), self.segments(text[half:]))

    def join_segments(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        keep = max(0, len(left) - 3)
        seam = sum(map(len, left[keep:]))
        take = min(len(right), 4)
        while True:
            window = "".join(chain(left[keep:], right[:take]))
            starts, at = {}, seam
            for i in range(take):
                starts[at] = i
                at += len(right[i])
            found: list[str] = []
            # matches near the window's end may be cut short; only those with two more
            # matches of the right half behind them are final, unless the text ends there
            final = len(window) if take == len(right) else at - sum(map(len, right[take - 2 : take]))
            for m in self.matches.finditer(window):
                if m.start() >= seam and m.start() in starts and m.start() <= final:
                    return left[:keep] + found + right[starts[m.start()] :]
                if m.end() > final:
                    break
                found.append(m.group())
            if take == len(right):
                return left[:keep] + self.matches.findall(window)
            take = min(len(right), take * 2)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.segments(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Known(dict):
    """Encodings of matches met before; emptied when full, so that memory stays bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, match: str) -> list[int]:
        ids = self.encode(match)
        if len(match) <= 64:
            if len(self) >= CACHE_MATCHES:
                self.clear()
            self[match] = ids
        return ids


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_table(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ids array<int> of every row; null text counts as empty (no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of `encode_table`'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            body = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(body, pa.binary())], names=["doc_id", "body"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Null text counts as empty: 0 tokens and the digests of no bytes. Repeated rows give
    repeated results, an empty table an empty one; columns other than id and text are not read.
    Ids are of type long, others fail and have to be cast first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
