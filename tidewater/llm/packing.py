"""Cost-balanced packing of documents into fixed-length token sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n (feed-forward work plus
attention inside the document). Documents longer than a sequence are cut into full sequences;
what remains of them and all shorter documents are taken in descending length and each goes to
the cheapest open sequence with room. When no sequence has room for a whole piece, the piece is
cut to fill the sequence with most room and its rest is placed next.

A task packs the documents of its own partition in groups of bounded token count, so there is
no shuffle, no global sort and no state that grows with the corpus; each group leaves at most one
sequence that is not full.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE_TOKENS = 2048
GROUP_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END_OF_DOCUMENT = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, piece_cost double"
)


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """Encoder text -> ids for a rank file; `special` strings become their single ids."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding(
        "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special)
    )
    allowed = set(dict(special))
    plain = coder.encode_ordinary
    if not allowed:
        return plain
    return lambda text: (
        coder.encode(text, allowed_special=allowed, disallowed_special=())
        if any(s in text for s in allowed)
        else plain(text)
    )


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) covering each document exactly once.

    Sequences are numbered from 0 in order of first use. Documents of length 0 get one piece of
    length 0 in no sequence of their own: they join sequence 0 at offset 0.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # (-length, document, start)
    n_seq = 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n - full * capacity or not n:
            rest.append((full * capacity - n, d, full * capacity))
    need = -(-sum(-r for r, _, _ in rest) // capacity)
    used = [0] * need
    first = n_seq
    cheapest = [(0.0, i) for i in range(need)]  # heap by cost
    by_room = [(capacity, i) for i in range(need)]  # ascending room of open sequences
    costs = [0.0] * need
    heapq.heapify(rest)

    def put(d: int, start: int, n: int, i: int) -> None:
        at = bisect_left(by_room, (capacity - used[i], i))
        by_room.pop(at)
        pieces.append((d, start, n, first + i, used[i]))
        used[i] += n
        costs[i] += cost(n)
        if used[i] < capacity:
            insort(by_room, (capacity - used[i], i))
            heapq.heappush(cheapest, (costs[i], i))

    while rest:
        minus, d, start = heapq.heappop(rest)
        n = -minus
        if not n:
            pieces.append((d, start, 0, 0, 0))
            continue
        aside = []
        chosen = -1
        if by_room[-1][0] >= n:
            while chosen < 0:
                c, i = heapq.heappop(cheapest)
                if c != costs[i] or used[i] == capacity:
                    continue  # an entry from before its sequence changed
                if capacity - used[i] >= n:
                    chosen = i
                else:
                    aside.append((c, i))
            for x in aside:
                heapq.heappush(cheapest, x)
            put(d, start, n, chosen)
        else:
            room, i = by_room[-1]
            put(d, start, room, i)
            heapq.heappush(rest, (room - n, d, start + room))
    return pieces


def _group_rows(ids: list, tokens: list[np.ndarray], capacity: int, base: int) -> tuple[pa.RecordBatch, int]:
    pieces = pack_lengths([len(t) for t in tokens], capacity)
    crc = [zlib.crc32(tokens[d][s : s + n].data) for d, s, n, _, _ in pieces]
    doc, start, length, seq, off = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    counts = np.array([len(t) for t in tokens], np.int64)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([ids[d] for d in doc], pa.int64()),
            pa.array(start),
            pa.array(length),
            pa.array(crc, pa.int64()),
            pa.array(counts[doc]),
            pa.array(base + seq),
            pa.array(off),
            pa.array(LINEAR * length + QUADRATIC * length * length),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )
    return batch, int(seq.max()) + 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    special: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Pieces of all documents packed into sequences of at most `sequence_tokens` tokens.

    A document's tokens are its text's ids followed by END_OF_DOCUMENT. Null or empty text
    gives that single token. Repeated rows are packed as often as they occur; a null id stays
    null. Within a sequence the pieces' offsets are gapless from 0. Sequence ids are unique
    over the result but not dense: partition number and running number in one integer. Ids are
    of type long, others fail and have to be cast first. Other columns are not read.
    """
    marks = tuple(sorted((special or {}).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary, pattern, marks)
        base = TaskContext.get().partitionId() << 33
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py() or "")
                got.append(END_OF_DOCUMENT)
                ids.append(doc_id)
                tokens.append(np.array(got, "<u4"))
                held += len(got)
                if held >= group_tokens:
                    rows, n = _group_rows(ids, tokens, sequence_tokens, base)
                    base += n
                    ids, tokens, held = [], [], 0
                    yield rows
        if ids:
            yield _group_rows(ids, tokens, sequence_tokens, base)[0]

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
