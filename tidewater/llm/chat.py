"""Chat formatting: conversations rendered through a compiled template, with a loss mask.

The rows of a conversation are brought together and ordered by Spark (hash partitioning and a
sort that spills), then streamed through the template's closures: a task holds one turn and the
part being written, never a conversation. Output comes in parts of whole turns, so a conversation
of any length gives rows of bounded size. A conversation's parts follow each other in one
partition; its digest is sequential by definition and costs one pass over its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.chat_template import compile_template

CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | escape | one_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)
PART_CHARS = 1 << 20
PARTS = "conv_id long, part int, formatted string, loss_spans array<struct<start:long,end:long>>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)

_OPENS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Double backslashes, and break every control string by a backslash after its first character."""
    return _OPENS.sub(r"\1\\", text.replace("\\", "\\\\"))


def one_line(text: str) -> str:
    return text.replace("\n", "\\N")


def unescape(text: str) -> str:
    """Inverse of `escape` and of `one_line` after it. No control string has N in second place."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "N" else m[1], text) if "\\" in text else text


@lru_cache(maxsize=4)
def _compiled(template: str):
    return compile_template(template, {"escape": escape, "one_line": one_line, "trim": str.strip})


class _Turns:
    """Conversations out of sorted record batches, one turn at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (
            (c, {"role": r.as_py() or "", "text": t.as_py() or ""})
            for b in batches
            for c, r, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True)
        )
        self.ahead = next(self.rows, None)

    def of(self, conv_id) -> Iterator[dict]:
        while self.ahead is not None and self.ahead[0] == conv_id:
            turn = self.ahead[1]
            self.ahead = next(self.rows, None)
            yield turn


def _part(conv_id, part: int, text: list[str], spans: list[tuple[int, int]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([conv_id], pa.int64()),
            pa.array([part], pa.int32()),
            pa.array(["".join(text)], pa.string()),
            pa.array([[{"start": a, "end": b} for a, b in spans]], kind),
        ],
        names=["conv_id", "part", "formatted", "loss_spans"],
    )


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (conv_id, part, formatted, loss_spans) of all conversations in `turns`.

    `turns` has conv_id, turn, role and text; other columns are not read. Null role or text
    counts as empty, a null turn comes first, rows with equal turn are ordered by role and text,
    repeated rows are repeated turns, and rows with null conv_id form one conversation. An
    empty table gives no parts. `loss_spans` are code point ranges of a part under the loss mask.
    A part ends with the first turn that takes it past `part_chars`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, turns = _compiled(template), _Turns(batches)
        while turns.ahead is not None:
            conv_id = turns.ahead[0]
            text: list[str] = []
            spans: list[tuple[int, int]] = []
            size = part = 0
            for chunk, generated in render({"messages": turns.of(conv_id)}):
                if size >= part_chars and chunk.startswith(CONTROL[0]):
                    yield _part(conv_id, part, text, spans)
                    text, spans, size, part = [], [], 0, part + 1
                if generated:
                    spans.append((size, size + len(chunk)))
                text.append(chunk)
                size += len(chunk)
            yield _part(conv_id, part, text, spans)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.col("role").alias("role"),
        F.col("text").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of turns and loss text, read from the formatted parts of `format_conversations`.

    `parts` must come straight from that function: parts of a conversation adjacent and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id: object = None
        state: list | None = None

        def closed() -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            row = [open_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)],
                names=[c.split()[0] for c in DIGEST.split(", ")],
            )

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                conv_id, part, formatted, spans = (v.as_py() for v in row)
                if part == 0:
                    if state:
                        yield closed()
                    open_id, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _TURN.findall(formatted):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
        if state:
            yield closed()

    return parts.mapInArrow(run, DIGEST)
