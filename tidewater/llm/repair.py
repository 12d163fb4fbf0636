"""Repair of conversation structure: the cheapest edits that leave a legal order of roles.

Rows of a conversation are read in order as a lattice: a node is (rows read, what the repaired part
ends with), an arc is an edit with its integer cost. The cheapest way through is found by an auction:
nodes have prices, at most the cost of an arc plus the price of its end; a path grows from the entry
over arcs that meet their price exactly and shrinks, raising the price of its last node, where none
does. When the path arrives, prices of its nodes are true distances, so every cheapest path consists of
tight arcs, and the ASCII-least one is read off by taking the least letter that still arrives.

A conversation of any length is cut into blocks of rows. Blocks that are not alone first yield the
costs between their entry and exit states; these small tables, added up from the end of a conversation,
give each block the prices beyond its exit, with which it is solved for all entries at once, and from
the start they give the entry that is taken. Texts take no part in that; they meet their edits at the
end. Only the digest of a repaired conversation, sequential by definition, reads one conversation in one
task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.tables import materialise

DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
BLOCK_ROWS = 8192
STRETCH = 16  # rows of one auction
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,), "s": (START,)}
_REACHED = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
END_PRICES = (0, None, None, 0)  # nothing at all, or a last assistant row

Prices = tuple[int | None, ...]
Arc = tuple[str, int, int]


def _lattice(signs: str, beyond: Prices, last: bool) -> list[list[Arc]]:
    """Arcs (letter, node, cost) of each node 4 * rows read + state, without those that cannot arrive.

    A sign is `-` for a row that must go, else the role's initial (`x` for others), in capitals where
    the text is unfinished. The node after all others is the arrival; its arcs cost the prices beyond.
    """
    n = len(signs)
    arcs: list[list[Arc]] = [[] for _ in range(4 * n + 5)]
    arrives = [False] * (4 * n + 4) + [True]
    for at in range(n, -1, -1):
        here: list[list[Arc]] = [[] for _ in STATES]
        for s in STATES:
            if at == n:
                if beyond[s] is not None:
                    here[s].append(("", 4 * n + 4, beyond[s]))
            else:
                sign, base = signs[at], 4 * at + 4
                here[s].append(("D", base + s, DELETE))
                if sign != "-":
                    more = UNFINISHED if sign.isupper() else 0
                    kind = sign.lower()
                    if s in _AFTER.get(kind, ()):
                        here[s].append(("K", base + _REACHED[kind], more))
                    here[s].append(("R", base + _NEXT[s], REROLE + more))
            if at < n or last:
                here[s].append(("I", 4 * at + _NEXT[s], INSERT))
        for s in (*STATES,) * 3:  # up to two inserts lead on among nodes of the same number of rows
            arrives[4 * at + s] = arrives[4 * at + s] or any(arrives[j] for _, j, _ in here[s])
        for s in STATES:
            arcs[4 * at + s] = [a for a in here[s] if arrives[a[1]]]
    return arcs


def auction(arcs: list[list[Arc]], prices: list[int], origin: int, goal: int) -> None:
    """Raise `prices` until a path of tight arcs leads from `origin` to `goal`."""
    path = [origin]
    while path[-1] != goal:
        i = path[-1]
        cheapest, j = min((cost + prices[j], j) for _, j, cost in arcs[i])
        if prices[i] < cheapest:
            prices[i] = cheapest
            if len(path) > 1:
                path.pop()
        else:
            path.append(j)


class _Stretch:
    """A few rows with converged prices for all entries."""

    def __init__(self, signs: str, beyond: Prices, last: bool):
        self.rows, self.goal = len(signs), 4 * len(signs) + 4
        self.arcs = _lattice(signs, beyond, last)
        self.price = [0] * (self.goal + 1)
        for s in STATES:
            if self.arcs[s]:
                auction(self.arcs, self.price, s, self.goal)
        self.entry = tuple(self.price[s] if self.arcs[s] else None for s in STATES)
        self.tight: list[dict[str, int]] = [{} for _ in self.arcs]
        arrives = [False] * self.goal + [True]
        for at in range(self.rows, -1, -1):
            nodes = range(4 * at, 4 * at + 4)
            for i in (*nodes,) * 3:
                for letter, j, cost in self.arcs[i]:
                    if arrives[j] and self.price[i] == cost + self.price[j]:
                        self.tight[i][letter] = j
                        arrives[i] = True

    def walk(self, state: int) -> tuple[str, int]:
        """Letters of the ASCII-least cheapest way from an entry, and the state it leaves with."""
        node, letters = state, []
        while True:
            letter = min(self.tight[node])
            following = self.tight[node][letter]
            if following == self.goal:
                return "".join(letters), node % 4
            letters.append(letter)
            node = following


@lru_cache(maxsize=1 << 16)
def _solved(signs: str, beyond: Prices, last: bool) -> tuple[Prices, tuple[tuple[str, int] | None, ...]]:
    """Entry prices of a stretch, and (letters, exit) for each entry that can arrive."""
    found = _Stretch(signs, beyond, last)
    return found.entry, tuple(found.walk(s) if found.entry[s] is not None else None for s in STATES)


def _stretches(signs: str, beyond: Prices, last: bool) -> tuple[Prices, list]:
    """Entry prices of a block, and the ways through its stretches in order."""
    cuts = range(0, max(len(signs), 1), STRETCH)
    ways = []
    for i in reversed(cuts):
        least = min(p for p in beyond if p is not None)  # differences alone decide, and stay small
        relative = tuple(p if p is None else p - least for p in beyond)
        prices, way = _solved(signs[i : i + STRETCH], relative, last and i == cuts[-1])
        beyond = tuple(p if p is None else p + least for p in prices)
        ways.append(way)
    return beyond, ways[::-1]


def transfer(signs: str) -> list[int | None]:
    """Costs of a block from each entry (outer) to each exit state."""
    columns = [_stretches(signs, tuple(0 if t == s else None for t in STATES), False)[0] for s in STATES]
    return [columns[t][s] for s in STATES for t in STATES]


def solve(signs: str, beyond: Prices = END_PRICES, last: bool = True) -> list[tuple[int, str, int] | None]:
    """For each entry state (cost to the end, letters, exit state) of a block's cheapest edits, ASCII-least."""
    prices, ways = _stretches(signs, beyond, last)
    out: list[tuple[int, str, int] | None] = []
    for s in STATES:
        if prices[s] is None:
            out.append(None)
            continue
        at, letters = s, []
        for way in ways:
            part, at = way[at]
            letters.append(part)
        out.append((prices[s], "".join(letters), at))
    return out


def initial(role: Column) -> Column:
    """s, u or a as a role starts, x for all others."""
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by a checksum of conversation and turn; nulls read as one space.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes out full stops, exclamation and
    question marks, 3 repeats it and 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.crc32(key) % 20, F.coalesce("text", blank)
    return turns.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a number each, their facts): a fact row has `place`, a number that rises with conversation
    and order, the role's initial and the first fault of its row: blank, duplicate, truncated or none.

    Order is by turn, nulls first, then role and text (by 64 characters and a digest). Facts carry no texts.
    """
    conv, digest = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    numbered = materialise(rows.withColumns({"conv": conv, "row": F.monotonically_increasing_id()}), "turns")
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    facts = numbered.select(
        "conv",
        "row",
        F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.left("role", F.lit(64)).alias("role"),
        F.left("text", F.lit(64)).alias("text"),
        digest.alias("digest"),
        initial(F.col("role")).alias("kind"),
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("truncated"),
    )
    firsts = facts.groupBy("conv", "digest").agg(F.min(F.struct("known", "turn", "row")).alias("first"))
    joined = facts.join(firsts.select(F.col("first.row").alias("row"), F.lit(True).alias("first")), "row", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    order = ["conv", "known", "turn", "role", "text", "digest", "row"]
    ordered = joined.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().alias("place")
    seen = F.when(F.col("known"), F.col("turn")).alias("turn")
    return numbered, materialise(ordered.select("conv", "row", seen, "kind", "fault", place), "places")


def _sign() -> Column:
    kind = F.col("kind")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)


def _add(costs: list[int | None], beyond: Prices) -> Prices:
    """Prices before a block, from its costs and the prices beyond it."""
    ways = [[costs[4 * s + t] + beyond[t] for t in STATES if costs[4 * s + t] is not None and beyond[t] is not None] for s in STATES]
    return tuple(min(w) if w else None for w in ways)


_KEYS = [("conv", pa.string()), ("block", pa.int64())]
_INTS = pa.list_(pa.int32())
_WAY = pa.struct([("cost", pa.int32()), ("letters", pa.string()), ("exit", pa.int32())])
COSTS = ("conv string, block long, costs array<int>", pa.schema([*_KEYS, ("costs", _INTS)]))
PRICES = ("conv string, block long, beyond array<int>", pa.schema([*_KEYS, ("beyond", _INTS)]))
WAYS = ("conv string, block long, ways array<struct<cost:int,letters:string,exit:int>>", pa.schema([*_KEYS, ("ways", pa.list_(_WAY))]))
ENTRY = ("conv string, block long, entry int", pa.schema([*_KEYS, ("entry", pa.int32())]))
LINES = ("conv string, block long, lines array<array<string>>", pa.schema([*_KEYS, ("lines", pa.list_(pa.list_(pa.string())))]))


def _each(blocks: DataFrame, of, schema: tuple[str, pa.Schema]) -> DataFrame:
    """One result for each row of `blocks`, by a function of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"conv": r["conv"], "block": r["block"], **of(r)} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema[1])

    return blocks.mapInArrow(run, schema[0])


def _along(blocks: DataFrame, of, schema: tuple[str, pa.Schema]) -> DataFrame:
    """Results for the blocks of a conversation in order, by a function of their list; a row a block."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        return pa.Table.from_pylist([{"conv": r["conv"], "block": r["block"], **x} for r, x in zip(rows, of(rows), strict=True)], schema[1])

    return blocks.groupBy("conv").applyInArrow(run, schema[0])


def _prices_beyond(rows: list[dict]) -> list[dict]:
    beyond, out = END_PRICES, []
    for r in reversed(rows):
        out.append({"beyond": list(beyond)})
        beyond = _add(r["costs"], beyond) if r["costs"] else solve_prices(r["signs"])
    return out[::-1]


def _entries(rows: list[dict]) -> list[dict]:
    at, out = START, []
    for r in rows:
        out.append({"entry": at})
        at = r["exits"][at]
    return out


def solve_prices(signs: str) -> Prices:
    """Prices before a conversation's last block."""
    return _stretches(signs, END_PRICES, True)[0]


def lines(signs: str, letters: str, state: int) -> list[list[str]]:
    """What each row becomes: `=` itself, `=role` itself in another role, `+role` an inserted row before it
    (behind it, after the last row)."""
    out: list[list[str]] = [[] for _ in signs]
    at = 0
    for letter in letters:
        here = out[min(at, len(signs) - 1)]
        if letter == "K":
            here.append("=")
            state = _REACHED[signs[at].lower()]
        elif letter != "D":
            state = _NEXT[state]
            here.append("=+"[letter == "I"] + ROLE[state])
        at += letter != "I"
    return out


def edit_blocks(facts: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(blocks, ways): runs of a conversation's rows in order, and each block's edits by its true entry.

    `blocks` has rows, places, signs and kinds in order; `ways` its cost, letters, entry and exit.
    """
    each = F.array_sort(F.collect_list(F.struct("place", "row", _sign().alias("sign"), "kind", "fault")))
    grouped = facts.groupBy("conv", F.floor(F.col("place") / block_rows).alias("block")).agg(each.alias("r"))
    of = Window.partitionBy("conv")
    blocks = materialise(
        grouped.select(
            "conv",
            "block",
            F.col("r.row").alias("rows"),
            F.array_join("r.sign", "").alias("signs"),
            F.array_join("r.kind", "").alias("kinds"),
            F.col("r.fault").alias("faults"),
        ).withColumns({"last": F.col("block") == F.max("block").over(of), "alone": F.count(F.lit(1)).over(of) == 1}),
        "blocks",
    )
    single, several = blocks.where("alone"), blocks.where("not alone")
    narrow = ["conv", "block", "signs", "last"]
    costs = _each(several.select(*narrow), lambda r: {"costs": None if r["last"] else transfer(r["signs"])}, COSTS)
    ends = several.select("conv", "block", F.when(F.col("last"), F.col("signs")).alias("signs"))
    beyond = _along(costs.join(ends, ["conv", "block"]), _prices_beyond, PRICES)
    none = F.lit(None).cast("array<int>").alias("beyond")
    priced = several.select(*narrow).join(beyond, ["conv", "block"]).unionByName(single.select(*narrow, none))

    def ways(r: dict) -> dict:
        found = solve(r["signs"], tuple(r["beyond"]) if r["beyond"] else END_PRICES, r["last"])
        return {"ways": [w and dict(zip(("cost", "letters", "exit"), w, strict=True)) for w in found]}

    solved = materialise(_each(priced, ways, WAYS), "ways")
    exits = solved.join(several.select("conv", "block"), ["conv", "block"]).select("conv", "block", F.col("ways.exit").alias("exits"))
    taken = F.coalesce("entry", F.lit(START))
    chosen = solved.join(_along(exits, _entries, ENTRY), ["conv", "block"], "left").select(
        "conv", "block", taken.alias("entry"), F.element_at("ways", taken + 1).alias("way")
    )
    return blocks, materialise(chosen.select("conv", "block", "entry", "way.letters"), "edits")


def repaired(numbered: DataFrame, blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows (conv, conv_id, block, nth, n, turn, role, text) of the repaired conversations, in order of block, nth, n."""
    given = blocks.select("conv", "block", "rows", "signs").join(ways, ["conv", "block"])
    each = _each(given.select("conv", "block", "signs", "letters", "entry"), lambda r: {"lines": lines(r["signs"], r["letters"], r["entry"])}, LINES)
    edits = blocks.select("conv", "block", "rows").join(each, ["conv", "block"])
    placed = edits.select("block", F.posexplode(F.arrays_zip("rows", "lines")).alias("nth", "e")).select("block", "nth", F.col("e.rows").alias("row"), F.col("e.lines").alias("lines"))
    out = numbered.join(placed, "row").select("conv", "conv_id", "turn", "role", "text", "block", "nth", F.posexplode("lines").alias("n", "line"))
    added = F.left("line", F.lit(1)) == "+"
    return out.select(
        "conv",
        "conv_id",
        "block",
        "nth",
        "n",
        F.when(~added, F.col("turn")).alias("turn"),
        F.when(F.length("line") > 1, F.substring("line", 2, 16)).otherwise(F.col("role")).alias("role"),
        F.when(added, "").otherwise(F.col("text")).alias("text"),
    )


def _digests(rows: DataFrame) -> DataFrame:
    """Digest of each conversation's `role:text` lines; a task reads its conversations row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        closed = lambda: pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [digest.hexdigest()]})
        for batch in batches:
            for own, role, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                if own.as_py() == conv:
                    digest.update(b"\n")
                else:
                    if conv is not None:
                        yield closed()
                    conv, digest = own.as_py(), hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if conv is not None:
            yield closed()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "block", "nth", "n")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, costs and digests of every conversation of `turns`, whose rows as found are `rows`.

    Both have conv_id, turn, role and text; in `rows` roles and texts are not null. A null conversation id is
    a conversation; rows of one turn are ordered by role and text, repeated rows follow each other. Only
    spaces and the control characters 9 to 13 count as blank. A conversation without rows, or with nothing
    but rows that must go, has an empty audit if nothing is left, zeros and the digest of an empty text.
    An empty table gives no rows; other columns are not read.
    """
    numbered, facts = placed(rows.select("conv_id", "turn", "role", "text"))
    blocks, ways = edit_blocks(facts, block_rows)
    # one row a turn first: a turn may stand in very many rows
    turn = facts.groupBy("conv", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = turn.groupBy("conv").agg(gaps, *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    before = F.lag(F.right("kinds", F.lit(1)), 1, "").over(Window.partitionBy("conv").orderBy("block"))  # one row a block
    seen = F.concat(before, "kinds")
    pairs = F.transform(F.sequence(F.lit(1), F.length(seen) - 1), lambda i: F.substr(seen, i, F.lit(2)))
    wrong = F.when(F.length(seen) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))))
    illegal = blocks.select("conv", wrong.alias("wrong")).groupBy("conv").agg(F.sum("wrong").alias("illegal"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x.letters), "")
    costs = blocks.select("conv", "block", "signs").join(ways, ["conv", "block"]).groupBy("conv").agg(F.sum(_cost()).alias("cost"), audit.alias("audit"))
    found = counts.join(illegal, "conv").join(costs, "conv").join(_digests(repaired(numbered, blocks, ways)), "conv", "left")
    known = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(found, "conv", "left").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _cost() -> Column:
    """Cost of a block's letters: the edits, and rows that stay unfinished."""
    letters = F.col("letters")
    edits = sum((F.length(letters) - F.length(F.replace(letters, F.lit(x)))) * c for x, c in (("D", DELETE), ("R", REROLE), ("I", INSERT)))
    rows = F.arrays_zip(F.split(F.replace(letters, F.lit("I")), "").alias("letter"), F.split("signs", "").alias("sign"))
    kept = F.size(F.filter(rows, lambda x: (x.letter != "D") & (x.sign != "-") & (F.lower(x.sign) != x.sign)))
    return edits + kept * UNFINISHED
