"""N-gram Jaccard join with token-combination prefixes.

A document's set is that of its distinct word shingles ("tokens"). Two sets link when
100 * |x & y| >= 80 * |x | y|. All tokens are ordered by (number of sets that hold the token,
token). Of two linked sets the smaller one, and the larger one, share tokens in a prefix of
that order:

* the smaller set's overlap is at least 8/9 of its size (as smaller partner) and the larger
  set's at least 8/10 of its size, so prefixes of n - need + l tokens share at least l of them;
* tokens in more than FREQUENT sets are dealt into c classes by hash, c depending on the size
  class of the pair. With l = 1 + c, two sets that share no rare token in their prefixes share two
  frequent tokens of one class. So rare tokens are indexed alone, frequent ones as pairs within
  their class;
* tokens of a single set can be shared with nobody: they fill the prefix first, and a set with too
  many of them has no index entries at all.

Candidates are verified on the sets themselves. Only the components of the links are asked for, so
within an index entry every set is first compared with the entry's most typical one (fewest
tokens of its own); pairs of sets that are then in one component need no comparison. What
is left, pairs in one entry but in different components, is compared pair by pair, without a limit.

The order needs the number of sets of every token. Counting is done on blobs: tasks cut their
tokens by range, a reducer counts a range and answers each block of documents with the counts of
the tokens held more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.shingles import mix, shingle_sets
from tidewater.llm.tables import materialise

FREQUENT = 128
RANGE_TOKENS = 1 << 21
BLOCK_TOKENS, MOST_BLOCK_TOKENS, BLOCK_DOCS = 1 << 21, 1 << 24, 1 << 14
MOST_BITS = 24  # 2^24 ranges of RANGE_TOKENS are more tokens than 100 TB of text have
MEMBERS = "doc_id long, n int, f1 long, f2 long"
BLOBS = "r int, b long, data binary"
SETS = "f1 long, f2 long, n int, m int, singles array<long>, pairs array<long>, index_singles array<long>, index_pairs array<long>, tokens array<long>"


def _bodies(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _prints(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(tokens, s).sum(dtype=np.uint64).astype(np.int64)) for s in (1, 2))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set size n and 128-bit print (f1, f2) of every row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_bodies(batch.column(1)))
            prints = [_prints(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                ],
                names=["doc_id", "n", "f1", "f2"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, MEMBERS)


def _range_blobs(docs: DataFrame, bits: int, text_col: str) -> DataFrame:
    """Per block of documents and token range: the block's tokens there; at r >= 2**bits its sets.

    A set occurring more than once in a block is represented once.
    """
    block_tokens = min(max(BLOCK_TOKENS, 256 << bits), MOST_BLOCK_TOKENS)

    def rows(block: int, sets: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        about = np.array(list(sets), np.int64)
        meta = np.column_stack([about, sizes]).tobytes()
        tokens = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        at = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        tokens, owner, at = tokens[order], owner[order], at[order]
        key = tokens >> np.uint64(24 - bits)
        cuts = np.flatnonzero(np.diff(at)) + 1
        r, data = [], []
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]), strict=True):
            step = np.diff(owner[a:b], prepend=np.uint16(0)).astype("<u2")
            k = key[a:b]
            r.append(int(at[a]))
            data.append(step.tobytes() + (k >> np.uint64(8)).astype("<u4").tobytes() + k.astype(np.uint8).tobytes())
        r.append((1 << bits) + block % (1 << bits))
        data.append(meta)
        return pa.RecordBatch.from_arrays(
            [pa.array(r, pa.int32()), pa.array([block] * len(r), pa.int64()), pa.array(data, pa.binary())],
            names=["r", "b", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        sets: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for batch in batches:
            for s in (s for i in range(0, batch.num_rows, 256) for s in shingle_sets(_bodies(batch.column(0).slice(i, 256)))):
                if not len(s) or (name := _prints(s)) in sets:
                    continue
                sets[name] = s
                held += len(s)
                if held >= block_tokens or len(sets) >= BLOCK_DOCS:
                    yield rows(block, sets)
                    sets, held, block = {}, 0, block + 1
        if sets:
            yield rows(block, sets)

    return docs.select(text_col).mapInArrow(run, BLOBS)


def _read_range(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 7
    owner = np.cumsum(np.frombuffer(data, "<u2", n), dtype=np.uint16)
    high = np.frombuffer(data, "<u4", n, 2 * n).astype(np.uint64)
    return owner, (high << np.uint64(8)) | np.frombuffer(data, np.uint8, n, 6 * n)


def _count_range(bits: int):
    """Answer each block's tokens of one range with those held by several sets, and their counts."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("r")[0].as_py() >= 1 << bits:
            return table
        parts = [_read_range(d.as_py()) for d in table.column("data")]
        keys = np.concatenate([k for _, k in parts])
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        df = np.minimum(counts, 255).astype(np.uint8)[inverse]
        out, at = [], 0
        for owner, key in parts:
            d = df[at : at + len(key)]
            at += len(key)
            s = d > 1
            key = key[s]
            out.append(
                owner[s].astype("<u2").tobytes()
                + (key >> np.uint64(8)).astype("<u4").tobytes()
                + key.astype(np.uint8).tobytes()
                + d[s].tobytes()
            )
        return table.set_column(2, "data", pa.chunked_array([pa.array(out, pa.binary())]))

    return run


def _size_class(n: int) -> int:
    """Sizes of linked sets lie in one class or in neighbouring ones."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1.25) + 1e-9))


def _classes(size_class: int) -> int:
    return max(1, int(0.2 * 1.25 ** (size_class + 1) / 4))


def _pair_names(frequent: np.ndarray, size_class: int, c: int) -> np.ndarray:
    """Names of all pairs of tokens of one class."""
    frequent = np.sort(frequent)
    kind = mix(frequent, size_class + 100) % np.uint64(c)
    out = []
    for one in np.unique(kind):
        t = frequent[kind == one]
        if len(t) > 1:
            i, j = np.triu_indices(len(t), 1)
            out.append(mix(mix(t[i], size_class) ^ (t[j] * np.uint64(0x9E3779B97F4A7C15)), 3))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def entries(tokens: np.ndarray, df: np.ndarray, n: int, frequent: int = FREQUENT) -> dict[str, np.ndarray]:
    """Index entries of a set of size n whose tokens held elsewhere, in order, are `tokens`.

    As the larger partner the set needs 4n/5 shared tokens, as the smaller 8n/9.
    """
    own = n - len(tokens)
    got: dict[str, np.ndarray] = {}
    for role, need in (("", -(-4 * n // 5)), ("index_", -(-8 * n // 9))):
        short = max(0, n - need + 1 - own)
        singles = tokens[:short][df[:short] <= frequent]
        pairs = np.zeros(0, np.uint64)
        if len(singles) < min(short, len(tokens)):  # the prefix reaches frequent tokens
            here = _size_class(n)
            for size_class in (here,) if role else (here, here - 1):
                c = _classes(size_class)
                long = slice(0, max(0, n - need + 1 + c - own))
                singles = np.union1d(singles, tokens[long][df[long] <= frequent])
                pairs = np.concatenate([pairs, _pair_names(tokens[long][df[long] > frequent], size_class, c)])
        got[f"{role}singles"], got[f"{role}pairs"] = mix(singles, 4), pairs
    return got


def _assemble(bits: int, frequent: int):
    """Sets of one block that can link at all, with their index entries."""

    def run(table: pa.Table) -> pa.Table:
        meta, owners, tokens, dfs = np.zeros((0, 3), np.int64), [], [], []
        for r, data in zip(table.column("r").to_pylist(), table.column("data").to_pylist(), strict=True):
            if r >= 1 << bits:
                meta = np.frombuffer(data, np.int64).reshape(-1, 3)
                continue
            n = len(data) // 8
            owners.append(np.frombuffer(data, "<u2", n))
            high = np.frombuffer(data, "<u4", n, 2 * n).astype(np.uint64)
            key = (high << np.uint64(8)) | np.frombuffer(data, np.uint8, n, 6 * n)
            tokens.append((np.uint64(r) << np.uint64(40)) | key)
            dfs.append(np.frombuffer(data, np.uint8, n, 7 * n))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.uint16)
        token = np.concatenate(tokens) if owners else np.zeros(0, np.uint64)
        df = np.concatenate(dfs) if owners else np.zeros(0, np.uint8)
        order = np.lexsort((token, df, owner))
        owner, token, df = owner[order], token[order], df[order]
        cut = np.searchsorted(owner, np.arange(len(meta) + 1))
        rows = []
        for i, (f1, f2, n) in enumerate(meta.tolist()):
            t, d = token[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
            if 5 * len(t) < 4 * n:
                continue
            e = entries(t, d, n, frequent)
            rows.append((f1, f2, n, len(t), *(e[k].astype(np.int64) for k in ("singles", "pairs", "index_singles", "index_pairs")), np.sort(t).astype(np.int64)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 5]
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SETS.split(", ")]
        )

    return run


def _possible(x: str, y: str) -> Column:
    """Whether set sizes and shareable tokens leave a link of `x` and `y` possible (9 i >= 4 (n + n'))."""
    n, m = F.col(f"{x}n") + F.col(f"{y}n"), F.least(F.col(f"{x}m"), F.col(f"{y}m"))
    return (9 * m >= 4 * n) & (5 * F.least(F.col(f"{x}n"), F.col(f"{y}n")) >= 4 * F.greatest(F.col(f"{x}n"), F.col(f"{y}n")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, linked) of distinct node pairs, by the sizes of the sets and of their intersection."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    both = F.size(F.array_intersect("at", "bt"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", both.alias("shared"), (F.col("an") + F.col("bn")).alias("sizes"))
    return met.select("a", "b", "shared", (9 * F.col("shared") >= 4 * F.col("sizes")).alias("linked"))


def links(docs: DataFrame, group: DataFrame, total: int, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Node pairs (a, b) whose components are those of all links between different sets.

    `group` names the sets: n, f1, f2, node. `total` is the number of tokens in all of them.
    """
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / RANGE_TOKENS)), 2, MOST_BITS))
    blobs = _range_blobs(docs, bits, text_col)
    counted = blobs.groupBy("r").applyInArrow(_count_range(bits), BLOBS)
    found = counted.groupBy("b").applyInArrow(_assemble(bits, frequent), SETS)
    sets = materialise(
        found.dropDuplicates(["f1", "f2", "n"]).join(group.select("n", "f1", "f2", "node"), ["n", "f1", "f2"]), "sets"
    )
    at = [
        sets.select(F.explode(column).alias("entry"), "node", "n", "m", F.lit(column.startswith("index")).alias("index"))
        for column in ("singles", "pairs", "index_singles", "index_pairs")
    ]
    rows = at[0].unionByName(at[1]).unionByName(at[2]).unionByName(at[3])
    rows = rows.groupBy("entry", "node", "n", "m").agg(F.max("index").alias("index"))
    pivots = rows.groupBy("entry").agg(
        F.min(F.struct((1 - F.col("m") / F.col("n")).alias("own"), "node", "n", "m")).alias("p"), F.count("*").alias("k")
    )
    pivots = pivots.where("k > 1").select("entry", F.col("p.node").alias("pnode"), F.col("p.n").alias("pn"), F.col("p.m").alias("pm"))
    rows = materialise(rows.join(pivots, "entry"), "entries")
    rows = rows.where(F.col("node") != F.col("pnode"))
    ends = [F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")]
    stars = rows.where(_possible("", "p")).select(*ends).distinct()
    first = materialise(_verified(stars, sets), "stars")
    linked = first.where("linked").select("a", "b")

    label = components(linked)
    rows = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    pivot_label = label.select(F.col("node").alias("pnode"), F.col("component").alias("pcomponent"))
    rows = rows.join(pivot_label, "pnode", "left").withColumn("pcomponent", F.coalesce("pcomponent", "pnode"))
    spread = rows.groupBy("entry").agg(F.count_if(F.col("component") != F.col("pcomponent")).alias("apart"), F.count("*").alias("k"))
    # two sets besides the most typical one can only be apart where one of them is apart from it
    spread = spread.where("apart > 0 and k > 1").select("entry")
    rows = materialise(rows.join(spread, "entry", "left_semi"), "open-entries")
    # what each set shares with the typical set p bounds what two of them share:
    # |x & y| <= min(|x & p|, |y & p|) + min(|x - p|, |y - p|), tokens of a single set left out
    unknown = rows.select(*ends).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    met = materialise(first.unionByName(_verified(unknown, sets)).select("a", "b", "shared"), "shared")
    rows = rows.select("*", *ends).join(met, ["a", "b"]).withColumnRenamed("shared", "i")
    rows = materialise(rows.select("entry", "node", "n", "m", "i", "index", "component", "pcomponent"), "bounded")
    # of two components in an entry at most one is the typical set's; sizes of linked sets lie in one class or in neighbouring ones
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25)) + 1e-9).cast("int")
    x = rows.where("component != pcomponent").withColumn("size", F.explode(F.array(size - 1, size, size + 1))).select("entry", "size", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "m", "i", "index", "component")))
    y = rows.select("entry", size.alias("size"), *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "m", "i", "index", "component")))
    smaller_indexed = (F.col("x_index") & (F.col("x_n") <= F.col("y_n"))) | (F.col("y_index") & (F.col("y_n") <= F.col("x_n")))
    most = F.least("x_i", "y_i") + F.least(F.col("x_m") - F.col("x_i"), F.col("y_m") - F.col("y_i"))
    near = (9 * most >= 4 * (F.col("x_n") + F.col("y_n"))) & (F.col("x_component") != F.col("y_component"))
    rest = x.join(y, (x.entry == y.entry) & (x["size"] == y["size"]) & smaller_indexed & near & _possible("x_", "y_"))
    rest = rest.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    rest = rest.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = materialise(_verified(rest, sets), "rest")
    return linked.unionByName(second.where("linked").select("a", "b"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    A text of fewer than five words has its whole word sequence as one shingle; null text and text
    without words have none and are linked with nothing. Repeated rows and equal sets are linked.
    component_id is the smallest doc_id in the component (a null id is never the smallest). Ids are
    of type long, others fail and have to be cast first. An empty table gives an empty result; other columns are not read.
    """
    member = materialise(members(docs, id_col, text_col), "members")
    keys = ["n", "f1", "f2"]
    group = materialise(
        member.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("node")).where("node is not null"), "groups"
    )
    total = group.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    label = components(links(docs, group, total, text_col, frequent))
    named = group.join(label, "node", "left").select(*keys, F.coalesce("component", "node").alias("component_id"))
    named = materialise(named, "named")
    found = member.join(named, keys, "left")
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, that with the smallest id (a null id is never the smallest).

    Rows are numbered in a written copy and compared by that number, so ids may be repeated or
    null. The column name `__n` is taken by the operator.
    """
    numbered = materialise(docs.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    found = ngram_components(numbered, "__n", text_col).select(F.col("doc_id").alias("__n"), "component_id")
    found = found.join(numbered.select("__n", F.col(id_col).alias("id")), "__n")
    found = materialise(found.select("__n", "component_id", F.struct(F.col("id").isNull(), "id", "__n").alias("place")), "placed")
    best = found.groupBy("component_id").agg(F.min("place").alias("best"))
    stay = best.select(F.col("best.__n").alias("__n"))
    lost = materialise(found.select("__n").join(stay, "__n", "left_anti"), "near-copies")
    return numbered.join(lost, "__n", "left_anti").select(*docs.columns)
