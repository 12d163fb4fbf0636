"""Boosted trees of many fits at once: each level of all trees of all fits is one pass over rows that are binned once.

The trees are those of Spark ML's GBTClassifier (log loss, variance, ordered categories, medians and flags for missing
numbers). A column of at most BINS values is cut between any two of them, others at quantiles of all training rows, where
Spark ML takes those of 10,000 rows. Where the bins have fewer combinations than there are rows and no tree draws rows, rows of
equal bins, label and part are one row with their summed weight and their number, so the passes do not grow with the rows. In a
pass tasks sum up their rows by node, column and bin, Spark groups the sums by fit, and one task a fit, whose input does not
grow with the rows, picks the splits. Only trees and cuts are on the driver.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.forests import BINS, Cells, Fit, Tree, drawn, grown
from tidewater.sources.store import materialise

BATCH = 1 << 15
ROWS = 1 << 18  # of a task
CELLS = 1 << 20  # of a fold whose forests grow within tasks
ACCURACY = 10_000
PLAIN, BAGGED = 3, 18  # fits that a task grows side by side; those that draw rows share the draws


@dataclass
class Cuts:
    """How a fold's columns become bins: medians and bounds of numbers, values of categories by falling frequency."""

    middle: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, np.ndarray] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)

    def sizes(self, numeric: Sequence[str], flags: Sequence[str], kinds: Sequence[str]) -> list[int]:
        """The number of bins of each column; the last of a category is for values that are missing or new."""
        return [*(len(self.bounds[x]) + 1 for x in numeric), *(2 for _ in flags), *(len(self.values[x]) + 1 for x in kinds)]

    def binned(self, numeric: Sequence[str], flags: Sequence[str], kinds: Sequence[str], arrays: Mapping[str, pa.Array]) -> np.ndarray:
        """One row of bins for each of numeric, flags and kinds."""
        out = []
        for c in numeric:
            x = arrays[c].to_numpy(zero_copy_only=False).astype(float)
            out.append(np.searchsorted(self.bounds[c], np.where(np.isnan(x), self.middle[c], x)).astype(np.uint8))
        out += [arrays[c].is_null().to_numpy(zero_copy_only=False).astype(np.uint8) for c in flags]
        for c in kinds:
            known = pc.index_in(arrays[c], value_set=pa.array(self.values[c], pa.string()), skip_nulls=True)
            out.append(pc.fill_null(known, len(self.values[c])).to_numpy(zero_copy_only=False).astype(np.uint8))
        return np.stack(out)


def margins(bins: np.ndarray, forest: Sequence[Tree], rate: float) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for i, tree in enumerate(forest):
        out += ((rate if i else 1.0) * tree.value).take(tree.nodes(bins))
    return out


@dataclass
class Model:
    """Cuts of every fold and the trees of every fit; `loss` is the mean log loss of validating rows, where there are any."""

    numeric: list[str]
    flags: list[str]
    kinds: list[str]
    cuts: dict[int, Cuts]
    fits: list[Fit]
    forests: list[list[Tree]]
    loss: list[float | None]

    def scores(self, fold: str) -> Column:
        """Probabilities of a row's fold, as an array with one for each of the fold's fits in their order; numbers have to be doubles."""
        numeric, flags, kinds, cuts, fits, forests = self.numeric, self.flags, self.kinds, self.cuts, self.fits, self.forests

        @F.arrow_udf("array<double>")
        def scored(of: pa.Array, *columns: pa.Array) -> pa.Array:
            arrays, of = dict(zip([*numeric, *kinds], columns, strict=True)), of.to_numpy(zero_copy_only=False)
            width = max(sum(f.fold == k for f in fits) for k in cuts)
            out = np.full((len(of), width), np.nan)
            for k in np.unique(of):
                mine = np.flatnonzero(of == k)
                bins = cuts[k].binned(numeric, flags, kinds, {c: a.take(pa.array(mine)) for c, a in arrays.items()})
                for i, (f, forest) in enumerate((f, t) for f, t in zip(fits, forests, strict=True) if f.fold == k):
                    out[mine, i] = 1 / (1 + np.exp(-2 * margins(bins, forest, f.rate)))
            return pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * width, out.ravel())

        return scored(F.col(fold), *(F.col(c) for c in numeric), *(F.col(c).cast("string") for c in kinds))


def _cuts(train: DataFrame, numeric: Sequence[str], kinds: Sequence[str]) -> tuple[dict[int, Cuts], dict[int, float], list[str], int]:
    """Cuts and ratio of class masses of each fold, the numbers that miss values anywhere, and the number of rows; at most BINS values a column and fold are collected."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    bad = F.count_if(F.col("_u").isNull() | F.coalesce(~F.col("_y").isin(0.0, 1.0), F.lit(True)))
    mass = lambda y: F.sum(F.when(F.col("_y") == y, F.col("_u")))
    first = [f(c).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("m", lambda c: F.percentile_approx(known(c), 0.5, ACCURACY)), ("n", lambda c: F.count_if(F.col(c).isNull())))]
    cuts, ratio, flags, n = {}, {}, set(), 0
    for r in train.groupBy("_for").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), mass(1).alias("p"), mass(0).alias("q"), *first).collect():  # one row a fold
        if r["bad"] or any(r[f"m_{i}"] is None for i in range(len(numeric))):
            raise ValueError(f"fold {r['_for']}: labels other than 0 and 1, missing weights, or a column without numbers")
        cuts[r["_for"]] = Cuts({c: r[f"m_{i}"] for i, c in enumerate(numeric)})
        ratio[r["_for"]] = (1.0 if r["q"] is None else r["q"]) / (1.0 if r["p"] is None else r["p"])
        n += r["n"]
        flags |= {c for i, c in enumerate(numeric) if r[f"n_{i}"]}
    filled = train
    if numeric:
        middle = train.sparkSession.createDataFrame([(k, [c.middle[n] for n in numeric]) for k, c in cuts.items()], "_for int, _m array<double>")
        filled = train.join(F.broadcast(middle), "_for").withColumns({c: F.coalesce(known(c), F.col("_m")[i]) for i, c in enumerate(numeric)})
        at = [(i + 1) / BINS for i in range(BINS - 1)]
        second = [f(c).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("q", lambda c: F.percentile_approx(c, at, ACCURACY)), ("d", lambda c: F.approx_count_distinct(c)))]
        few = defaultdict(list)
        for r in filled.groupBy("_for").agg(*second).collect():  # one row a fold
            cuts[r["_for"]].bounds = {c: np.unique(r[f"q_{i}"]) for i, c in enumerate(numeric)}
            for i, c in enumerate(numeric):
                if r[f"d_{i}"] <= 2 * BINS:
                    few[c].append(r["_for"])
        if few:
            values = F.array(*(F.struct(F.lit(c).alias("c"), F.when(F.col("_for").isin(of), F.col(c)).alias("v")) for c, of in few.items()))
            each = filled.select("_for", F.explode(values).alias("x")).select("_for", "x.*").where("v is not null").distinct()
            for r in each.groupBy("_for", "c").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():  # at most about 2 * BINS values each
                if len(r["v"]) <= BINS:
                    v = np.array(r["v"])
                    cuts[r["_for"]].bounds[r["c"]] = (v[1:] + v[:-1]) / 2
    if kinds:
        each = train.select("_for", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in kinds))).alias("x")).select("_for", "x.*")
        seen = defaultdict(list)
        for r in each.where("v is not null").groupBy("_for", "c", "v").count().limit(len(cuts) * len(kinds) * BINS + 1).collect():
            seen[r["_for"], r["c"]].append((-r["count"], r["v"]))
        for k in cuts:
            cuts[k].values = {c: [v for _, v in sorted(seen[k, c])] for c in kinds}
            if any(len(v) >= BINS for v in cuts[k].values.values()):
                raise ValueError(f"a category of fold {k} has more than {BINS - 1} values")
    return cuts, ratio, sorted(flags, key=list(numeric).index), n


def _bagged(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """The rows that a tree sees, by a hash of row and tree."""
    x = (key.view(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) < share * (1 << 53)


def _best(sums: np.ndarray, fit: Fit, ordered: Sequence[bool], allowed: Sequence[Sequence[int]] | None) -> list[tuple]:
    """The best split of each node, or -1: (column's place, bins that go left, value, value left, value right); `sums` has node, column, bin and target, weight, rows."""
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for node, of in enumerate(sums):
            total = of[0].sum(axis=0)
            best = (0.0, -1, None, 0.0, 0.0)
            for j in range(len(of)) if allowed is None else allowed[node]:
                order = np.arange(BINS)
                if not ordered[j]:
                    order = np.argsort(np.where(of[j, :, 2] > 0, of[j, :, 0] / of[j, :, 1], np.inf), kind="stable")
                left = np.cumsum(of[j][order], axis=0)
                right = total - left
                gain = (left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - total[0] ** 2 / total[1]) / total[1]
                gain = np.where((left[:, 2] >= fit.least) & (right[:, 2] >= fit.least) & (left[:, 2] > 0) & (right[:, 2] > 0), gain, 0.0)
                i = int(np.argmax(gain))
                if gain[i] > max(best[0], 1e-15):
                    goes = np.zeros(BINS, bool)
                    goes[order[: i + 1]] = True
                    best = (gain[i], j, goes, left[i, 0] / left[i, 1], right[i, 0] / right[i, 1])
            out.append((best[1], best[2], total[0] / total[1] if total[1] else 0.0, *best[3:]))
    return out


@dataclass
class Binned:
    """Rows by bins, written, with what was fitted before any tree; `own` has the places in `names` of each fit's columns."""

    rows: DataFrame
    cuts: dict[int, Cuts]
    flags: list[str]
    names: list[str]
    own: list[list[int]]
    alone: bool  # the rows of a fold are so few that a task can take them


def _binned(train: DataFrame, numeric: list[str], kinds: list[str], fits: Sequence[Fit], within: bool = False) -> Binned:
    """With `within` rows of equal bins are one row also where trees draw rows, if a fold then has at most CELLS combinations."""
    cuts, ratio, flags, n = _cuts(train.where("not _valid"), numeric, kinds)
    if missing := {f.fold for f in fits} - set(cuts):
        raise ValueError(f"no training rows for folds {sorted(missing)}")
    names = [*numeric, *(f"_na_{c}" for c in flags), *kinds]
    own = [[names.index(c) for c in (*(c for c in f.columns if c in numeric), *(f"_na_{c}" for c in f.columns if c in flags), *(c for c in f.columns if c in kinds))] for f in fits]
    key = F.xxhash64(*numeric, *kinds, *(c for c in ("decision_us", "exit_us", "event_id") if c in train.columns))

    each = [math.prod(c.sizes(numeric, flags, kinds)) for c in cuts.values()]
    spread, alone = 2 * sum(each), within and min(max(each), n) <= CELLS
    grouped = alone or (spread <= n and all(f.bag == 1 for f in fits))
    u = F.col("_u")
    bad = F.count_if(u.isNull() | F.isnan(u) | (F.abs(u) == float("inf")) | F.coalesce(~F.col("_y").isin(0.0, 1.0), F.lit(True)))
    top = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(u)).alias("u"), bad.alias("bad")).first()
    if top["bad"]:
        raise ValueError("labels other than 0 and 1, or weights that are missing or not finite")
    # whole multiples of a unit add up to the same sum in any order
    unit = 2.0 ** (math.frexp(top["n"] * top["u"] * max(1.0, *ratio.values()))[1] - 62) if grouped else 1.0

    def binning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b["_for"].to_numpy()
            for k in np.unique(of):
                part = b.filter(pa.array(of == k))
                bins = np.ascontiguousarray(cuts[k].binned(numeric, flags, kinds, {c: part[c] for c in (*numeric, *kinds)}).T)
                size, width = bins.shape
                packed = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(np.arange(size + 1, dtype=np.int32) * width), pa.py_buffer(bins)])
                y, u, valid = (part[c].to_numpy(zero_copy_only=False) for c in ("_y", "_u", "_valid"))
                w = np.where((y == 1) & ~valid, u * ratio[k], u)
                w = np.rint(w / unit).astype(np.int64) if grouped else w
                yield pa.RecordBatch.from_arrays([part["_for"], packed, part["_y"].cast(pa.int8()), pa.array(w), part["_valid"], part["_key"]], ["_for", "bins", "y", "w", "valid", "key"])

    cast = train.select("_for", *numeric, *(F.col(c).cast("string").alias(c) for c in kinds), "_y", "_u", "_valid", key.alias("_key")).where(F.col("_for").isin(list(cuts)))
    dealt = cast.mapInArrow(binning, f"_for int, bins binary, y byte, w {'long' if grouped else 'double'}, valid boolean, key long").withColumn("n", F.lit(1.0))
    if grouped:
        by = ["_for", "bins", "y", "valid"]
        dealt = dealt.groupBy(*by).agg((F.sum("w") * F.lit(unit)).alias("w"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("key", F.xxhash64(*by))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, (min(n, spread) if grouped else n) // ROWS)
    rows = materialise(dealt.repartition(tasks, "key").sortWithinPartitions("_for", "key"), "binned")  # binned rows are so few bytes that a task would read millions
    return Binned(rows, cuts, flags, names, own, alone)


def judged(train: DataFrame, numeric: Sequence[str], kinds: Sequence[str], fits: Sequence[Fit], patience: int) -> list[tuple[float | None, int]]:
    """The loss and the number of trees of each fit as in `boosted`; the trees themselves are not kept.

    Where a fold has at most CELLS combinations of bins, or the table as many rows, tasks grow the forests of a few fits each.
    """
    numeric, kinds, fits = list(numeric), list(kinds), list(fits)
    binned = _binned(train, numeric, kinds, fits, within=True)
    if not binned.alone:
        model = _boosted(binned, numeric, kinds, fits, patience)
        return [(loss, len(forest)) for loss, forest in zip(model.loss, model.forests, strict=True)]
    cuts, flags, names, own = binned.cuts, binned.flags, binned.names, binned.own

    def packed(table: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, len(names))
        cells = Cells.of(bins, *(table[c].to_numpy() for c in ("y", "w", "valid", "n")))
        return pa.table({"_for": pa.array([table["_for"][0].as_py()], pa.int32()), "cells": pa.array([pickle.dumps(cells)], pa.binary())})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, cells, ids in zip(b["_for"].to_pylist(), b["cells"], b["ids"].to_pylist(), strict=True):
                draws = [(lambda m, node, j=j: drawn(fits[j], names, kinds, own[j], m, node)) if fits[j].third else None for j in ids]
                found = grown(pickle.loads(cells.as_py()), cuts[k].sizes(numeric, flags, kinds), [c not in kinds for c in names], [fits[j] for j in ids], [own[j] for j in ids], draws, patience)
                yield pa.RecordBatch.from_pylist([{"fit": j, "loss": loss, "trees": m} for j, (loss, m) in zip(ids, found, strict=True)], pa.schema([("fit", pa.int32()), ("loss", pa.float64()), ("trees", pa.int32())]))

    cells = materialise(binned.rows.groupBy("_for").applyInArrow(packed, "_for int, cells binary"), "cells")  # one row a fold
    alike = defaultdict(list)
    for j, f in enumerate(fits):
        alike[f.bag, -f.fold].append(j)
    shares = [of[i :: -(-len(of) // many)] for (bag, _), of in sorted(alike.items()) for many in [BAGGED if bag < 1 else PLAIN] for i in range(-(-len(of) // many))]
    work = train.sparkSession.createDataFrame([(i, fits[ids[0]].fold, ids) for i, ids in enumerate(shares)], "share int, _for int, ids array<int>")
    dealt = cells.join(F.broadcast(work), "_for").repartitionByRange(len(shares), "share")
    done = {r["fit"]: (r["loss"], r["trees"]) for r in dealt.select("_for", "cells", "ids").mapInArrow(grow, "fit int, loss double, trees int").collect()}  # one row a fit
    return [done[j] for j in range(len(fits))]


def boosted(train: DataFrame, numeric: Sequence[str], kinds: Sequence[str], fits: Sequence[Fit]) -> Model:
    """Fit `fits` to `train`: _for (fold of the fit), _y, _u (weight), _valid, and the columns; numbers have to be doubles.

    Weights of positives are multiplied by the ratio of class masses. Where a fold has `_valid` rows, boosting ends when their
    weighted log loss rises, and the trees up to the least loss stay.
    """
    numeric, kinds, fits = list(numeric), list(kinds), list(fits)
    return _boosted(_binned(train, numeric, kinds, fits), numeric, kinds, fits)


def _boosted(binned: Binned, numeric: list[str], kinds: list[str], fits: list[Fit], patience: int = 1) -> Model:
    rows, cuts, flags, names, own = binned.rows, binned.cuts, binned.flags, binned.names, binned.own
    forests: list[list[Tree]] = [[] for _ in fits]

    def one_pass(work: dict[int, list[int]]) -> dict[int, tuple[list[tuple], float, float]]:
        """For each fit of `work` the best splits of its open nodes, and the summed loss and weight of validating rows."""
        growing_of = {j: growing.get(j) for j in work}
        trees_of = {j: forests[j] for j in work}
        draws = {j: [drawn(fits[j], names, kinds, own[j], len(forests[j]), node) for node in nodes] if fits[j].third else None for j, nodes in work.items()}

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {j: np.zeros((len(nodes), len(own[j]), BINS, 3)) for j, nodes in work.items()}
            loss = defaultdict(lambda: np.zeros(2))
            seen = set()

            def take(k, bins, y, w, valid, key, n):
                bins = np.ascontiguousarray(bins.T)
                sign = 2.0 * y - 1
                for j, nodes in work.items():
                    f = fits[j]
                    if f.fold != k:
                        continue
                    seen.add(j)
                    f0 = margins(bins, trees_of[j], f.rate)
                    if valid.any():
                        loss[j] += (w[valid] * np.logaddexp(0, -2 * sign[valid] * f0[valid])).sum(), w[valid].sum()
                    if not nodes:
                        continue
                    kept = ~valid
                    if f.bag < 1:
                        kept &= _bagged(key, len(trees_of[j]), f.bag)
                    target = 4 * sign / (1 + np.exp(2 * sign * f0)) if trees_of[j] else sign
                    place = np.full(2 << f.depth, len(nodes))
                    place[nodes] = np.arange(len(nodes))
                    at = np.where(kept, place.take(growing_of[j].nodes(bins, nodes[0].bit_length() - 1)) * BINS, len(nodes) * BINS)
                    size, wt = (len(nodes) + 1) * BINS, w * target
                    for i, c in enumerate(own[j]):
                        cell = at + bins[c]
                        for s, v in enumerate((wt, w, n)):
                            sums[j][:, i, :, s] += np.bincount(cell, v, size)[:-BINS].reshape(-1, BINS)

            waiting = defaultdict(list)
            for b in batches:
                if not b.num_rows:
                    continue
                of, bins = b["_for"].to_numpy(), b["bins"].cast(pa.large_binary())
                start = int(np.frombuffer(bins.buffers()[1], np.int64)[bins.offset])
                raw = np.frombuffer(bins.buffers()[2], np.uint8)[start : start + len(of) * len(names)]
                arrays = [raw.reshape(len(of), -1), *(b[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "valid", "key", "n"))]
                for k in np.unique(of):
                    mine = of == k
                    waiting[k].append([a[mine] for a in arrays])
                    if sum(len(x[1]) for x in waiting[k]) >= BATCH:
                        take(k, *(np.concatenate(x) for x in zip(*waiting.pop(k), strict=True)))
            for k, parts in waiting.items():
                take(k, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            for j in sorted(seen):
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pylist([{"fit": j, "part": part, "sums": sums[j].tobytes(), "loss": loss[j][0], "mass": loss[j][1]}], pa.schema([("fit", pa.int32()), ("part", pa.int32()), ("sums", pa.binary()), ("loss", pa.float64()), ("mass", pa.float64())]))

        def pick(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")  # sums do not depend on the order of arrival
            j = table["fit"][0].as_py()
            shape = (len(work[j]), len(own[j]), BINS, 3)
            total = np.zeros(shape)
            for one in table["sums"]:
                total += np.frombuffer(one.as_py()).reshape(shape)
            ordered = [names[c] not in kinds for c in own[j]]
            best = [(own[j][s[0]] if s[0] >= 0 else -1, *s[1:]) for s in _best(total, fits[j], ordered, draws[j])]
            return pa.table({"fit": pa.array([j], pa.int32()), "best": [pickle.dumps(best)], "loss": [pc.sum(table["loss"]).as_py()], "mass": [pc.sum(table["mass"]).as_py()]})

        folds = sorted({fits[j].fold for j in work})
        summed = rows.where(F.col("_for").isin(folds)).mapInArrow(add_up, "fit int, part int, sums binary, loss double, mass double")
        picked = summed.groupBy("fit").applyInArrow(pick, "fit int, best binary, loss double, mass double").collect()  # one row a fit
        return {r["fit"]: (pickle.loads(r["best"]), r["loss"], r["mass"]) for r in picked}

    best: dict[int, tuple[float, int]] = {}
    live = set(range(len(fits)))
    growing: dict[int, Tree] = {}

    def judge(found: Mapping[int, tuple]) -> None:
        """Ends fits whose validating rows no longer gain by the last tree."""
        for j, (_, loss, mass) in found.items():
            if not mass or not forests[j]:
                continue
            now = loss / mass
            if j in best and best[j][0] < now and len(forests[j]) - best[j][1] >= patience:
                live.discard(j)
            elif j not in best or now < best[j][0]:
                best[j] = (now, len(forests[j]))

    for m in range(max(f.trees for f in fits)):
        growing = {j: Tree.of(fits[j].depth) for j in sorted(live) if m < fits[j].trees}
        work = {j: [1] for j in growing}
        level = 0
        while work:
            found = one_pass(work)
            if not level:
                judge(found)
            deeper = {}
            for j, (splits, _, _) in found.items():
                tree = growing[j]
                for node, (column, goes, value, left, right) in zip(work[j], splits, strict=True):
                    tree.value[node] = value
                    if column >= 0:
                        tree.column[node], tree.left[node] = column, goes
                        tree.value[2 * node], tree.value[2 * node + 1] = left, right
                        deeper.setdefault(j, []).extend((2 * node, 2 * node + 1))
                    else:
                        tree.close(node)
            level += 1
            work = {j: nodes for j, nodes in deeper.items() if j in live and level < fits[j].depth}
        for j in growing:
            if j in live:
                forests[j].append(growing[j])
    if best:
        growing = {}
        judge(one_pass({j: [] for j in sorted(live & set(best))}))
    forests = [t[: best[j][1]] if j in best else t for j, t in enumerate(forests)]
    return Model(numeric, flags, kinds, cuts, fits, forests, [best[j][0] if j in best else None for j in range(len(fits))])
