"""Forests that grow within one task, on the cells of a fold: rows of equal bins as one. A task grows several fits side by side.

The trees are those of `boosting`. What a tree needs of the trees before it are the odds of each cell, so time grows with trees
and cells, not with rows. Where columns are few and ordered and most combinations of their bins have rows, a node is a box of
bins, whose sums come from sums up to each corner; else cells are counted by node, column and bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import product
from math import frexp, prod

import numpy as np

BINS = 64
GRID = 1 << 20  # combinations of bins, at most, that are laid out as boxes
SPARSE = 8  # so many combinations for each cell make boxes slower than counting cells


@dataclass(frozen=True)
class Fit:
    """A classifier of a fold; `columns` are numbers and categories, `least` the rows of a leaf, `bag` the share of rows a tree
    sees. With `third` a node may split by a random third of the columns and flags; the draws are not those of Spark ML."""

    fold: int
    columns: tuple[str, ...]
    trees: int
    depth: int
    least: int = 1
    rate: float = 0.1
    bag: float = 1.0
    third: bool = False


@dataclass
class Tree:
    """Nodes by heap number from 1: column, bins that go left, value. What is no split sends all rows left, with its value."""

    column: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.zeros(n, np.int64), np.ones((n, BINS), bool), np.zeros(n))

    def close(self, node: int) -> None:
        while 2 * node < len(self.value):
            self.value[2 * node] = self.value[node]
            node *= 2

    def below(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes one level below the nodes `at` of the rows."""
        n = bins.shape[1]
        cell = self.column.take(at)
        cell *= n
        cell += np.arange(n)
        down = at * BINS
        down += bins.ravel().take(cell)
        return 2 * at + ~self.left.ravel().take(down)

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row after so many levels, all by default."""
        at = np.ones(bins.shape[1], np.int64)
        for _ in range(len(self.column).bit_length() - 2 if levels is None else levels):
            at = self.below(bins, at)
        return at


@lru_cache(1 << 17)
def _third(n: int, tree: int, node: int) -> tuple[int, ...]:
    return tuple(sorted(np.random.default_rng([7, tree, node]).choice(n, -(-n // 3), replace=False).tolist()))


def drawn(fit: Fit, names: Sequence[str], kinds: Sequence[str], own: Sequence[int], tree: int, node: int) -> list[int]:
    """Places in `own` of a random third of a fit's columns; flags of numbers that miss nothing count, but split nothing."""
    numbers = [c for c in fit.columns if c not in kinds]
    every = [*numbers, *(f"_na_{c}" for c in numbers), *(c for c in fit.columns if c in kinds)]
    return [own.index(names.index(every[i])) for i in _third(len(every), tree, node) if every[i] in names]


@dataclass
class Cells:
    """Bins by column and cell; by label and cell the weight and number of training rows and the weight of validating rows."""

    bins: np.ndarray
    w: np.ndarray
    n: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, bins: np.ndarray, y: np.ndarray, w: np.ndarray, valid: np.ndarray, n: np.ndarray) -> Cells:
        """From rows that differ in bins (one row of them each), label or part."""
        order = np.lexsort(bins.T[::-1])
        bins, y, w, valid, n = (x[order] for x in (bins, y, w, valid, n))
        new = np.ones(len(y), bool)
        new[1:] = (bins[1:] != bins[:-1]).any(axis=1)
        at = np.cumsum(new) - 1
        out = cls(np.ascontiguousarray(bins[new].T), *(np.zeros((2, new.sum())) for _ in range(3)))
        for part, to, x in ((~valid, out.w, w), (~valid, out.n, n), (valid, out.v, w)):
            to[y[part], at[part]] = x[part]
        out.w = out.whole(out.w)
        return out

    @cached_property
    def unit(self) -> float:
        return 2.0 ** (frexp(4 * self.w.sum())[1] - 48)

    def whole(self, x: np.ndarray) -> np.ndarray:
        """Weights or targets as multiples of a unit, so that their sums and differences are exact and equal splits tie."""
        x = x / self.unit
        np.rint(x, out=x)
        x *= self.unit
        return x

    def laid_out(self, sizes: Sequence[int]) -> Cells:
        """All combinations of bins as cells, in order."""
        at = np.ravel_multi_index(tuple(self.bins), sizes)
        out = [np.zeros((2, prod(sizes))) for _ in range(3)]
        for to, x in zip(out, (self.w, self.n, self.v), strict=True):
            to[:, at] = x
        grid = Cells(np.stack(np.unravel_index(np.arange(prod(sizes)), sizes)).astype(np.uint8), *out)
        grid.unit = self.unit
        return grid

    def bagged(self, tree: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Weight and number of the rows that a tree sees: each row with the same chance, so a binomial number of each cell's, with their mean weight."""
        some = np.flatnonzero(self.n)
        of = self.n.ravel()[some]
        seen = np.random.default_rng([11, tree]).binomial(of.astype(np.int64), share)
        w, n = np.zeros(self.n.size), np.zeros(self.n.size)
        n[some] = seen
        w[some] = self.whole(self.w.ravel()[some] * (seen / of))
        return w.reshape(self.w.shape), n.reshape(self.n.shape)


class Counted:
    """Sums by node, column and bin, counted over cells."""

    def __init__(self, cells: Cells, ordered: Sequence[bool]) -> None:
        self.cells, self.ordered = cells, ordered

    def load(self, w: np.ndarray, n: np.ndarray) -> None:
        self.w, self.n = w.sum(axis=0), n.sum(axis=0)

    def start(self, target: np.ndarray) -> None:
        self.target, self.at = target, np.ones(len(target), np.int64)

    def left(self, nodes: Sequence[int], own: Sequence[int]) -> tuple[np.ndarray, np.ndarray | None]:
        """Targets, weights and rows up to each bin by node and column, and the order of bins if it is not their own."""
        place = np.full(1 << nodes[0].bit_length(), len(nodes))
        place[list(nodes)] = np.arange(len(nodes))
        at, size = place.take(self.at) * BINS, (len(nodes) + 1) * BINS
        sums = np.empty((3, len(nodes), len(own), BINS))
        for i, c in enumerate(own):
            cell = at + self.cells.bins[c]
            for s, v in enumerate((self.target, self.w, self.n)):
                sums[s, :, i] = np.bincount(cell, v, size)[:-BINS].reshape(-1, BINS)
        order = None
        if not all(self.ordered[c] for c in own):
            mean = np.where(sums[2] > 0, sums[0] / sums[1], np.inf)
            given = np.array([self.ordered[c] for c in own])[:, None]
            order = np.where(given, np.arange(BINS), np.argsort(mean, axis=-1, kind="stable"))
            sums = np.take_along_axis(sums, order[None], axis=-1)
        return np.cumsum(sums, axis=-1, out=sums), order

    def split(self, tree: Tree, chosen: Sequence[tuple[int, int, int]]) -> None:
        self.at = tree.below(self.cells.bins, self.at)

    def multiply(self, odds: np.ndarray, tree: Tree, factor: np.ndarray) -> None:
        at, levels = self.at, len(tree.value).bit_length() - 1
        while int(at[0]).bit_length() < levels:
            at = 2 * at  # all that is below is closed
        odds *= factor.take(at)


class Boxes:
    """Sums of boxes of bins, each from sums up to its corners; all columns are ordered."""

    def __init__(self, cells: Cells, sizes: Sequence[int]) -> None:
        d, wide = len(sizes), [s + 1 for s in sizes]
        self.sizes, self.w, self.n, self.target = tuple(sizes), *(np.zeros(wide) for _ in range(3))
        self.step = np.array([prod(wide[i + 1 :]) for i in range(d)])
        ends = np.array(list(product((0, 1), repeat=d - 1)), np.int64).reshape(2 ** (d - 1), d - 1)
        self.sign = np.prod(2.0 * ends - 1, axis=1)
        self.high = np.stack([np.insert(ends, c, 0, axis=1) for c in range(d)])  # column, corner, dimension
        self.low = np.stack([np.insert(1 - ends, c, 0, axis=1) for c in range(d)])

    def _upto(self, x: np.ndarray, out: np.ndarray) -> None:
        out[(slice(1, None),) * x.ndim] = x
        for axis in range(x.ndim - 1):
            lines = np.moveaxis(out, axis, 0)
            for i in range(2, len(lines)):
                lines[i] += lines[i - 1]
        np.cumsum(out, axis=-1, out=out)

    def load(self, w: np.ndarray, n: np.ndarray) -> None:
        self._upto(w.sum(axis=0).reshape(self.sizes), self.w)
        self._upto(n.sum(axis=0).reshape(self.sizes), self.n)

    def start(self, target: np.ndarray) -> None:
        self._upto(target.reshape(self.sizes), self.target)
        self.box = {1: (np.zeros(len(self.sizes), np.int64), np.array(self.sizes))}

    def left(self, nodes: Sequence[int], own: Sequence[int]) -> tuple[np.ndarray, None]:
        low, high = (np.stack([self.box[node][i] for node in nodes]) for i in (0, 1))
        corner = np.einsum("kd,jcd->kjc", low * self.step, self.low[own]) + np.einsum("kd,jcd->kjc", high * self.step, self.high[own])
        along = np.clip(np.arange(BINS + 1), low[:, own, None], high[:, own, None]) * self.step[own][:, None]
        at = corner[:, :, :, None] + along[:, :, None, :]
        lines = np.stack([np.einsum("c,kjcx->kjx", self.sign, x.ravel().take(at)) for x in (self.target, self.w, self.n)])
        return lines[..., 1:] - lines[..., :1], None

    def split(self, tree: Tree, chosen: Sequence[tuple[int, int, int]]) -> None:
        for node, column, last in chosen:
            low, high = self.box.pop(node)
            self.box[2 * node], self.box[2 * node + 1] = (low, high.copy()), (low.copy(), high)
            self.box[2 * node][1][column] = self.box[2 * node + 1][0][column] = last + 1

    def multiply(self, odds: np.ndarray, tree: Tree, factor: np.ndarray) -> None:
        odds = odds.reshape(self.sizes)
        levels = len(tree.value).bit_length() - 1
        for node, (low, high) in self.box.items():
            odds[tuple(map(slice, low, high))] *= factor[node << (levels - node.bit_length())]


@dataclass
class Growing:
    """A fit's forest: the odds of cells after its trees, and the least loss of validating rows with the trees up to it."""

    fit: Fit
    own: list[int]
    drawn: Callable[[int, int], list[int]] | None
    odds: np.ndarray
    trees: int = 0
    loss: float | None = None
    best: int = 0
    over: bool = False

    def add(self, cells: Cells, layout: Counted | Boxes, w: np.ndarray, both: np.ndarray) -> None:
        """One more tree; `both` has the weights `w` of both labels."""
        fit, m = self.fit, self.trees
        if m:
            target = 4 / (1 + self.odds)
            target *= both
            target -= 4 * w[0]
        else:
            target = w[1] - w[0]
        layout.start(cells.whole(target))
        tree, nodes = Tree.of(fit.depth), [1]
        for _ in range(fit.depth):
            left, order = layout.left(nodes, self.own)
            total = left[..., -1:]
            right = total - left
            (a, u, n), (ra, ru, rn), (ta, tu, _) = left, right, total
            gain = (a * a / u + ra * ra / ru - ta * ta / tu) / tu
            few = max(fit.least, 1)
            gain[(n < few) | (rn < few) | (u <= 0) | (ru <= 0)] = 0.0
            if self.drawn:
                may = np.zeros(gain.shape[:2])
                for k, node in enumerate(nodes):
                    may[k, self.drawn(m, node)] = 1.0
                gain *= may[:, :, None]
            flat = gain.reshape(len(nodes), -1)
            found = flat.argmax(axis=1)
            chosen = []
            for k, (node, i) in enumerate(zip(nodes, found.tolist(), strict=True)):
                j, last = divmod(i, BINS)
                tree.value[node] = ta[k, 0, 0] / tu[k, 0, 0] if tu[k, 0, 0] > 0 else 0.0
                if flat[k, i] <= 1e-15:
                    tree.close(node)
                    continue
                tree.column[node] = self.own[j]
                tree.left[node] = False
                tree.left[node, slice(last + 1) if order is None else order[k, j, : last + 1]] = True
                tree.value[2 * node], tree.value[2 * node + 1] = a[k, j, last] / u[k, j, last], ra[k, j, last] / ru[k, j, last]
                chosen.append((node, self.own[j], last))
            if not chosen:
                break
            layout.split(tree, chosen)
            nodes = [child for node, _, _ in chosen for child in (2 * node, 2 * node + 1)]
        layout.multiply(self.odds, tree, np.exp(2 * (fit.rate if m else 1.0) * tree.value))
        if 2 * (1 + 4 * fit.rate * fit.trees) > 700:
            np.clip(self.odds, 1e-300, 1e300, out=self.odds)
        self.trees += 1

    def judge(self, of: Sequence[np.ndarray], v: Sequence[np.ndarray], mass: float, patience: int) -> None:
        """`of` and `v` are validating cells and their weights by label."""
        now = float((v[0] * np.log(1 + self.odds.take(of[0]))).sum() + (v[1] * np.log(1 + 1 / self.odds.take(of[1]))).sum()) / mass
        if self.loss is None or now < self.loss:
            self.loss, self.best = now, self.trees
        self.over = now > self.loss and self.trees - self.best >= patience


def grown(
    cells: Cells, sizes: Sequence[int], ordered: Sequence[bool], fits: Sequence[Fit], own: Sequence[list[int]], draws: Sequence[Callable[[int, int], list[int]] | None], patience: int,
) -> list[tuple[float | None, int]]:
    """Least loss of validating rows and number of trees of each fit; all fits have the same `bag`.

    A fit ends after its trees, or where a loss is above the least and `patience` trees have not lowered that.
    """
    boxes = all(ordered) and prod(sizes) <= min(GRID, SPARSE * cells.bins.shape[1]) and len(sizes) <= 6
    cells = cells.laid_out(sizes) if boxes else cells
    layout = Boxes(cells, sizes) if boxes else Counted(cells, ordered)
    all_of = [Growing(f, list(o), d, np.ones(cells.bins.shape[1])) for f, o, d in zip(fits, own, draws, strict=True)]
    of, mass, w = [np.flatnonzero(v) for v in cells.v], float(cells.v.sum()), cells.w
    both = w[0] + w[1]
    v = [x[i] for x, i in zip(cells.v, of, strict=True)]
    layout.load(cells.w, cells.n)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # sides without rows; no split is taken from them
        for m in range(max(f.trees for f in fits)):
            live = [g for g in all_of if m < g.fit.trees and not g.over]
            if not live:
                break
            if fits[0].bag < 1:
                w, n = cells.bagged(m, fits[0].bag)
                layout.load(w, n)
                both = w[0] + w[1]
            for g in live:
                g.add(cells, layout, w, both)
                if mass:
                    g.judge(of, v, mass, patience)
    return [(g.loss, g.best if g.loss is not None else g.trees) for g in all_of]
