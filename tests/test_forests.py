"""Forests grown within tasks: the whole search is registered, and both layouts of cells and the passes over rows give the same."""

import inspect
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large_steps import mixed_events

from tidewater.operators import boosting as B
from tidewater.operators import forests as T
from tidewater.operators import models as L
from tidewater.operators import search as H
from tidewater.plans import model_queries as Q
from tidewater.sources.store import scope

NAMES = ["a", "b", "c"]


def planted(n, sizes, seed=3):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    y = (bins @ (1 / np.array(sizes)) + 0.3 * rng.random(n) > 1.2 + 0.15).astype(np.int8)
    valid = np.arange(n) >= 3 * n // 4
    key, at = np.unique(np.column_stack([bins, y, valid]), axis=0, return_inverse=True)
    w = np.bincount(at.ravel(), 0.5 + rng.random(n))
    return T.Cells.of(key[:, :3].astype(np.uint8), key[:, 3], w, key[:, 4].astype(bool), np.bincount(at.ravel()).astype(float))


def test_the_whole_search_is_registered(spark, monkeypatch):
    asked = {}

    def search(*args, **named):
        asked.update(inspect.signature(whole).bind(*args, **named).arguments)
        return spark.createDataFrame([], "fold int, config_id string, inner_loss double, trees int, won boolean")

    whole = H.nested_search
    monkeypatch.setattr(H, "nested_search", search)
    Q.Q["nested_search"](spark, "/root/testdata/sf0.001")
    default = {k: p.default for k, p in inspect.signature(whole).parameters.items()}
    assert len(H.configurations(asked.get("axes", default["axes"]))) == 108 and list(asked["folds"]) == [2, 3, 4, 5]
    assert asked.get("iterations", default["iterations"]) == 1500 and asked.get("patience", default["patience"]) == 50


def test_boxes_and_counted_cells_grow_the_same_forests(monkeypatch):
    cells, sizes = planted(4000, [13, 9, 16]), [13, 9, 16]
    plain = [T.Fit(2, tuple(NAMES), 40, depth, least, 0.3, third=third) for depth in (1, 4) for least in (1, 30) for third in (False, True)]
    for fits in (plain, [replace(f, bag=0.8) for f in plain]):
        draws = [(lambda m, node, f=f: T.drawn(f, NAMES, [], [0, 1, 2], m, node)) if f.third else None for f in fits]
        found = []
        for sparse in (10**9, 0):
            monkeypatch.setattr(T, "SPARSE", sparse)
            found.append(T.grown(cells, sizes, [True] * 3, fits, [[0, 1, 2]] * len(fits), draws, 5))
        assert found[0] == found[1] and len({loss for loss, _ in found[0]}) > 4
        assert all(loss < np.log(2) and 1 <= trees <= 40 for loss, trees in found[0])


def test_boosting_goes_on_for_the_patience(monkeypatch):
    cells, sizes = planted(700, [13, 9, 16]), [13, 9, 16]
    run = lambda trees, patience: T.grown(cells, sizes, [True] * 3, [T.Fit(2, tuple(NAMES), trees, 4, 1, 0.5, bag=0.3)], [[0, 1, 2]], [None], patience)[0]
    losses = np.minimum.accumulate([run(m, 10**6)[0] for m in range(1, 61)])
    ended = {p: run(60, p) for p in (1, 2, 10**6)}
    assert ended[10**6] == (losses[-1], int(np.argmin(losses)) + 1)
    assert ended[1][1] <= ended[2][1] <= ended[10**6][1] and ended[1][0] > ended[10**6][0]
    assert all(loss == losses[trees - 1] for loss, trees in ended.values())


def test_bags_take_each_row_with_the_same_chance():
    cells = planted(4000, [13, 9, 16])
    taken = [cells.bagged(tree, 0.8) for tree in range(200)]
    w, n = (np.array([x[i] for x in taken]) for i in (0, 1))
    one = cells.n == 1
    assert set(np.unique(n[:, one])) == {0, 1} and np.array_equal(w[:, one], n[:, one] * cells.w[one])
    assert (n <= cells.n).all() and n[:, cells.n > 0].sum() / cells.n.sum() / 200 == pytest.approx(0.8, abs=0.005)
    many = cells.n >= 2
    assert n[:, many].var(axis=0).sum() == pytest.approx(0.16 * cells.n[many].sum(), rel=0.05)
    assert w.sum() / cells.w.sum() / 200 == pytest.approx(0.8, abs=0.005)
    assert np.array_equal(cells.bagged(7, 0.8)[1], n[7])


@pytest.mark.parametrize(("numeric", "kinds"), [(["a", "b"], ["c"]), (["b"], [])])
def test_tasks_grow_the_forests_of_passes(spark, monkeypatch, numeric, kinds):
    e = mixed_events(spark).withColumn("symbol", F.lit("s"))
    rows = L._flagged(H.inner_rows(e, [2, 3], 0, 0.25), numeric, "win").withColumn("_u", F.col("u"))
    fits = [B.Fit(k, (*numeric, *kinds), 6, depth, 5, 0.4, third=third) for k in (2, 3) for depth in (2, 4) for third in (False, True)]
    with scope() as written:
        within = B.judged(rows, numeric, kinds, fits, 2)
    assert any("/cells-" in p for p in written)
    monkeypatch.setattr(B, "CELLS", 0)
    with scope() as written:
        passes = B.judged(rows, numeric, kinds, fits, 2)
    assert not any("/cells-" in p for p in written)
    assert [m for _, m in within] == [m for _, m in passes]
    assert [x for x, _ in within] == pytest.approx([x for x, _ in passes], abs=1e-9)


def test_bagged_fits_do_not_depend_on_the_layout(spark):
    e = mixed_events(spark, 900).withColumn("symbol", F.lit("s"))
    axes = {"depth": [3], "l2": [3], "rate": [0.3], "w": [1, 2], "bag": [0, 1]}
    run = lambda df: {(r.fold, r.config_id): (r.inner_loss, r.trees) for r in H.nested_search(df, ["a", "b"], ["c"], "win", "u", [2, 3], 0, axes, iterations=5, patience=3).collect()}
    got = run(e)
    assert len(got) == 8 and len({x for x, _ in got.values()}) == 8 and got == run(e.repartition(3, "b"))
