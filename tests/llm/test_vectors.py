"""Hard negatives and nearest neighbours against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from stockflow.llm import hard_negatives as H
from stockflow.llm import vantage_search as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(seed: int, n: int, width: int = 7):
    rng = random.Random(seed)
    one = [0.5] * width
    out = []
    for i in range(n):
        v = one if i % 3 == 0 else [round(rng.gauss(0, 1), 1 + i % 2) for _ in range(width)]
        out.append((i, [float(np.float32(x)) for x in v], rng.randrange(4)))
    nan, inf = float("nan"), float("inf")
    return out + [(n + 1, None, 1), (n + 2, [nan] * width, 1), (n + 3, [inf] + [0.0] * (width - 1), 1),
                  (n + 4, [None] + [1.0] * (width - 1), 2), (n + 5, [0.0] * width, 2), (n + 6, one, None),
                  (n + 7, [1.0, 2.0], 3), (None, one, 1), (n + 8, [], 1)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr(
        "*", "vec_id AS row", "vec_id AS score", "vec_id AS rank", "vec_id AS c", "vec_id AS x", "vec_id AS shard")


def _good(rows, zero: bool):
    return [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def test_strassen_equals_the_product():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (17, 33, 40), (64, 64, 64), (100, 65, 31), (70, 129, 200), (40, 0, 50)):
        a, b = rng.integers(-10 ** 6, 10 ** 6, (m, k)), rng.integers(-10 ** 6, 10 ** 6, (k, n))
        assert (H.strassen(a, b) == a @ b).all()
    a = rng.integers(-2 ** 29, 2 ** 29, (40, 16 + 2))  # sums on the way leave 64 bits, results don't
    assert (H.strassen(a, a.T) == (a.astype(object) @ a.T.astype(object))).all()


def _negatives(rows):
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in e]) for i, e, lab in _good(rows, True)
         if lab is not None]
    out = []
    for i, lab, c in v:
        if i % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(c, d)), j, x) for j, x, d in v if j != i)
        for ps, p in [(-s_, j) for s_, j, x in s if x == lab][:5]:
            near = [(-s_, j) for s_, j, x in s if x != lab and 80 * ps <= -100 * s_ <= 100 * ps][:5]
            out += [(i, p, r, j, ps, ns) for r, (ns, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [(1024, 4096), (2, 37)])
def test_hard_negatives(spark, tile):
    rows = _rows(2, 420)
    got = H.prepared(_frame(spark, rows)).checkpoint()
    got = H.hard_negatives(got, got.filter("vec_id % 100 = 0"), tile=tile)
    want = _negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_no_anchors_no_rows(spark):
    none = H.prepared(_frame(spark, [])).checkpoint()
    assert H.hard_negatives(none, none).count() == 0
    alone = H.prepared(_frame(spark, [(100, [1.0, 2.0], 1), (3, [1.0, 1.0], 2)])).checkpoint()
    assert H.hard_negatives(alone, alone.filter("vec_id = 100")).count() == 0


def test_scores_that_a_long_cannot_hold_are_an_error():
    import pyarrow as pa
    side = pa.table({"vec_id": [1], "c": [[1 << 40, 1 << 40]]})
    with pytest.raises(OverflowError):
        H._tile(side, side)


def _in_order(q, x):
    total = 0.0
    for a, b in zip(q, x):
        total += a * b
    return total


def _nearest(rows, step: int, k: int):
    v = _good(rows, False)
    out = []
    for i, q, _ in v:
        if i % step == 0:
            s = sorted((-_in_order(q, x), j) for j, x, _ in v if j != i)[:k]
            out += [(i, r, j, -t) for r, (t, j) in enumerate(s, 1)]
    return sorted(out)


def _search(spark, rows, step, k, factor=1.0, shard=4096, at_once=2048):
    v = V.prepared(_frame(spark, rows)).selectExpr("monotonically_increasing_id() AS row", "vec_id", "x").checkpoint()
    index = V.build_index(v.select("vec_id", "x"), k, shard).checkpoint()
    assert index.count() >= len(v.select("x").distinct().collect()) / shard / 2
    return sorted(tuple(r) for r in V.search(index, v.filter(f"vec_id % {step} = 0"), k, factor, at_once).collect())


@pytest.mark.parametrize("shard,at_once", [(4096, 2048), (60, 9)])
def test_factor_one_is_exact(spark, shard, at_once):
    rows = _rows(4, 400)
    assert _search(spark, rows, 20, 5, shard=shard, at_once=at_once) == _nearest(rows, 20, 5)


def test_fewer_candidates_than_asked_for_and_repeated_rows(spark):
    rows = [(20, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 2), (5, [0.0, 1.0], 1)]
    assert _search(spark, rows, 20, 20) == [(20, 1, 3, 2.0), (20, 2, 5, 0.0)]
    assert _search(spark, [], 20, 20) == []


def test_the_factor_trades_neighbours_for_comparisons():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 6)) * rng.uniform(0.5, 2, (4000, 1))
    order, tree = V.build_tree(x, 32)
    assert sorted(order) == list(range(4000))
    q = x[:60]
    true = np.sort(q @ x.T, axis=1)[:, ::-1][:, :20]
    seen, recall = [], []
    for factor in (1.0, 0.8, 0.4):
        s = V.Search(x[order], np.arange(4000), tree, q, 20, factor)
        seen.append(s.seen)
        recall.append(np.mean([np.isin(np.round(t, 9), np.round(g, 9)).mean() for t, g in zip(true, s.score)]))
    assert recall[0] == 1.0 and seen[0] < 0.8 * 60 * 4000     # pruning alone saves work and loses nothing
    assert seen[0] > seen[1] > seen[2] and recall[0] >= recall[1] >= 0.9 > recall[2]
