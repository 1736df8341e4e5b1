"""Ranks and quantiles over range partitions, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stockflow.operators import sorts as SO


@pytest.mark.parametrize("limit", [1, 8, 1 << 16])
def test_ranks_with_ties_over_borders(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(200)]
    rows += [("hot", 7, 1000 + i) for i in range(100)]          # a third of the rows tie
    df = spark.createDataFrame(rows, "a string, b long, i long").repartition(5)

    def key(r):      # a ascending with NULLs first, b descending with NULLs last
        return (r[0] is not None, r[0] or "", r[1] is None, -(r[1] or 0))
    keys = sorted(key(r) for r in rows)
    want = {r[2]: keys.index(key(r)) + 1 for r in rows}
    got = SO.rank_by_ranges(df, [("a", True), ("b", False)], limit=limit).collect()
    assert {r["i"]: r["posicion"] for r in got} == want and len(got) == len(rows)


def test_ranks_of_nothing(spark):
    assert SO.rank_by_ranges(spark.createDataFrame([], "a long"), [("a", True)]).count() == 0


@pytest.mark.parametrize("limit", [2, 1 << 16])
def test_quantiles_by_selection(spark, limit):
    rng = random.Random(3)
    values = [rng.randint(-50, 50) for _ in range(501)] + [7] * 300 + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(4)
    probs = {"least": 0.0, "q": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}
    got = SO.quantiles(df, "v", probs, limit).first()
    known = [v for v in values if v is not None]
    for p, q in probs.items():
        assert abs(got[p] - np.quantile(known, q)) < 1e-9
    one = SO.quantiles(spark.createDataFrame([(4,)], "v int"), "v", {"m": 0.5}, limit).first()
    assert one["m"] == 4.0
    assert SO.quantiles(df.where("v > 99"), "v", {"m": 0.5}, limit).first()["m"] is None
