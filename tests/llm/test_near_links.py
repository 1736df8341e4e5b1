"""Near classes along a chain of edits, and doc_ids on rows with different texts."""

from __future__ import annotations

import random

from stockflow.llm import minhash_dedup as MD
from tests.llm.data import frame, prose
from tests.llm.test_dedup import _near_brute


def test_a_chain_of_edits_is_one_class(spark):
    rng = random.Random(21)
    rows = [(1000, prose(rng, 200, 4000), "en", "s", 1)]
    for i in range(40):
        w = rows[-1][1].split(" ")
        at = rng.randrange(len(w) - 4)
        w[at:at + 4] = [f"step{i}x{j}" for j in range(4)]
        rows.append((1001 + i, " ".join(w), "en", "s", 1))
    assert len(rows) == 41
    want = _near_brute(rows, 5, 80)
    assert {c for _, c in want.values()} == {1000}
    got = MD.near_classes(frame(spark, rows), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_every_set_of_a_doc_id_is_kept(spark):
    rng = random.Random(22)
    texts = [prose(rng, 90, 4000) for _ in range(3)]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1), (1, texts[1], "en", "s", 1), (2, texts[2], "en", "s", 1)]
    docs = frame(spark, rows, clash=False).select("doc_id", "text")
    nodes = MD.sketches(docs, 5).filter("n_shingles > 0").selectExpr("doc_id AS node", "d1", "d2", "n_shingles AS n").distinct()
    assert sorted(r["node"] for r in MD.full_sets(nodes, docs, 5).collect()) == [1, 1, 2]
    for k in (0, 1):  # a near copy of either text is linked with the doc_id
        w = texts[k].split(" ")
        w[40] = "edited"
        got = MD.near_classes(frame(spark, [*rows, (7, " ".join(w), "en", "s", 1)]), 5, 80).collect()
        assert {r["component_id"] for r in got if r["doc_id"] == 7} == {1}
