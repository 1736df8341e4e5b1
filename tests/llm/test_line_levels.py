"""The query's own parameters must make op6's levels: runs fill a level and are merged into the next."""

from __future__ import annotations

from collections import Counter

from stockflow.llm import line_dedup as LD
from tests.llm.test_dedup import _line_brute
from tests.llm.data import frame


def test_the_default_batches_fill_and_merge_levels(spark, monkeypatch):
    made = []

    class Watched(LD.LineRuns):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            made.append(self)

    monkeypatch.setattr(LD, "LineRuns", Watched)
    rows = [(i, f"a line that {i % 7} documents hold in common\nown line number {i} of the text", "en", "s", 1) for i in range(60)]
    got = LD.line_dedup(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == _line_brute(rows)
    (runs,) = made
    assert len(runs.levels) > 1 and runs.levels[1] and len(runs.levels[0]) < runs.fanout
    assert len(runs.updates) > 1 and runs.updates[1]
