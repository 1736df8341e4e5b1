"""Decontamination of long items, of copies changed at their ends and of documents shorter than the item's class."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from stockflow.llm import decontaminate as DC
from tests.llm.data import frame, prose


def _found(items, texts):
    held = DC.Items([k for k, _ in items], [t for _, t in items])
    return {(row, held.ids[item]): s for row, item, s, *_ in held.find(pa.array(texts, pa.string()))}


def test_long_items_with_both_ends_changed(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, n, 4000)) for k, n in enumerate((60, 130, 300, 700, 1000, 2000, 2000, 5000))]
    rows = []
    for k, t in items:
        w = t.split()
        cut = (len(w) - 4) // 20                         # a tenth of the shingles
        w[:cut] = [f"head{k}x{i}" for i in range(cut)]
        w[len(w) - cut:] = [f"tail{k}x{i}" for i in range(cut)]
        rows.append((k, prose(rng, 50, 4000) + " " + " ".join(w) + " " + prose(rng, 50, 4000), "en", "s", 1))
        far = t.split()
        far[:len(far) // 4] = prose(rng, len(far) // 4, 4000).split()
        rows.append((100 + k, " ".join(far), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in DC.matches(frame(spark, rows), bench).collect()}
    assert got == {(k, k) for k, _ in items}


def test_every_copy_over_the_threshold_is_found():
    rng = random.Random(12)
    items = [(k, prose(rng, rng.choice((9, 12, 16, 22, 30, 50, 95, 128, 400, 1500)), 4000)) for k in range(60)]
    texts, want = [], {}
    for k, t in items:
        for _ in range(6):
            w, spare = t.split(), max(1, len(t.split()) // 9)
            for _ in range(rng.randint(0, 5)):
                at, n = rng.randrange(len(w)), rng.randint(1, max(1, spare // 2))
                kind = rng.randrange(3)
                w[at:at + (n if kind else 0)] = [f"new{rng.random()}" for _ in range(n if kind < 2 else 0)]
            before = prose(rng, 20, 4000).split() if rng.random() < 0.5 else []
            texts.append(" ".join(before + w))
            held = DC.Items([k], [t])
            doc, _ = DC._words(*_bytes(texts[-1]), DC._plain(), DC.WordHasher())
            n = held.n[0]
            best = max(held._similarity(0, DC.shingle_hashes(doc[a:a + n], np.array([0, len(doc[a:a + n])]), DC.SHINGLE)[0])
                       for a in {0, len(before), max(0, len(doc) - n)})
            if best >= DC.THRESHOLD:
                want[len(texts) - 1, k] = best
    got = _found(items, texts)
    assert len(want) > 60 and set(want) <= set(got)
    assert all(s >= DC.THRESHOLD for s in got.values())


def _bytes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_documents_shorter_than_the_class():
    rng = random.Random(13)
    for n in (12, 16, 32, 96, 128, 192, 1024):
        t = prose(rng, n, 4000)
        short = t.split()[:n - (n - 4) // 8]
        assert len(short) < DC._class(n)
        assert set(_found([(7, t)], [" ".join(short), " ".join(t.split()[-len(short):]), None])) == {(0, 7), (1, 7)}


def test_anchors_lie_in_every_run():
    for n in [*range(9, 150), *range(150, 3000, 97)]:
        size, offsets = DC.anchors(n)
        run = DC._run(n)
        starts = np.array(offsets)
        for at in range(n - run + 1):
            assert ((starts >= at) & (starts + size <= at + run)).any()


def test_windows_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sizes = [1, 24, 192, 256, 384, 1024]
    whole = DC.fingerprints(h, sizes)
    monkeypatch.setattr(DC, "WINDOWS", 100)
    apart = DC.fingerprints(h, sizes)
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    for size in sizes:
        assert (whole[size] == apart[size]).all() and len(whole[size]) == 3001 - size
        for at in (0, 1500, 3000 - size):
            assert whole[size][at] == np.packbits(bits[at:at + size].sum(0) * 2 > size).view(np.uint64)[0]
            assert DC.whole_print(h[at:at + size]) == whole[size][at]
