"""Operator 3, benchmark decontamination by SimHash windows.

Words are runs of other characters than white space and ASCII punctuation, A-Z
lower-cased. An item's size class is the largest power of two, or one and a half
of one, not over its number of words, without an upper end. The SimHash of every
window of a class's size in every document comes from sliding sums of the words'
hash bits, doubled from size to size; a document of fewer words than the class is
one window. Each item has the SimHash of its first and of its last window of that
size, and of shorter anchor windows between: a window of the document at
``THRESHOLD`` or more leaves some ``_run`` of the item's words as they are, however
its edits (runs of words changed, put in or left out) lie, and the anchors stand so
close that one lies whole in any such run. So each such copy has an anchor at
distance 0; anchors are looked up within ``NEAR`` bits, class windows within
``RADIUS``.

Multi-index look-up: 64 bits are four blocks of 16; fingerprints at a distance of
up to ``RADIUS`` agree in some block up to RADIUS // 4 bits, and the index lists
the items under every value within that of theirs, so it gives every pair within
the radius. Long windows of one language come near each other by its common words;
those over ``LONG`` words are looked up only where enough of their shingles are in
the benchmark for any item of the class to reach the threshold. A pair places an item-sized window in the document, and the weighted
Jaccard similarity of 5-word shingles (weight: times that each occurs) of that
window and the item must be ``THRESHOLD`` or more.

The benchmark goes to the executors in blocks of ``BLOCK_CHARS`` characters (or
one longer item), one pass over the documents for each block; a block's index is
bounded by that size.

Defined cases: null and empty texts and items match nothing; an item of fewer
words than a shingle is one shingle, its whole sequence; of several windows of a
document that match an item the most similar (then the first) is reported; rows
that repeat a doc_id are reported as one document by ``matches`` and each on its
own by ``drop_contaminated``; a null ``doc_id`` is reported as null; extra columns
are ignored or kept; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import (WordHasher, lower_bytes, shingle_hashes, table, text_steps, word_bounds, word_spans)

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 10
BLOCK_CHARS = 4 << 20
STEP = 1 << 17
NEAR = 3
LONG = 128
#: Windows whose sums are held at once, and pairs that are compared at once.
WINDOWS = 1 << 16
PAIRS = 1 << 20


def _class(n: int) -> int:
    """The size class of n words: the largest power of two, or one and a half of one, up to n."""
    top = 1 << (n.bit_length() - 1)
    return top + top // 2 if top > 1 and n >= top + top // 2 else top


def _classes(most: int):
    """All size classes up to ``most``, ascending."""
    size = 1
    while size <= most:
        yield size
        size += size if size == 1 else size // 2 if size & (size - 1) == 0 else size // 3


def _run(n: int) -> int:
    """Words of an item of n that stand together unchanged in any window at THRESHOLD or more.

    Of its N shingles such a window lacks N / 9 at most, if it has as many, and
    N / 5 if it is shorter; an edit inside the item costs SHINGLE - 1 or more.
    """
    shingles = n - SHINGLE + 1
    edits = shingles // 9 // (SHINGLE - 1)
    kept = shingles - min(shingles // 5, shingles // 9 + SHINGLE - 1)
    return -(-kept // (edits + 1)) + SHINGLE - 1


def anchors(n: int) -> tuple[int, list[int]]:
    """Size and offsets of an item's anchor windows: one lies whole in every run of ``_run(n)`` words."""
    if n < 2 * SHINGLE - 1:  # a copy at the threshold has all of its shingles
        return _class(n), []
    run = _run(n)
    size = _class(max(1, (run + 1) * 3 // 4))
    steps = -(-(n - size) // (run - size + 1))
    return size, sorted({(n - size) * k // steps for k in range(steps + 1)}) if steps else [0]


def _plain() -> np.ndarray:
    """Bytes as they are, but ASCII punctuation as a space."""
    out = np.arange(256, dtype=np.uint8)
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = 32
    return out


def _words(data: np.ndarray, off: np.ndarray, plain: np.ndarray, hasher: WordHasher):
    data = lower_bytes(plain[data])
    start, end, doc = word_spans(data, off)
    return hasher(data, start, end), doc


def fingerprints(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """SimHashes of all windows of each size: size -> one for each start."""
    parts: dict[int, list] = {}
    sizes = {s for s in sizes if s <= len(words)}
    most = max(sizes, default=0)
    step = max(WINDOWS, 2 * most)
    for top in range(0, len(words) if sizes else 0, step):
        for size, got in _fingerprints(words[top:top + step + most - 1], sizes).items():
            parts.setdefault(size, []).append(got[:step])
    return {size: np.concatenate(x) for size, x in parts.items()}


def _fingerprints(words: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    sums = {1: np.unpackbits(words.view(np.uint8)).reshape(len(words), 64)}
    out = {}
    for size in _classes(min(max(sizes), len(words))):
        if size > 1:
            half = 1 << ((size - 1).bit_length() - 1)  # the sum of two sizes that are there
            a, b = sums[half], sums[size - half]
            n = len(words) - size + 1
            kind = np.uint8 if size < 256 else np.uint16 if size < 1 << 16 else np.uint32
            sums[size] = np.add(a[:n], b[half:half + n], dtype=kind)
            for old in [x for x in sums if 4 * x < size]:
                del sums[old]
        if size in sizes:
            bits = sums[size] * np.uint8(2) > size if size < 128 else sums[size] > size // 2
            out[size] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    return out


def whole_print(words: np.ndarray) -> np.uint64:
    """The SimHash of all words as one window."""
    total = np.zeros(64, np.int64)
    for top in range(0, len(words), WINDOWS):
        part = words[top:top + WINDOWS]
        total += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(words)).view(np.uint64)[0]


class BlockIndex:
    """Fingerprints by the value of each 16-bit block, under all values within radius // 4 bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        flips = [0]
        for k in range(1, radius // 4 + 1):
            flips += [sum(1 << b for b in bits) for bits in combinations(range(16), k)]
        flips = np.array(flips, np.uint16)
        self.first, self.items, self.some = [], [], []
        for b in range(4):
            values = (prints.view(np.uint16).reshape(-1, 4)[:, b][:, None] ^ flips[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.first.append(np.searchsorted(values[order], np.arange(65537)).astype(np.int32))
            self.items.append((order // len(flips)).astype(np.int32))
            self.some.append(np.diff(self.first[-1]) > 0)

    def pairs(self, windows: np.ndarray):
        """(window, print, distance) of all pairs within the radius, once each."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8))]
        blocks = windows.view(np.uint16).reshape(-1, 4)
        for b in range(4):
            some = np.flatnonzero(self.some[b][blocks[:, b]])
            v = blocks[some, b].astype(np.int64)
            first = self.first[b][v].astype(np.int64)
            count = self.first[b][v + 1] - first
            ends = np.cumsum(count)
            i = 0
            while i < len(some):  # about PAIRS at once, or one window's
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                lo, n = first[i:j], count[i:j]
                w = np.repeat(some[i:j], n)
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(w))
                p = self.items[b][at]
                d = np.bitwise_count(windows[w] ^ self.prints[p])
                near = d <= self.radius
                found.append((w[near], p[near], d[near]))
                i = j
        w, i, d = (np.concatenate(x) for x in zip(*found))
        once = np.unique(w * len(self.prints) + i, return_index=True)[1]
        return w[once], i[once], d[once]


class Items:
    """A block of benchmark items: their shingles, and an index of class windows and one of anchors for each size."""

    def __init__(self, ids: list, texts: list):
        plain, hasher = _plain(), WordHasher()
        self.ids, self.n, self.shingles = [], [], []
        prints: dict[tuple, list] = {}
        for item, (_, _, data, off) in zip(ids, text_steps(pa.array(texts, pa.string()), 0)):
            words, _ = _words(data, off, plain, hasher)
            n = len(words)
            if not n:
                continue
            size, (anchor, between) = _class(n), anchors(n)
            got = fingerprints(words, [size, anchor])
            me = len(self.ids)
            for s, radius, offsets in ((size, RADIUS, sorted({0, n - size})), (anchor, NEAR, between)):
                for offset in offsets:
                    prints.setdefault((s, radius), []).append((got[s][offset], me, offset))
            self.ids.append(item)
            self.n.append(n)
            self.shingles.append(np.unique(shingle_hashes(words, np.array([0, n]), SHINGLE)[0], return_counts=True))
        self.index = {k: (BlockIndex(np.array([p for p, _, _ in x], np.uint64), k[1]), np.array([i for _, i, _ in x]),
                          np.array([o for _, _, o in x])) for k, x in prints.items()}
        self.n = np.array(self.n, np.int64)
        #: Marks of all items' shingles by their last bits, to pass by windows that hold too few.
        total = sum(len(x) for x, _ in self.shingles)
        self.known = np.zeros(1 << max(10, total.bit_length() + 5), bool)
        for x, _ in self.shingles:
            self.known[x & (len(self.known) - 1)] = True

    def _similarity(self, item: int, shingles: np.ndarray) -> float:
        a, n_a = self.shingles[item]
        b, n_b = np.unique(shingles, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = int(np.minimum(n_a[i], n_b[j]).sum())
        return shared / max(1, int(n_a.sum() + n_b.sum()) - shared)

    @staticmethod
    def _windows(size, radius, prints, words, doc, bounds, shingled):
        """Starts and SimHashes of the windows to look up: those of ``size`` that lie in one
        document and, for class windows, the documents that are shorter but not too short."""
        at, asked = np.empty(0, np.int64), np.empty(0, np.uint64)
        if prints is not None:
            at = np.flatnonzero(doc[:len(prints)] == doc[size - 1:size - 1 + len(prints)])
            if radius == RADIUS and size > LONG:
                _, first, marks = shingled()
                lo = first[doc[at]] + at - bounds[doc[at]]
                # the longest item of the class, so the most shingles that a window may lack
                lack = (size + size // 2 - SHINGLE) // 9 + 1
                at = at[marks[lo + size - SHINGLE + 1] - marks[lo] >= size - SHINGLE + 1 - lack]
            asked = prints[at]
        if radius == RADIUS:
            n = np.diff(bounds)
            short = np.flatnonzero((n < size) & (n >= SHINGLE) & (n - SHINGLE + 1 >= THRESHOLD * (size - SHINGLE + 1)))
            if len(short):
                at = np.concatenate([at, bounds[short]])
                asked = np.concatenate([asked, np.array([whole_print(words[bounds[r]:bounds[r + 1]]) for r in short], np.uint64)])
        return at, asked

    def find(self, column):
        """(row, item number, similarity, start word, number of words, distance) for a string column."""
        plain, hasher = _plain(), WordHasher()
        out = []
        for row, _, data, off in text_steps(column, STEP):
            words, doc = _words(data, off, plain, hasher)
            bounds = word_bounds(doc, len(off) - 1)
            best: dict[tuple, tuple] = {}
            seen = None

            def shingled():
                nonlocal seen
                if seen is None:
                    shingles, first = shingle_hashes(words, bounds, SHINGLE)
                    marks = np.concatenate([[0], np.cumsum(self.known[shingles & (len(self.known) - 1)])])
                    seen = shingles, first, marks
                return seen
            prints = fingerprints(words, sorted({s for s, _ in self.index}))
            for size, radius in sorted(self.index):
                index, owner, offset = self.index[size, radius]
                at, asked = self._windows(size, radius, prints.get(size), words, doc, bounds, shingled)
                w, i, d = index.pairs(asked)
                if not len(w):
                    continue
                shingles, first, marks = shingled()
                at, item = at[w], owner[i]
                here = doc[at]
                a = np.maximum(bounds[here], at - offset[i]) - bounds[here]  # words of the document
                b = np.minimum(bounds[here + 1] - bounds[here], a + self.n[item])
                lo = first[here] + a                                         # and its shingles
                hi = first[here] + np.maximum(b - SHINGLE, 0) + 1
                hi = np.minimum(hi, first[here + 1])
                lo = np.minimum(lo, hi)
                short = b - a < SHINGLE  # a window of fewer words is one shingle of its own
                # a similarity of THRESHOLD needs that share of the window's shingles in the item
                some = np.flatnonzero(short | ((marks[hi] - marks[lo] >= THRESHOLD * (hi - lo)) & (hi > lo)))
                some = some[np.lexsort((d[some], a[some], item[some], here[some]))]
                done = None
                for k in some.tolist():
                    if done == (here[k], item[k], a[k]):  # the same place by another window
                        continue
                    done = here[k], item[k], a[k]
                    own = words[bounds[here[k]] + a[k]:bounds[here[k]] + b[k]]
                    s = self._similarity(int(item[k]), shingle_hashes(own, np.array([0, len(own)]), SHINGLE)[0]
                                         if short[k] else shingles[lo[k]:hi[k]])
                    if s >= THRESHOLD:
                        got = (s, -int(a[k]), int(b[k] - a[k]), -int(d[k]))
                        key = int(here[k]), int(item[k])
                        best[key] = max(best.get(key, got), got)
            out += [(row + r, item, s, -a, n, -d) for (r, item), (s, a, n, d) in best.items()]
        return out


def item_blocks(bench: DataFrame):
    """Lists of items (id, text) of about BLOCK_CHARS characters, in blocks by hash."""
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        yield Items([r["item_id"] for r in got], [r["text"] for r in got])


_HITS = ("doc_id long, item_id long, similarity double, start_word long, n_words long, distance int")


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text) and item of ``bench``
    (item_id, text) that it holds: doc_id, item_id, similarity, start_word, n_words, distance."""
    out = None
    for items in item_blocks(bench):
        held = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS of items

        def run(batches, held=held):
            for batch in batches:
                hits = held.value.find(batch.column(1))
                rows = [h[0] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())),
                     pa.array([held.value.ids[h[1]] for h in hits], pa.int64()),
                     *[pa.array([h[k] for h in hits], t) for k, t in
                       ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int32()))]],
                    names=["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"])
        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _HITS)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("start_word", "n_words", "distance"), F.struct("similarity", -F.col("start_word")))
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("at")).select(
        "doc_id", "item_id", "similarity", "at.start_word", "at.n_words", "at.distance")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``bench``, with all their columns."""
    at = docs.columns.index("text")
    for items in item_blocks(bench):
        held = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS of items

        def run(batches, held=held):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in held.value.find(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_simhash_decontamination": (op3_simhash_decontamination, None)}
