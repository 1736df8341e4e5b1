"""Operator 1, LM scoring by context-tree weighting.

A text is the bytes of its words (A-Z lower-cased) with one space between words
and one end after the last. Each byte is eight binary decisions; a decision has
a node for each depth 0 to ``DEPTH`` of preceding bytes, with the counts of both
outcomes in the training texts. A node's Krichevsky-Trofimov probability of its
counts is mixed half and half with the product of the weighted probabilities of
the nodes one byte deeper, which gives the weight of its estimate against the
deeper ones'; a node that training never reached takes the estimate above it.
The score is the log10 probability of all bytes; the base score is that of an
add-one unigram model of the words and the end.

Counts are gathered from all training texts, in chunks of ``CHUNK_ROWS`` rows of
the input files. A chunk sends its distinct byte runs (context and byte) and word
hashes with their training counts, in buckets by the two nearest context bytes or
by hash, as packed arrays; a bucket adds them up. All subtrees from depth 2 on lie
in one bucket; the two depths above are sums over buckets of 65,280 rows at most,
which the driver holds. A bucket then answers each chunk with the log probability
of the runs, and counts of the words, that the chunk has sent, and the chunk's
texts are scored against these. Nothing that grows with the corpus is broadcast,
and a chunk or a bucket holds a bounded number of rows; the number of buckets
grows with the input. Words are known by 64-bit hashes.

Defined cases: null and empty texts are the end alone; with no training text every
bit has probability 1/2 and base_score is that of an empty vocabulary; a null
``doc_id`` isn't held out; rows that repeat a doc_id are scored each; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import (HashArray, WordHasher, lower_bytes, mix, stored, table, text_steps, word_bounds,
                                  word_spans)

DEPTH = 5
CHUNK_ROWS = 5000
LEAST_BUCKETS = 48
STEP = 2 << 20
END_WORD = np.uint64(0x00E4D00000000001)
_BLOBS = "kind string, bucket int, chunk long, keys binary, counts binary"


# -- packed arrays --------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Byte planes of whole numbers, compressed."""
    v = np.ascontiguousarray(values.astype("<u8"))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return len(v).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def add_up(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.empty(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.empty(0, np.uint64)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts[order], heads)


# -- texts ----------------------------------------------------------------------

def byte_stream(data: np.ndarray, off: np.ndarray):
    """The bytes that are scored, each text after DEPTH ends as first context; the
    place of each text's first byte; word starts and ends, word offsets of the texts."""
    data = lower_bytes(data)
    start, end, doc = word_spans(data, off)
    bounds = word_bounds(doc, len(off) - 1)
    size = end - start
    before = np.concatenate([[0], np.cumsum(size + 1)])
    length = np.maximum(before[bounds[1:]] - before[bounds[:-1]], 1)
    first = np.concatenate([[0], np.cumsum(length + DEPTH)]) + DEPTH
    out = np.full(int(first[-1]) - DEPTH, 10, np.uint8)
    put = before[:-1] - before[bounds[doc]] + first[doc]
    if len(size):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(put, size) + within] = data[np.repeat(start, size) + within]
        inner = np.ones(len(size), bool)
        inner[bounds[1:][length > 1] - 1] = False  # after a text's last word comes the end
        out[(put + size)[inner]] = 32
    return data, out, first, start, end, bounds


def runs_of(out: np.ndarray, first: np.ndarray):
    """Byte runs of all scored bytes (nearest context byte on top, the byte itself
    last) and the texts' offsets in them."""
    n = len(out)
    key = out.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        key[k:] |= out[:n - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    scored = np.ones(n, bool)
    for k in range(1, DEPTH + 1):
        scored[first[:-1] - k] = False
    return key[scored], first - DEPTH * np.arange(1, len(first) + 1)


def token_hashes(hasher: WordHasher, data, start, end, bounds):
    """Hashes of all words, with the end after each text's last one, and the texts' offsets."""
    words = hasher(data, start, end)
    words = np.where(words == END_WORD, words + np.uint64(1), words)
    return np.insert(words, bounds[1:], END_WORD), bounds + np.arange(len(bounds))


def _counted(keys: np.ndarray, learn: np.ndarray):
    """Distinct keys with their counts where ``learn`` is true."""
    known, n = np.unique(keys[learn], return_counts=True)
    other = np.unique(keys[~learn])
    return add_up([(known, n.astype(np.uint64)), (other, np.zeros(len(other), np.uint64))])


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, learn, held_out and chunk: a number for each CHUNK_ROWS rows of an input file.

    It follows from the file and the row's place in it, so each scan gives the same.
    """
    rows = docs.select("doc_id", "text")
    try:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK_ROWS))
                           .alias("chunk"))
        rows.schema
    except AnalysisException:  # not a plain read of files
        return chunked(stored(rows, "documents"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return rows.withColumn("held_out", held)


def gather(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed distinct byte runs (kind g) and words (kind w) of each chunk, in buckets."""
    def run(batches):
        hasher = WordHasher()
        chunk, parts = None, {"g": [], "w": []}

        def emit():
            for kind, got in parts.items():
                keys, counts = add_up(got)
                got.clear()
                place = bucket_of(kind, keys, buckets)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                pieces = [order[cuts[b]:cuts[b + 1]] for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(full), pa.string()), pa.array(full, pa.int32()),
                     pa.array([chunk] * len(full), pa.int64()),
                     pa.array([pack_sorted(keys[p]) for p in pieces], pa.binary()),
                     pa.array([pack(counts[p]) for p in pieces], pa.binary())],
                    names=["kind", "bucket", "chunk", "keys", "counts"])

        for batch in batches:
            chunks = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]])) if len(chunks) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if chunk is not None and chunk != chunks[a]:
                    yield from emit()
                chunk = int(chunks[a])
                learn = ~np.asarray(batch.column(3).slice(a, b - a))
                for i, j, data, off in text_steps(batch.column(1).slice(a, b - a), STEP):
                    data, out, first, start, end, bounds = byte_stream(data, off)
                    keys, at = runs_of(out, first)
                    parts["g"].append(_counted(keys, np.repeat(learn[i:j], np.diff(at))))
                    words, at = token_hashes(hasher, data, start, end, bounds)
                    parts["w"].append(_counted(words, np.repeat(learn[i:j], np.diff(at))))
                    if len(parts["g"]) >= 8:
                        parts = {k: [add_up(v)] for k, v in parts.items()}
        if chunk is not None:
            yield from emit()
    return rows.select("doc_id", "text", "chunk", "held_out").mapInArrow(run, _BLOBS)


def bucket_of(kind: str, keys: np.ndarray, buckets: int) -> np.ndarray:
    own = mix(keys >> np.uint64(8 * (DEPTH - 1))) if kind == "g" else mix(keys)
    return (own % np.uint64(buckets)).astype(np.int64)


# -- the tree -------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    big = np.maximum(n0, n1) > 1e6  # the product in _lgamma would overflow far above this

    def lg(x):
        series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
        return np.where(big, series, _lgamma(np.where(big, 1.0, x)))
    return lg(n0 + 0.5) + lg(n1 + 0.5) - lg(n0 + n1 + 1.0) - math.log(math.pi)


class Node:
    """The nodes of one depth and bit: sorted keys (context, bits so far), counts, weight of the own estimate."""

    __slots__ = ("keys", "n", "n1", "own", "log_weighted")

    def __init__(self, run_keys: np.ndarray, counts: np.ndarray, bit: int):
        ahead = run_keys >> np.uint64(8 - bit)
        heads = np.flatnonzero(np.concatenate([[True], ahead[1:] != ahead[:-1]]))
        one = (run_keys >> np.uint64(7 - bit)) & np.uint64(1)
        top = run_keys[heads]
        prefix = np.uint64(1 << bit) | ((top & np.uint64(255)) >> np.uint64(8 - bit))
        self.keys = (top >> np.uint64(8)) << np.uint64(8) | prefix
        self.n = np.add.reduceat(counts, heads)
        self.n1 = np.add.reduceat(counts * one, heads)

    def weigh(self, below: "Node | None"):
        kt = log_kt(self.n - self.n1, self.n1)
        if below is None:
            self.own, self.log_weighted = np.ones(len(kt)), kt
            return
        parent = (below.keys >> np.uint64(16)) << np.uint64(8) | (below.keys & np.uint64(255))
        deeper = np.bincount(np.searchsorted(self.keys, parent), below.log_weighted, len(self.keys))
        self.own = 1 / (1 + np.exp(np.clip(deeper - kt, -700, 700)))
        self.log_weighted = np.logaddexp(kt, deeper) - math.log(2)


def subtrees(keys: np.ndarray, counts: np.ndarray):
    """Weighted nodes of depths 2 to DEPTH: depth -> a Node for each bit."""
    out: dict[int, list[Node]] = {}
    counts = counts.astype(np.float64)
    for d in range(DEPTH, 1, -1):
        short = (keys >> np.uint64(8 * (DEPTH - d) + 8)) << np.uint64(8) | (keys & np.uint64(255))
        order = np.argsort(short)
        short = short[order]
        heads = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        run_keys, n = short[heads], np.add.reduceat(counts[order], heads)
        out[d] = [Node(run_keys, n, b) for b in range(8)]
        # counts are below 2**53, so sums of them as floats are exact
        for b, node in enumerate(out[d]):
            node.weigh(out[d + 1][b] if d < DEPTH else None)
    return out


class Top:
    """Depths 0 and 1: counts and weights by nearest byte and bits so far."""

    def __init__(self, rows):
        self.n, self.n1, deeper = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for r in rows:
            self.n[r["near"], r["node"]], self.n1[r["near"], r["node"]] = r["n"], r["n1"]
            deeper[r["near"], r["node"]] = r["deeper"]
        kt = np.where(self.n > 0, log_kt(self.n - self.n1, self.n1), 0)
        self.own = 1 / (1 + np.exp(np.clip(deeper - kt, -700, 700)))
        weighted = np.where(self.n > 0, np.logaddexp(kt, deeper) - math.log(2), 0)
        self.n_all, self.n1_all = self.n.sum(0), self.n1.sum(0)
        kt = np.where(self.n_all > 0, log_kt(self.n_all - self.n1_all, self.n1_all), 0)
        self.own_all = 1 / (1 + np.exp(np.clip(weighted.sum(0) - kt, -700, 700)))

    def finish(self, p: np.ndarray, near: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one at the root, from that at depth 2 (nan: not reached in training)."""
        for n, n1, own in ((self.n[near, node], self.n1[near, node], self.own[near, node]),
                           (self.n_all[node], self.n1_all[node], self.own_all[node])):
            est = (n1 + 0.5) / (n + 1)
            p = np.where(n > 0, np.where(np.isnan(p), est, own * est + (1 - own) * p), p)
        return np.where(np.isnan(p), 0.5, p)


def log10_probs(keys: np.ndarray, tree, top: Top) -> np.ndarray:
    """log10 probability of the byte of each run after its context."""
    out = np.zeros(len(keys))
    byte = keys & np.uint64(255)
    near = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    for b in range(8):
        node = np.uint64(1 << b) | (byte >> np.uint64(8 - b))
        one = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        p = np.full(len(keys), np.nan)
        for d in range(DEPTH, 1, -1):
            nodes = tree[d][b] if tree else None
            if nodes is None or not len(nodes.keys):
                continue
            want = (keys >> np.uint64(8 * (DEPTH - d) + 8)) << np.uint64(8) | node
            at = np.minimum(np.searchsorted(nodes.keys, want), len(nodes.keys) - 1)
            hit = nodes.keys[at] == want
            est = (nodes.n1[at] + 0.5) / (nodes.n[at] + 1)
            mixed = np.where(np.isnan(p), est, nodes.own[at] * est + (1 - nodes.own[at]) * p)
            p = np.where(hit, mixed, p)
        p = top.finish(p, near, node.astype(np.int64))
        out += np.log10(np.where(one, p, 1 - p))
    return out


# -- the jobs -------------------------------------------------------------------

def merge(blobs: DataFrame) -> DataFrame:
    """One row for each bucket: all keys, their training counts, known keys and the sum."""
    def run(t: pa.Table) -> pa.Table:
        done = []
        for k, c in zip(t.column("keys"), t.column("counts")):
            done.append((unpack_sorted(k.as_py()), unpack(c.as_py())))
            if len(done) >= 16:
                done = [add_up(done)]
        keys, counts = add_up(done)
        return pa.table({"kind": t.column("kind").slice(0, 1), "bucket": t.column("bucket").slice(0, 1),
                         "keys": pa.array([pack_sorted(keys)], pa.binary()),
                         "counts": pa.array([pack(counts)], pa.binary()),
                         "known": pa.array([int((counts > 0).sum())], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64())})
    return blobs.groupBy("kind", "bucket").applyInArrow(
        run, "kind string, bucket int, keys binary, counts binary, known long, total long")


def top_of(merged: DataFrame) -> Top:
    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, counts = unpack_sorted(k.as_py()), unpack(c.as_py())
                keys, counts = keys[counts > 0], counts[counts > 0]
                if not len(keys):
                    continue
                nodes = subtrees(keys, counts)[2]
                for node in nodes:
                    near = (node.keys >> np.uint64(16)).astype(np.int32)
                    place = near.astype(np.int64) << 8 | (node.keys & np.uint64(255)).astype(np.int64)
                    own, back = np.unique(place, return_inverse=True)
                    cols = [np.bincount(back, x, len(own)) for x in (node.n, node.n1, node.log_weighted)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own >> 8, pa.int32()), pa.array(own & 255, pa.int32()),
                         pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])],
                        names=["near", "node", "n", "n1", "deeper"])
    rows = (merged.filter("kind = 'g'").select("keys", "counts")
            .mapInArrow(run, "near int, node int, n long, n1 long, deeper double")
            .groupBy("near", "node").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("deeper").alias("deeper")))
    return Top(rows.collect())  # 256 * 255 rows at most


def answer(merged: DataFrame, blobs: DataFrame, top: Top) -> DataFrame:
    """For each chunk and bucket: keys, with log10 probabilities (g) or training counts (w) as packed bits."""
    held = merged.sparkSession.sparkContext.broadcast(top)  # 5 arrays of 65,536

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.column("kind")[0].as_py()
        keys, counts = unpack_sorted(left.column("keys")[0].as_py()), unpack(left.column("counts")[0].as_py())
        if kind == "g":
            some = counts > 0
            tree = subtrees(keys[some], counts[some]) if some.any() else None
            values = log10_probs(keys, tree, held.value).astype(np.float32).view(np.uint32)
        else:
            values = counts
        answers = [pack(values[np.searchsorted(keys, unpack_sorted(k.as_py()))]) for k in right.column("keys")]
        n = right.num_rows
        return pa.table({"kind": pa.array([kind] * n, pa.string()), "chunk": right.column("chunk"),
                         "keys": right.column("keys"), "values": pa.array(answers, pa.binary())})
    return merged.groupBy("kind", "bucket").cogroup(blobs.drop("counts").groupBy("kind", "bucket")).applyInArrow(
        run, "kind string, chunk long, keys binary, values binary")


def score_chunks(rows: DataFrame, answers: DataFrame) -> DataFrame:
    def run(docs: pa.Table, got: pa.Table) -> pa.Table:
        lists = {"g": [[], []], "w": [[], []]}
        for kind, k, v in zip(got.column("kind").to_pylist(), got.column("keys"), got.column("values")):
            lists[kind][0].append(unpack_sorted(k.as_py()))
            lists[kind][1].append(unpack(v.as_py()))
        tables, values = {}, {}
        for kind, (k, v) in lists.items():
            tables[kind] = HashArray(np.concatenate(k) if k else np.empty(0, np.uint64))
            flat = (np.concatenate(v) if v else np.empty(0, np.uint64))[tables[kind].order]
            values[kind] = flat.astype(np.uint32).view(np.float32) if kind == "g" else flat.astype(np.float64)
        n = docs.num_rows
        n_tokens, n_known, log_c, scores = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        hasher = WordHasher()
        for i, j, data, off in text_steps(docs.column("text"), STEP):
            data, out, first, start, end, bounds = byte_stream(data, off)
            keys, at = runs_of(out, first)
            place = tables["g"].find(keys)
            if (place < 0).any():
                raise RuntimeError("a chunk has byte runs that it has not sent: the input files changed meanwhile")
            scores[i:j] = np.add.reduceat(values["g"][place], at[:-1], dtype=np.float64)
            words, at = token_hashes(hasher, data, start, end, bounds)
            c = values["w"][tables["w"].find(words)]
            n_tokens[i:j] = np.diff(at)
            n_known[i:j] = np.add.reduceat((c > 0).astype(np.int64), at[:-1])
            log_c[i:j] = np.add.reduceat(np.log10(c + 1), at[:-1])
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                         "n_tokens": n_tokens, "n_known": n_known, "log_c": log_c, "score": scores})
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, score double")


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row
    of ``docs`` (doc_id, text), with a model of the rows that aren't held out."""
    rows = chunked(docs)
    buckets = buckets or max(LEAST_BUCKETS, docs.count() // CHUNK_ROWS)
    blobs = stored(gather(rows, buckets), "runs")
    merged = stored(merge(blobs), "merged")
    size = merged.filter("kind = 'w'").agg(F.sum("known").alias("v"), F.sum("total").alias("n")).first()
    total, vocabulary = int(size["n"] or 0), int(size["v"] or 0)
    answers = answer(merged, blobs, top_of(merged))
    return score_chunks(rows, answers).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(math.log10(total + vocabulary + 1))).alias("base_score"), "score")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_context_tree_weighting": (op1_context_tree_weighting, None)}
