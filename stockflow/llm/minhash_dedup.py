"""Operator 8, near-dedup by bottom-k sketches of one hash function.

A text's set holds the hashes of its word shingles; its sketch is the k least of
them. Texts of one set are one node. The retained values make inverted lists
value -> nodes. Two sets with a Jaccard similarity of t share at least c
retained values (c: the whole share for sets that the sketch holds whole, else
the mean k*t less ``SIGMAS`` deviations), and so they share one of each node's
|sketch| - c + 1 rarest values, in the order (documents, value) that is the same
for all. Only those places of the lists make candidates, so words, lines and
passages that everybody has make none.

Candidates come in two rounds and never as all pairs of a list. First a star:
each node with its list's most typical one, that with the fewest values that no
other node has. Then, where a list still joins different components of the
verified links, its nodes are compared by their full sets in the same manner,
without slack: they are candidates if they share one of the |set| - ceil(t * |set|)
+ 1 rarest values among these nodes and if the values from there on, were it the
first that they share, leave room for the threshold. That covers every pair left, so no link between
different components is lost, and edited copies that are too far from all others
make no pairs. The first round's estimate is the share of the k least values of
the union that both have. Links are verified on the full sets.

Defined cases: null and empty texts have no set (n_shingles 0) and are linked
with nothing; a text of fewer words than a shingle is one shingle; a null
``doc_id`` is linked with nothing, component null, kept; rows that repeat a
doc_id are one node per set and share that id; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import (WordHasher, free_names, lower_bytes, mix, shingle_hashes, stored, table, text_steps,
                                  word_bounds, word_spans)
from stockflow.llm.components import components

K = 64
SIGMAS = 5.5
_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>"


def _sets(column, words: int, hasher: WordHasher):
    """The sorted distinct shingle hashes of each text of a column, in order."""
    for _, _, data, off in text_steps(column):
        data = lower_bytes(data)
        start, end, doc = word_spans(data, off)
        bounds = word_bounds(doc, len(off) - 1)
        hashes, at = shingle_hashes(hasher(data, start, end), bounds, words)
        for i in range(len(off) - 1):
            yield np.unique(hashes[at[i]:at[i + 1]])


def _digests(s: np.ndarray) -> tuple[int, int]:
    """d1 and d2: with the number of values they tell a set from others."""
    m = mix(s.view(np.uint64))
    return (int(m.sum(dtype=np.uint64).view(np.int64)),
            int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            n, d1, d2, sketch = [], [], [], []
            for s in _sets(batch.column(1), words, hasher):
                n.append(len(s))
                for out, d in zip((d1, d2), _digests(s)):
                    out.append(d)
                sketch.append(s[:k].copy())
            off = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            flat = np.concatenate(sketch) if sketch else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _least_shared(k: int, pct: int) -> int:
    t = pct / 100
    return max(1, math.floor(k * t - SIGMAS * math.sqrt(k * t * (1 - t))))


def _shared_needed(size, k: int | None, pct: int):
    """c of a sketch of ``size`` values; without k of a full set."""
    whole = F.ceil(size * pct / 100)
    return F.least(whole, F.lit(_least_shared(k, pct))) if k else whole


def _estimate_passes(a, b, n_a, n_b, k: int, pct: int):
    """Union sketch: enough of the k least values of the union are in both sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    whole = F.greatest(n_a, n_b) <= k
    return (F.greatest(n_a, n_b) * pct <= F.least(n_a, n_b) * 100) & F.when(
        whole, both * 100 >= F.size(union) * pct).otherwise(both >= F.least(
            F.lit(_least_shared(k, pct)), F.ceil(F.least(n_a, n_b) * pct / 100)))


def rare_lists(nodes: DataFrame, k: int | None, pct: int) -> DataFrame:
    """(v, node, n, s, held, ahead) at the places of the inverted lists that make candidates,
    from rows (node, d1, n, sketch), a node's sets each on its own; s: values of the sketch, held: those that other nodes have
    too, ahead: those of them from v on in the order."""
    places = nodes.select("node", "d1", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = places.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    rare = (places.join(often, "v").groupBy("node", "d1", "n", "s")
            .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
            # values that no other node has come first in the order
            .withColumn("take", F.size("vs") - _shared_needed(F.col("s"), k, pct) + 1)
            .filter("take > 0"))
    return rare.select(F.posexplode(F.expr("slice(vs, 1, int(take))")).alias("i", "x"), "node", "n", "s",
                       F.size("vs").alias("held")).select(
        "x.v", "node", "n", "s", "held", (F.col("held") - F.col("i")).alias("ahead"))


def full_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, d1, d2, n, sketch): the full set of each row of ``nodes`` (node, d1, d2, n), from its text."""
    key = ["node", "d1", "d2", "n"]
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(
        nodes.select("node").distinct(), "node", "left_semi")

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = list(_sets(part.column(1), words, hasher))
                off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                digests = [_digests(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)],
                     pa.array([len(x) for x in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets), pa.int64()))],
                    names=[*key, "sketch"])
    sets = texts.mapInArrow(run, "node long, d1 long, d2 long, n long, sketch array<long>")
    return sets.join(nodes.select(*key), key, "left_semi").dropDuplicates(key)


def verify(pairs: DataFrame, docs: DataFrame, words: int, pct: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets have 100 * shared >= pct * union."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(
        ids, "doc_id", "left_semi")
    rows = (pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "ta"}), "a")
            .join(texts.withColumnsRenamed({"doc_id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb"))

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            ok = []
            for s, t in zip(_sets(batch.column(2), words, hasher), _sets(batch.column(3), words, hasher)):
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * shared >= pct * (len(s) + len(t) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_classes(docs: DataFrame, words: int = 5, pct: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text);
    links are pairs of texts with 100 * shared >= pct * union of their shingles."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs, words, k), "sketches")
    key = ["d1", "d2", "n_shingles"]
    nodes = stored(rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*key)
                   .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
                   .withColumnRenamed("n_shingles", "n"), "nodes")
    lists = stored(rare_lists(nodes, k, pct), "lists")
    sketch = nodes.select("node", "n", "sketch")

    # first round: each node with the most typical of its list
    centre = lists.groupBy("v").agg(F.min_by("node", F.struct(F.col("s") - F.col("held"), "node")).alias("b"))
    star = (lists.join(centre, "v").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
            .join(sketch.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a")
            .join(sketch.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b")
            .filter(_estimate_passes(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, pct))
            .select("a", "b"))
    links = stored(verify(stored(star, "star"), docs, words, pct), "links")
    group = components(links)

    # second round: the nodes of lists that still join several components, by full sets
    named = lists.select("v", "node").join(group, "node", "left").withColumn("c", F.coalesce("component", "node"))
    several = named.groupBy("v").agg((F.min("c") < F.max("c")).alias("several")).filter("several")
    left = named.join(several, "v", "left_semi").select("node", "c").distinct()
    left = stored(left, "left")
    full = full_sets(nodes.select("node", "d1", "d2", "n").join(left, "node", "left_semi"), docs, words)
    exact = rare_lists(full, None, pct).join(left, "node").select("v", "node", "n", "ahead", "c")
    exact = stored(exact, "exact")
    a = exact.withColumnsRenamed({c: f"{c}_a" for c in ("node", "n", "ahead", "c")})
    b = exact.withColumnsRenamed({c: f"{c}_b" for c in ("node", "n", "ahead", "c")})
    room = F.expr(f"{pct} * (n_a + n_b) <= {100 + pct} * least(ahead_a, ahead_b)")
    rest = a.join(b.withColumnRenamed("v", "v_b"), (F.col("v") == F.col("v_b")) & (F.col("c_a") < F.col("c_b")) & room)
    rest = stored(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "rest")
    more = verify(rest, docs, words, pct)
    links = stored(links.unionByName(more), "links")
    group = components(links)

    named_nodes = nodes.select("d1", "d2", F.col("n").alias("n_shingles"), "node").join(group, "node", "left").select(
        *key, F.coalesce("component", "node").alias("c"))
    # a doc_id on several rows is one node of the classes
    return (rows.select("doc_id", *key).join(named_nodes, key, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, words: int = 5, pct: int = 80) -> DataFrame:
    """The rows of ``docs`` that represent their class, with all their columns."""
    [node] = free_names(docs, "__id")
    kept = near_classes(docs, words, pct).filter("kept and doc_id is not null").select(
        F.col("doc_id").alias(node)).distinct()
    ids = docs.filter(F.col("doc_id").isNotNull()).join(
        kept, F.col("doc_id").cast("long") == F.col(node), "left_semi")
    return ids.unionByName(docs.filter(F.col("doc_id").isNull()))


def op8_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=3, pct=85)


QUERIES = {"op8_bottom_k_near_dedup": (op8_bottom_k_near_dedup, None)}
