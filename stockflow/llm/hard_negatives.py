"""Operator 12, hard-negative mining by Strassen products of integer tiles.

Components become integers (``floor(256 * x)``), so a score is an exact inner
product. Anchors and candidates are dealt into blocks of bounded size; each pair of
blocks is one group of a cogroup, whose score tile is one int64 product by
Strassen's recursion: odd sides get a row or column of zeros, seven half-size
products are added and subtracted exactly (modulo 2**64, so sums on the way can't
spoil a result that fits), and small tiles end the recursion.

Each tile keeps heaps of a fixed size. First the best ``positives`` rows of the
anchor's own label; the heaps of all tiles are merged by a ranked window, which
Spark limits before its shuffle too. Then, with the positives' scores known, the
tiles are made once more, and each (anchor, positive) gets a heap of the best
different-label rows inside its score window, merged the same way. Order is score
descending, then vec_id ascending, in the tiles as in the merges.

Defined cases: a row with a null vec_id, label or vector, or a component that is
null or not finite, takes no part; shorter vectors count as filled up with zeros;
rows of one vec_id are never each other's positives; repeated rows are rows of
their own; an anchor without positives, or a positive without a row in its window,
gives none; scores that a long can't hold a hundredfold are an error; extra columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import stored, table
from stockflow.llm.vectors import block, first_of_each, matrix, n_blocks, to_all, usable, widened

ANCHORS = 1024     # rows of a tile
CANDIDATES = 4096  # columns of a tile
LEAF = 16          # a product with a side of at most this is made directly


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 matrix product, by seven products of half the size."""
    m, k, n = len(a), a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    out = np.empty((m, n), np.int64)
    both = strassen(a11 + a22, b11 + b22)
    low = strassen(a21 + a22, b11)
    right = strassen(a11, b12 - b22)
    left = strassen(a22, b21 - b11)
    high = strassen(a11 + a12, b22)
    out[:i, :j] = both + left - high + strassen(a12 - a22, b21 + b22)
    out[:i, j:] = right + high
    out[i:, :j] = low + left
    out[i:, j:] = both - low + right + strassen(a21 - a11, b11 + b12)
    return out


def _checked(a: np.ndarray, b: np.ndarray) -> None:
    top = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (a, b)]
    if 100 * top[0] * top[1] * a.shape[1] >= 1 << 63:
        raise OverflowError("vector components are too large for exact scores in a long")


def _tile(anchors: pa.Table, candidates: pa.Table):
    """Scores of the anchors (rows) and candidates in order of their vec_id (columns), and that order."""
    order = np.argsort(candidates["vec_id"].to_numpy(), kind="stable")
    a, b = matrix(anchors["c"], np.int64), matrix(candidates["c"], np.int64)
    width = max(a.shape[1], b.shape[1])
    a, b = widened(a, width), widened(b, width)
    _checked(a, b)
    return strassen(np.ascontiguousarray(a), np.ascontiguousarray(b[order].T)), order


def prepared(rows: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """row, vec_id, label, c (integer components) of the rows that take part; the label of each
    ``relabel``-th vec_id moves on by one."""
    good = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("x"))
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
                       moved.cast("long").alias("label"),
                       F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("c"))


def _positives(most: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"row": [], "score": [], "positive_id": []}
        if anchors.num_rows and candidates.num_rows:
            scores, order = _tile(anchors, candidates)
            rows, own, of = (anchors[c].to_numpy() for c in ("row", "vec_id", "label"))
            ids, label = (candidates[c].to_numpy()[order] for c in ("vec_id", "label"))
            for x in np.unique(of):
                a, b = np.flatnonzero(of == x), np.flatnonzero(label == x)
                for i in a:
                    other = b[ids[b] != own[i]]
                    best = other[np.argsort(-scores[i, other], kind="stable")[:most]]
                    out["row"].append(np.full(len(best), rows[i]))
                    out["score"].append(scores[i, best])
                    out["positive_id"].append(ids[best])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0), pa.int64()) for k, v in out.items()})
    return run


def _negatives(most: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"row": [], "place": [], "negative_score": [], "negative_id": []}
        if anchors.num_rows and candidates.num_rows:
            scores, order = _tile(anchors, candidates)
            rows, of = (anchors[c].to_numpy() for c in ("row", "label"))
            ids, label = (candidates[c].to_numpy()[order] for c in ("vec_id", "label"))
            wanted = matrix(anchors["found"], np.int64)
            count = np.array([len(x) for x in anchors["found"].to_pylist()])
            bottom = np.min(np.where(np.arange(wanted.shape[1]) < count[:, None], wanted, np.iinfo(np.int64).max), axis=1)
            top = wanted[:, 0]  # positives stand in descending order
            near = (scores <= top[:, None]) & (100 * scores >= low * np.minimum(bottom, top)[:, None])
            i, j = np.nonzero(near & (of[:, None] != label[None, :]))
            s = scores[i, j]
            turn = np.lexsort((j, -s, i))
            i, j, s = i[turn], j[turn], s[turn]
            for p in range(wanted.shape[1]):
                ps = wanted[i, p]
                at = np.flatnonzero((count[i] > p) & (low * ps <= 100 * s) & (100 * s <= high * ps))
                at = at[first_of_each(i[at], most)]
                out["row"].append(rows[i[at]])
                out["place"].append(np.full(len(at), p))
                out["negative_score"].append(s[at])
                out["negative_id"].append(ids[j[at]])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.empty(0), pa.int64()) for k, v in out.items()})
    return run


def _tiles(anchors: DataFrame, candidates: DataFrame, rows: int, columns: int):
    """The two sides, grouped by pairs of blocks."""
    i, j = n_blocks(anchors, rows), n_blocks(candidates, columns)
    left = to_all(block(anchors, "i", i, "row"), "j", j)
    right = to_all(block(candidates, "j", j, "row"), "i", i)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100, tile: tuple[int, int] = (ANCHORS, CANDIDATES)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``anchors``, some of the
    prepared ``rows``: per anchor and positive the best other-label rows whose hundredfold score lies
    between ``low`` and ``high`` times the positive's."""
    anchors = stored(anchors, "anchors")
    near = _tiles(anchors, rows, *tile).applyInArrow(_positives(positives), "row long, score long, positive_id long")
    by = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < positives)
    near = stored(near, "positives")
    found = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p")).select(
        "row", F.col("p.score").alias("found"))
    asked = anchors.join(found, "row")
    far = _tiles(asked, rows, *tile).applyInArrow(
        _negatives(negatives, low, high), "row long, place long, negative_score long, negative_id long")
    by = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    return (far.join(near.withColumnRenamed("score", "positive_score"), ["row", "place"])
            .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(prepared(table(spark, sf_dir, "embeddings")), "vectors")
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum([p[1] * p[2] for p in list_zip(a.c, b.c)])::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

QUERIES = {"op12_strassen_hard_negatives": (op12_strassen_hard_negatives, SQL)}
