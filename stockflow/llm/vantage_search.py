"""Operator 13, nearest neighbours by vantage-point trees per shard.

The index deals the distinct vectors into shards of bounded size by hash and builds
one tree a shard in a task: a node picks the point farthest from a start point as
its vantage point, cuts its points at the median distance, and keeps the distance
range of both halves. Vectors carry one more coordinate, the root of what their
square length lacks to the shard's largest, which makes the largest inner product
the least Euclidean distance, for which the triangle inequality holds.

A search sends blocks of queries to every shard and walks a block down a tree at
once, each query into its nearer half first. A half is left out where the gap
between the query's distance to the vantage point and the half's range is over
``factor`` times the distance of the query's k-th best so far: with factor one that
can't lose a neighbour, smaller factors visit less. What a shard finds is at most
the best k + 1 vectors a query, merged over shards by a ranked window.

Equal vectors are one point that knows its ``k + 1`` smallest ids, so a group of
copies of any size costs one point. Scores are sums of products in the order of the
components, in double precision; matrix products only sort out what is surely below
the k-th best. Ties go to the smaller vec_id.

Defined cases: a row with a null vec_id or a vector that is null, empty, zero or
holds a component that is null or not finite takes no part; rows that repeat id and
vector count once; several vectors of one id are rows of their own, none of them a
candidate of another, and each is asked; shorter vectors count as filled up
with zeros; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import stored, table
from stockflow.llm.vectors import block, first_of_each, matrix, n_blocks, to_all, usable, widened

SHARD = 4096    # points of a shard
QUERIES_AT_ONCE = 2048
LEAF = 256      # points that are compared without a further cut
NEAREST = 20
FACTOR = 1.0    # see README: on the given vectors 0.2 saves 9 % of the comparisons for 1 % of the neighbours
_EPS = 1e-9

_INDEX = ("shard int, points array<double>, width int, ids array<array<long>>, node array<array<double>>")


def prepared(rows: DataFrame) -> DataFrame:
    """Distinct (vec_id, x) of the rows that take part."""
    x = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    return x.filter(F.col("vec_id").isNotNull() & usable("x") & F.exists("x", lambda v: v != 0)).distinct()


# -- trees (inside tasks) ------------------------------------------------------

def _lifted(x: np.ndarray) -> np.ndarray:
    """The points with the coordinate that makes all of them as long as the longest."""
    square = (x * x).sum(1)
    top = square.max() if len(x) else 0.0
    return np.column_stack([x, np.sqrt(np.maximum(top - square, 0))])


def _distances(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = a - p
    return np.sqrt((d * d).sum(1))


def build_tree(x: np.ndarray, leaf: int = LEAF):
    """Order of the points and nodes (start, end, vantage, inner child, outer child, their distance ranges);
    a leaf's children are -1. Points are in no node's range twice."""
    lifted = _lifted(x)
    order = np.arange(len(x))
    nodes: list[list[float]] = []
    todo = [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([start, end, -1, -1, -1, 0, 0, 0, 0])
        if parent >= 0:
            nodes[parent][3 + side] = me
        if end - start <= leaf:
            continue
        part = order[start:end]
        vantage = part[np.argmax(_distances(lifted[part], lifted[part[0]]))]
        d = _distances(lifted[part], lifted[vantage])
        turn = np.argsort(d, kind="stable")
        order[start:end], d = part[turn], d[turn]
        mid = (end - start) // 2
        nodes[me][2] = vantage
        nodes[me][5:] = [d[0], d[mid - 1], d[mid], d[-1]]
        todo += [(start, start + mid, me, 0), (start + mid, end, me, 1)]
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    tree = np.array(nodes, float)
    inner = tree[:, 2] >= 0
    tree[inner, 2] = place[tree[inner, 2].astype(int)]
    return order, tree


def _in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first component on."""
    out = np.zeros(len(q))
    for c in range(q.shape[1]):
        out += q[:, c] * x[:, c]
    return out


class Search:
    """The best ``keep`` points of one shard for each query; points of equal score by their smallest id."""

    def __init__(self, points: np.ndarray, least: np.ndarray, tree: np.ndarray, queries: np.ndarray, keep: int,
                 factor: float):
        self.x, self.least, self.tree, self.q, self.keep, self.factor = points, least, tree, queries, keep, factor
        square = (points * points).sum(1)
        self.top = np.sqrt(square.max())
        self.length = np.sqrt((queries * queries).sum(1))
        self.slack = _EPS * self.top * self.length
        self.score = np.full((len(queries), keep), -np.inf)
        self.point = np.full((len(queries), keep), -1)
        self.seen = 0
        self._walk(0, np.arange(len(queries)))

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far; without end where the query's length is too small for a double."""
        return np.where(self.length[who] > 0, self._distance(self.score[who, -1], who), np.inf)

    def _distance(self, score: np.ndarray, who: np.ndarray) -> np.ndarray:
        # query scaled to the points' length: d2 = 2 top2 - 2 top q.x / |q|
        length = np.where(self.length[who] > 0, self.length[who], 1)
        return np.sqrt(np.maximum(2 * self.top * (self.top - score / length), 0))

    def _walk(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        start, end, vantage, *child = self.tree[node, :5].astype(int)
        if vantage < 0:
            self._leaf(start, end, who)
            return
        ranges = self.tree[node, 5:].reshape(2, 2)
        d = self._distance(self.q[who] @ self.x[vantage], who)
        outer = d > (ranges[0, 1] + ranges[1, 0]) / 2
        for turn in (0, 1):  # nearer halves first, then the others with what the nearer ones have found
            for nearer in (0, 1):
                side = nearer ^ turn
                group = np.flatnonzero(outer == bool(nearer))
                low, high = ranges[side]
                gap = np.maximum(np.maximum(low - d[group], d[group] - high), 0)
                near = gap <= self.factor * self._reach(who[group]) + _EPS * self.top
                self._walk(child[side], who[group[near]])

    def _leaf(self, start: int, end: int, who: np.ndarray) -> None:
        self.seen += len(who) * (end - start)
        rough = self.q[who] @ self.x[start:end].T
        i, j = np.nonzero(rough >= (self.score[who, -1] - self.slack[who])[:, None])
        if not len(i):
            return
        asked, point = who[i], j + start
        score = _in_order(self.q[asked], self.x[point])
        touched = np.unique(asked)
        old = np.repeat(touched, self.keep)
        asked = np.concatenate([old, asked])
        score = np.concatenate([self.score[touched].ravel(), score])
        point = np.concatenate([self.point[touched].ravel(), point])
        turn = np.lexsort((self.least[point], -score, asked))
        turn = turn[first_of_each(asked[turn], self.keep)]
        self.score[touched] = score[turn].reshape(len(touched), self.keep)
        self.point[touched] = point[turn].reshape(len(touched), self.keep)


# -- index and search ----------------------------------------------------------

def build_index(vectors: DataFrame, nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """One row a shard: its points in the tree's order, their smallest ids, and the tree's nodes."""
    few = Window.partitionBy("x").orderBy("vec_id")
    points = stored(vectors.withColumn("k", F.row_number().over(few)).filter(F.col("k") <= nearest + 1)
                    .groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    shards = n_blocks(points, shard)

    def run(part: pa.Table) -> pa.Table:
        x = matrix(part["x"], np.float64)
        order, tree = build_tree(x)
        return pa.table([pa.array([part["shard"][0].as_py()], pa.int32()),
                         pa.array([x[order].ravel()], pa.list_(pa.float64())), pa.array([x.shape[1]], pa.int32()),
                         pa.array([part["ids"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         pa.array([tree.tolist()], pa.list_(pa.list_(pa.float64())))],
                        names=["shard", "points", "width", "ids", "node"])
    return block(points, "shard", shards, "x").groupBy("shard").applyInArrow(run, _INDEX)


def _search(nearest: int, factor: float):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = {"row": [], "vec_id": [], "score": []}
        if queries.num_rows and index.num_rows:
            ids = index["ids"][0].as_py()
            x = matrix(index["points"], np.float64).reshape(len(ids), index["width"][0].as_py())
            q = matrix(queries["x"], np.float64)
            width = max(q.shape[1], x.shape[1])
            least = np.array([i[0] for i in ids])
            found = Search(widened(x, width), least, matrix(index["node"].combine_chunks().values, np.float64),
                           widened(q, width), nearest + 1, factor)
            for k, (row, own) in enumerate(zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist())):
                some = sorted((-found.score[k, c], i) for c, p in enumerate(found.point[k]) if p >= 0
                              for i in ids[p] if i != own)[:nearest]
                out["row"] += [row] * len(some)
                out["score"] += [-s for s, _ in some]
                out["vec_id"] += [i for _, i in some]
        return pa.table({"row": pa.array(out["row"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})
    return run


def search(index: DataFrame, queries: DataFrame, nearest: int = NEAREST, factor: float = FACTOR,
           at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``nearest`` points of each of ``queries`` (row, vec_id, x)."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = n_blocks(queries, at_once)
    left = to_all(block(queries, "part", blocks, "row"), "shard", shards)
    right = to_all(index, "part", blocks)
    near = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(
        _search(nearest, factor), "row long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= nearest)
    return best.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select(
        "query_id", "rank", "vec_id", "score")


def op13_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(prepared(table(spark, sf_dir, "embeddings")).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")
    index = stored(build_index(vectors.select("vec_id", "x")), "index")
    return search(index, vectors.filter("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 for x in embedding if x <> 0]) > 0)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id, q.x ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)::INTEGER AS rank,
       c.vec_id, list_inner_product(q.x, c.x) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id
WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""

QUERIES = {"op13_vantage_point_search": (op13_vantage_point_search, SQL)}
