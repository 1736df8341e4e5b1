"""Ordering operators.

``global_rank`` gives the SQL ``RANK()`` of each row in a total order without
an unpartitioned window over all rows: rows are ranked inside buckets (a
prefix of the order, e.g. the branch name) and each bucket is shifted by the
number of rows in earlier buckets, taken from a prefix sum over the small
per-bucket count table. Ties stay inside one bucket because the bucket is a
prefix of the sort key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.operators.windows import ordered_chunks


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "posicion",
                bucket: Sequence[Column] | None = None) -> DataFrame:
    """RANK() over ``order``. ``bucket``: leading *ascending* sort expressions
    used to split the work; omit only for small (aggregated) inputs."""
    order = list(order)
    if not bucket:
        return df.withColumn(out, F.rank().over(Window.orderBy(*order)).cast("bigint"))
    bucket = list(bucket)
    # one struct for the bucket: it equals itself also where a part is null, so no row is lost
    x = df.withColumn("_sf_b", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]))
    counts = x.groupBy("_sf_b").agg(F.count(F.lit(1)).alias("_sf_n"))
    before = Window.orderBy("_sf_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_sf_b", F.coalesce(F.sum("_sf_n").over(before), F.lit(0)).alias("_sf_off"))
    inside = Window.partitionBy("_sf_b").orderBy(*order)
    return (x.join(offs, "_sf_b", "inner")
             .withColumn(out, (F.col("_sf_off") + F.rank().over(inside)).cast("bigint"))
             .drop("_sf_b", "_sf_off"))


def rank_by_ranges(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "posicion", limit: int = 1 << 16) -> DataFrame:
    """RANK() over columns ``order`` ((name, ascending) pairs) with no task that holds more than ``limit`` rows of a key.

    Rows are range-partitioned and cut into chunks by the whole order (``windows.ordered_chunks``). A
    rank is the rows of earlier chunks plus the rank inside the chunk; rows that tie with the last row before their
    chunk take that row's rank, which is carried over the table of chunks (one row a chunk). NULLs come first where
    ascending, last where descending, and tie with each other.
    """
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    x = ordered_chunks(df, [], by, limit).withColumn("_sf_k", F.struct(*[F.col(c) for c, _ in order]))
    inside = F.rank().over(Window.partitionBy("_sf_chunk").orderBy(*by))
    x = x.withColumn("_sf_in", inside)
    chunks = x.groupBy("_sf_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_sf_k", "_sf_row").alias("first"), F.max_by("_sf_k", "_sf_row").alias("last"),
        F.max("_sf_in").alias("last_in"))
    at = Window.orderBy("_sf_chunk")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "ties", F.coalesce(F.lag("last").over(at).eqNullSafe(F.col("first")) & (F.lag("n").over(at) > 0), F.lit(False)))
    # rank of a chunk's last key: made here unless the whole chunk is the key before it
    own = F.when(~F.col("ties") | (F.col("last_in") > 1), F.col("off") + F.col("last_in"))
    chunks = chunks.withColumn("own", own)
    carried = F.last("own", ignorenulls=True).over(before)
    chunks = chunks.select("_sf_chunk", "off", F.when(F.col("ties"), carried).otherwise(F.col("off") + 1).alias("head"))
    rank = F.when(F.col("_sf_in") == 1, F.col("head")).otherwise(F.col("off") + F.col("_sf_in"))
    return x.join(chunks, "_sf_chunk").withColumn(out, rank.cast("bigint")).select(*df.columns, out)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], limit: int = 1 << 16) -> DataFrame:
    """Exact quantiles (linear between the two order statistics around each) as one row of doubles; NULLs don't count.

    Selection, not aggregation: rows are counted per value, the values are cut into chunks by their order, the counts are
    summed over the table of chunks, and only the chunks that hold a wanted order statistic are looked into. No task or
    aggregate holds all distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_sf_n"))
    x = ordered_chunks(counts, [], [value], limit)
    per = x.groupBy("_sf_chunk").agg(F.sum("_sf_n").alias("t"))
    before = Window.orderBy("_sf_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("off", F.coalesce(F.sum("t").over(before), F.lit(0)))
    place = {p: F.lit(q) * (F.col("total") - 1) for p, q in probs.items()}
    ranks = per.agg(F.sum("t").alias("total")).where("total > 0").select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), h.alias("h"), side(h).cast("bigint").alias("r"))
        for p, h in place.items() for side in (F.floor, F.ceil)]))).distinct()
    held = per.join(F.broadcast(ranks), (F.col("r") >= F.col("off")) & (F.col("r") < F.col("off") + F.col("t")))
    run = Window.partitionBy("_sf_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = x.join(held.select("_sf_chunk").distinct(), "_sf_chunk", "left_semi").withColumn("upto", F.sum("_sf_n").over(run))
    found = near.join(held, "_sf_chunk").where((F.col("r") - F.col("off") < F.col("upto"))
                                               & (F.col("r") - F.col("off") >= F.col("upto") - F.col("_sf_n")))
    v = F.col(value).cast("double")
    low = {p: F.min(F.when(F.col("p") == p, v)) for p in probs}
    high = {p: F.max(F.when(F.col("p") == p, v)) for p in probs}
    part = {p: F.max(F.when(F.col("p") == p, F.col("h") - F.floor("h"))) for p in probs}
    return found.agg(*[(low[p] + (high[p] - low[p]) * part[p]).alias(p) for p in probs])


def sort_stable_cells(deltas: DataFrame, keys: Sequence[str] = ("id_sucursal", "id_variante"),
                      order: Sequence[str] = ("id_detalle", "leg"), num_partitions: int | None = None) -> DataFrame:
    """Rows clustered by cell and sorted by line order inside each partition
    (``repartition`` + ``sortWithinPartitions``: no global sort)."""
    keys, order = list(keys), list(order)
    r = deltas.repartition(num_partitions, *keys) if num_partitions else deltas.repartition(*keys)
    return r.sortWithinPartitions(*keys, *order)


def sort_small(df: DataFrame, *order: Column | str) -> DataFrame:
    """Total order for an output whose size is bounded by a dimension (brands,
    one branch's employees, branch x brand): one partition sorted in place.

    A global ``orderBy`` range-partitions its input and first runs a sampling
    job to pick the ranges; for a few hundred aggregated rows that is pure
    overhead. The rows are exchanged to one partition after the final aggregate,
    which stays parallel. Use ``orderBy`` for outputs that grow with the facts.
    """
    return df.repartition(1).sortWithinPartitions(*order)
