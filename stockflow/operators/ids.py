"""Id assignment (SERIAL semantics) without a single global window.

``id_assign`` numbers rows 1..n (or from ``start``) in a total order. A global
``row_number()`` over an unpartitioned window would pull every row into one
task, so big tables are numbered in two passes:

1. count rows per *bucket*, where the bucket columns are a monotone coarsening
   of the order (every row of bucket b sorts before every row of bucket b' > b,
   nulls first);
2. prefix sums over the bucket table give each bucket's offset, and a
   ``row_number`` partitioned by bucket adds the rank inside the bucket.

The prefix sums are taken on two levels: inside each value of the first bucket
column (a day), in parallel, and over the totals of these values. Only the table
of the first column's values goes through a single-partition window, so let that
column have few values (days) and the others cut them. Rows whose bucket has
nulls are numbered like all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_assign(df: DataFrame, order: Sequence[str | Column], id_col: str = "id",
              bucket: Sequence[str] | None = None, start: int | Column = 1, tasks: int | None = None) -> DataFrame:
    """Dense ids in ``order``. ``bucket`` = monotone coarsening of the order
    (column names already present in ``df``); leave it out only for small
    dimension tables. ``tasks``: the number of partitions that the buckets are dealt
    to, which Spark doesn't join again; Spark's own number, if not given."""
    order = list(order)
    base = start if isinstance(start, Column) else F.lit(start)
    if not bucket:
        w = Window.orderBy(*order)
        return df.withColumn(id_col, (base - 1 + F.row_number().over(w)).cast("bigint"))
    x = df.withColumn("_sf_b", F.struct(*bucket))     # a struct of nulls equals itself, so no row is lost in the join
    first = F.col("_sf_b")[bucket[0]]
    counts = x.groupBy("_sf_b").agg(F.count(F.lit(1)).alias("_sf_n")).withColumn("_sf_d", F.struct(first.alias("d")))
    before = Window.partitionBy("_sf_d").orderBy("_sf_b").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_sf_in", F.coalesce(F.sum("_sf_n").over(before), F.lit(0)))
    if len(bucket) > 1:           # offsets inside the first bucket column, plus the offset of its value
        days = counts.groupBy("_sf_d").agg(F.sum("_sf_n").alias("_sf_n"))
        top = Window.orderBy("_sf_d").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select("_sf_d", F.coalesce(F.sum("_sf_n").over(top), F.lit(0)).alias("_sf_top"))
        inner = inner.join(days, "_sf_d")
        offset = F.col("_sf_top") + F.col("_sf_in")
    else:
        top = Window.orderBy("_sf_b").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum("_sf_n").over(top), F.lit(0))
    offsets = (inner if len(bucket) > 1 else counts).select("_sf_b", offset.alias("_sf_off"))
    inside = Window.partitionBy("_sf_b").orderBy(*order)
    if tasks:       # the counts above are summed before they move; both sides, or Spark may deal the rows again by its own number
        x, offsets = x.repartition(tasks, "_sf_b"), offsets.repartition(tasks, "_sf_b")
    # ranked before the join, which can then use the same sort; merged, as a hash join may turn a bucket's rows round,
    # and with them what a second numbering makes of rows that tie
    return (x.withColumn("_sf_row", F.row_number().over(inside)).join(offsets.hint("merge"), on="_sf_b", how="inner")
              .withColumn(id_col, (base - 1 + F.col("_sf_off") + F.col("_sf_row")).cast("bigint"))
              .drop("_sf_off", "_sf_row", "_sf_b"))


def id_continue(df: DataFrame, existing: DataFrame, id_col: str, order: Sequence[str | Column],
                existing_id_col: str | None = None, bucket: Sequence[str] | None = None,
                tasks: int | None = None) -> DataFrame:
    """New ids continue after ``MAX(id)`` of ``existing`` (1 when it is empty).

    ``existing`` is only scanned for its max id, which enters the plan as a
    scalar subquery; ``bucket`` and ``tasks`` work as in ``id_assign`` for big batches.
    """
    src = existing_id_col or id_col
    start = existing.select(F.coalesce(F.max(src), F.lit(0)).cast("bigint") + 1).scalar()
    return id_assign(df, order, id_col=id_col, bucket=bucket, start=start, tasks=tasks)


def id_before(df: DataFrame, existing: DataFrame, id_col: str, order: Sequence[str | Column],
              existing_id_col: str | None = None, bucket: Sequence[str] | None = None) -> DataFrame:
    """Ids that end right before ``MIN(id)`` of ``existing`` (before 1 when it is empty).

    ``order`` and ``bucket`` are those of the *reversed* sequence: the first row
    gets the highest new id. So no count of ``df`` is needed.
    """
    src = existing_id_col or id_col
    least = existing.select(F.coalesce(F.min(src), F.lit(1)).cast("bigint")).scalar()
    return id_assign(df, order, id_col="_sf_rev", bucket=bucket).withColumn(
        id_col, (least - F.col("_sf_rev")).cast("bigint")).drop("_sf_rev")
