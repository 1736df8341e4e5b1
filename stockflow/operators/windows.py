"""Window operators, written so that a hot key never lands whole in one task.

A plain ``sum().over(partitionBy(cell).orderBy(t))`` puts every row of a cell
into one task. If one cell holds a third of all rows that task is the job.
``running_sum_split`` and ``dip_and_total`` measure which keys are hot and cut only
these, by their own row counts, into contiguous *chunks* of the order; running sums
and (lowest prefix, total) pairs are made inside each (key, chunk) in parallel, and
combined over one row a chunk. ``running_sum`` and ``prefix_min_and_total`` take the
chunks as given (for example one day of movements): lazy, exact for any chunk column
that is monotone in the order, and as parallel as that column makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.session import kept

_UNB = Window.unboundedPreceding


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str,
                out: str = "running", chunk: Column | None = None) -> DataFrame:
    """Cumulative ``sum(value)`` per key in ``order`` (rows frame, current row included).

    With ``chunk`` (a column monotone in ``order``), the sum is computed per
    (key, chunk) plus the chunk's offset, so hot keys are split across tasks.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_UNB, Window.currentRow)
        return df.withColumn(out, F.sum(value).over(w))
    # The in-chunk window shuffles by (key, chunk); the per-chunk sums and the
    # join back reuse that partitioning, only the small per-chunk table moves again.
    # Keys travel as one struct, which equals itself also where a key is null: no row is lost.
    x = df.withColumn("_sf_key", F.struct(*keys)).withColumn("_sf_chunk", F.struct(chunk.alias("c")))
    w_in = Window.partitionBy("_sf_key", "_sf_chunk").orderBy(*order).rowsBetween(_UNB, Window.currentRow)
    x = x.withColumn("_sf_in", F.sum(value).over(w_in))
    offs = chunk_offsets(x, ["_sf_key"], value)
    return (x.join(offs, on=["_sf_key", "_sf_chunk"], how="inner")
             .withColumn(out, F.col("_sf_off") + F.col("_sf_in"))
             .drop("_sf_key", "_sf_chunk", "_sf_in", "_sf_off"))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The keys of more than ``limit`` rows, as a frame of at most count / ``limit`` rows; None where there are none.

    One job of counts summed on the map side, where no key is hot; hot keys are kept
    in the shared checkpoint folder.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sf_n")).where(F.col("_sf_n") > limit).drop("_sf_n")
    return None if hot.isEmpty() else kept(hot, "hot")


def split_hot(df: DataFrame, keys: Sequence[str], limit: int, count_on: DataFrame | None = None,
              ) -> tuple[DataFrame, DataFrame | None]:
    """(rows of cold keys, rows of hot keys or None). Where a key is hot, ``df`` is stored first: it is
    evaluated once for both parts. ``count_on``: a cheaper frame with the keys, or a prefix of them, whose hot
    keys include all of ``df``'s."""
    keys = list(keys)
    if count_on is not None:
        keys = [k for k in keys if k in count_on.columns]
    hot = hot_keys(df if count_on is None else count_on, keys, limit)
    if hot is None:
        return df, None
    df = kept(df, "rows")
    hot = hot.withColumnsRenamed({k: f"_sf_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_sf_{k}"))
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int) -> DataFrame:
    """``df`` with ``_sf_row``, numbers that rise with the order by keys and ``order``, and ``_sf_chunk``:
    contiguous pieces of it of at most ``limit`` rows.

    The cuts are measured, not guessed from values: rows are range-partitioned by
    the whole order (Spark samples the ranges), sorted inside each partition, and
    each ``limit`` rows of a partition make a chunk. The numbered rows are stored, as ranges drawn again may differ.
    ``limit`` is rounded down to a power of two.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = [F.col(k) for k in keys] + order
    bits = max(0, limit.bit_length() - 1)
    return kept(df.repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumn("_sf_row", F.monotonically_increasing_id())
                .withColumn("_sf_chunk", F.shiftright("_sf_row", bits)), "chunks")


def running_sum_split(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str,
                      out: str = "running", limit: int = 1 << 16, count_on: DataFrame | None = None) -> DataFrame:
    """``running_sum`` with no window partition of more than ``limit`` rows of a key, for any spread of the order.

    Keys of up to ``limit`` rows are one window partition each. The others are cut by
    row counts (``ordered_chunks``); a chunk's rows add the sum of the key's earlier chunks,
    which is a prefix sum over one row a chunk. ``count_on``: see ``split_hot``.
    """
    cold, hot = split_hot(df, keys, limit, count_on)
    whole = running_sum(cold, keys, order, value, out)
    if hot is None:
        return whole
    x = ordered_chunks(hot, keys, order, limit)
    w_in = Window.partitionBy(*keys, "_sf_chunk").orderBy(*order).rowsBetween(_UNB, Window.currentRow)
    offs = chunk_offsets(x, keys, value)
    offs = offs.withColumnsRenamed({k: f"_sf_{k}" for k in keys}).withColumnRenamed("_sf_chunk", "_sf_c")
    x = x.withColumn("_sf_in", F.sum(value).over(w_in))
    on = F.col("_sf_chunk") == F.col("_sf_c")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_sf_{k}"))
    parts = x.join(offs, on, "inner").withColumn(out, F.col("_sf_off") + F.col("_sf_in"))
    return whole.unionByName(parts.select(*whole.columns))


def chunk_offsets(x: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per (key, chunk): the sum of ``value`` over all earlier chunks of the key."""
    keys = list(keys)
    per_chunk = x.groupBy(*keys, "_sf_chunk").agg(F.sum(value).alias("_sf_tot"))
    before = Window.partitionBy(*keys).orderBy("_sf_chunk").rowsBetween(_UNB, -1)
    return per_chunk.select(*keys, "_sf_chunk",
                            F.coalesce(F.sum("_sf_tot").over(before), F.lit(0)).alias("_sf_off"))


def prefix_min_and_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str,
                         chunk: Column | str | None = None, min_out: str = "worst", total_out: str = "net",
                         peers: bool = False, tasks: int | None = None) -> DataFrame:
    """Per key: the minimum of the running sum and the total, without emitting per-row sums.

    Two aggregation levels: inside a (key, chunk) the running sum and its min;
    across chunks ``min(offset + chunk_min)``. Work per task is bounded by the
    chunk size, not the key size. ``chunk`` may name a column already present
    (e.g. when the input was pre-aggregated on a partitioning by key + chunk).
    With ``peers``, rows of one place of ``order`` count together. ``tasks``: the
    number of partitions that both levels are dealt to, which Spark doesn't join
    again, so that a task's share doesn't grow with the input.
    """
    keys, order = list(keys), list(order)
    if isinstance(chunk, str):
        x = df.withColumnRenamed(chunk, "_sf_chunk") if chunk != "_sf_chunk" else df
    else:
        x = df.withColumn("_sf_chunk", chunk if chunk is not None else F.lit(0))
    w_in = Window.partitionBy(*keys, "_sf_chunk").orderBy(*order)
    w_in = w_in.rangeBetween(_UNB, Window.currentRow) if peers else w_in.rowsBetween(_UNB, Window.currentRow)
    x = x.repartition(tasks, *keys, "_sf_chunk") if tasks else x
    per_chunk = (x.withColumn("_sf_run", F.sum(value).over(w_in))
                  .groupBy(*keys, "_sf_chunk")
                  .agg(F.sum(value).alias("_sf_tot"), F.min("_sf_run").alias("_sf_min")))
    per_chunk = per_chunk.repartition(tasks, *keys) if tasks else per_chunk
    before = Window.partitionBy(*keys).orderBy("_sf_chunk").rowsBetween(_UNB, -1)
    per_chunk = per_chunk.withColumn("_sf_off", F.coalesce(F.sum("_sf_tot").over(before), F.lit(0)))
    return per_chunk.groupBy(*keys).agg(
        F.min(F.col("_sf_off") + F.col("_sf_min")).alias(min_out),
        F.sum("_sf_tot").alias(total_out))


def dip_and_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, limit: int = 1 << 16,
                  min_out: str = "worst", total_out: str = "net", count_on: DataFrame | None = None) -> DataFrame:
    """Per key: the lowest sum after any place of ``order`` and the total; rows of one place count together.

    (lowest prefix, total) of neighbouring pieces combine associatively:
    ``(min(low1, total1 + low2), total1 + total2)``. A key of up to ``limit`` rows is
    folded by one window; the others are summed by place, cut into chunks by row counts,
    folded inside each chunk and merged up a tree, so any key, and any place, may be
    hot. ``count_on``: see ``split_hot``.
    """
    keys, order = list(keys), list(order)
    cold, hot = split_hot(df, keys, limit, count_on)
    at = Window.partitionBy(*keys).orderBy(*order)      # default frame: up to the current place, its peers included
    out = (cold.withColumn("_sf_run", F.sum(value).over(at)).groupBy(*keys)
           .agg(F.min("_sf_run").alias(min_out), F.sum(value).alias(total_out)))
    if hot is None:
        return out
    places = hot.groupBy(*keys, *order).agg(F.sum(value).alias("_sf_v"))
    x = ordered_chunks(places, keys, order, limit)
    w_in = Window.partitionBy(*keys, "_sf_chunk").orderBy(*order).rowsBetween(_UNB, Window.currentRow)
    level = (x.withColumn("_sf_run", F.sum("_sf_v").over(w_in)).groupBy(*keys, "_sf_chunk")
             .agg(F.min("_sf_run").alias("_sf_low"), F.sum("_sf_v").alias("_sf_tot")))
    return out.unionByName(merge_up(level, keys).withColumnsRenamed({"_sf_low": min_out, "_sf_tot": total_out})
                           .select(*out.columns))


#: Pieces that one step of the tree merges: 2 ** 10; chunk numbers have 63 bits.
_TREE_BITS, _TREE_LEVELS = 10, 5


def merge_up(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold (``_sf_low``, ``_sf_tot``) of each key's pieces in the order of ``_sf_chunk``, up a tree.

    A step merges pieces whose numbers agree but for their last ten bits, so no task folds
    more than 1,024 of a key; the last step has few left and folds what there is.
    """
    for step in range(_TREE_LEVELS):
        last = step == _TREE_LEVELS - 1
        parent = F.lit(0).cast("bigint") if last else F.shiftright("_sf_chunk", _TREE_BITS)
        x = level.withColumn("_sf_parent", parent)
        before = Window.partitionBy(*keys, "_sf_parent").orderBy("_sf_chunk").rowsBetween(_UNB, -1)
        level = (x.withColumn("_sf_off", F.coalesce(F.sum("_sf_tot").over(before), F.lit(0)))
                 .groupBy(*keys, "_sf_parent").agg(F.min(F.col("_sf_off") + F.col("_sf_low")).alias("_sf_low"),
                                                   F.sum("_sf_tot").alias("_sf_tot"))
                 .withColumnRenamed("_sf_parent", "_sf_chunk"))
    return level.drop("_sf_chunk")
