"""Registered streaming queries.

Each one lands the test data's lines (with their header fields) as Parquet
files under the shared checkpoint folder, runs the streaming query over them
with an ``availableNow`` trigger into a Parquet sink, and returns the sink
read back as a DataFrame. The SQL oracle is the batch rule: a stream must
produce exactly what the batch ledger produces.
"""

from __future__ import annotations

import re
import time
from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.plans import ledger as L
from stockflow.registry import _SQL, register
from stockflow.session import ensure_checkpoint_dir, kept, releasing
from stockflow.sources import files as FS
from stockflow.sources import stock_log
from stockflow.sources.testdata import headers, lines
from stockflow.streaming import ledger_stream as LS


def _dir(spark, what: str) -> str:
    return FS.new_version_dir(f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{what}")


#: Landing files that a micro-batch takes, and lines in a file: together they bound a micro-batch. Every
#: micro-batch starts each of the state's partitions and writes the pages that it names, so few large ones cost least.
FILES_PER_TRIGGER, LINES_PER_FILE = 64, 250_000


def _land(df: DataFrame, what: str, order: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER,
          lines_per_file: int = LINES_PER_FILE, last: int | None = None) -> tuple[str, DataFrame]:
    """Write a batch frame as the stream's landing files; return the folder and a streaming reader.

    With ``order`` the files are ranges of it, named and landed in its order, so that each
    micro-batch takes the lines that come next. ``last``: whole numbers of ``order`` run from 1 to about
    this one, so that the ranges needn't be drawn from a first pass over the lines; without it they are.
    """
    spark = df.sparkSession
    path = _dir(spark, what) + "/landing"
    with releasing(spark):
        if order is None:
            df.write.option("maxRecordsPerFile", lines_per_file).parquet(path)
        else:
            if last is None:
                dealt = df.repartitionByRange(order)
            else:
                n = max(1, -(-last // lines_per_file))
                place = F.floor((F.coalesce(F.col(order), F.lit(1)) - 1) / F.lit(lines_per_file))
                place = F.greatest(F.lit(0), F.least(F.lit(n - 1), place)).cast("int")
                dealt = df.repartitionById(n, place)
            dealt.sortWithinPartitions(order).write.option("maxRecordsPerFile", lines_per_file).parquet(path + "/staged")
    if order is not None:
        _in_name_order(spark, path)
    return path, (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def _in_name_order(spark, path: str) -> None:
    """Move staged files into the landing folder with times that rise with their names: the file source takes
    the oldest first."""
    fs, staged = FS._hadoop_fs(spark, path + "/staged/part-*")
    # by the numbers in their names, which have no fixed width
    files = sorted((str(f.getPath()) for f in fs.globStatus(staged)),
                   key=lambda name: [int(x) for pair in re.findall(r"^part-(\d+)-|-c(\d+)\.", name.rsplit("/", 1)[1]) for x in pair if x])
    start = int(time.time() * 1000) - 1000 * (len(files) + 1)
    for n, name in enumerate(files):
        _, old = FS._hadoop_fs(spark, name)
        _, new = FS._hadoop_fs(spark, f"{path}/{n:09d}.parquet")
        fs.setTimes(old, start + 1000 * n, -1)
        if not fs.rename(old, new):
            raise OSError(f"could not land {name}")
    fs.delete(FS._hadoop_fs(spark, path + "/staged")[1], True)


def _run_to_parquet(stream_df: DataFrame, what: str, stateful: bool = False) -> DataFrame:
    spark = stream_df.sparkSession
    base = _dir(spark, what)
    w = (stream_df.writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/chk").outputMode("append").trigger(availableNow=True))
    with LS.few_state_partitions(spark) if stateful else nullcontext():
        q = w.start()
    q.awaitTermination()   # to the end of the landed files; a failed query raises here
    return spark.read.schema(stream_df.schema).parquet(base + "/out")


def _lines(t):
    return L.lines_with_header(headers(t), t["detalle_movimientos"],
                               ["id_detalle", "id_movimiento", "id_variante", "cantidad", "precio_unitario"])


def _last_line(t) -> int:
    """Lines are numbered from 1 without gaps, so the last one has their number."""
    return lines(t).count()


def _variants(t):
    """The variants that lines may name, made once for all micro-batches."""
    return kept(t["producto_variante"].select("id_variante"), "variants")


@register("stream_fill_price")
def stream_fill_price(t):
    """Arriving till lines (first line of each order at price 0) priced by a stream-static join."""
    li = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id_movimiento"), F.col("l_partkey").alias("id_variante"),
        F.col("l_quantity").cast("int").alias("cantidad"),
        F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_extendedprice")).cast("decimal(12,2)")
         .alias("precio_unitario"))
    req = li.join(headers(t).select("id_movimiento", "tipo_movimiento"), "id_movimiento", "inner")
    _, stream = _land(req, "fill")
    # the static side is made once, not in every micro-batch
    pv = kept(t["producto_variante"].select("id_variante", "id_producto"), "fill-variants")
    prod = kept(t["productos"].select("id_producto", "precio_venta_actual"), "fill-products")
    out = LS.stream_fill_price(stream, pv, prod)
    res = _run_to_parquet(out.select("id_movimiento", "id_variante", "cantidad", "precio_original", "precio_unitario",
                                     "precio_completado"), "fill-out")
    return res


@register("stream_stock_ledger")
def stream_stock_ledger(t):
    """Every line accepted or rejected by the keyed streaming ledger, from empty stock."""
    _, stream = _land(_lines(t).select(*LS.LINE_COLUMNS), "ledger", order="id_detalle", last=_last_line(t))
    return _run_to_parquet(LS.stream_stock_ledger(stream, pv=_variants(t)), "ledger-out", stateful=True)


@register("stream_publish_stock")
def stream_publish_stock(t):
    """Latest stock per cell published by foreachBatch from the streaming ledger."""
    spark = t["marcas"].sparkSession
    _, stream = _land(_lines(t).select(*LS.LINE_COLUMNS), "publish", order="id_detalle", last=_last_line(t))
    decided = LS.stream_stock_ledger(stream, pv=_variants(t))
    base = _dir(spark, "publish-out")
    q = LS.stream_publish_stock(decided, base + "/stock", base + "/chk")
    q.awaitTermination()   # to the end of the landed files; a failed query raises here
    return stock_log.read_stock(spark, base + "/stock")


def _attach_sql():
    """The streams must equal the batch rules: reuse the batch oracles."""
    from stockflow.plans import ledger_queries  # noqa: F401  (registers the batch keys)
    _SQL["stream_fill_price"] = _SQL["ledger_fill_price"]
    _SQL["stream_stock_ledger"] = _SQL["ledger_validate_stock"]
    _SQL["stream_publish_stock"] = _SQL["ledger_apply"]


_attach_sql()
