"""Structured Streaming twins of the ledger jobs.

Arriving detail lines (with their header fields) are processed as the
triggers would process each inserted row:

* ``stream_fill_price``   — stream-static join with the list prices;
* ``stream_stock_ledger`` — ``transformWithState`` with a map state page -> cells. A page
  is the stock of up to ``PAGE`` neighbouring variants as one value: a call to the state costs
  as much as tens of lines, so a micro-batch reads and writes each page that its lines
  name once, and no others. Pages are dealt to ``BUCKETS`` keys. Lines travel to
  their key packed (``pack_lines``), as a row that enters Python costs more than its replay.
  The lines of a micro-batch are replayed in ``id_detalle`` order, accepted or
  rejected. A line touches one variant only (a transfer moves stock between two
  cells of the same variant), so the buckets are exact;
* ``stream_publish_stock`` — ``foreachBatch`` writes the cells that a micro-batch has
  changed as one delta of the stock (``sources.stock_log``): what it writes follows
  the batch, not the table.

No watermark is involved: arrival order is the rule, as with the triggers. The
sources land in id order, one bounded file after the other, and a micro-batch takes
``maxFilesPerTrigger`` of them: that bounds what a task holds of one variant,
however much of the history the variant has.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stockflow.plans import ledger as L
from stockflow.plans.ledger import _NONE as NONE
from stockflow.plans.ledger import FOLD_SCHEMA
from stockflow.sources import stock_log

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep keyed state in RocksDB (off-heap, spills to local disk, checkpointed to the
    shared checkpoint folder) unless the session already names a provider."""
    current = spark.conf.get(_PROVIDER_KEY, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER_KEY, ROCKSDB_PROVIDER)


#: Keys of the stream's state, and variants of a page of it. A checkpoint holds its stock by them: not to be changed under one.
BUCKETS, PAGE_BITS = 1024, 6
PAGE = 1 << PAGE_BITS
#: Lines that a task packs at a time; bytes of packed lines that enter Python at a time.
PACK_LINES, PACK_BYTES = 1 << 18, 16 << 20
#: Partitions of the state for each core, at most.
PARTITIONS_A_CORE = 3
LINE_COLUMNS = ["id_detalle", "id_variante", "cantidad", "precio_unitario", "tipo_movimiento",
                "id_sucursal_origen", "id_sucursal_destino"]


def stream_fill_price(lines: DataFrame, pv: DataFrame, prod: DataFrame) -> DataFrame:
    """Price fill on arriving sale lines: a stream-static left join with list prices."""
    return L.fill_price(lines, pv, prod)


@contextmanager
def few_state_partitions(spark: SparkSession):
    """A query started inside deals its state to a few partitions a core, or to the session's number if that is less.

    Each partition costs each micro-batch a start, a commit and its files, however few lines it has. The
    number stays with the query's checkpoint."""
    n = PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": lambda now: str(min(int(now), n)),
            "spark.sql.execution.arrow.maxBytesPerBatch": lambda now: str(min(_bytes(now), PACK_BYTES))}
    before = {key: spark.conf.get(key) for key in held}
    for key, new in held.items():
        spark.conf.set(key, new(before[key]))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _bytes(text: str) -> int:
    """A size as Spark's settings tell it; what isn't above 0 is no limit."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    number = text.lower().removesuffix("b")
    n = int(number[:-1]) << units[number[-1]] if number[-1:] in units else int(number)
    return n if n > 0 else 1 << 62


_EVENT = pa.schema([
    ("ev_kind", pa.int32()), ("id_variante", pa.int64()), ("id_detalle", pa.int64()), ("tipo_movimiento", pa.string()),
    ("id_sucursal_origen", pa.int64()), ("id_sucursal_destino", pa.int64()), ("cantidad", pa.int32()), ("ev_pre", pa.string()),
    ("ev_null", pa.string()), ("ev_late", pa.string()), ("ev_init", pa.int64())])


def pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of each bucket among ``PACK_LINES`` of a task as one row: their columns (``_EVENT``) as Arrow bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_LINES:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    bucket = table.column("ev_bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    (lines,) = table.select(_EVENT.names).cast(_EVENT).take(pa.array(order)).combine_chunks().to_batches()
    keys, starts, counts = np.unique(bucket[order], return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([lines.slice(a, n).serialize().to_pybytes() for a, n in zip(starts.tolist(), counts.tolist())],
                                              pa.binary())], names=["ev_bucket", "ev_lines"])


def _unpacked(rows: Iterator[pd.DataFrame]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of ``_EVENT`` of all packed rows, texts as places in an array of the distinct ones, and that array."""
    table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(packed), _EVENT) for p in rows for packed in p["ev_lines"]])
    columns, places = [], {None: 0}     # of one micro-batch: bounded by the source's rate
    for c in table.columns:
        if not pa.types.is_string(c.type):
            columns.append(c.to_numpy())
        elif c.null_count == len(c):
            columns.append(np.zeros(len(c), dtype=np.int32))
        else:
            c = c.combine_chunks().dictionary_encode()
            known = np.array([places.setdefault(x, len(places)) for x in [*c.dictionary.to_pylist(), None]], dtype=np.int32)
            columns.append(known[c.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)])
    return columns, np.array(list(places), dtype=object)


def _narrow(values: list[int]) -> bytes:
    """Whole numbers in the fewest bytes each that hold all of them, after a byte that tells how many."""
    a = np.array(values, dtype=np.int64)
    for width in (1, 2, 4):
        bound = 1 << (8 * width - 1)
        if -bound <= a.min() and a.max() < bound:
            break
    else:
        width = 8
    return bytes([width]) + a.astype(f"<i{width}").tobytes()


def page_bytes(page: dict[int, dict[int, int]], number: int) -> bytes:
    """The cells of a page (variant -> branch -> units), column by column: variants by their place, branches, units."""
    first = number << PAGE_BITS
    columns = ([v - first for v, stock in page.items() for _ in stock], [b for stock in page.values() for b in stock],
               [u for stock in page.values() for u in stock.values()])
    n = len(columns[0])
    return n.to_bytes(8, "little") + b"".join(_narrow(c) for c in columns if n)


def page_cells(data: bytes, number: int) -> dict[int, dict[int, int]]:
    """The page that ``page_bytes`` has written."""
    n, at, columns = int.from_bytes(data[:8], "little"), 8, []
    for _ in range(3 if n else 0):
        width = data[at]
        columns.append(np.frombuffer(data, f"<i{width}", n, at + 1).tolist())
        at += 1 + n * width
    first, page = number << PAGE_BITS, {}
    for v, b, u in zip(*columns):
        page.setdefault(first + v, {})[b] = u
    return page


def _whole_or_null(values: np.ndarray, null: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(values.astype(np.int64), null)


class VariantLedger(StatefulProcessor):
    """Replays each micro-batch's lines of a bucket of variants, one variant after the other, against its stock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getMapState("stock", "pagina long", "celdas binary")

    def _read(self, number: int) -> dict:
        if not self.stock.containsKey((number,)):
            return {}
        return page_cells(bytes(self.stock.getValue((number,))[0]), number)

    def _write(self, number: int | None, page: dict, changed: bool) -> None:
        if changed:
            self.stock.updateValue((number,), (page_bytes(page, number),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns, texts = _unpacked(rows)
        order = np.lexsort((columns[2], columns[0], columns[1]))
        now, stock, number, page, changed = None, {}, None, {}, False
        for a in range(0, len(order), 10_000):
            part = [c[order[a:a + 10_000]] for c in columns]
            for k in (3, 7, 8, 9):
                part[k] = texts[part[k]]
            out = []        # of each line: available units, reason, balances of origin and destination
            for kind, v, t, o, d, q, pre, null, late, init in zip(*(c.tolist() for k, c in enumerate(part) if k != 2)):
                if v != now:
                    if v >> PAGE_BITS != number:
                        self._write(number, page, changed)
                        number, changed = v >> PAGE_BITS, False
                        page = self._read(number)
                    now, stock = v, page.setdefault(v, {})
                if kind == 0:                       # starting stock of a cell
                    stock[o], changed = init, True
                    continue
                decided = L.replay_line(stock, t, None if o == NONE else o, None if d == NONE else d, q, pre, null, late)
                changed = changed or decided[1] is None
                out.append(decided)
            if out:
                yield self._frame(part, *zip(*out))
        self._write(number, page, changed)

    @staticmethod
    def _frame(part: list[np.ndarray], available: tuple, reasons: tuple, origin: tuple, destination: tuple) -> pd.DataFrame:
        """Rows of FOLD_SCHEMA; whole numbers with NULLs stay whole numbers."""
        line = part[0] != 0
        _, variant, ids, tipo, o, d, q, _, null, _, _ = (c[line] for c in part)

        def of(values):
            x = np.array([NONE if x is None else x for x in values], dtype=np.int64)
            return _whole_or_null(x, x == NONE)
        return pd.DataFrame({
            "id_detalle": ids, "id_variante": _whole_or_null(variant, variant == NONE), "tipo_movimiento": tipo,
            "id_sucursal_origen": _whole_or_null(o, o == NONE), "id_sucursal_destino": _whole_or_null(d, d == NONE),
            "cantidad": _whole_or_null(q, null == L.REASON_NULL_QUANTITY), "disponible": np.array(available, dtype=np.int64),
            "aceptado": np.array([r is None for r in reasons], dtype=bool), "motivo": np.array(reasons, dtype=object),
            "saldo_origen": of(origin), "saldo_destino": of(destination)})

    def close(self) -> None:
        pass


def stream_stock_ledger(lines: DataFrame, pv: DataFrame | None = None, stock: DataFrame | None = None) -> DataFrame:
    """Accept or reject each arriving line against the keyed stock state.

    ``lines``: a streaming DataFrame with ``LINE_COLUMNS`` (optionally
    ``motivo_previo``); ``pv``: static variants for the foreign-key check;
    ``stock``: optional streaming rows of starting stock that arrive first.
    """
    x = L._prepare(lines, pv).withColumnsRenamed({"_pre": "ev_pre", "_late": "ev_late", "_null": "ev_null"})
    text = F.lit(None).cast("string")
    events = x.withColumn("ev_kind", F.lit(1)).withColumn("ev_init", F.lit(0).cast("bigint"))
    if stock is not None:
        events = events.unionByName(stock.select(
            F.lit(0).alias("ev_kind"), F.lit(NONE).alias("id_detalle"),
            F.col("id_variante").cast("bigint").alias("id_variante"), text.alias("tipo_movimiento"),
            F.col("id_sucursal").cast("bigint").alias("id_sucursal_origen"), F.lit(NONE).alias("id_sucursal_destino"),
            F.lit(0).alias("cantidad"), text.alias("ev_pre"), text.alias("ev_late"), text.alias("ev_null"),
            F.coalesce(F.col("cantidad_disponible").cast("bigint"), F.lit(0)).alias("ev_init")))
    use_rocksdb_state(lines.sparkSession)
    page = F.shiftright("id_variante", PAGE_BITS)
    events = events.select(F.pmod(F.xxhash64(page), F.lit(BUCKETS)).alias("ev_bucket"), *_EVENT.names)
    packed = events.mapInArrow(pack_lines, "ev_bucket long, ev_lines binary")
    return packed.groupBy("ev_bucket").transformWithStateInPandas(
        statefulProcessor=VariantLedger(), outputStructType=FOLD_SCHEMA, outputMode="Append", timeMode="None")


def latest_per_cell(decided: DataFrame) -> DataFrame:
    """Balance after the highest line id per cell (both legs of a transfer)."""
    legs = decided.select("id_detalle", "id_variante", F.inline(F.array(
        F.struct(F.col("id_sucursal_origen").alias("id_sucursal"), F.col("saldo_origen").alias("saldo")),
        F.struct(F.col("id_sucursal_destino").alias("id_sucursal"), F.col("saldo_destino").alias("saldo")))))
    legs = legs.where(F.col("id_sucursal").isNotNull() & F.col("saldo").isNotNull())
    return legs.groupBy("id_sucursal", "id_variante").agg(
        F.max_by("saldo", "id_detalle").cast("int").alias("cantidad_disponible"))


def publish_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: int) -> None:
    """Publish the cells that one micro-batch has changed; a replayed batch changes nothing."""
    stock_log.append(spark, root, latest_per_cell(batch), batch_id)


def stream_publish_stock(decided: DataFrame, root: str, checkpoint: str, trigger_once: bool = True):
    """Start the publishing query (``foreachBatch``); returns the StreamingQuery."""
    spark = decided.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        publish_batch(spark, root, batch, batch_id)

    w = decided.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    with few_state_partitions(spark):
        return w.start()


# The keyed replay runs in Python workers, which may not have this package on
# their path: ship it by value (it only uses pandas, Arrow and the constants above).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
