"""The stream's state in pages: few calls, few partitions, whole lines whatever their ids and texts are."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.readwriter import DataStreamWriter

from stockflow.plans import ledger as L
from stockflow.sources import stock_log
from stockflow.streaming import ledger_stream as LS
from stockflow.streaming import queries as SQ

LINES = ("id_detalle long, id_variante long, cantidad int, precio_unitario decimal(12,2), tipo_movimiento string, "
         "id_sucursal_origen long, id_sucursal_destino long")


class State:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def _events(rows):
    """Packed rows of (variant, line, type, origin, destination, units)."""
    n = len(rows)
    v, i, t, o, d, q = zip(*rows)
    columns = [[0] * n, [1] * n, v, i, t, o, [LS.NONE if x is None else x for x in d], q, [None] * n, [None] * n, [None] * n, [0] * n]
    batch = pa.Table.from_arrays([pa.array(c, x.type) for c, x in zip(columns, [pa.field("ev_bucket", pa.int64()), *LS._EVENT])],
                                 names=["ev_bucket", *LS._EVENT.names])
    return pa.Table.from_batches(LS.pack_lines(iter(batch.to_batches(max_chunksize=7)))).to_pandas()


def test_variants_of_a_page_share_their_calls():
    ledger = LS.VariantLedger()
    ledger.stock = State()
    for turn in range(2):
        rows = [(v, 1000 * turn + v, "Entrada", 1 + v % 3, None, 5) for v in range(LS.PAGE)]
        got = pd.concat(ledger.handleInputRows((0,), iter([_events(rows)]), None))
        assert len(got) == LS.PAGE and got["aceptado"].all() and set(got["saldo_origen"]) == {5 * (turn + 1)}
    assert ledger.stock.calls <= 5      # of one page: one write, then a look, a read and a write; it was three calls a variant


def test_a_page_keeps_any_cell():
    big = 1 << 62
    for number in (0, -3, LS.NONE >> LS.PAGE_BITS, big >> LS.PAGE_BITS):
        first = number << LS.PAGE_BITS
        page = {first: {1: 2, 300: -1}, first + LS.PAGE - 1: {big: big, -big: -big, 0: 0}, first + 1: {7: 1 << 20}}
        assert LS.page_cells(LS.page_bytes(page, number), number) == page
    assert LS.page_cells(LS.page_bytes({5: {}}, 0), 0) == {}


def _rows():
    from decimal import Decimal
    types = ["Entrada", "Salida", "Traslado", None, "otro"]
    rows = []
    for i in range(1, 901):
        v = None if i % 97 == 0 else (i * 37) % 301 - 20
        t = types[i % 5] if i % 11 == 0 else types[(i * 7) % 3]
        rows.append((i, v, None if i % 89 == 0 else (i * 13) % 9 - 1, Decimal(i % 50 - 1), t, None if i % 71 == 0 else i % 4,
                     i % 3 if t == "Traslado" or i % 53 == 0 else None))
    return rows


def _run(spark, lines, sink, **land):
    path, stream = SQ._land(lines, "pages", order="id_detalle", **land)
    assert spark.read.parquet(path).count() == lines.count()
    pv = spark.range(-20, 250).withColumnRenamed("id", "id_variante")
    return path, sink(LS.stream_stock_ledger(stream, pv=pv)), pv


def _few(query, spark):
    turns = [p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress if p["stateOperators"]]
    return turns and max(turns) <= LS.PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism


def test_the_ledger_stream_keeps_to_few_partitions_and_the_batch_rule(spark):
    """Many shuffle partitions in the session: each would cost every micro-batch a start and a commit."""
    lines = spark.createDataFrame(_rows(), LINES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(500))
    queries = []
    try:
        start = DataStreamWriter.start

        def seen(writer, *a, **b):
            queries.append(start(writer, *a, **b))
            return queries[-1]
        DataStreamWriter.start = seen
        try:
            path, got, pv = _run(spark, lines, lambda d: SQ._run_to_parquet(d, "pages-out", stateful=True), lines_per_file=150,
                                 files_per_trigger=2, last=900)
        finally:
            DataStreamWriter.start = start
        assert spark.conf.get("spark.sql.shuffle.partitions") == "500" and _few(queries[0], spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    names = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    ids = [sorted(r[0] for r in spark.read.parquet(f"{path}/{f}").select("id_detalle").collect()) for f in names]
    assert [i for file in ids for i in file] == list(range(1, 901)) and max(map(len, ids)) <= 150
    cols = [f.name for f in L.FOLD_SCHEMA]

    def in_order(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: r[0])
    assert in_order(got) == in_order(L.validate_stock(lines, pv=pv))


def test_the_publishing_stream_keeps_to_few_partitions(spark, tmp_path):
    lines = spark.createDataFrame(_rows(), LINES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(500))
    try:
        _, query, pv = _run(spark, lines, lambda d: LS.stream_publish_stock(d, str(tmp_path / "stock"), str(tmp_path / "chk")),
                            lines_per_file=300, files_per_trigger=2)
        query.awaitTermination(600)
        assert query.exception() is None and _few(query, spark)
        got = {(r[0], r[1]): r[2] for r in stock_log.read_stock(spark, str(tmp_path / "stock")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = spark.createDataFrame([], "id_sucursal long, id_variante long, cantidad_disponible int")
    decided = L.validate_stock(lines, pv=pv)
    assert got == {(r[0], r[1]): r[2] for r in LS.latest_per_cell(decided).collect()}
    new = {(r[0], r[1]): r[2] for r in L.apply_accepted(empty, decided).collect()}
    assert {k: q for k, q in got.items() if k in new} == {k: q for k, q in new.items() if k in got} and len(got) > 100


def test_ids_beyond_the_last_one_land_too(spark):
    """``last`` deals the ranges; it leaves no line out and keeps their order, also where it is wrong."""
    rows = [(i, 1, 1, None, "Entrada", 1, None) for i in [None, -5, *range(1, 60), 10**12]]
    path, _ = SQ._land(spark.createDataFrame(rows, LINES), "beyond", order="id_detalle", lines_per_file=10, last=20)
    names = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    ids = [[r[0] for r in spark.read.parquet(f"{path}/{f}").select("id_detalle").collect()] for f in names]
    assert [i for file in ids for i in file] == [None, -5, *range(1, 60), 10**12] and max(map(len, ids)) <= 10
