"""The streaming ledger equals the batch ledger, also when the lines arrive over several micro-batches."""

from __future__ import annotations

import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq

from stockflow.plans import ledger as L
from stockflow.sources import files as FS
from stockflow.sources import stock_log
from stockflow.streaming import ledger_stream as LS

SCHEMA = pa.schema([("id_detalle", pa.int64()), ("id_variante", pa.int64()), ("cantidad", pa.int32()),
                    ("precio_unitario", pa.decimal128(12, 2)), ("tipo_movimiento", pa.string()),
                    ("id_sucursal_origen", pa.int64()), ("id_sucursal_destino", pa.int64())])


def _lines():
    from decimal import Decimal
    rows, i = [], 0
    pattern = [("Entrada", 1, None, 5), ("Salida", 1, None, 3), ("Traslado", 1, 2, 2), ("Salida", 2, None, 1),
               ("Salida", 1, None, 4), ("Entrada", 2, None, 2), ("Traslado", 2, 1, 3), ("Salida", 1, None, 2)]
    for rep in range(3):
        for v in (1, 2, 3):
            for t, o, d, q in pattern:
                i += 1
                rows.append((i, v, q + rep % 2, Decimal("1.00"), t, o, d))
    return rows


def test_stream_equals_batch_over_micro_batches(spark):
    rows = _lines()
    landing = tempfile.mkdtemp(prefix="sf-land-")
    chunks = [rows[k:k + 20] for k in range(0, len(rows), 20)]
    now = time.time() - 1000
    for n, chunk in enumerate(chunks):
        cols = list(zip(*chunk, strict=True))
        table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, SCHEMA, strict=True)],
                                     schema=SCHEMA)
        path = os.path.join(landing, f"part-{n:05d}.parquet")
        pq.write_table(table, path)
        os.utime(path, (now + n * 10, now + n * 10))    # arrival order = file order
    batch_df = spark.createDataFrame(rows, "id_detalle long, id_variante long, cantidad int, "
                                           "precio_unitario decimal(12,2), tipo_movimiento string, "
                                           "id_sucursal_origen long, id_sucursal_destino long")
    stream = (spark.readStream.schema(batch_df.schema).option("maxFilesPerTrigger", 1).parquet(landing))
    out = tempfile.mkdtemp(prefix="sf-out-")
    q = (LS.stream_stock_ledger(stream).writeStream.format("parquet").option("path", out + "/o")
         .option("checkpointLocation", out + "/c").trigger(availableNow=True).start())
    q.awaitTermination(600)
    assert q.exception() is None
    assert len(q.recentProgress) >= len(chunks)
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/o").select(*[f.name for f in L.FOLD_SCHEMA]).collect())
    want = sorted(tuple(r) for r in L.validate_stock(batch_df).select(*[f.name for f in L.FOLD_SCHEMA]).collect())
    assert got == want

    # publishing keeps the latest balance per cell = stock after applying the accepted lines
    decided = spark.read.parquet(out + "/o")
    root = tempfile.mkdtemp(prefix="sf-pub-")
    LS.publish_batch(spark, root, decided.where("id_detalle <= 30"), 0)
    LS.publish_batch(spark, root, decided.where("id_detalle > 30"), 1)
    LS.publish_batch(spark, root, decided.where("id_detalle > 30"), 1)      # replay is idempotent
    pub = {(r[0], r[1]): r[2] for r in stock_log.read_stock(spark, root).collect()}
    empty = spark.createDataFrame([], "id_sucursal long, id_variante long, cantidad_disponible int")
    applied = {(r[0], r[1]): r[2] for r in L.apply_accepted(empty, L.validate_stock(batch_df)).collect()}
    assert pub == applied


def test_a_hot_variant_over_restarts_equals_the_batch_ledger(spark):
    """A third of the lines on one variant, several micro-batches, and the query stopped and started in between."""
    import random

    from stockflow.streaming.queries import _land
    rng = random.Random(4)
    rows = [(i + 1, 1 if i % 3 == 0 else rng.randint(2, 9), rng.randint(1, 6), None,
             rng.choice(["Entrada", "Salida", "Salida", "Traslado"]), rng.randint(1, 3), rng.randint(1, 3)) for i in range(600)]
    rows = [r if r[4] == "Traslado" else (*r[:6], None) for r in rows]
    lines = spark.createDataFrame(rows, "id_detalle long, id_variante long, cantidad int, precio_unitario decimal(12,2), "
                                        "tipo_movimiento string, id_sucursal_origen long, id_sucursal_destino long")
    path, stream = _land(lines, "hot", order="id_detalle", files_per_trigger=2, lines_per_file=40)
    sizes = [spark.read.parquet(f"{path}/{f}").count() for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    assert max(sizes) <= 40 and sum(sizes) == 600

    base = tempfile.mkdtemp(prefix="sf-hot-")
    half = base + "/first-files"
    os.mkdir(half)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    now = time.time() - 1000

    def arrive(names):
        for n, f in enumerate(names):
            with open(f"{path}/{f}", "rb") as src, open(f"{half}/{f}", "wb") as dst:
                dst.write(src.read())
            os.utime(f"{half}/{f}", (now + files.index(f), now + files.index(f)))

    def run():
        source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(half)
        q = (LS.stream_stock_ledger(source).writeStream.format("parquet").option("path", base + "/o")
             .option("checkpointLocation", base + "/c").trigger(availableNow=True).start())
        q.awaitTermination(600)
        assert q.exception() is None
        return len([p for p in q.recentProgress if p["numInputRows"]])

    arrive(files[:len(files) // 2])
    turns = run()
    arrive(files[len(files) // 2:])
    turns += run()                                  # a new query on the state that the first one has left
    assert turns >= len(files) // 2
    cols = [f.name for f in L.FOLD_SCHEMA]
    got = sorted(tuple(r) for r in spark.read.parquet(base + "/o").select(*cols).collect())
    assert got == sorted(tuple(r) for r in L.validate_stock(lines).select(*cols).collect())


CELLS = "id_sucursal long, id_variante long, cantidad_disponible int"


def _stock(spark, root, **how):
    return {(r[0], r[1]): r[2] for r in stock_log.read_stock(spark, root, **how).collect()}


def test_stock_log_writes_what_changed_and_survives_a_crash(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "stock")
    first = [(1, v, v) for v in range(2000)]
    assert stock_log.append(spark, root, spark.createDataFrame(first, CELLS), 0)
    assert stock_log.append(spark, root, spark.createDataFrame([(1, 7, 70), (2, 7, 5)], CELLS), 1)
    size = lambda b: sum(os.path.getsize(f"{root}/delta-{b:012d}/{f}") for f in os.listdir(f"{root}/delta-{b:012d}"))
    assert spark.read.parquet(f"{root}/delta-{1:012d}").count() == 2 and size(1) < size(0)
    want = {(b, v): q for b, v, q in first} | {(1, 7): 70, (2, 7): 5}
    assert _stock(spark, root) == want

    # the same batch again changes nothing
    assert not stock_log.append(spark, root, spark.createDataFrame([(1, 7, 1)], CELLS), 1)
    assert _stock(spark, root) == want

    # a crash after the delta, and one after the manifest: readers see the old version, the batch written again counts once
    with monkeypatch.context() as m:
        m.setattr(stock_log, "_write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            stock_log.append(spark, root, spark.createDataFrame([(1, 8, 0)], CELLS), 2)
        except OSError:
            pass
    assert _stock(spark, root) == want
    with monkeypatch.context() as m:
        m.setattr(FS, "publish_pointer", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            stock_log.append(spark, root, spark.createDataFrame([(1, 8, 0)], CELLS), 2)
        except OSError:
            pass
    assert _stock(spark, root) == want and [v["batch"] for v in stock_log.versions(spark, root)] == [0, 1]
    assert stock_log.append(spark, root, spark.createDataFrame([(1, 8, 80)], CELLS), 2)
    want2 = want | {(1, 8): 80}
    assert _stock(spark, root) == want2

    # compaction changes no value, and every version can still be read
    stock_log.compact(spark, root)
    assert stock_log.manifest(spark, root)["deltas"] == [] and _stock(spark, root) == want2
    assert stock_log.append(spark, root, spark.createDataFrame([(3, 1, 9)], CELLS), 3)
    assert _stock(spark, root) == want2 | {(3, 1): 9}
    assert _stock(spark, root, as_of=0) == {(b, v): q for b, v, q in first}
    assert _stock(spark, root, as_of=1) == want and _stock(spark, root, as_of=2) == want2
    times = [v["time"] for v in stock_log.versions(spark, root)]
    assert times == sorted(times) and [v["batch"] for v in stock_log.versions(spark, root)] == [0, 1, 2, 2, 3]


def test_an_empty_log(spark, tmp_path):
    root = str(tmp_path / "none")
    assert stock_log.manifest(spark, root) is None and stock_log.versions(spark, root) == []
    stock_log.compact(spark, root)
    assert stock_log.append(spark, root, spark.createDataFrame([], CELLS), 5)
    assert _stock(spark, root) == {}
