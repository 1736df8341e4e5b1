"""No row is lost: NULL keys, NULL quantities, the version pointer."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockflow.operators.ids import id_assign, id_before
from stockflow.operators.sorts import global_rank
from stockflow.operators.windows import running_sum, running_sum_split
from stockflow.plans import jobs as J
from stockflow.plans import ledger as L
from stockflow.sources import files as FS
from stockflow.sources import stock_log
from stockflow.streaming import ledger_stream as LS
from tests.conftest import seed_frames

NOW = dt.datetime(2025, 1, 2, 9, 0, 0)


def test_ids_number_rows_with_null_buckets(spark):
    rows = [(None, 5), (None, 6), (1, None), (1, 2), (2, 1), (None, None)]
    df = spark.createDataFrame(rows, "d int, k int")
    got = id_assign(df, [F.col("d").asc_nulls_first(), F.col("k").asc_nulls_first()], bucket=["d", "k"]).collect()
    assert [(r["d"], r["k"]) for r in sorted(got, key=lambda r: r["id"])] == [
        (None, None), (None, 5), (None, 6), (1, None), (1, 2), (2, 1)]
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5, 6]
    old = spark.createDataFrame([(3,), (9,)], "id int")
    back = id_before(df, old, "id", [F.col("d").desc_nulls_last(), F.col("k").desc_nulls_last()])
    assert sorted(r["id"] for r in back.collect()) == [-3, -2, -1, 0, 1, 2]


def test_running_sums_keep_null_keys(spark):
    rows = [(None, i, 1) for i in range(20)] + [(1, i, 2) for i in range(5)] + [(2, 7, -1)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    plain = sorted((r["k"] or 0, r["i"], r["running"]) for r in running_sum(df, ["k"], ["i"], "v").collect())
    chunked = running_sum(df, ["k"], ["i"], "v", chunk=F.floor(F.col("i") / 3))
    split = running_sum_split(df, ["k"], ["i"], "v", limit=4)
    for x in (chunked, split):
        assert sorted((r["k"] or 0, r["i"], r["running"]) for r in x.collect()) == plain
    assert len(plain) == len(rows)


def test_rank_keeps_null_buckets(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("b", 1)], "b string, x int")
    got = global_rank(df, [F.col("b"), F.col("x")], bucket=[F.col("b")]).collect()
    assert sorted((r["b"] or "", r["x"], r["posicion"]) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 1, 3), ("b", 1, 4)]


def _receive(spark, rows):
    return spark.createDataFrame(rows, "request_id long, id_sucursal long, id_empleado long, id_proveedor long, "
                                       "id_variante long, cantidad int, precio_unitario decimal(12,2)")


def test_broken_requests_are_refused_one_by_one(spark, seed):
    from decimal import Decimal as D
    p = D("1.00")
    rows = [(1, 1, 1, 1, 1, 5, p), (2, 999, 1, 1, 1, 5, p), (3, 1, 888, 1, 1, 5, p), (4, 1, 1, 777, 1, 5, p),
            (5, 1, None, 1, 1, 5, p), (6, 1, 1, 1, None, 5, p), (7, 1, 1, 1, 1, None, p), (8, 1, 1, 1, 555, 5, p),
            (None, 1, 1, 1, 1, 5, p), (9, None, 1, 1, 1, 5, p), (10, 1, 1, None, 1, 7, p)]
    res = J.job_receive(_receive(spark, rows), seed, seed["inventario"], NOW)
    got = {r["request_id"]: r["motivo"] for r in res.results.collect()}
    assert got == {None: None, 1: None, 2: L.REASON_BRANCH, 3: L.REASON_EMPLOYEE, 4: L.REASON_SUPPLIER,
                   5: L.REASON_NULL_EMPLOYEE, 6: L.REASON_NULL_VARIANT, 7: L.REASON_NULL_QUANTITY, 8: L.REASON_UNKNOWN,
                   9: L.REASON_NO_BRANCH, 10: None}
    stock = {(r["id_sucursal"], r["id_variante"]): r["cantidad_disponible"] for r in res.stock.collect()}
    assert stock[1, 1] == 153 + 5 + 5 + 7 and (999, 1) not in stock


def test_both_replays_agree_on_odd_lines(spark):
    big = 2 ** 53 + 1
    rows = [(1, 1, 4, "1.00", None, 1, None), (2, 1, 4, "1.00", "Salida", 1, None), (3, 1, None, "1.00", "Salida", 1, None),
            (4, None, 2, "1.00", "Salida", 1, None), (5, 2, 3, "1.00", "Entrada", 1, None), (6, 2, 1, "1.00", "Traslado", 1, big),
            (6, 2, 1, "1.00", "Traslado", 1, 3), (7, 2, 9, "-1.00", "Salida", 1, None), (8, 2, 1, "1.00", "Otro", 1, None)]
    lines = spark.createDataFrame(rows, "id_detalle long, id_variante long, cantidad int, precio_unitario string, "
                                        "tipo_movimiento string, id_sucursal_origen long, id_sucursal_destino long")
    lines = lines.withColumn("precio_unitario", F.col("precio_unitario").cast("decimal(12,2)"))
    stock = spark.createDataFrame([(1, 1, 5)], "id_sucursal long, id_variante long, cantidad_disponible int")
    plain = L.validate_stock(lines, stock).collect()
    split = L.validate_stock(lines, stock, split=True, chunk_lines=2).collect()
    assert len(plain) == len(rows)
    # two lines share an id, so their order is open: compare the lines by what identifies them
    key = lambda r: (r["id_detalle"], r["id_sucursal_destino"] or 0)
    for a, b in zip(sorted(plain, key=key), sorted(split, key=key)):
        assert (a["id_variante"], a["aceptado"], a["motivo"], a["cantidad"]) == (b["id_variante"], b["aceptado"], b["motivo"], b["cantidad"])
    assert big in {r["id_sucursal_destino"] for r in plain}


def test_pointer_is_replaced_in_one_step_and_its_loss_is_an_error(spark, tmp_path):
    root = str(tmp_path / "stock")
    cols = ("id_detalle long, id_variante long, id_sucursal_origen long, id_sucursal_destino long, "
            "saldo_origen long, saldo_destino long")
    first = spark.createDataFrame([(1, 1, 1, None, 5, None)], cols)
    LS.publish_batch(spark, root, first, 0)
    LS.publish_batch(spark, root, spark.createDataFrame([(2, 2, 1, None, 7, None)], cols), 1)
    assert stock_log.read_stock(spark, root).count() == 2
    fs, cur = FS._hadoop_fs(spark, root + "/_CURRENT")
    fs.rename(cur, FS._hadoop_fs(spark, root + "/_LOST")[1])
    with pytest.raises(RuntimeError):
        LS.publish_batch(spark, root, spark.createDataFrame([(3, 3, 1, None, 9, None)], cols), 2)


def test_bad_load_is_not_published(spark, tmp_path, seed):
    from stockflow.plans.catalog_queries import load_problems
    lines = spark.createDataFrame([(None, 1, 1, 1)], "id_detalle long, cantidad int, id_movimiento long, id_variante long")
    t = dict(seed_frames(spark).items())
    t["detalle_movimientos"] = lines.withColumn("precio_unitario", F.lit("1.00").cast("decimal(12,2)"))
    with pytest.raises(ValueError, match="primary keys"):
        FS.load_in_dependency_order(spark, t, str(tmp_path / "load"), checks=load_problems)
    assert FS.current_version(spark, str(tmp_path / "load")) is None
