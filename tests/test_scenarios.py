"""The reference's transaction scenarios, as request batches through the write jobs."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from stockflow.plans import jobs as J
from stockflow.plans import ledger as L
from stockflow.session import ensure_checkpoint_dir
from stockflow.sources import files as FS

NOW = dt.datetime(2026, 1, 1, 10, 0, 0)
SELL = "request_id long, id_sucursal long, id_empleado long, observaciones string, id_variante long, cantidad int"
RECV = ("request_id long, id_sucursal long, id_empleado long, id_proveedor long, observaciones string, "
        "id_variante long, cantidad int, precio_unitario decimal(12,2)")
MOVE = ("request_id long, id_sucursal_origen long, id_sucursal_destino long, id_empleado long, "
        "observaciones string, id_variante long, cantidad int, precio_unitario decimal(12,2)")


def stock_of(df, branch, variant):
    r = df.where((F.col("id_sucursal") == branch) & (F.col("id_variante") == variant)).collect()
    return r[0]["cantidad_disponible"] if r else None


def results(res):
    return {r["request_id"]: r for r in res.results.collect()}


def test_sale_fills_price_and_subtracts(spark, seed):
    req = spark.createDataFrame([(1, 2, 2, "venta", 1, 4)], SELL)
    res = J.job_sell(req, seed, seed["inventario"], NOW)
    r = results(res)[1]
    assert r["aceptado"] and r["precio_unitario"] == Decimal("150000.00")
    assert stock_of(res.stock, 2, 1) == 71
    assert res.lines.count() == 1 and res.headers.count() == 1
    # no time given: the header takes the batch time (the column's CURRENT_TIMESTAMP default)
    assert res.headers.collect()[0]["fecha_hora"] == NOW


def test_oversell_rejected_leaves_nothing(spark, seed):
    req = spark.createDataFrame([(1, 2, 2, None, 1, 4), (2, 2, 2, None, 1, 500)], SELL)
    res = J.job_sell(req, seed, seed["inventario"], NOW)
    r = results(res)
    assert r[1]["aceptado"] and not r[2]["aceptado"]
    assert r[2]["motivo"] == L.REASON_STOCK and r[2]["disponible"] == 71
    assert r[2]["mensaje"] == J.MSG_ERROR["Salida"] % L.REASON_STOCK
    assert stock_of(res.stock, 2, 1) == 71
    # the rejected request leaves neither header nor line
    assert res.headers.count() == 1 and res.lines.count() == 1


def test_partial_receipt_batch(spark, seed):
    req = spark.createDataFrame([(1, 1, 1, 1, None, 2, 100, Decimal("90000.00")),
                                 (2, 1, 1, 1, None, 2, -20, Decimal("90000.00"))], RECV)
    res = J.job_receive(req, seed, seed["inventario"], NOW)
    r = results(res)
    assert r[1]["aceptado"] and not r[2]["aceptado"] and r[2]["motivo"] == L.REASON_QUANTITY
    assert stock_of(res.stock, 1, 2) == 159
    published, quarantined = J.reject_policy(res, "reject")
    assert published.count() == 1 and quarantined.count() == 1
    published, quarantined = J.reject_policy(res, "fail")
    assert published.count() == 0 and quarantined.count() == 2
    counts = {r["politica"]: (r["publicadas"], r["en_cuarentena"]) for r in J.policy_counts(res).collect()}
    assert counts == {"reject": (1, 1), "fail": (0, 2)}

    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/publish-test-{uuid.uuid4().hex[:8]}"
    vdir, published = J.publish_job(res, root, "reject")
    assert published and FS.current_version(spark, root) == vdir
    assert spark.read.parquet(f"{vdir}/resultados").count() == 2
    assert spark.read.parquet(f"{vdir}/movimientos").count() == 1
    assert spark.read.parquet(f"{vdir}/detalle_movimientos").count() == 1
    assert stock_of(spark.read.parquet(f"{vdir}/inventario"), 1, 2) == 159
    vdir2, published = J.publish_job(res, root, "fail")
    assert not published and FS.current_version(spark, root) == vdir


def test_transfer_moves_between_branches(spark, seed):
    req = spark.createDataFrame([(1, 1, 2, 1, None, 3, 10, Decimal("0.00"))], MOVE)
    res = J.job_transfer(req, seed, seed["inventario"], NOW)
    assert results(res)[1]["aceptado"]
    assert stock_of(res.stock, 1, 3) == 73 and stock_of(res.stock, 2, 3) == 61


def test_transfer_checks(spark, seed):
    req = spark.createDataFrame([(1, 1, 1, 1, None, 3, 10, Decimal("0")), (2, 1, None, 1, None, 3, 10, Decimal("0"))],
                                MOVE)
    res = J.job_transfer(req, seed, seed["inventario"], NOW)
    r = results(res)
    assert r[1]["motivo"] == L.REASON_SAME_BRANCH and r[2]["motivo"] == L.REASON_NO_DESTINATION
    assert stock_of(res.stock, 1, 3) == 83


def test_competing_sales_served_in_order(spark, seed):
    req = spark.createDataFrame([(1, 1, 1, None, 1, 7), (2, 1, 2, None, 1, 7)], SELL)
    res = J.job_sell(req, seed, seed["inventario"], NOW)
    r = results(res)
    assert r[1]["aceptado"] and r[2]["aceptado"]
    assert r[1]["disponible"] == 153 and r[2]["disponible"] == 146
    assert stock_of(res.stock, 1, 1) == 139


def test_missing_cell(spark, seed):
    sell = spark.createDataFrame([(1, 1, 1, None, 4, 1)], SELL)
    res = J.job_sell(sell, seed, seed["inventario"], NOW)
    assert results(res)[1]["motivo"] == L.REASON_STOCK and results(res)[1]["disponible"] == 0
    recv = spark.createDataFrame([(1, 2, 1, 1, None, 4, 5, Decimal("10.00"))], RECV)
    res = J.job_receive(recv, seed, seed["inventario"], NOW)
    assert stock_of(res.stock, 2, 4) == 5


def test_rejected_line_consumes_nothing(spark, seed):
    req = spark.createDataFrame([(1, 3, 1, None, 4, 7), (2, 3, 1, None, 4, 4)], SELL)
    res = J.job_sell(req, seed, seed["inventario"], NOW)
    r = results(res)
    assert not r[1]["aceptado"] and r[2]["aceptado"]
    assert stock_of(res.stock, 3, 4) == 1


def test_unknown_variant_rejected(spark, seed):
    req = spark.createDataFrame([(1, 2, 1, 1, None, 99, 5, Decimal("1.00"))], RECV)
    res = J.job_receive(req, seed, seed["inventario"], NOW)
    assert results(res)[1]["motivo"] == L.REASON_UNKNOWN


def test_new_ids_continue_after_existing(spark):
    from tests.conftest import seed_frames
    t = seed_frames(spark, movimientos=[(41, NOW, "Entrada", None, 1, None, 1, None)],
                    detalle_movimientos=[(90, 1, Decimal("1.00"), 41, 1)])
    req = spark.createDataFrame([(7, 2, 2, None, 1, 1), (3, 2, 2, None, 1, 1)], SELL)
    r = results(J.job_sell(req, t, t["inventario"], NOW))
    assert (r[3]["id_movimiento"], r[3]["id_detalle"]) == (42, 91)
    assert (r[7]["id_movimiento"], r[7]["id_detalle"]) == (43, 92)


def test_explicit_sale_price_kept(spark, seed):
    lines = spark.createDataFrame([(1, 1, 1, Decimal("120000.00"), "Salida"), (2, 1, 1, Decimal("0.00"), "Salida"),
                                   (3, 1, 1, Decimal("0.00"), "Entrada"), (4, 99, 1, Decimal("0.00"), "Salida")],
                                  "id_detalle long, id_variante long, cantidad int, precio_unitario decimal(12,2), "
                                  "tipo_movimiento string")
    out = {r["id_detalle"]: r for r in L.fill_price(lines, seed["producto_variante"], seed["productos"]).collect()}
    assert out[1]["precio_unitario"] == Decimal("120000.00") and not out[1]["precio_completado"]
    assert out[2]["precio_unitario"] == Decimal("150000.00") and out[2]["precio_completado"]
    assert out[3]["precio_unitario"] == Decimal("0.00")
    assert out[4]["precio_unitario"] == Decimal("0.00") and not out[4]["precio_completado"]


def test_reprice(spark, seed):
    new, status = J.reprice_brand(seed["productos"], seed["marcas"], 2, "10.00")
    assert {r["id_producto"]: r["precio_venta_actual"] for r in new.collect()}[2] == Decimal("110.06")
    s = status.collect()[0]
    assert s["ok"] and s["filas"] == 1
    new, status = J.reprice_brand(seed["productos"], seed["marcas"], 2, "-100.00")
    assert not status.collect()[0]["ok"]
    assert {r["id_producto"]: r["precio_venta_actual"] for r in new.collect()}[2] == Decimal("100.05")
    _, status = J.reprice_brand(seed["productos"], seed["marcas"], 99, "5.00")
    s = status.collect()[0]
    assert not s["ok"] and "99" in s["mensaje"] and s["filas"] == 0


def test_quarantined_requests_are_kept_whole_and_can_be_submitted_again(spark, seed, tmp_path):
    req = spark.createDataFrame([(1, 2, 2, None, 1, 4), (2, 2, 2, None, 1, 500), (3, 2, 999, None, 1, 1)], SELL)
    res = J.job_sell(req, seed, seed["inventario"], NOW)
    vdir, ok = J.publish_job(res, str(tmp_path / "jobs"), "reject")
    q = {r["request_id"]: r for r in spark.read.parquet(f"{vdir}/cuarentena").collect()}
    assert ok and set(q) == {2, 3} and q[2]["motivo"] == L.REASON_STOCK and q[3]["motivo"] == L.REASON_EMPLOYEE
    assert (q[2]["id_sucursal_origen"], q[2]["id_variante"], q[2]["cantidad"], q[2]["id_empleado"]) == (2, 1, 500, 2)
    assert q[2]["fecha_hora"] == NOW

    # once the stock is there, the request passes; the other still lacks its employee
    stock = spark.createDataFrame([(2, 1, 600)], "id_sucursal long, id_variante long, cantidad_disponible int")
    again = results(J.job_sell(J.quarantined(spark, vdir), seed, stock, NOW))
    assert again[2]["aceptado"] and not again[3]["aceptado"]

    # under "fail" nothing is published and the whole batch is in quarantine
    vdir2, ok = J.publish_job(res, str(tmp_path / "jobs"), "fail")
    assert not ok and spark.read.parquet(f"{vdir2}/cuarentena").count() == 3
    assert spark.read.parquet(f"{vdir2}/movimientos").count() == 0
    assert stock_of(spark.read.parquet(f"{vdir2}/inventario"), 2, 1) == 75
    rows = {(r["politica"], r["request_id"]): r["estado"] for r in J.policy_rows(res).collect()}
    assert rows == {("reject", 1): "publicada", ("reject", 2): "cuarentena", ("reject", 3): "cuarentena",
                    ("fail", 1): "cuarentena", ("fail", 2): "cuarentena", ("fail", 3): "cuarentena"}


def test_states_of_a_job_are_versions(spark, seed, tmp_path):
    req = spark.createDataFrame([(n, 2, 2, None, 1, 10) for n in (1, 2, 3, 4)], SELL)
    res = J.checkpointed(J.job_sell(req, seed, seed["inventario"], NOW))
    states = J.job_states(res, str(tmp_path / "log"))
    assert [stock_of(states[k], 2, 1) for k in ("antes", "durante", "despues")] == [75, 55, 35]
    assert stock_of(states["durante"], 1, 1) == 153
