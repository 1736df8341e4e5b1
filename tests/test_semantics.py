"""Edge cases of the reference's SQL semantics (one test each)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.plans import operator_queries as OQ
from stockflow.plans import quality as Q
from stockflow.plans import reports as R
from tests.conftest import seed_frames

T0 = dt.datetime(2026, 5, 31, 12, 0, 0)


def _history(spark, movs, lines):
    return seed_frames(spark, movimientos=movs, detalle_movimientos=lines)


def test_concat_skips_nulls(spark):
    df = spark.createDataFrame([("30-71000001-1",), (None,)], "cuit string")
    out = [r[0] for r in df.select(X.mask_tax_id("cuit")).collect()]
    assert out == ["30-7100****-*", "-****-*"]
    assert df.select(F.concat("cuit", F.lit("x"))).collect()[1][0] is None  # plain concat would be NULL


def test_months_back_clips_to_month_end(spark):
    r = spark.range(1).select(X.months_back("2026-05-31", 3).alias("d")).collect()[0]["d"]
    assert r == dt.datetime(2026, 2, 28)


def test_year_is_half_open(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 12, 31, 23, 59, 59),), (dt.datetime(2026, 1, 1),)],
                               "ts timestamp_ntz")
    assert df.where(X.in_year("ts", 2025)).count() == 1


def test_not_in_with_null_in_list(spark):
    probe = spark.createDataFrame([(1,), (2,), (None,)], "id_variante long")
    with_null = spark.createDataFrame([(2,), (None,)], "id_variante long")
    without = spark.createDataFrame([(2,)], "id_variante long")
    empty = spark.createDataFrame([], "id_variante long")
    assert OQ.anti_not_in_frame(probe, "id_variante", with_null, "id_variante").count() == 0
    assert sorted(r[0] for r in OQ.anti_not_in_frame(probe, "id_variante", without, "id_variante").collect()) == [1]
    assert OQ.anti_not_in_frame(probe, "id_variante", empty, "id_variante").count() == 3


def test_reports_on_seed_history(spark):
    movs = [(10, T0, "Salida", None, 2, None, 1, None), (11, T0, "Salida", None, 3, None, 2, None),
            (12, T0, "Salida", None, 1, None, 3, None), (13, T0, "Entrada", None, 1, None, 1, 1)]
    lines = [(1, 2, Decimal("10.00"), 10, 1), (2, 1, Decimal("5.00"), 10, 2), (3, 1, Decimal("5.00"), 10, 3),
             (4, 3, Decimal("1.00"), 11, 1), (5, 1, Decimal("7.00"), 12, 4), (6, 9, Decimal("1.00"), 13, 3)]
    t = _history(spark, movs, lines)
    # report 5: the two 'Sucursal NOA' branches merge by name
    r5 = {(r["sucursal"], r["marca"]): r for r in R.brand_by_branch(t).collect()}
    assert r5[("Sucursal NOA", "Alfa")]["total_unidades_vendidas"] == 6
    assert r5[("Sucursal NOA", "Alfa")]["recaudacion_por_marca"] == Decimal("28.00")
    # report 3: a ticket with three lines counts once
    r3 = R.employee_tickets(t, "Sucursal NOA", 2026).collect()
    laura = [r for r in r3 if r["nombre"] == "Laura"][0]
    carlos = [r for r in r3 if r["nombre"] == "Carlos"][0]
    assert carlos["cantidad_tickets_emitidos"] == 1 and carlos["total_plata_ingresada"] == Decimal("30.00")
    assert laura["cantidad_tickets_emitidos"] == 1
    # report 2: variant 3 was only received or sold once; variant only received stays unsold
    unsold = R.unsold_variants(t, as_of="2026-06-30").collect()
    assert len(unsold) == 0 or all(r["producto"] for r in unsold)
    # report 1 keeps a sale exactly at as_of - 3 months
    r1 = R.revenue_by_brand(t, as_of="2026-08-31", months=3).collect()
    assert {r["marca_deportiva"] for r in r1} == {"Alfa", "Beta", "Gamma"}
    r1_late = R.revenue_by_brand(t, as_of="2026-09-01", months=3).collect()
    assert r1_late == []


def test_low_stock_threshold(spark):
    t = seed_frames(spark, inventario=[(1, 1, 34), (1, 2, 35)])
    rows = R.low_stock(t, 35).collect()
    assert [r["stock_actual"] for r in rows] == [34]


def test_reconciliation_cases(spark):
    inv = spark.createDataFrame([(1, 1, 5), (1, 2, 3)], "id_sucursal long, id_variante long, cantidad_disponible int")
    net = spark.createDataFrame([(1, 1, 5), (2, 2, 0), (None, 3, 4)], "id_sucursal long, id_variante long, cantidad long")
    out = {(r["id_sucursal"], r["id_variante"]): r for r in Q.reconcile(inv, net).collect()}
    # stock-only cell and the NULL-branch transfer leg differ; net 0 missing from stock is fine
    assert set(out) == {(1, 2), (None, 3)}


def test_quality_checks_find_problems(spark):
    t = seed_frames(spark, talles=[(1, "S"), (2, "S"), (3, 40)],
                    inventario=[(1, 1, -2), (9, 1, 3)],
                    empleados=[(1, 1, "A", "B", "Jefe"), (2, 2, "C", "D", "Operativo"), (3, 3, "E", "F", "Consulta")])
    uq = {r["tabla"]: r["valores_duplicados"] for r in Q.unique(t).collect()}
    assert uq["talles"] == 1
    fk = {(r["tabla"], r["columna"]): r["huerfanas"] for r in Q.foreign_key(t).collect()}
    assert fk[("inventario", "id_sucursal")] == 1
    dom = {r["tabla"]: r["filas_fuera_de_dominio"] for r in Q.domain_in(t).collect()}
    assert dom["empleados"] == 1
    neg = Q.no_negative_stock(t).collect()[0]
    assert neg["negativas"] == 1 and neg["detalle"] == "(sucursal 1, variante 1) = -2"
    num = {r["restriccion"]: r["filas_invalidas"] for r in Q.numeric(t).collect()}
    assert num["chk_stock_positivo"] == 1


def test_tables_present(spark):
    r = Q.tables_present(spark, ["marcas", "talles", "colores"], ["marcas"]).collect()[0]
    assert r["faltantes"] == 2 and r["lista"] == "colores, talles"


def test_delete_cascade_and_restrict(spark):
    movs = [(10, T0, "Salida", None, 2, None, 1, None), (11, T0, "Salida", None, 1, None, 1, None)]
    lines = [(1, 1, Decimal("1.00"), 10, 1), (2, 1, Decimal("1.00"), 11, 2)]
    t = _history(spark, movs, lines)
    doomed = t["movimientos"].where("id_movimiento = 10")
    out = Q.delete_cascade(t, "movimientos", doomed)
    assert out["movimientos"].count() == 1 and out["detalle_movimientos"].count() == 1
    # variant 1 is referenced by a line (RESTRICT): blocked; its stock would cascade otherwise
    out = Q.delete_cascade(t, "producto_variante", t["producto_variante"].where("id_variante IN (1, 4)"))
    assert [r[0] for r in out["_blocked"].collect()] == [1]
    assert out["producto_variante"].count() == 3
    assert out["inventario"].where("id_variante = 4").count() == 0


def test_rekey_cascade(spark, seed):
    mapping = spark.createDataFrame([(1, 101)], "old long, new long")
    out = Q.rekey_cascade(seed, "sucursales", mapping)
    assert out["inventario"].where("id_sucursal = 101").count() == 3
    assert out["sucursales"].where("id_sucursal = 1").count() == 0


def test_barcode_keeps_long_ids(spark):
    df = spark.createDataFrame([(7,), (1234567890,)], "id long")
    assert [r[0] for r in df.select(X.barcode("id")).collect()] == ["779000000007", "7791234567890"]


def test_percent_adjust_half_up(spark):
    df = spark.createDataFrame([(Decimal("100.05"),)], "p decimal(12,2)")
    assert df.select(X.percent_adjust("p", F.lit("10.00"))).collect()[0][0] == Decimal("110.06")
