"""Sources/sinks round trips, the driver contract, and a subset of the SQL oracle checks."""

from __future__ import annotations

import decimal
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from stockflow import schema as S
from stockflow.sources import files as FS
from tests.conftest import SF_SMALL, seed_frames

ORACLE_KEYS = ["report_revenue_by_brand", "report_unsold_variants", "report_employee_tickets", "report_low_stock",
               "report_brand_by_branch", "view_movement_audit", "ledger_validate_stock", "ledger_final_stock",
               "job_transfer", "chk_stock_reconciles", "agg_stock_profile", "sort_branch_then_stock",
               "fn_date_shift", "win_share_total"]


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 120


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["sucursal", "marca", "total_unidades_vendidas", "recaudacion_por_marca"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, cur.fetchall())


def test_csv_round_trip_by_name(spark):
    t = seed_frames(spark)
    root = tempfile.mkdtemp(prefix="sf-csv-")
    FS.sink_csv_tables(t, root, ["productos", "proveedores", "empleados"])
    back = FS.src_csv_tables(spark, root, ["productos", "proveedores", "empleados"])
    for n in ["productos", "proveedores", "empleados"]:
        assert sorted(back[n].collect()) == sorted(t[n].collect())
        assert back[n].schema == S.SCHEMAS[n] or [f.dataType for f in back[n].schema] == \
            [f.dataType for f in S.SCHEMAS[n]]


def test_inline_rows_coerce_integers_to_text(spark):
    df = FS.src_inline_rows(spark, "talles", [(1, 40)])
    assert df.collect()[0]["nomenclatura"] == "40"


def test_catalog_unknown_names(spark, seed):
    cat = spark.createDataFrame([("Remera", None, decimal.Decimal("1.00"), "Alfa", "Remeras"),
                                 ("Gorra", None, decimal.Decimal("1.00"), "Omega", "Accesorios")],
                                FS.CATALOG_SCHEMA)
    bad = {(r["tipo"], r["nombre"]) for r in FS.ingest_reject_unknown(cat, seed["marcas"], seed["categorias"]).collect()}
    assert bad == {("marca", "Omega"), ("categoria", "Accesorios")}


def test_versioned_load_is_all_or_nothing(spark, seed):
    root = tempfile.mkdtemp(prefix="sf-load-")
    v1 = FS.load_in_dependency_order(spark, seed, root)
    assert FS.current_version(spark, root) == v1
    with pytest.raises(ValueError):
        FS.load_in_dependency_order(spark, seed, root, checks=lambda stored: ["bad"])
    assert FS.current_version(spark, root) == v1
    stored = FS.read_version(spark, v1, ["inventario"])
    assert stored["inventario"].count() == seed["inventario"].count()


def test_layout_prunes_partitions(spark):
    import datetime as dt
    t = seed_frames(spark, movimientos=[(1, dt.datetime(2025, 3, 1), "Salida", None, 1, None, 1, None),
                                        (2, dt.datetime(2026, 3, 1), "Entrada", None, 1, None, 1, None)])
    path = tempfile.mkdtemp(prefix="sf-layout-") + "/mov"
    FS.write_layout(FS.movements_layout(t["movimientos"]), path, ["tipo_movimiento", "anio"], ["id_movimiento"])
    back = spark.read.parquet(path).where("tipo_movimiento = 'Salida' AND anio = 2025")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(tipo_movimiento" in back._jdf.queryExecution().executedPlan().toString()


def test_catalog_csv_and_full_refresh(spark):
    root = tempfile.mkdtemp(prefix="sf-cat-")
    cat = spark.createDataFrame([("Remera", "algodon", decimal.Decimal("150.50"), "Alfa", "Remeras")],
                                FS.CATALOG_SCHEMA)
    # columns written in another order: the reader maps them by name
    cat.select("marca", "categoria", "nombre", "precio_venta_actual", "descripcion").write.option(
        "header", True).csv(root + "/catalogo.csv")
    back = FS.src_catalog_csv(spark, root + "/catalogo.csv").collect()[0]
    assert back["precio_venta_actual"] == decimal.Decimal("150.50") and back["marca"] == "Alfa"
    FS.load_full_refresh(cat, root + "/t")
    FS.load_full_refresh(cat.limit(0), root + "/t")
    assert spark.read.parquet(root + "/t").count() == 0


def test_bucketed_header_detail_join_has_no_shuffle(spark, seed):
    import datetime as dt
    loc = tempfile.mkdtemp(prefix="sf-wh-")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sf_bucket LOCATION '{loc}'")
    mov = spark.createDataFrame([(i, dt.datetime(2026, 1, 1), "Salida", None, 1, None, 1, None) for i in range(50)],
                                seed["movimientos"].schema)
    det = spark.createDataFrame([(i, 1, decimal.Decimal("1.00"), i % 50, 1) for i in range(200)],
                                seed["detalle_movimientos"].schema)
    FS.write_bucketed(mov, "sf_bucket.mov", 4, "id_movimiento")
    FS.write_bucketed(det, "sf_bucket.det", 4, "id_movimiento")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("sf_bucket.det").join(spark.table("sf_bucket.mov"), "id_movimiento")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
