"""Registered source/sink and catalogue queries with their SQL oracles.

The round-trip queries write to a fresh folder under the session's shared
checkpoint folder (``spark.checkpoint.dir``) and read it back, so the result
is whatever the sink and source really produced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stockflow import schema as S
from stockflow.plans import ledger as L
from stockflow.plans.ledger_queries import fold_sql
from stockflow.registry import register
from stockflow.session import ensure_checkpoint_dir
from stockflow.sources import files as FS
from stockflow.sources.testdata import from_frames, lines


def _scratch(t, what: str) -> str:
    spark = t["marcas"].sparkSession
    return FS.new_version_dir(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}")


def _catalog(t):
    return t.raw("part").select(F.col("p_name").alias("nombre"), F.lit(None).cast("string").alias("descripcion"),
                                F.col("p_retailprice").cast(S.MONEY).alias("precio_venta_actual"),
                                F.col("p_brand").alias("marca"), F.col("p_type").alias("categoria"))


@register("ingest_reject_unknown", """
SELECT 'marca' AS tipo, p_brand AS nombre, CAST(count(*) AS BIGINT) AS filas FROM part
WHERE p_brand NOT IN (SELECT nombre FROM marcas) GROUP BY p_brand
UNION ALL
SELECT 'categoria', p_type, CAST(count(*) AS BIGINT) FROM part
WHERE p_type NOT IN (SELECT nombre FROM categorias) GROUP BY p_type""")
def ingest_reject_unknown(t):
    """Catalogue brands/categories unknown to the reference lists (empty = loadable)."""
    return FS.ingest_reject_unknown(_catalog(t), t["marcas"], t["categorias"])


@register("id_assign", "SELECT id_detalle, id_movimiento, id_variante, cantidad FROM detalle_movimientos")
def id_assign(t):
    """Dense line ids 1..n in (date, order, line, ...) order, numbered in two passes
    (per-date counts + offsets), never one global window."""
    return t["detalle_movimientos"].select("id_detalle", "id_movimiento", "id_variante", "cantidad")


_COUNTS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS tabla, CAST(count(*) AS BIGINT) AS filas FROM {'detalle_lineas' if n == 'detalle_movimientos' else n}"
    for n in S.DEPENDENCY_ORDER)


def _model_tables(t):
    return {n: t[n] for n in S.DEPENDENCY_ORDER}


def load_problems(stored) -> list[str]:
    """What keeps a load from being published: orphans, repeated or NULL primary keys, NULLs in NOT NULL columns."""
    from stockflow.plans import quality as Q
    fk = Q.foreign_key(stored).where("huerfanas > 0").count()
    pk = Q.primary_key(stored).where("claves_duplicadas > 0 OR claves_nulas > 0").count()
    nn = Q.not_null(stored).where("filas_nulas > 0").count()
    return [f"{n} {what}" for n, what in ((fk, "foreign keys with orphans"), (pk, "tables with bad primary keys"),
                                          (nn, "NOT NULL columns with NULLs")) if n]


@register("load_in_dependency_order", _COUNTS_SQL)
def load_in_dependency_order(t):
    """Write all 12 tables parents-first to a new version, check keys and NULLs, publish, read back counts."""
    from stockflow.plans import quality as Q
    spark = t["marcas"].sparkSession
    root = _scratch(t, "load")
    FS.load_in_dependency_order(spark, _model_tables(t), root, checks=load_problems)
    vdir = FS.current_version(spark, root)
    stored = FS.read_version(spark, vdir, S.DEPENDENCY_ORDER)
    return Q._stack([stored[n].agg(F.count(F.lit(1)).cast("bigint").alias("filas"))
                     .select(F.lit(n).alias("tabla"), "filas") for n in S.DEPENDENCY_ORDER])


def _money_cols(n: str) -> list[str]:
    return [f.name for f in S.SCHEMAS[n].fields if f.dataType == S.MONEY]


def _csv_sql(n: str) -> str:
    names = [f.name for f in S.SCHEMAS[n].fields]
    money = " + ".join(f"sum({c})" for c in _money_cols(n)) or "NULL"
    return (f"SELECT '{n}' AS tabla, CAST(count(*) AS BIGINT) AS filas, CAST(sum({names[0]}) AS BIGINT) AS suma_ids, "
            f"CAST({money} AS DECIMAL(38,2)) AS suma_importes, "
            f"CAST({' + '.join(f'count({c})' for c in names)} AS BIGINT) AS no_nulos, "
            f"CAST(sum({' + '.join(f'coalesce(length(CAST({c} AS VARCHAR)), 0)' for c in names)}) AS BIGINT) AS largo FROM {n}")


@register("sink_csv_tables", "\nUNION ALL\n".join(map(_csv_sql, S.TABLE_NAMES)))
def sink_csv_tables(t):
    """All 12 tables written as header CSV and read back by column name (NULLs as
    empty fields, money with two decimals): rows, sums, values and their lengths."""
    from stockflow.plans import quality as Q
    spark = t["marcas"].sparkSession
    root = _scratch(t, "csv")
    FS.sink_csv_tables(from_frames(_model_tables(t)), root)
    back = FS.src_csv_tables(spark, root)
    out = []
    for n in S.TABLE_NAMES:
        names = [f.name for f in S.SCHEMAS[n].fields]
        money = [F.sum(c) for c in _money_cols(n)]
        out.append(back[n].agg(
            F.lit(n).alias("tabla"), F.count(F.lit(1)).cast("bigint").alias("filas"),
            F.sum(names[0]).cast("bigint").alias("suma_ids"),
            (money[0] if money else F.lit(None)).cast("decimal(38,2)").alias("suma_importes"),
            sum((F.count(c) for c in names[1:]), F.count(names[0])).cast("bigint").alias("no_nulos"),
            F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in names[1:]),
                      F.coalesce(F.length(F.col(names[0]).cast("string")), F.lit(0)))).cast("bigint").alias("largo")))
    return Q._stack(out)


@register("src_csv_tables", "SELECT * FROM detalle_movimientos")
def src_csv_tables(t):
    """The lines with their ids, written as header CSV and read back with their types."""
    spark = t["marcas"].sparkSession
    root = _scratch(t, "csv-lines")
    FS.sink_csv_tables(from_frames({"detalle_movimientos": t["detalle_movimientos"]}), root, ["detalle_movimientos"])
    return FS.src_csv_tables(spark, root, ["detalle_movimientos"])["detalle_movimientos"]


@register("src_catalog_csv", """
SELECT p_name AS nombre, CAST(NULL AS VARCHAR) AS descripcion, CAST(p_retailprice AS DECIMAL(12,2)) AS precio_venta_actual,
       p_brand AS marca, p_type AS categoria FROM part""")
def src_catalog_csv(t):
    """The catalogue as a CSV whose columns come in another order, read by name."""
    path = _scratch(t, "catalog")
    _catalog(t).select("categoria", "precio_venta_actual", "marca", "nombre", "descripcion").write.option(
        "header", True).option("nullValue", "").csv(path)
    return FS.src_catalog_csv(t["marcas"].sparkSession, path)


@register("load_full_refresh", "SELECT * FROM productos WHERE id_marca % 2 = 0")
def load_full_refresh(t):
    """A table loaded whole, then replaced by another content: only the second is there."""
    path = _scratch(t, "refresh")
    FS.load_full_refresh(t["productos"], path)
    FS.load_full_refresh(t["productos"].where("id_marca % 2 = 0"), path)
    return t["marcas"].sparkSession.read.parquet(path)


@register("chk_tables_present", """
SELECT CAST(2 AS BIGINT) AS faltantes, 'colores, talles' AS lista
WHERE (SELECT count(*) FROM colores) > 0 AND (SELECT count(*) FROM talles) > 0""")
def chk_tables_present(t):
    """A version written without two of the 12 tables: the folders that are missing."""
    from stockflow.plans import quality as Q
    spark = t["marcas"].sparkSession
    root = _scratch(t, "present")
    for n in S.TABLE_NAMES:
        if n not in ("colores", "talles"):
            t[n].write.parquet(f"{root}/{n}")
    fs, path = FS._hadoop_fs(spark, root)
    there = [s.getPath().getName() for s in fs.listStatus(path)]
    return Q.tables_present(spark, S.TABLE_NAMES, there)


@register("write_layout", """
SELECT tipo_movimiento, CAST(EXTRACT(YEAR FROM fecha_hora) AS INTEGER) AS anio, CAST(count(*) AS BIGINT) AS filas,
       min(id_movimiento) AS primer_id
FROM movimientos GROUP BY tipo_movimiento, EXTRACT(YEAR FROM fecha_hora)""")
def write_layout(t):
    """Movements written partitioned by (type, year), id-sorted inside files; read back per partition."""
    spark = t["marcas"].sparkSession
    path = _scratch(t, "layout")
    FS.write_layout(FS.movements_layout(t["movimientos"]), path, ["tipo_movimiento", "anio"], ["id_movimiento"])
    back = spark.read.parquet(path)
    return back.groupBy("tipo_movimiento", "anio").agg(F.count(F.lit(1)).cast("bigint").alias("filas"),
                                                       F.min("id_movimiento").alias("primer_id"))


@register("write_layout_paths", "\nUNION ALL\n".join(
    f"SELECT '{tab}' AS tabla, '{c}' AS columna, max({c}) AS valor, "
    f"CAST(count(*) FILTER (WHERE {c} = (SELECT max({c}) FROM {tab})) AS BIGINT) AS filas FROM {tab}"
    for tab, cols in FS.ACCESS_PATHS.items() for c in cols))
def write_layout_paths(t):
    """Tables clustered on their access paths, read back by each: rows of the column's largest value."""
    spark = t["marcas"].sparkSession
    out = []
    for tab, cols in FS.ACCESS_PATHS.items():
        path = _scratch(t, f"clustered-{tab}")
        FS.write_clustered(t[tab], path, cols, files=16)
        back = spark.read.parquet(path)
        for c in cols:
            top = back.agg(F.max(c).alias("v")).select("v").scalar()
            out.append(back.where(F.col(c) == top).agg(F.count(F.lit(1)).alias("filas")).select(
                F.lit(tab).alias("tabla"), F.lit(c).alias("columna"), top.alias("valor"), "filas"))
    return reduce(lambda a, b: a.unionByName(b), out)


_COMPETING_SQL = f"""
WITH sales AS (
  SELECT d.id_detalle, d.id_variante, d.cantidad, d.precio_unitario, m.tipo_movimiento,
         m.id_sucursal_origen, m.id_sucursal_destino, CAST(NULL AS VARCHAR) AS motivo_previo
  FROM detalle_movimientos d JOIN movimientos m ON d.id_movimiento = m.id_movimiento
  WHERE m.tipo_movimiento = 'Salida'),
opening AS (
  SELECT id_sucursal, id_variante, CAST(-least(min(saldo), 0) + 2 AS INTEGER) AS cantidad_disponible
  FROM mov_cell_bal GROUP BY id_sucursal, id_variante),
{fold_sql("sales", "opening").strip()}
SELECT id_sucursal_origen AS id_sucursal, id_variante, CAST(count(*) AS BIGINT) AS solicitudes,
       CAST(sum(CASE WHEN aceptado THEN 1 ELSE 0 END) AS BIGINT) AS aceptadas,
       CAST(sum(CASE WHEN aceptado THEN cantidad ELSE 0 END) AS BIGINT) AS unidades_vendidas
FROM fold_out GROUP BY id_sucursal_origen, id_variante HAVING count(*) >= 2"""


@register("job_competing_sales", _COMPETING_SQL, recursive=True)
def job_competing_sales(t):
    """Sales competing for the same cell served one at a time in line order
    against the opening stock: per cell with 2+ requests, how many were served."""
    lh = L.lines_with_header(t["movimientos"], t["detalle_movimientos"],
                             ["id_detalle", "id_movimiento", "id_variante", "cantidad", "precio_unitario"])
    sales = lh.where(F.col("tipo_movimiento") == "Salida")
    opening = L.opening_stock(t["movimientos"], lines(t), 2).select(
        "id_sucursal", "id_variante", F.col("cantidad_apertura").alias("cantidad_disponible"))
    dec = L.validate_stock(sales, stock=opening, pv=t["producto_variante"])
    return (dec.groupBy(F.col("id_sucursal_origen").alias("id_sucursal"), "id_variante")
            .agg(F.count(F.lit(1)).cast("bigint").alias("solicitudes"),
                 F.sum(F.when(F.col("aceptado"), 1).otherwise(0)).cast("bigint").alias("aceptadas"),
                 F.sum(F.when(F.col("aceptado"), F.col("cantidad")).otherwise(0)).cast("bigint")
                 .alias("unidades_vendidas"))
            .where("solicitudes >= 2"))
