"""Registered integrity and data-quality checks with their SQL oracles.

The SQL side is generated from the same constraint lists of
``stockflow.schema`` (the lists are data; each engine checks them its own way).
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import functions as F

from stockflow import schema as S
from stockflow.plans import ledger as L
from stockflow.plans import quality as Q
from stockflow import registry
from stockflow.registry import register
from stockflow.sources.testdata import OPENING_BUFFER

PURGE_BEFORE = "1996-01-01"
RETIRED_BRAND = 13


def _tbl(tab):
    return "detalle_lineas" if tab == "detalle_movimientos" else tab


def _union(parts):
    return "\nUNION ALL\n".join(parts)


_NN = {}
for _t, _c in S.NOT_NULL:
    _NN.setdefault(_t, []).append(_c)

_NOT_NULL_SQL = _union(
    f"SELECT '{tab}' AS tabla, '{c}' AS columna, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS filas_nulas "
    f"FROM {tab}" for tab, cols in _NN.items() for c in cols)


@register("chk_not_null", _NOT_NULL_SQL)
def chk_not_null(t):
    """NULLs in NOT NULL columns, per column."""
    return Q.not_null(t)


@register("chk_max_length", _union(
    f"SELECT '{tab}' AS tabla, '{c}' AS columna, {n} AS limite, "
    f"CAST(count(*) FILTER (WHERE length({c}) > {n}) AS BIGINT) AS filas_largas FROM {tab}"
    for tab, c, n in S.MAX_LENGTHS))
def chk_max_length(t):
    """Values longer than the declared VARCHAR(n)."""
    return Q.max_length(t)


def _pk_sql(tab, keys):
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    anynull = " OR ".join(f"{x} IS NULL" for x in keys)
    return (f"SELECT '{tab}' AS tabla, "
            f"(SELECT CAST(count(*) AS BIGINT) FROM (SELECT {k} FROM {tab} WHERE {nn} GROUP BY {k} HAVING count(*) > 1) d) "
            f"AS claves_duplicadas, (SELECT CAST(count(*) AS BIGINT) FROM {tab} WHERE {anynull}) AS claves_nulas")


@register("chk_primary_key", _union(_pk_sql(tab, keys) for tab, keys in S.PRIMARY_KEYS.items()))
def chk_primary_key(t):
    """Duplicate and NULL primary keys per table."""
    return Q.primary_key(t)


@register("chk_unique", _union(
    f"SELECT '{tab}' AS tabla, '{c}' AS columna, (SELECT CAST(count(*) AS BIGINT) FROM "
    f"(SELECT {c} FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) d) AS valores_duplicados"
    for tab, c in S.UNIQUE_KEYS))
def chk_unique(t):
    """Values of UNIQUE columns held by more than one row."""
    return Q.unique(t)


@register("chk_domain_in", _union(
    f"SELECT '{tab}' AS tabla, '{c}' AS columna, CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ("
    + ", ".join(f"'{v}'" for v in vals) + f")) AS BIGINT) AS filas_fuera_de_dominio FROM {tab}"
    for tab, c, vals in S.DOMAINS))
def chk_domain_in(t):
    """Profile and movement type outside their lists."""
    return Q.domain_in(t)


@register("chk_numeric", _union(
    f"SELECT '{name}' AS restriccion, '{tab}' AS tabla, CAST(count(*) FILTER (WHERE NOT ({pred})) AS BIGINT) "
    f"AS filas_invalidas FROM {_tbl(tab)}" for name, tab, pred in S.NUMERIC_CHECKS))
def chk_numeric(t):
    """Rows violating price > 0, stock >= 0, quantity > 0, line price >= 0."""
    return Q.numeric(t)


@register("chk_foreign_key", _union(
    f"SELECT '{child}' AS tabla, '{cc}' AS columna, '{par}' AS tabla_padre, CAST(count(*) AS BIGINT) AS huerfanas "
    f"FROM {_tbl(child)} c WHERE c.{cc} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM {par} p WHERE p.{pc} = c.{cc})" for child, cc, par, pc, _ in S.FOREIGN_KEYS))
def chk_foreign_key(t):
    """Orphan child rows per foreign key (NULL passes)."""
    return Q.foreign_key(t)


@register("chk_non_empty", _union(
    f"SELECT '{n}' AS tabla, CAST(count(*) AS BIGINT) AS filas, rpad('{n}', 22, ' ') AS etiqueta, "
    f"count(*) = 0 AS vacia FROM {_tbl(n)}" for n in S.TABLE_NAMES))
def chk_non_empty(t):
    """Row count per table and whether it is empty."""
    return Q.non_empty(t)


@register("row_count_report", _union([
    "SELECT 'productos' AS tabla, CAST(count(*) AS BIGINT) AS cantidad FROM productos",
    "SELECT 'variantes', CAST(count(*) AS BIGINT) FROM producto_variante",
    "SELECT 'movimientos', CAST(count(*) AS BIGINT) FROM movimientos",
    "SELECT 'detalles', CAST(count(*) AS BIGINT) FROM detalle_lineas",
    "SELECT 'inventario', CAST(count(*) AS BIGINT) FROM inventario"]))
def row_count_report(t):
    """Table name and row count for five tables (stacked counts)."""
    from stockflow.sources.testdata import lines
    parts = [("productos", t["productos"]), ("variantes", t["producto_variante"]), ("movimientos", t["movimientos"]),
             ("detalles", lines(t)), ("inventario", t["inventario"])]
    return Q._stack([df.agg(F.count(F.lit(1)).cast("bigint").alias("cantidad"))
                     .select(F.lit(n).alias("tabla"), "cantidad") for n, df in parts])


@register("union_all_counts", _union([
    "SELECT 'productos' AS tabla, CAST(count(*) AS BIGINT) AS cantidad FROM productos",
    "SELECT 'variantes', CAST(count(*) AS BIGINT) FROM producto_variante",
    "SELECT 'movimientos', CAST(count(*) AS BIGINT) FROM movimientos",
    "SELECT 'detalles', CAST(count(*) AS BIGINT) FROM detalle_lineas",
    "SELECT 'inventario', CAST(count(*) AS BIGINT) FROM inventario"]))
def union_all_counts(t):
    """Stacked count rows (UNION ALL of one-row aggregates)."""
    return row_count_report(t)


@register("chk_no_negative_stock", """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM inventario WHERE cantidad_disponible < 0) AS negativas,
       (SELECT string_agg(printf('(sucursal %d, variante %d) = %d', id_sucursal, id_variante, cantidad_disponible),
                          '; ' ORDER BY id_sucursal, id_variante)
        FROM (SELECT * FROM inventario WHERE cantidad_disponible < 0 ORDER BY id_sucursal, id_variante LIMIT 5) m)
         AS detalle
""")
def chk_no_negative_stock(t):
    """Negative stock cells: count and first 5."""
    return Q.no_negative_stock(t)


@register("limit_sample", """
SELECT string_agg(printf('(sucursal %d, variante %d) = %d', id_sucursal, id_variante, cantidad_disponible),
                  '; ' ORDER BY id_sucursal, id_variante) AS detalle
FROM (SELECT * FROM inventario WHERE cantidad_disponible < 35 ORDER BY id_sucursal, id_variante LIMIT 5) m
""")
def limit_sample(t):
    """First 5 low-stock cells in key order, formatted into one message."""
    inv = t["inventario"].where(F.col("cantidad_disponible") < 35)
    return Q.sample_text(inv, ["id_sucursal", "id_variante"], "(sucursal %d, variante %d) = %d",
                         ["id_sucursal", "id_variante", "cantidad_disponible"])


# Stock and legs stacked with their signs' own columns and summed per cell; cells whose sums differ stay.
_RECON_SQL = """
libro AS (
  SELECT id_sucursal, id_variante, cantidad_disponible AS contado, NULL AS movido FROM inventario
  UNION ALL BY NAME
  SELECT id_sucursal, id_variante, delta AS movido FROM historia),
recon AS (
  SELECT id_sucursal, id_variante, CAST(sum(contado) AS BIGINT) AS en_inventario,
         CAST(sum(movido) AS BIGINT) AS recalculado
  FROM libro GROUP BY ALL HAVING coalesce(en_inventario, 0) <> coalesce(recalculado, 0))"""

_HIST_PLAIN = "historia AS (SELECT id_sucursal, id_variante, delta FROM mov_deltas),"

# History plus the opening quantity of each cell.
_HIST_WITH_OPENING = f"""
historia AS (
  SELECT id_sucursal, id_variante, delta FROM mov_deltas
  UNION ALL
  SELECT id_sucursal, id_variante, {OPENING_BUFFER} - least(min(saldo), 0) FROM mov_cell_bal GROUP BY ALL),"""


@register("full_outer_reconcile", "WITH " + _HIST_PLAIN.strip() + _RECON_SQL + "\nSELECT * FROM recon")
def full_outer_reconcile(t):
    """Stock vs the net of the history alone, per cell (the opening quantities show up)."""
    return Q.reconcile(t["inventario"], L.net_stock(t["movimientos"], t["detalle_lineas"]))


@register("chk_stock_reconciles", "WITH " + _HIST_WITH_OPENING.strip() + _RECON_SQL + """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM recon) AS discrepancias,
       (SELECT string_agg(printf('(sucursal %d, variante %d) inventario %d, recalculado %d',
                                 id_sucursal, id_variante, en_inventario, recalculado), '; '
                          ORDER BY id_sucursal, id_variante)
        FROM (SELECT * FROM recon ORDER BY id_sucursal, id_variante LIMIT 5) m) AS detalle
""")
def chk_stock_reconciles(t):
    """Stock equals the net of history + opening movements: discrepancy count and first 5."""
    mov, det = _history_with_opening(t)
    return Q.stock_reconciles(t["inventario"], mov, det)


def _history_with_opening(t):
    hdr, lin = L.opening_movements(t["movimientos"], t["detalle_lineas"], t["productos"], t["producto_variante"],
                                   _dt.datetime(1994, 12, 31, 8, 0, 0), buffer=OPENING_BUFFER)
    cols = ["id_movimiento", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino", "fecha_hora"]
    mov = t["movimientos"].select(*cols).unionByName(hdr.select(*cols))
    det = t["detalle_lineas"].select("id_movimiento", "id_variante", "cantidad").unionByName(
        lin.select("id_movimiento", "id_variante", "cantidad"))
    return mov, det


@register("chk_generated_invariants", """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM inventario WHERE cantidad_disponible < 0) AS stock_negativo,
       (SELECT CAST(count(*) AS BIGINT) FROM detalle_movimientos WHERE cantidad <= 0) AS cantidad_no_positiva,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT id_detalle FROM detalle_movimientos GROUP BY id_detalle
                                              HAVING count(*) > 1) a) AS ids_detalle_repetidos,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT id_movimiento FROM movimientos GROUP BY id_movimiento
                                              HAVING count(*) > 1) b) AS ids_movimiento_repetidos
""")
def chk_generated_invariants(t):
    """Final stock >= 0, quantities > 0, unique ids."""
    return Q.generated_invariants(t["inventario"], t["movimientos"], t["detalle_movimientos"])


@register("del_cascade", f"""
WITH doomed AS (SELECT id_movimiento FROM movimientos WHERE fecha_hora < TIMESTAMP '{PURGE_BEFORE} 00:00:00'),
retired AS (SELECT pv.id_variante FROM producto_variante pv JOIN productos p ON pv.id_producto = p.id_producto
            WHERE p.id_marca = {RETIRED_BRAND}),
blocked AS (SELECT DISTINCT r.id_variante FROM retired r JOIN detalle_lineas d ON d.id_variante = r.id_variante),
gone AS (SELECT id_variante FROM retired WHERE id_variante NOT IN (SELECT id_variante FROM blocked))
SELECT 'movimientos' AS tabla, 'borradas' AS accion, CAST(count(*) AS BIGINT) AS filas FROM doomed
UNION ALL SELECT 'detalle_movimientos', 'cascada', CAST(count(*) AS BIGINT) FROM detalle_lineas
  WHERE id_movimiento IN (SELECT id_movimiento FROM doomed)
UNION ALL SELECT 'detalle_movimientos', 'quedan', CAST(count(*) AS BIGINT) FROM detalle_lineas
  WHERE id_movimiento NOT IN (SELECT id_movimiento FROM doomed)
UNION ALL SELECT 'producto_variante', 'bloqueadas', CAST(count(*) AS BIGINT) FROM blocked
UNION ALL SELECT 'producto_variante', 'borradas', CAST(count(*) AS BIGINT) FROM gone
UNION ALL SELECT 'inventario', 'cascada', CAST(count(*) AS BIGINT) FROM inventario
  WHERE id_variante IN (SELECT id_variante FROM gone)
""")
def del_cascade(t):
    """Purge movements before 1996 (lines cascade) and retire one brand's variants
    (RESTRICT by lines blocks sold ones, stock cascades)."""
    from stockflow.sources.testdata import from_frames, lines
    frames = {k: t[k] for k in ("movimientos", "producto_variante", "inventario", "productos")}
    frames["detalle_movimientos"] = lines(t)
    tt = from_frames(frames)
    doomed = t["movimientos"].where(F.col("fecha_hora") < F.lit(PURGE_BEFORE).cast("timestamp_ntz"))
    a = Q.delete_cascade(tt, "movimientos", doomed)
    retired = (t["producto_variante"].join(t["productos"].where(F.col("id_marca") == RETIRED_BRAND)
                                           .select("id_producto"), "id_producto", "left_semi"))
    b = Q.delete_cascade(tt, "producto_variante", retired)
    inv_before = t["inventario"].select("id_variante")
    rows = [
        ("movimientos", "borradas", a["_deleted"]),
        ("detalle_movimientos", "cascada", lines(t).join(a["_deleted"], "id_movimiento", "left_semi")),
        ("detalle_movimientos", "quedan", a["detalle_movimientos"]),
        ("producto_variante", "bloqueadas", b["_blocked"]),
        ("producto_variante", "borradas", b["_deleted"]),
        ("inventario", "cascada", inv_before.join(b["_deleted"], "id_variante", "left_semi")),
    ]
    return Q._stack([df.agg(F.count(F.lit(1)).cast("bigint").alias("filas"))
                     .select(F.lit(tab).alias("tabla"), F.lit(act).alias("accion"), "filas")
                     for tab, act, df in rows])


@register("rekey_cascade", """
SELECT m.id_movimiento, m.id_sucursal_origen + 100 AS id_sucursal_origen, m.id_sucursal_destino + 100 AS id_sucursal_destino
FROM movimientos m
""")
def rekey_cascade(t):
    """Branch ids renumbered (+100): every movement's origin and destination follow."""
    mapping = t["sucursales"].select(F.col("id_sucursal").alias("old"), (F.col("id_sucursal") + 100).alias("new"))
    out = Q.rekey_cascade({"sucursales": t["sucursales"], "movimientos": t["movimientos"],
                           "inventario": t["inventario"]}, "sucursales", mapping)
    return out["movimientos"].select("id_movimiento", "id_sucursal_origen", "id_sucursal_destino")


#: Every key of each parent that this number divides is deleted.
DOOMED_MOD = 7
REKEY_OFFSET = 5000


def _parents():
    return {parent: pcol for _, _, parent, pcol, _ in S.FOREIGN_KEYS}


def _row_key_sql(tab: str) -> str:
    return " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in S.PRIMARY_KEYS[tab])


@register("del_cascade_rows", _union(
    f"SELECT '{parent}' AS tabla_padre, CAST({ccol} AS BIGINT) AS clave, '{child}' AS tabla, '{ccol}' AS columna, "
    f"{_row_key_sql(child)} AS fila, '{'cascada' if action == 'CASCADE' else 'bloquea'}' AS accion "
    f"FROM {child} WHERE {ccol} IN (SELECT {pcol} FROM {parent} WHERE {pcol} % {DOOMED_MOD} = 0)"
    for child, ccol, parent, pcol, action in S.FOREIGN_KEYS))
def del_cascade_rows(t):
    """Every child row that deleting every 7th key of each parent takes along or is held back by (13 keys)."""
    doomed = {parent: t[parent].where(F.col(pcol) % DOOMED_MOD == 0) for parent, pcol in _parents().items()}
    return Q.delete_effects(t, doomed)


@register("rekey_cascade_rows", _union(
    f"SELECT '{child}' AS tabla, '{ccol}' AS columna, {_row_key_sql(child)} AS fila, "
    f"CAST({ccol} + {REKEY_OFFSET} AS BIGINT) AS clave_nueva FROM {child}"
    for child, ccol, _, _, _ in S.FOREIGN_KEYS))
def rekey_cascade_rows(t):
    """All parents' keys moved by an offset: every child row's new foreign key (13 keys)."""
    return Q.rekey_effects(t, REKEY_OFFSET)


# ---------------------------------------------------------------------------
# The same checks over tables that break the rules on purpose, row by row by key
# ---------------------------------------------------------------------------
DIRTY_SQL = """
movimientos_d AS (
  SELECT * REPLACE (
    CASE WHEN id_movimiento % 101 = 0 THEN 'Perdida' ELSE tipo_movimiento END AS tipo_movimiento,
    CASE WHEN id_movimiento % 103 = 0 THEN NULL ELSE id_empleado END AS id_empleado,
    id_sucursal_origen + CASE WHEN id_movimiento % 107 = 0 THEN 1000 ELSE 0 END AS id_sucursal_origen)
  FROM movimientos
  UNION ALL BY NAME SELECT * FROM movimientos WHERE id_movimiento % 109 = 0),
productos_d AS (
  SELECT * REPLACE (
    CASE WHEN id_producto % 13 = 0 THEN 0 ELSE precio_venta_actual END AS precio_venta_actual,
    CASE WHEN id_producto % 17 = 0 THEN repeat('x', 200) ELSE nombre END AS nombre)
  FROM productos),
producto_variante_d AS (
  SELECT * REPLACE (CASE WHEN id_variante % 211 = 0 THEN '1' ELSE codigo_barras END AS codigo_barras)
  FROM producto_variante WHERE id_variante % 997 > 0),
inventario_d AS (
  SELECT * REPLACE (CASE WHEN id_variante % 97 = 0 THEN -1 ELSE cantidad_disponible END AS cantidad_disponible)
  FROM inventario)"""


def _dirty(t):
    """The tables of ``t`` with the faults of DIRTY_SQL."""
    from stockflow.sources.testdata import from_frames
    frames = {n: t[n] for n in [*S.TABLE_NAMES, "detalle_lineas"]}

    def put(table, col, key, mod, value):
        frames[table] = frames[table].withColumn(col, F.when(F.col(key) % mod == 0, value).otherwise(F.col(col)))
    m = frames["movimientos"]
    put("movimientos", "tipo_movimiento", "id_movimiento", 101, F.lit("Perdida"))
    put("movimientos", "id_empleado", "id_movimiento", 103, F.lit(None))
    put("movimientos", "id_sucursal_origen", "id_movimiento", 107, F.col("id_sucursal_origen") + 1000)
    frames["movimientos"] = frames["movimientos"].unionByName(m.where("id_movimiento % 109 = 0"))
    put("productos", "precio_venta_actual", "id_producto", 13, F.lit(0).cast(S.MONEY))
    put("productos", "nombre", "id_producto", 17, F.repeat(F.lit("x"), F.lit(200)))
    put("producto_variante", "codigo_barras", "id_variante", 211, F.lit("1"))
    frames["producto_variante"] = frames["producto_variante"].where("id_variante % 997 > 0")
    put("inventario", "cantidad_disponible", "id_variante", 97, F.lit(-1))
    return from_frames(frames)


def _register_dirty():
    clean = {"chk_not_null": chk_not_null, "chk_max_length": chk_max_length, "chk_primary_key": chk_primary_key,
             "chk_unique": chk_unique, "chk_domain_in": chk_domain_in, "chk_numeric": chk_numeric,
             "chk_foreign_key": chk_foreign_key, "chk_no_negative_stock": chk_no_negative_stock}
    for key, check in clean.items():
        body = registry.oracle_body(key)
        body = re.sub(r"\b(FROM|JOIN) (movimientos|productos|producto_variante|inventario)\b", r"\1 \2_d", body)

        def run(t, check=check):
            return check(_dirty(t))
        run.__doc__ = f"{check.__doc__} Over tables with faults."
        register(f"{key}_dirty", f"WITH {DIRTY_SQL.strip()}\n{body}")(run)


_register_dirty()
