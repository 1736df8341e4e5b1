"""Registered ledger and write-job queries with their SQL oracles.

The accept/reject replay has no closed SQL form; its oracle is a recursive
CTE that walks each variant's lines one step per line with a branch -> stock
map as state (``fold_sql``), an independent formulation of the same rule.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.plans import jobs as J
from stockflow.plans import ledger as L
from stockflow.registry import register
from stockflow.session import ensure_checkpoint_dir
from stockflow.sources import files as FS
from stockflow.sources.testdata import OPENING_BUFFER, legs_sql

BATCH_TIME = _dt.datetime(2001, 8, 2, 9, 0, 0)   # fixed "now" of the request batches
BATCH_TIME_SQL = "TIMESTAMP '2001-08-02 09:00:00'"
REPRICE_BRAND = 13
REPRICE_PCT = "10.00"


# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------
_LINES_HDR_SQL = """
lines_hdr AS (
  SELECT d.id_detalle, d.id_variante, d.cantidad, d.precio_unitario, m.tipo_movimiento,
         m.id_sucursal_origen, m.id_sucursal_destino, m.fecha_hora, d.id_movimiento
  FROM detalle_movimientos d JOIN movimientos m ON d.id_movimiento = m.id_movimiento)"""

_DELTAS_SQL = legs_sql("line_deltas", "detalle_movimientos", "movimientos")


def fold_sql(lines: str, stock: str | None) -> str:
    """CTEs ``fold_lines``, ``fold_init``, ``fold`` and ``fold_out`` for the replay.

    ``lines`` names a CTE with id_detalle, id_variante, tipo_movimiento,
    id_sucursal_origen, id_sucursal_destino, cantidad, precio_unitario and
    motivo_previo; ``stock`` a CTE with id_sucursal, id_variante,
    cantidad_disponible (or None for empty stock).
    """
    init = "MAP {}::MAP(BIGINT, BIGINT)"
    if stock:
        init_src = f"""
  LEFT JOIN (SELECT id_variante,
                    map_from_entries(list(struct_pack(k := id_sucursal, v := CAST(cantidad_disponible AS BIGINT)))) AS st
             FROM {stock} GROUP BY id_variante) s ON s.id_variante = v.id_variante"""
        init_expr = f"coalesce(s.st, {init})"
    else:
        init_src, init_expr = "", init
    avail = "CASE WHEN l.o IS NULL THEN 0 ELSE coalesce(r.st[l.o], 0) END"
    return f"""
fold_lines AS (
  SELECT l.id_detalle, coalesce(l.id_variante, -1) AS id_variante, l.tipo_movimiento AS tipo, l.id_sucursal_origen AS o,
         l.id_sucursal_destino AS d, CAST(l.cantidad AS INTEGER) AS q, l.motivo_previo AS pre,
         CASE WHEN l.precio_unitario < 0 THEN '{L.REASON_PRICE}'
              WHEN pvk.id_variante IS NULL THEN '{L.REASON_UNKNOWN}' END AS late,
         row_number() OVER (PARTITION BY coalesce(l.id_variante, -1) ORDER BY l.id_detalle) AS rn
  FROM {lines} l LEFT JOIN producto_variante pvk ON l.id_variante = pvk.id_variante),
fold_init AS (
  SELECT v.id_variante, {init_expr} AS st
  FROM (SELECT DISTINCT id_variante FROM fold_lines) v{init_src}),
fold(id_variante, rn, st, id_detalle, tipo, o, d, q, disponible, motivo) AS (
  SELECT id_variante, CAST(0 AS BIGINT), st, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT),
         CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  FROM fold_init
  UNION ALL
  SELECT z.id_variante, z.rn,
         CASE WHEN z.motivo IS NOT NULL OR z.tipo <> 'Traslado' THEN z.st1
              ELSE map_concat(z.st1, MAP {{coalesce(z.d, -1): coalesce(z.st1[z.d], 0) + z.q}}) END,
         z.id_detalle, z.tipo, z.o, z.d, z.q, z.disponible, z.motivo
  FROM (
    SELECT y.*,
           CASE WHEN y.motivo IS NOT NULL THEN y.st
                WHEN y.tipo = 'Entrada' THEN map_concat(y.st, MAP {{coalesce(y.o, -1): coalesce(y.st[y.o], 0) + y.q}})
                WHEN y.st[y.o] IS NULL THEN y.st
                ELSE map_concat(y.st, MAP {{coalesce(y.o, -1): y.st[y.o] - y.q}}) END AS st1
    FROM (
      SELECT r.id_variante, l.rn, r.st, l.id_detalle, l.tipo, l.o, l.d, l.q,
             CAST({avail} AS BIGINT) AS disponible,
             CASE WHEN l.pre IS NOT NULL THEN l.pre
                  WHEN l.tipo IN ('Salida', 'Traslado') AND {avail} < l.q THEN '{L.REASON_STOCK}'
                  WHEN l.q IS NULL THEN '{L.REASON_NULL_QUANTITY}'
                  WHEN l.id_variante = -1 THEN '{L.REASON_NULL_VARIANT}'
                  WHEN l.q <= 0 THEN '{L.REASON_QUANTITY}'
                  WHEN l.late IS NOT NULL THEN l.late
                  WHEN (l.tipo = 'Entrada' AND l.o IS NULL) OR (l.tipo = 'Traslado' AND l.d IS NULL)
                    THEN '{L.REASON_NO_BRANCH}' END AS motivo
      FROM fold r JOIN fold_lines l ON l.id_variante = r.id_variante AND l.rn = r.rn + 1) y) z),
fold_out AS (
  SELECT id_detalle, nullif(id_variante, -1) AS id_variante, tipo AS tipo_movimiento, o AS id_sucursal_origen, d AS id_sucursal_destino,
         q AS cantidad, disponible, motivo IS NULL AS aceptado, motivo,
         CASE WHEN o IS NULL THEN NULL ELSE st[o] END AS saldo_origen,
         CASE WHEN d IS NULL THEN NULL ELSE st[d] END AS saldo_destino
  FROM fold WHERE rn > 0)"""


def apply_sql(stock: str | None, decided: str = "fold_out", name: str = "applied") -> str:
    """CTE ``name``: new stock from ``stock`` and the accepted lines of ``decided``."""
    base = stock or "(SELECT CAST(NULL AS BIGINT) AS id_sucursal, CAST(NULL AS BIGINT) AS id_variante, " \
                    "CAST(NULL AS INTEGER) AS cantidad_disponible WHERE false)"
    return f"""
{name}_net AS (
  SELECT pata.sede AS id_sucursal, id_variante, sum(pata.unidades) AS dd
  FROM (SELECT id_variante, unnest(list_filter([
                 {{'sede': id_sucursal_origen, 'leg': 0,
                   'unidades': cantidad * (CASE tipo_movimiento WHEN 'Entrada' THEN 1 ELSE -1 END)}},
                 {{'sede': id_sucursal_destino, 'leg': 1, 'unidades': cantidad}}],
               lambda x: x.leg = 0 OR tipo_movimiento = 'Traslado')) AS pata
        FROM {decided} WHERE aceptado)
  GROUP BY ALL),
{name} AS (
  SELECT coalesce(s.id_sucursal, n.id_sucursal) AS id_sucursal, coalesce(s.id_variante, n.id_variante) AS id_variante,
         CAST(coalesce(s.cantidad_disponible, 0) + coalesce(n.dd, 0) AS INTEGER) AS cantidad_disponible
  FROM {base} s FULL OUTER JOIN {name}_net n ON s.id_sucursal = n.id_sucursal AND s.id_variante = n.id_variante)"""


# ---------------------------------------------------------------------------
# Replay without rejection
# ---------------------------------------------------------------------------
@register("ledger_net_stock", """
SELECT id_sucursal, id_variante, CAST(sum(delta) AS BIGINT) AS cantidad FROM mov_deltas GROUP BY ALL
""")
def ledger_net_stock(t):
    """Stock per cell = net of all movements."""
    return L.net_stock(t["movimientos"], t["detalle_lineas"])


@register("ledger_running_balance", f"""
WITH {_DELTAS_SQL}
SELECT id_detalle, leg, id_sucursal, id_variante, delta,
       CAST(sum(delta) OVER (PARTITION BY id_sucursal, id_variante ORDER BY id_detalle, leg
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS saldo
FROM line_deltas
""")
def ledger_running_balance(t):
    """Balance after every line leg per cell, in line order."""
    return L.running_balance(t["movimientos"], t["detalle_movimientos"])


@register("ledger_worst_dip", """
SELECT id_sucursal, id_variante, CAST(least(min(saldo), 0) AS BIGINT) AS peor_saldo, CAST(sum(d) AS BIGINT) AS neto
FROM mov_cell_bal GROUP BY id_sucursal, id_variante
""")
def ledger_worst_dip(t):
    """Lowest running balance per cell (capped at 0) and the net."""
    return L.worst_dip(t["movimientos"], t["detalle_lineas"])


@register("ledger_opening_stock", f"""
SELECT id_sucursal, id_variante, CAST(-least(min(saldo), 0) + {OPENING_BUFFER} AS INTEGER) AS cantidad_apertura
FROM mov_cell_bal GROUP BY id_sucursal, id_variante
""")
def ledger_opening_stock(t):
    """Opening quantity per cell so no balance goes negative."""
    return L.opening_stock(t["movimientos"], t["detalle_lineas"], OPENING_BUFFER).drop("neto")


@register("ledger_final_stock", """
SELECT id_sucursal, id_variante, cantidad_disponible FROM inventario
""")
def ledger_final_stock(t):
    """Opening + net per cell (the inventario the history implies)."""
    return L.final_stock(t["movimientos"], t["detalle_lineas"], OPENING_BUFFER)


# ---------------------------------------------------------------------------
# Price fill and replay with rejection
# ---------------------------------------------------------------------------
@register("ledger_fill_price", """
SELECT l.l_orderkey AS id_movimiento, l.l_partkey AS id_variante, CAST(l.l_quantity AS INTEGER) AS cantidad,
       CASE WHEN l.l_linenumber = 1 THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) END
         AS precio_original,
       CASE WHEN m.tipo_movimiento = 'Salida' AND l.l_linenumber = 1 AND lp.precio IS NOT NULL THEN lp.precio
            WHEN l.l_linenumber = 1 THEN CAST(0 AS DECIMAL(12,2))
            ELSE CAST(l.l_extendedprice AS DECIMAL(12,2)) END AS precio_unitario,
       (m.tipo_movimiento = 'Salida' AND l.l_linenumber = 1 AND lp.precio IS NOT NULL) AS precio_completado
FROM lineitem l
JOIN movimientos m ON m.id_movimiento = l.l_orderkey
LEFT JOIN (SELECT pv.id_variante, p.precio_venta_actual AS precio
           FROM producto_variante pv JOIN productos p ON pv.id_producto = p.id_producto) lp
  ON lp.id_variante = l.l_partkey
""")
def ledger_fill_price(t):
    """Sale lines with price 0 get the list price (first line of each order comes at 0)."""
    li = t.raw("lineitem")
    req = li.select(
        F.col("l_orderkey").alias("id_movimiento"), F.col("l_partkey").alias("id_variante"),
        F.col("l_quantity").cast("int").alias("cantidad"),
        F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_extendedprice")).cast("decimal(12,2)")
         .alias("precio_unitario"))
    req = req.join(t["movimientos"].select("id_movimiento", "tipo_movimiento"), "id_movimiento", "inner")
    out = L.fill_price(req, t["producto_variante"], t["productos"])
    return out.select("id_movimiento", "id_variante", "cantidad", "precio_original", "precio_unitario",
                      "precio_completado")


def _lines_for_fold(t):
    return L.lines_with_header(t["movimientos"], t["detalle_movimientos"],
                               ["id_detalle", "id_movimiento", "id_variante", "cantidad", "precio_unitario"])


def _history_decided(t):
    return L.validate_stock(_lines_for_fold(t), stock=None, pv=t["producto_variante"],
                            count_on=t["detalle_lineas"])


_FOLD_EMPTY = f"""
WITH {_LINES_HDR_SQL.strip()},
fl AS (SELECT *, CAST(NULL AS VARCHAR) AS motivo_previo FROM lines_hdr),
{fold_sql("fl", None).strip()}
"""


@register("ledger_validate_stock", _FOLD_EMPTY + "SELECT * FROM fold_out", recursive=True)
def ledger_validate_stock(t):
    """Every line accepted or rejected in id order, starting from empty stock."""
    return _history_decided(t)


@register("ledger_apply", _FOLD_EMPTY + "," + apply_sql(None).strip() + "\nSELECT * FROM applied", recursive=True)
def ledger_apply(t):
    """Stock after applying the accepted lines of the replay to empty stock."""
    decided = _history_decided(t)
    empty = t["inventario"].limit(0)
    return L.apply_accepted(empty, decided)


# ---------------------------------------------------------------------------
# Request jobs: the history's lines replayed as procedure calls against the
# final stock (so many are rejected)
# ---------------------------------------------------------------------------
#: Every 60th request or so breaks one rule: remainder of the request id by BREAK_MOD -> what is wrong with it.
BREAK_MOD, SHIFT = 419, 10**9
BREAKS = {1: "NULL quantity", 2: "NULL variant", 3: "unknown variant", 4: "NULL employee", 5: "unknown employee",
          6: "unknown branch", 7: "unknown supplier"}


def _requests(t, tipo: str):
    """The history's lines of one type as requests, some of them broken on purpose (BREAKS)."""
    det, tasks = t["detalle_movimientos"], t.line_tasks()
    if tasks:       # as the movements are dealt
        det = det.repartition(tasks, "id_movimiento")
    lh = L.lines_with_header(t["movimientos"], det,
                             ["id_detalle", "id_movimiento", "id_variante", "cantidad", "precio_unitario"])
    m = t["movimientos"].select("id_movimiento", "id_empleado", "id_proveedor")
    r = lh.where(F.col("tipo_movimiento") == tipo).join(m, "id_movimiento", "inner")
    k = F.col("id_detalle") % BREAK_MOD

    def broken(col, null, shift, name=None):
        x = F.when(k == shift, F.col(col) + SHIFT) if shift else F.when(F.lit(False), F.col(col))
        return x.when(k == null, F.lit(None)).otherwise(F.col(col)).alias(name or col)
    branch = F.when(k == 6, F.col("id_sucursal_origen") + SHIFT).otherwise(F.col("id_sucursal_origen"))
    return r.select(F.col("id_detalle").alias("request_id"), branch.alias("id_sucursal"),
                    branch.alias("id_sucursal_origen"), "id_sucursal_destino", broken("id_empleado", 4, 5),
                    broken("id_proveedor", -1, 7), F.lit(None).cast("string").alias("observaciones"),
                    broken("id_variante", 2, 3), broken("cantidad", 1, None), "precio_unitario")


def _job_sql(tipo: str, price_sql: str, dest_sql: str, supplier_sql: str, pre_sql: str) -> str:
    msg_ok, msg_err = J.MSG_OK[tipo], J.MSG_ERROR[tipo]
    fill = ""
    price_col = price_sql
    if tipo == "Salida":
        fill = """
  LEFT JOIN (SELECT pv.id_variante AS lv, p.precio_venta_actual AS lista
             FROM producto_variante pv JOIN productos p ON pv.id_producto = p.id_producto) lp ON lp.lv = r.id_variante"""
        price_col = f"CASE WHEN {price_sql} = 0 AND lp.lista IS NOT NULL THEN lp.lista ELSE {price_sql} END"
    return f"""
WITH {_LINES_HDR_SQL.strip()},
req AS (
  SELECT l.id_detalle AS request_id,
         l.id_sucursal_origen + CASE l.id_detalle % {BREAK_MOD} WHEN 6 THEN {SHIFT} ELSE 0 END AS id_sucursal,
         id_sucursal AS id_sucursal_origen, l.id_sucursal_destino,
         m.id_empleado + CASE l.id_detalle % {BREAK_MOD} WHEN 4 THEN NULL WHEN 5 THEN {SHIFT} ELSE 0 END AS id_empleado,
         m.id_proveedor + CASE l.id_detalle % {BREAK_MOD} WHEN 7 THEN {SHIFT} ELSE 0 END AS id_proveedor,
         l.id_variante + CASE l.id_detalle % {BREAK_MOD} WHEN 2 THEN NULL WHEN 3 THEN {SHIFT} ELSE 0 END AS id_variante,
         l.cantidad + CASE l.id_detalle % {BREAK_MOD} WHEN 1 THEN NULL ELSE 0 END AS cantidad, l.precio_unitario
  FROM lines_hdr l JOIN movimientos m ON l.id_movimiento = m.id_movimiento
  WHERE l.tipo_movimiento = '{tipo}'),
req_ids AS (
  SELECT r.*,
         (SELECT max(id_movimiento) FROM movimientos) + row_number() OVER (ORDER BY r.request_id) AS id_movimiento,
         (SELECT max(id_detalle) FROM detalle_movimientos) + row_number() OVER (ORDER BY r.request_id) AS id_detalle_n
  FROM req r),
fl AS (
  SELECT r.id_detalle_n AS id_detalle, r.id_variante, '{tipo}' AS tipo_movimiento,
         CAST(r.id_sucursal AS BIGINT) AS id_sucursal_origen, {dest_sql} AS id_sucursal_destino,
         r.cantidad, CAST({price_col} AS DECIMAL(12,2)) AS precio_unitario,
         coalesce({pre_sql}, CASE
           WHEN r.id_empleado IS NULL THEN '{L.REASON_NULL_EMPLOYEE}'
           WHEN r.id_sucursal NOT IN (SELECT id_sucursal FROM sucursales)
             OR {dest_sql} NOT IN (SELECT id_sucursal FROM sucursales) THEN '{L.REASON_BRANCH}'
           WHEN r.id_empleado NOT IN (SELECT id_empleado FROM empleados) THEN '{L.REASON_EMPLOYEE}'
           WHEN {supplier_sql} NOT IN (SELECT id_proveedor FROM proveedores) THEN '{L.REASON_SUPPLIER}' END) AS motivo_previo,
         r.request_id, r.id_movimiento
  FROM req_ids r{fill}),
{fold_sql("fl", "inventario").strip()},
job_results AS (
SELECT fl.request_id, fl.id_movimiento, f.id_detalle, f.id_variante, f.id_sucursal_origen, f.id_sucursal_destino,
       f.cantidad, fl.precio_unitario, f.disponible, f.aceptado, f.motivo,
       CASE WHEN f.aceptado THEN 1 ELSE 0 END AS filas,
       CASE WHEN f.aceptado THEN printf('{msg_ok}', fl.id_movimiento) ELSE printf('{msg_err}', f.motivo) END AS mensaje
FROM fold_out f JOIN fl ON f.id_detalle = fl.id_detalle)
"""


_SELL_CTES = _job_sql("Salida", "CAST(0 AS DECIMAL(12,2))", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)",
                     "CAST(NULL AS VARCHAR)")
_RECEIVE_CTES = _job_sql("Entrada", "r.precio_unitario", "CAST(NULL AS BIGINT)", "r.id_proveedor",
                        "CAST(NULL AS VARCHAR)")
_TRANSFER_CTES = _job_sql(
    "Traslado", "r.precio_unitario", "r.id_sucursal_destino", "CAST(NULL AS BIGINT)",
    f"CASE WHEN r.id_sucursal_origen = r.id_sucursal_destino THEN '{L.REASON_SAME_BRANCH}' "
    f"WHEN r.id_sucursal_destino IS NULL THEN '{L.REASON_NO_DESTINATION}' END")
_SELL_SQL = _SELL_CTES + "SELECT * FROM job_results"
_RECEIVE_SQL = _RECEIVE_CTES + "SELECT * FROM job_results"
_TRANSFER_SQL = _TRANSFER_CTES + "SELECT * FROM job_results"


@register("job_sell", _SELL_SQL, recursive=True)
def job_sell(t):
    """Every historical sale line resubmitted as a till sale against the final stock."""
    return J.job_sell(_requests(t, "Salida"), t, t["inventario"], BATCH_TIME, t.line_tasks()).results


@register("job_receive", _RECEIVE_SQL, recursive=True)
def job_receive(t):
    """Every historical receipt line resubmitted as a supplier receipt."""
    return J.job_receive(_requests(t, "Entrada"), t, t["inventario"], BATCH_TIME, t.line_tasks()).results


@register("job_transfer", _TRANSFER_SQL, recursive=True)
def job_transfer(t):
    """Every historical transfer line resubmitted as a transfer against the final stock."""
    return J.job_transfer(_requests(t, "Traslado"), t, t["inventario"], BATCH_TIME, t.line_tasks()).results


@register("job_result_messages", _TRANSFER_CTES + "SELECT request_id, aceptado, filas, mensaje FROM job_results",
          recursive=True)
def job_result_messages(t):
    """One status row per transfer request: id, ok, rows touched, message."""
    return job_transfer(t).select("request_id", "aceptado", "filas", "mensaje")


@register("job_reject_policy", _SELL_CTES + """
SELECT 'reject' AS politica, CAST(sum(CASE WHEN aceptado THEN 1 ELSE 0 END) AS BIGINT) AS publicadas,
       CAST(sum(CASE WHEN aceptado THEN 0 ELSE 1 END) AS BIGINT) AS en_cuarentena FROM job_results
UNION ALL
SELECT 'fail', CAST(CASE WHEN bool_and(aceptado) THEN count(*) ELSE 0 END AS BIGINT),
       CAST(CASE WHEN bool_and(aceptado) THEN 0 ELSE count(*) END AS BIGINT) FROM job_results
""", recursive=True)
def job_reject_policy(t):
    """Published and quarantined request counts of the sale batch under both policies."""
    return J.policy_counts(J.job_sell(_requests(t, "Salida"), t, t["inventario"], BATCH_TIME, t.line_tasks()))


@register("job_reject_policy_rows", _SELL_CTES + """
SELECT politica, CASE WHEN (politica = 'reject' AND NOT aceptado)
                        OR (politica = 'fail' AND (SELECT NOT bool_and(aceptado) FROM job_results))
                      THEN 'cuarentena' ELSE 'publicada' END AS estado,
       request_id, id_movimiento, id_detalle, id_sucursal_origen, id_sucursal_destino, id_variante, cantidad,
       precio_unitario, motivo
FROM (SELECT *, unnest(['reject', 'fail']) AS politica FROM job_results)
""", recursive=True)
def job_reject_policy_rows(t):
    """Every request of the sale batch under both policies: published, or in quarantine with its reason."""
    return J.policy_rows(J.checkpointed(J.job_sell(_requests(t, "Salida"), t, t["inventario"], BATCH_TIME, t.line_tasks())))


@register("snapshot_compare", _TRANSFER_CTES + "," + apply_sql("inventario").strip() + """,
primera_mitad AS (
  SELECT * FROM fold_out WHERE id_detalle <= (SELECT (min(id_detalle) + max(id_detalle)) // 2 FROM fold_out)),
""" + apply_sql("inventario", "primera_mitad", "durante").strip() + """,
cells AS (
  SELECT id_sucursal_origen AS id_sucursal, id_variante FROM fold_out
  UNION SELECT id_sucursal_destino, id_variante FROM fold_out WHERE id_sucursal_destino IS NOT NULL)
SELECT c.id_sucursal, c.id_variante, c.etapa, e.cantidad_disponible AS cantidad
FROM (SELECT *, unnest(['antes', 'durante', 'despues']) AS etapa FROM cells) c
LEFT JOIN (SELECT 'antes' AS etapa, id_sucursal, id_variante, cantidad_disponible FROM inventario
           UNION ALL SELECT 'durante', * FROM durante
           UNION ALL SELECT 'despues', * FROM applied) e
  ON e.etapa = c.etapa AND e.id_sucursal = c.id_sucursal AND e.id_variante = c.id_variante
""", recursive=True)
def snapshot_compare(t):
    """Stock of every cell a transfer batch touches, before, during and after the batch (versions read as of their batch)."""
    # The numbered lines and the inventory are read several times, and each step's shuffles go before the next step's come.
    t.keep("detalle_movimientos", "inventario")
    # Results and the three states all come from the replay: checkpoint it once.
    res = J.checkpointed(J.job_transfer(_requests(t, "Traslado"), t, t["inventario"], BATCH_TIME, t.line_tasks()))
    r = res.results
    cells = (r.select(F.col("id_sucursal_origen").alias("id_sucursal"), "id_variante")
             .unionByName(r.where(F.col("id_sucursal_destino").isNotNull())
                          .select(F.col("id_sucursal_destino").alias("id_sucursal"), "id_variante")))
    root = FS.new_version_dir(f"{ensure_checkpoint_dir(r.sparkSession).rstrip('/')}/snapshot")
    return J.snapshot_states(J.job_states(res, root), cells).select("id_sucursal", "id_variante", "etapa", "cantidad")


# ---------------------------------------------------------------------------
# Price change per brand
# ---------------------------------------------------------------------------
@register("job_reprice_brand", f"""
SELECT id_producto, id_marca, precio_venta_actual AS precio_anterior,
       CASE WHEN id_marca = {REPRICE_BRAND}
            THEN CAST(precio_venta_actual * CAST(1 + CAST({REPRICE_PCT} AS DECIMAL(5,2)) / 100 AS DECIMAL(10,6))
                      AS DECIMAL(12,2))
            ELSE precio_venta_actual END AS precio_venta_actual
FROM productos
""")
def job_reprice_brand(t):
    """All list prices of brand 13 raised 10 %, half-up to cents."""
    new, _ = J.reprice_brand(t["productos"], t["marcas"], REPRICE_BRAND, REPRICE_PCT)
    return new.select("id_producto", "id_marca", "precio_anterior", "precio_venta_actual")


@register("job_reprice_brand_status", f"""
SELECT CAST({REPRICE_BRAND} AS BIGINT) AS id_marca, (SELECT nombre FROM marcas WHERE id_marca = {REPRICE_BRAND}) AS marca,
       CAST(count(*) AS BIGINT) AS filas, true AS ok,
       printf('precios cambiados: %d', count(*)) AS mensaje
FROM productos WHERE id_marca = {REPRICE_BRAND}
""")
def job_reprice_brand_status(t):
    """Status row of the price change: brand, rows touched, message."""
    _, status = J.reprice_brand(t["productos"], t["marcas"], REPRICE_BRAND, REPRICE_PCT)
    return status
