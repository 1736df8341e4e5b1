"""SQL of the reports and views for the oracle: (CTEs, select) pairs over the model tables.

Facts are summed per key first; names are attached to the sums afterwards.
"""

from __future__ import annotations

from stockflow.sources.testdata import AS_OF, REPORT3_BRANCH, REPORT3_YEAR

_YEAR = int(AS_OF[:4])

_LABELS = """
etiquetas AS (
  SELECT id_variante, codigo_barras, id_marca, marca, producto, talle, color
  FROM producto_variante
  JOIN (SELECT id_producto, id_marca, nombre AS producto FROM productos) USING (id_producto)
  JOIN (SELECT id_marca, nombre AS marca FROM marcas) USING (id_marca)
  JOIN (SELECT id_talle, nomenclatura AS talle FROM talles) USING (id_talle)
  JOIN (SELECT id_color, nombre_color AS color FROM colores) USING (id_color))"""

_BRANCHES = "sedes AS (SELECT id_sucursal, nombre AS sucursal FROM sucursales)"


def _in_year(year: int) -> str:
    return f"fecha_hora >= DATE '{year}-01-01' AND fecha_hora < DATE '{year + 1}-01-01'"


REVENUE_BY_BRAND = (f"""
recientes AS (
  SELECT id_movimiento FROM movimientos
  WHERE tipo_movimiento = 'Salida' AND fecha_hora >= DATE '{AS_OF}' - INTERVAL 3 MONTH),
por_variante AS (
  SELECT id_variante, sum(cantidad) AS u, sum(cantidad * precio_unitario) AS r
  FROM detalle_lineas SEMI JOIN recientes USING (id_movimiento) GROUP BY id_variante),{_LABELS},
por_marca AS (
  SELECT id_marca, any_value(marca) AS marca, sum(u) AS u, sum(r) AS r
  FROM por_variante JOIN etiquetas USING (id_variante) GROUP BY id_marca)""", """
SELECT marca AS marca_deportiva, CAST(u AS BIGINT) AS total_prendas_vendidas,
       CAST(r AS DECIMAL(38,2)) AS recaudacion_total FROM por_marca""")

UNSOLD_VARIANTS = (f"""{_LABELS.strip()},
vendidas AS (
  SELECT id_variante FROM detalle_lineas SEMI JOIN (
    SELECT id_movimiento FROM movimientos WHERE tipo_movimiento = 'Salida' AND {_in_year(_YEAR)})
  USING (id_movimiento)),
quietas AS (SELECT id_variante FROM producto_variante EXCEPT SELECT id_variante FROM vendidas)""", """
SELECT marca, producto, talle, color FROM etiquetas SEMI JOIN quietas USING (id_variante)""")

EMPLOYEE_TICKETS = (f"""
tickets AS (
  SELECT id_movimiento, id_empleado FROM movimientos
  WHERE tipo_movimiento = 'Salida' AND {_in_year(REPORT3_YEAR)}
    AND id_sucursal_origen IN (SELECT id_sucursal FROM sucursales WHERE nombre = '{REPORT3_BRANCH}')),
importes AS (
  SELECT id_movimiento, sum(cantidad * precio_unitario) AS r
  FROM detalle_lineas SEMI JOIN tickets USING (id_movimiento) GROUP BY id_movimiento),
por_empleado AS (
  SELECT id_empleado, count(*) AS n, sum(r) AS r FROM tickets JOIN importes USING (id_movimiento)
  GROUP BY id_empleado)""", f"""
SELECT nombre, apellido, '{REPORT3_BRANCH}' AS sucursal, CAST(n AS BIGINT) AS cantidad_tickets_emitidos,
       CAST(r AS DECIMAL(38,2)) AS total_plata_ingresada FROM por_empleado JOIN empleados USING (id_empleado)""")

LOW_STOCK = (f"{_LABELS.strip()},\n{_BRANCHES}", """
SELECT sucursal, producto, talle, color, cantidad_disponible AS stock_actual
FROM (FROM inventario WHERE cantidad_disponible < 35) JOIN etiquetas USING (id_variante) JOIN sedes USING (id_sucursal)""")

BRAND_BY_BRANCH = (f"""{_LABELS.strip()},
{_BRANCHES},
por_celda AS (
  SELECT id_sucursal, id_variante, sum(cantidad) AS u, sum(cantidad * precio_unitario) AS r
  FROM detalle_lineas JOIN (
    SELECT id_movimiento, id_sucursal_origen AS id_sucursal FROM movimientos WHERE tipo_movimiento = 'Salida')
  USING (id_movimiento) GROUP BY id_sucursal, id_variante)""", """
SELECT sucursal, marca, CAST(sum(u) AS BIGINT) AS total_unidades_vendidas,
       CAST(sum(r) AS DECIMAL(38,2)) AS recaudacion_por_marca
FROM por_celda JOIN sedes USING (id_sucursal) JOIN etiquetas USING (id_variante) GROUP BY sucursal, marca""")

VIEW_STOCK = (f"{_LABELS.strip()},\n{_BRANCHES}", """
SELECT sucursal, producto, marca, talle, color, codigo_barras, cantidad_disponible
FROM etiquetas JOIN inventario USING (id_variante) JOIN sedes USING (id_sucursal)""")

VIEW_MOVEMENT_AUDIT = (f"""
{_BRANCHES},
personal AS (
  SELECT id_empleado, coalesce(documento[1:2], '') || '******' AS documento_empleado_enmascarado,
         coalesce(nombre, '') || ' ' || coalesce(apellido, '') AS empleado_responsable FROM empleados),
firmas AS (SELECT id_proveedor, razon_social, cuit[1:2] AS tipo, cuit[4:7] AS cabeza FROM proveedores)""", """
SELECT fecha_hora, tipo_movimiento,
       (SELECT sucursal FROM sedes WHERE sedes.id_sucursal = id_sucursal_origen) AS sucursal_origen,
       (SELECT sucursal FROM sedes WHERE sedes.id_sucursal = id_sucursal_destino) AS sucursal_destino,
       coalesce(documento_empleado_enmascarado, '******') AS documento_empleado_enmascarado,
       coalesce(empleado_responsable, ' ') AS empleado_responsable,
       coalesce(tipo, '') || '-' || coalesce(cabeza, '') || '****-*' AS cuit_proveedor_enmascarado,
       razon_social AS proveedor
FROM movimientos LEFT JOIN personal USING (id_empleado) LEFT JOIN firmas USING (id_proveedor)""")


def plain(report: tuple[str, str]) -> str:
    ctes, select = report
    return f"WITH {ctes.strip()}\n{select.strip()}"


def ranked(report: tuple[str, str], order: str) -> str:
    """The report with its place in ``order``."""
    ctes, select = report
    return f"WITH {ctes.strip()}\nSELECT *, CAST(rank() OVER (ORDER BY {order}) AS BIGINT) AS posicion FROM ({select.strip()})"
