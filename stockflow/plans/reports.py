"""The five business reports and the two views, as DataFrame plans.

Plan shape, common to all: filter the movement headers first (pushed into
the Parquet scan), join the one big fact (lines) on ``id_movimiento``,
*aggregate before joining the dimensions* (eager aggregation: sums are
decomposable, so pre-summing per variant or per movement turns millions of
lines into one row per key before any label is attached), then join the small
dimension tables. Dimension joins are plain equi joins: Spark broadcasts them
when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(checked at plan time, and again at run time by AQE), and falls back to a
shuffled join otherwise.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.operators.sorts import sort_small
from stockflow.plans.dims import dim_variante, fits_broadcast
from stockflow.schema import LOW_STOCK_DEFAULT, MONEY_SUM, UNITS_SUM
from stockflow.sources.testdata import lines

Tables = Mapping[str, DataFrame]


def _units(c="cantidad"):
    return F.sum(c).cast(UNITS_SUM)


def _money(c):
    return F.sum(c).cast(MONEY_SUM)


def _money_from_cents(c):
    return X.cents_to_money(F.sum(c))


def sales_headers(t: Tables, since=None, year: int | None = None) -> DataFrame:
    """Sale headers (``tipo = 'Salida'``) with optional time filters."""
    m = t["movimientos"].where(F.col("tipo_movimiento") == "Salida")
    if since is not None:
        m = m.where(F.col("fecha_hora") >= since)
    if year is not None:
        m = m.where(X.in_year("fecha_hora", year))
    return m


def sales_by_variant(t: Tables, headers: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the given headers summed per (variant, *extra header keys)."""
    h = headers.select("id_movimiento", *extra_keys)
    return (lines(t).select("id_movimiento", "id_variante", "cantidad", "precio_unitario")
            .join(h, "id_movimiento", "inner")
            .groupBy("id_variante", *extra_keys)
            .agg(F.sum("cantidad").alias("_u"), F.sum(X.line_amount_cents()).alias("_c")))


def variant_brand(t: Tables) -> DataFrame:
    """id_variante -> id_marca, marca (variant -> product -> brand)."""
    return dim_variante(t).select("id_variante", "id_marca", "marca")


def sales_by(t: Tables, headers: DataFrame, dim: DataFrame, keys: tuple[str, ...],
             header_keys: tuple[str, ...] = ()) -> DataFrame:
    """Units (``_u``) and amount in cents (``_c``) of the given headers' lines per ``keys``.

    When the dimension side fits the broadcast threshold (plan-time
    statistics), it is broadcast and lines aggregate straight to the report
    keys: one shuffle of a few partial rows. Otherwise lines are first summed
    per variant (map-side partial aggregation, exact since sums decompose)
    and the dimension is joined to variant-level rows.
    """
    if fits_broadcast(dim):
        h = headers.select("id_movimiento", *header_keys)
        return (lines(t).select("id_movimiento", "id_variante", "cantidad", "precio_unitario")
                .join(h, "id_movimiento", "inner")
                .join(F.broadcast(dim), "id_variante", "inner")
                .groupBy(*keys)
                .agg(F.sum("cantidad").alias("_u"), F.sum(X.line_amount_cents()).alias("_c")))
    per_v = sales_by_variant(t, headers, extra_keys=header_keys)
    return (per_v.join(dim, "id_variante", "inner").groupBy(*keys)
            .agg(F.sum("_u").alias("_u"), F.sum("_c").alias("_c")))


def revenue_by_brand(t: Tables, as_of=None, months: int = 3, top: int | None = None) -> DataFrame:
    """Report 1: units and revenue of sales since ``as_of - months`` per brand, by revenue desc."""
    as_of = as_of or _dt.date.today()
    per = sales_by(t, sales_headers(t, since=X.months_back(as_of, months)), variant_brand(t), ("id_marca", "marca"))
    out = per.select(F.col("marca").alias("marca_deportiva"), F.col("_u").cast(UNITS_SUM).alias("total_prendas_vendidas"),
                     X.cents_to_money("_c").alias("recaudacion_total"))
    if top:
        return out.orderBy(F.col("recaudacion_total").desc()).limit(top)
    return sort_small(out, F.col("recaudacion_total").desc())


def variant_labels(t: Tables) -> DataFrame:
    """Variant -> brand, product, size and colour names."""
    return dim_variante(t)


def unsold_variants(t: Tables, as_of=None) -> DataFrame:
    """Report 2: variants with no sale in the year of ``as_of`` (NOT IN -> anti join;
    ``id_variante`` is NOT NULL on both sides so the two agree).

    The sold set is reduced to distinct variants (map-side partial distinct)
    before the anti join, so the build side of that join is bounded by the
    variant count, not by the number of lines sold."""
    as_of = as_of or _dt.date.today()
    year = X._to_date(as_of).year
    sold = (lines(t).select("id_movimiento", "id_variante")
            .join(sales_headers(t, year=year).select("id_movimiento"), "id_movimiento", "left_semi")
            .select("id_variante").distinct())
    return (dim_variante(t).join(sold, "id_variante", "left_anti")
            .select("marca", "producto", "talle", "color")
            .orderBy("marca", "producto"))


def employee_tickets(t: Tables, branch: str, year: int) -> DataFrame:
    """Report 3: per employee of one branch (by name), distinct sale tickets and revenue in a year.

    The branch filter reaches the header side as a semi join, so the header
    side's size estimate stays bounded by the headers (an inner join is
    estimated as the product of its inputs, which made Spark pick the lines as
    the broadcast side). The headers are broadcast only when that bound is
    under the threshold; otherwise the join is left to Spark (shuffled).
    Revenue is summed per movement, so the distinct ticket count is a plain
    count of per-movement rows (two small aggregation steps, no distinct
    expansion), and employee names (one row per ``id_empleado``) are
    attached to the per-employee rows after both aggregations.
    """
    suc = t["sucursales"].where(F.col("nombre") == branch).select(
        F.col("id_sucursal").alias("id_sucursal_origen"), F.col("nombre").alias("sucursal"))
    h = (sales_headers(t, year=year).select("id_movimiento", "id_empleado", "id_sucursal_origen")
         .join(suc.select("id_sucursal_origen"), "id_sucursal_origen", "left_semi"))
    if fits_broadcast(h):
        h = F.broadcast(h)
    keys = ["id_empleado", "sucursal"]
    per_mov = (lines(t).select("id_movimiento", "cantidad", "precio_unitario")
               .join(h, "id_movimiento", "inner")
               .join(suc, "id_sucursal_origen", "inner")
               .groupBy("id_movimiento", *keys).agg(F.sum(X.line_amount_cents()).alias("_c")))
    per_emp = (per_mov.groupBy(*keys)
               .agg(F.count(F.lit(1)).cast("bigint").alias("cantidad_tickets_emitidos"),
                    _money_from_cents("_c").alias("total_plata_ingresada")))
    out = (per_emp.join(t["empleados"].select("id_empleado", "nombre", "apellido"), "id_empleado", "inner")
           .select("nombre", "apellido", "sucursal", "cantidad_tickets_emitidos", "total_plata_ingresada"))
    return sort_small(out, F.col("cantidad_tickets_emitidos").desc(), F.col("total_plata_ingresada").desc())


def low_stock(t: Tables, max_stock: int = LOW_STOCK_DEFAULT) -> DataFrame:
    """Report 4: cells with stock below ``max_stock`` (comment says 5, code 35: a parameter)."""
    inv = t["inventario"].where(F.col("cantidad_disponible") < max_stock)
    return (inv.join(t["sucursales"].select("id_sucursal", F.col("nombre").alias("sucursal")), "id_sucursal", "inner")
            .join(dim_variante(t).select("id_variante", "producto", "talle", "color"), "id_variante", "inner")
            .select("sucursal", "producto", "talle", "color", F.col("cantidad_disponible").alias("stock_actual"))
            .orderBy(F.col("sucursal").asc(), F.col("stock_actual").asc()))


def brand_by_branch(t: Tables) -> DataFrame:
    """Report 5: units and revenue of all sales per (branch name, brand name).

    Grouped by names only, so two branches with the same name merge."""
    per = sales_by(t, sales_headers(t), variant_brand(t), ("id_sucursal_origen", "id_marca", "marca"),
                   header_keys=("id_sucursal_origen",))
    suc = t["sucursales"].select(F.col("id_sucursal").alias("id_sucursal_origen"), F.col("nombre").alias("sucursal"))
    out = (per.join(suc, "id_sucursal_origen", "inner")
           .groupBy("sucursal", "marca")
           .agg(_units("_u").alias("total_unidades_vendidas"), _money_from_cents("_c").alias("recaudacion_por_marca")))
    return sort_small(out, F.col("sucursal").asc(), F.col("recaudacion_por_marca").desc())


def view_stock(t: Tables) -> DataFrame:
    """View 1: stock with names only (no internal ids)."""
    inv = t["inventario"]
    dim = dim_variante(t).select("id_variante", "producto", "marca", "talle", "color", "codigo_barras")
    return (inv.join(t["sucursales"].select("id_sucursal", F.col("nombre").alias("sucursal")), "id_sucursal", "inner")
            .join(dim, "id_variante", "inner")
            .select("sucursal", "producto", "marca", "talle", "color", "codigo_barras", "cantidad_disponible"))


def view_movement_audit(t: Tables) -> DataFrame:
    """View 2: one row per movement with masked employee document and supplier tax id.

    Left joins keep movements whose employee, branch or supplier is missing;
    the branch table plays two roles (origin, destination)."""
    m = t["movimientos"].select("fecha_hora", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino",
                                "id_empleado", "id_proveedor")
    emp = t["empleados"].select("id_empleado", "documento", "nombre", "apellido")
    so = t["sucursales"].select(F.col("id_sucursal").alias("id_sucursal_origen"),
                                F.col("nombre").alias("sucursal_origen"))
    sd = t["sucursales"].select(F.col("id_sucursal").alias("id_sucursal_destino"),
                                F.col("nombre").alias("sucursal_destino"))
    prov = t["proveedores"].select("id_proveedor", "cuit", F.col("razon_social").alias("proveedor"))
    j = (m.join(emp, "id_empleado", "left").join(so, "id_sucursal_origen", "left")
         .join(sd, "id_sucursal_destino", "left").join(prov, "id_proveedor", "left"))
    return j.select(
        "fecha_hora", "tipo_movimiento", "sucursal_origen", "sucursal_destino",
        X.mask_document("documento").alias("documento_empleado_enmascarado"),
        X.full_name("nombre", "apellido").alias("empleado_responsable"),
        X.mask_tax_id("cuit").alias("cuit_proveedor_enmascarado"),
        "proveedor")


def filter_selectivity(t: Tables, max_stock: int = LOW_STOCK_DEFAULT) -> DataFrame:
    """Share of stock cells the low-stock filter keeps (why an index does not help)."""
    inv = t["inventario"]
    return inv.agg(
        F.count(F.lit(1)).cast("bigint").alias("celdas"),
        F.sum(F.when(F.col("cantidad_disponible") < max_stock, 1).otherwise(0)).cast("bigint").alias("celdas_bajo_stock"),
        F.round(F.avg(F.when(F.col("cantidad_disponible") < max_stock, 1.0).otherwise(0.0)), 6).alias("selectividad"))
