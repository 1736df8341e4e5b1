"""Filters and projections over the model tables (all pushed down where the column is stored)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.schema import CONSUMING_TYPES, LOW_STOCK_DEFAULT


def flt_type(mov: DataFrame, tipo: str) -> DataFrame:
    return mov.where(F.col("tipo_movimiento") == tipo)


def flt_type_in(mov: DataFrame, tipos: Sequence[str] = tuple(CONSUMING_TYPES)) -> DataFrame:
    return mov.where(F.col("tipo_movimiento").isin(list(tipos)))


def flt_recent_months(mov: DataFrame, as_of, n: int) -> DataFrame:
    """Time >= as_of minus n months (lower bound only)."""
    return mov.where(F.col("fecha_hora") >= X.months_back(as_of, n))


def flt_year(mov: DataFrame, year: int) -> DataFrame:
    """Year equals a constant, written as a half-open range so Parquet stats can prune."""
    return mov.where(X.in_year("fecha_hora", year))


def flt_current_year(mov: DataFrame, as_of) -> DataFrame:
    return flt_year(mov, X._to_date(as_of).year)


def flt_branch_name(df: DataFrame, branches: DataFrame, name: str, key: str = "id_sucursal_origen") -> DataFrame:
    """Keep rows whose branch has the given name: filter the small dimension, then semi join."""
    ids = branches.where(F.col("nombre") == name).select(F.col("id_sucursal").alias(key))
    return df.join(ids, key, "left_semi")


def flt_low_stock(inv: DataFrame, max_stock: int = LOW_STOCK_DEFAULT) -> DataFrame:
    return inv.where(F.col("cantidad_disponible") < max_stock)


def flt_negative_stock(inv: DataFrame) -> DataFrame:
    return inv.where(F.col("cantidad_disponible") < 0)


def flt_cell(inv: DataFrame, cells: DataFrame) -> DataFrame:
    """Point look-up of the cells listed in ``cells`` (id_sucursal, id_variante, or one of them for all its cells)."""
    keys = [c for c in ("id_sucursal", "id_variante") if c in cells.columns]
    return inv.join(cells.select(*keys).distinct(), keys, "left_semi")


def flt_differs(df: DataFrame, a: str, b: str) -> DataFrame:
    """``COALESCE(a, 0) <> COALESCE(b, 0)``."""
    return df.where(F.coalesce(F.col(a), F.lit(0)) != F.coalesce(F.col(b), F.lit(0)))


def flt_same_branch(mov: DataFrame) -> DataFrame:
    """Transfers whose origin equals the destination (NULL compares unknown: not kept)."""
    return mov.where((F.col("tipo_movimiento") == "Traslado") &
                     (F.col("id_sucursal_origen") == F.col("id_sucursal_destino")))


def flt_missing_destination(mov: DataFrame) -> DataFrame:
    return mov.where((F.col("tipo_movimiento") == "Traslado") & F.col("id_sucursal_destino").isNull())


def flt_zero_price_sale(lines_hdr: DataFrame) -> DataFrame:
    return lines_hdr.where((F.col("tipo_movimiento") == "Salida") & (F.col("precio_unitario") == 0))


def proj_line_amount(det: DataFrame, out: str = "importe") -> DataFrame:
    """quantity x unit price, exact: DECIMAL(23,2) (int x DECIMAL(12,2))."""
    return det.withColumn(out, X.line_amount().cast("decimal(23,2)"))


def proj_signed_delta(lines_hdr: DataFrame, out: str = "delta") -> DataFrame:
    return lines_hdr.withColumn(out, X.signed_delta())


def proj_state_tag(df: DataFrame, tag: str, col: str = "estado") -> DataFrame:
    return df.withColumn(col, F.lit(tag))


def proj_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def proj_default_time(mov: DataFrame, batch_time, col: str = "fecha_hora") -> DataFrame:
    """A missing movement time becomes the batch time (the column's CURRENT_TIMESTAMP default)."""
    now: Column = X.ntz(batch_time)
    return mov.withColumn(col, F.coalesce(F.col(col), now))
