"""Conformed variant dimension: one row per variant with every label the reports use.

The reports join the facts to variant -> product -> brand / size / colour.
Joining those four small tables in every query costs four broadcast jobs per
query; the denormalised dimension (built once per load, like a materialised
view, or on the fly from the 12 tables when it is not stored) costs one. It
is dimension-sized (one row per variant), never fact-sized.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_VARIANTE_COLS = ["id_variante", "codigo_barras", "id_producto", "producto", "id_marca", "marca", "id_categoria",
                     "id_talle", "talle", "id_color", "color"]


def build_dim_variante(t: Mapping[str, DataFrame]) -> DataFrame:
    """Variant -> product, brand, category, size, colour from the 12 tables (inner joins,
    as every report joins them)."""
    return (t["producto_variante"]
            .join(t["productos"].select("id_producto", F.col("nombre").alias("producto"), "id_marca", "id_categoria"),
                  "id_producto", "inner")
            .join(t["marcas"].select("id_marca", F.col("nombre").alias("marca")), "id_marca", "inner")
            .join(t["talles"].select("id_talle", F.col("nomenclatura").alias("talle")), "id_talle", "inner")
            .join(t["colores"].select("id_color", F.col("nombre_color").alias("color")), "id_color", "inner")
            .select(*DIM_VARIANTE_COLS))


def dim_variante(t: Mapping[str, DataFrame]) -> DataFrame:
    """The stored dimension if the table set has one, else built from the 12 tables."""
    return t["dim_variante"] if "dim_variante" in t else build_dim_variante(t)


def estimated_bytes(df: DataFrame) -> int:
    """Plan-time size estimate of a DataFrame (optimizer statistics; runs no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """True when Spark's own statistics put ``df`` under the broadcast threshold.

    This is the size check behind every explicit ``broadcast()`` here: a side
    is broadcast only when its estimate is within
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise the caller takes the
    shuffle-based plan.
    """
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    limit_b = _parse_bytes(limit)
    return limit_b > 0 and estimated_bytes(df) <= limit_b


def _parse_bytes(v: str) -> int:
    v = str(v).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for u in sorted(units, key=len, reverse=True):
        if v.endswith(u) and v[:-len(u)].strip().lstrip("-").isdigit():
            return int(v[:-len(u)]) * units[u]
    return int(v)
