from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from stockflow.session import ensure_checkpoint_dir  # noqa: E402
from stockflow.sources.files import src_inline_rows  # noqa: E402
from stockflow.sources.testdata import from_frames  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def D(x: str) -> Decimal:
    return Decimal(x)


def seed_frames(spark, **override):
    """A small seed-shaped model: three brands, two categories, three sizes
    (one given as an integer), two colours, three branches (two share a name),
    four variants and the stock cells used by the scenario tests."""
    rows = {
        "marcas": [(1, "Alfa"), (2, "Beta"), (3, "Gamma")],
        "categorias": [(1, "Remeras", None), (2, "Calzado", None)],
        "talles": [(1, "S"), (2, "M"), (3, 40)],
        "colores": [(1, "Negro"), (2, "Blanco")],
        "sucursales": [(1, "Sucursal Centro", None, "Cordoba"), (2, "Sucursal NOA", None, "Salta"),
                       (3, "Sucursal NOA", None, "Jujuy")],
        "proveedores": [(1, "Proveedor Uno", "30-71000001-1", None, None),
                        (2, "Proveedor Dos", "30-71000002-2", None, None)],
        "empleados": [(1, 35111222, "Carlos", "Gomez", "Administrador"), (2, 38444555, "Laura", "Diaz", "Operativo"),
                      (3, 40222333, "Martin", "Perez", "Operativo")],
        "productos": [(1, "Remera Alfa", None, D("150000.00"), 1, 1), (2, "Zapatilla Beta", None, D("100.05"), 2, 2),
                      (3, "Remera Gamma", None, D("2000.00"), 3, 1)],
        "producto_variante": [(1, 779000000001, 1, 1, 1), (2, 779000000002, 1, 2, 1), (3, 779000000003, 2, 3, 2),
                              (4, 779000000004, 3, 1, 2)],
        "inventario": [(1, 1, 153), (2, 1, 75), (1, 2, 59), (1, 3, 83), (2, 3, 51), (3, 4, 5)],
        "movimientos": [],
        "detalle_movimientos": [],
    }
    rows.update(override)
    return from_frames({k: src_inline_rows(spark, k, v) for k, v in rows.items()})


@pytest.fixture()
def seed(spark):
    return seed_frames(spark)
