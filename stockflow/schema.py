"""The 12 tables of the retail stock model: schemas and declared constraints.

Constraints are data, not engine objects: the quality jobs in
``stockflow.plans.quality`` read these lists and check them as Spark jobs.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
PERCENT = T.DecimalType(5, 2)
# Result types of sums, cast explicitly so Spark and SQL engines agree.
UNITS_SUM = T.LongType()
MONEY_SUM = T.DecimalType(38, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


ID = T.LongType()   # the test data keys are 64-bit

SCHEMAS: dict[str, T.StructType] = {
    "categorias": T.StructType([
        _f("id_categoria", ID, False), _f("nombre", T.StringType(), False),
        _f("descripcion", T.StringType())]),
    "marcas": T.StructType([
        _f("id_marca", ID, False), _f("nombre", T.StringType(), False)]),
    "proveedores": T.StructType([
        _f("id_proveedor", ID, False), _f("razon_social", T.StringType(), False),
        _f("cuit", T.StringType(), False), _f("telefono", T.StringType()),
        _f("email", T.StringType())]),
    "sucursales": T.StructType([
        _f("id_sucursal", ID, False), _f("nombre", T.StringType(), False),
        _f("direccion", T.StringType()), _f("ciudad", T.StringType())]),
    "empleados": T.StructType([
        _f("id_empleado", ID, False), _f("documento", T.StringType(), False),
        _f("nombre", T.StringType(), False), _f("apellido", T.StringType(), False),
        _f("perfil_acceso", T.StringType(), False)]),
    "productos": T.StructType([
        _f("id_producto", ID, False), _f("nombre", T.StringType(), False),
        _f("descripcion", T.StringType()), _f("precio_venta_actual", MONEY, False),
        _f("id_marca", ID, False), _f("id_categoria", ID, False)]),
    "talles": T.StructType([
        _f("id_talle", ID, False), _f("nomenclatura", T.StringType(), False)]),
    "colores": T.StructType([
        _f("id_color", ID, False), _f("nombre_color", T.StringType(), False)]),
    "producto_variante": T.StructType([
        _f("id_variante", ID, False), _f("codigo_barras", T.StringType(), False),
        _f("id_producto", ID, False), _f("id_talle", ID, False), _f("id_color", ID, False)]),
    "inventario": T.StructType([
        _f("id_sucursal", ID, False), _f("id_variante", ID, False),
        _f("cantidad_disponible", T.IntegerType(), False)]),
    "movimientos": T.StructType([
        _f("id_movimiento", ID, False), _f("fecha_hora", T.TimestampNTZType(), False),
        _f("tipo_movimiento", T.StringType(), False), _f("observaciones", T.StringType()),
        _f("id_sucursal_origen", ID), _f("id_sucursal_destino", ID),
        _f("id_empleado", ID, False), _f("id_proveedor", ID)]),
    "detalle_movimientos": T.StructType([
        _f("id_detalle", ID, False), _f("cantidad", T.IntegerType(), False),
        _f("precio_unitario", MONEY, False), _f("id_movimiento", ID, False),
        _f("id_variante", ID, False)]),
}

TABLE_NAMES = list(SCHEMAS)

# Load order that respects the foreign keys (parents first).
DEPENDENCY_ORDER = [
    "marcas", "categorias", "talles", "colores", "sucursales", "proveedores",
    "empleados", "productos", "producto_variante", "movimientos",
    "detalle_movimientos", "inventario",
]

# ---------------------------------------------------------------------------
# Fixed values of the model (they must equal the reference's for right results)
# ---------------------------------------------------------------------------
MOVEMENT_TYPES = ["Entrada", "Salida", "Traslado"]
ACCESS_PROFILES = ["Administrador", "Operativo", "Consulta"]
# Movement types that take stock out of the origin branch.
CONSUMING_TYPES = ["Salida", "Traslado"]
LOW_STOCK_DEFAULT = 35

PRIMARY_KEYS: dict[str, list[str]] = {
    "categorias": ["id_categoria"],
    "marcas": ["id_marca"],
    "proveedores": ["id_proveedor"],
    "sucursales": ["id_sucursal"],
    "empleados": ["id_empleado"],
    "productos": ["id_producto"],
    "talles": ["id_talle"],
    "colores": ["id_color"],
    "producto_variante": ["id_variante"],
    "inventario": ["id_sucursal", "id_variante"],
    "movimientos": ["id_movimiento"],
    "detalle_movimientos": ["id_detalle"],
}

# (table, column) pairs declared UNIQUE; NULLs never clash.
UNIQUE_KEYS: list[tuple[str, str]] = [
    ("categorias", "nombre"),
    ("marcas", "nombre"),
    ("proveedores", "cuit"),
    ("empleados", "documento"),
    ("talles", "nomenclatura"),
    ("colores", "nombre_color"),
    ("producto_variante", "codigo_barras"),
]

# (child table, child column, parent table, parent column, on delete)
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("productos", "id_marca", "marcas", "id_marca", "RESTRICT"),
    ("productos", "id_categoria", "categorias", "id_categoria", "RESTRICT"),
    ("producto_variante", "id_producto", "productos", "id_producto", "RESTRICT"),
    ("producto_variante", "id_talle", "talles", "id_talle", "RESTRICT"),
    ("producto_variante", "id_color", "colores", "id_color", "RESTRICT"),
    ("inventario", "id_sucursal", "sucursales", "id_sucursal", "RESTRICT"),
    ("inventario", "id_variante", "producto_variante", "id_variante", "CASCADE"),
    ("movimientos", "id_sucursal_origen", "sucursales", "id_sucursal", "RESTRICT"),
    ("movimientos", "id_sucursal_destino", "sucursales", "id_sucursal", "RESTRICT"),
    ("movimientos", "id_empleado", "empleados", "id_empleado", "RESTRICT"),
    ("movimientos", "id_proveedor", "proveedores", "id_proveedor", "RESTRICT"),
    ("detalle_movimientos", "id_movimiento", "movimientos", "id_movimiento", "CASCADE"),
    ("detalle_movimientos", "id_variante", "producto_variante", "id_variante", "RESTRICT"),
]

# VARCHAR(n) limits.
MAX_LENGTHS: list[tuple[str, str, int]] = [
    ("categorias", "nombre", 100),
    ("marcas", "nombre", 100),
    ("proveedores", "razon_social", 150),
    ("proveedores", "cuit", 20),
    ("proveedores", "telefono", 50),
    ("proveedores", "email", 100),
    ("sucursales", "nombre", 100),
    ("sucursales", "direccion", 200),
    ("sucursales", "ciudad", 100),
    ("empleados", "documento", 20),
    ("empleados", "nombre", 100),
    ("empleados", "apellido", 100),
    ("empleados", "perfil_acceso", 50),
    ("productos", "nombre", 150),
    ("talles", "nomenclatura", 20),
    ("colores", "nombre_color", 50),
    ("producto_variante", "codigo_barras", 50),
    ("movimientos", "tipo_movimiento", 20),
]

# Columns declared NOT NULL (besides primary keys).
NOT_NULL: list[tuple[str, str]] = [
    (t, f.name) for t, s in SCHEMAS.items() for f in s.fields if not f.nullable
]

# Domain CHECKs: (table, column, allowed values). NULL passes a CHECK.
DOMAINS: list[tuple[str, str, list[str]]] = [
    ("empleados", "perfil_acceso", ACCESS_PROFILES),
    ("movimientos", "tipo_movimiento", MOVEMENT_TYPES),
]

# Numeric CHECKs: (name, table, SQL predicate that must hold or be NULL).
NUMERIC_CHECKS: list[tuple[str, str, str]] = [
    ("chk_precio_positivo", "productos", "precio_venta_actual > 0"),
    ("chk_stock_positivo", "inventario", "cantidad_disponible >= 0"),
    ("chk_cantidad_movimiento", "detalle_movimientos", "cantidad > 0"),
    ("chk_precio_movimiento", "detalle_movimientos", "precio_unitario >= 0"),
]
