"""Map the driver's TPC-H-style test tables onto the 12-table retail model.

Rules (one per table):

* marcas       part: id = digits of ``p_brand``, nombre = ``p_brand``
* categorias   part: id by the fixed list below, nombre = ``p_type``
* talles       part: ``p_size`` as id and as text
* colores      part: first word of ``p_name``, id = alphabetical rank
* productos    part grouped by (brand, type): id = id_marca*10 + id_categoria,
               nombre = brand + ' ' + type, price = max(``p_retailprice``)
* producto_variante  part: id = ``p_partkey``, barcode = 779 + 9-digit id
* sucursales   nation + region: id = ``n_nationkey``+1, ciudad = ``r_name``
* proveedores  supplier: cuit = '30-' + (71000001+key) + '-' + key % 10
* empleados    customer: documento = 20000000+key, names around '#'
* movimientos  orders + customer: status F/O/P -> Salida/Entrada/Traslado,
               origin = customer's nation+1, transfer destination derived from
               the order key (never the origin), supplier of a receipt = the
               smallest ``l_suppkey`` of the order
* detalle_movimientos  lineitem: variant = ``l_partkey``, whole quantity,
               price = ``l_extendedprice``; ids follow (date, order, line, ...)
* inventario   derived: opening (worst dip + buffer 2) + net of the ledger, for
               every cell that has movements (no dense branch x variant grid)

The same mapping is given as a SQL ``WITH`` prefix (``MAPPING_SQL``) so an
independent SQL engine can check every query on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions import exprs as X
from stockflow.operators.ids import id_assign
from stockflow.plans.dims import DIM_VARIANTE_COLS
from stockflow.schema import MONEY
from stockflow.session import kept

# ---------------------------------------------------------------------------
# Fixed values of the mapping
# ---------------------------------------------------------------------------
CATEGORY_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
STATUS_TO_TYPE = {"F": "Salida", "O": "Entrada", "P": "Traslado"}
PROFILE_BY_MOD3 = {0: "Administrador", 1: "Operativo", 2: "Consulta"}
N_BRANCHES = 25          # nations in the test data
OPENING_BUFFER = 2
ID_BUCKET_ORDERS = 1 << 14   # order keys per id-assignment bucket inside a day
BYTES_A_TASK = 4 << 20       # stored lines that a task of the inventory or the numbering gets, whatever the history's size
# Report parameters on the test data
AS_OF = "2001-08-01"      # last order date
REPORT3_BRANCH = "NATION_1"
REPORT3_YEAR = 2000

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


class Tables(Mapping):
    """Lazy dict of the 12 model tables (plus ``detalle_lineas``: lines without ids, and
    ``cabeceras``: headers without supplier and remarks).

    Nothing is read until a table is asked for; each entry is a DataFrame plan,
    never collected data.
    """

    def __init__(self, builders: dict[str, Callable[[], DataFrame]],
                 raw: Callable[[str], DataFrame] | None = None,
                 line_tasks: Callable[[], tuple[int, bool]] | None = None):
        self._builders = builders
        self._line_tasks = line_tasks
        self._cache: dict[str, DataFrame] = {}
        self._raw = raw

    def raw(self, name: str) -> DataFrame:
        """A source table as given (only for tables built from the test data)."""
        if self._raw is None:
            raise KeyError(name)
        return self._raw(name)

    def line_tasks(self) -> int | None:
        """Tasks for a pass over the lines by their stored size, where that is more than Spark would take."""
        tasks, large = self._line_tasks() if self._line_tasks else (0, False)
        return tasks if large else None

    def keep(self, *names: str) -> None:
        """Store tables in the shared checkpoint folder; what reads them from now on doesn't derive them again."""
        for name in names:
            self._cache[name] = kept(self[name], name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def from_frames(frames: dict[str, DataFrame]) -> Tables:
    """Wrap already-built model tables (e.g. read from CSV or Parquet)."""
    return Tables({k: (lambda v=v: v) for k, v in frames.items()})


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    sf_dir = sf_dir.rstrip("/")

    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    t: dict[str, Callable[[], DataFrame]] = {}
    tables = Tables(t, raw, lambda: line_tasks())

    brand_id = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    cat_id = _case("p_type", CATEGORY_IDS).cast("bigint")
    colour = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))

    t["marcas"] = lambda: raw("part").select(brand_id.alias("id_marca"), F.col("p_brand").alias("nombre")).distinct()
    t["categorias"] = lambda: (raw("part").select(cat_id.alias("id_categoria"), F.col("p_type").alias("nombre"))
                               .distinct().withColumn("descripcion", F.lit(None).cast("string")))
    t["talles"] = lambda: raw("part").select(F.col("p_size").cast("bigint").alias("id_talle"),
                                             F.col("p_size").cast("string").alias("nomenclatura")).distinct()
    # Colour ids: rank of the distinct names (a handful of rows after the distinct).
    t["colores"] = lambda: (raw("part").select(colour.alias("nombre_color")).distinct()
                            .withColumn("id_color", F.dense_rank().over(_w_order("nombre_color")).cast("bigint"))
                            .select("id_color", "nombre_color"))
    t["productos"] = lambda: (raw("part")
                              .groupBy(brand_id.alias("id_marca"), cat_id.alias("id_categoria"), "p_brand", "p_type")
                              .agg(F.max("p_retailprice").alias("_p"))
                              .select((F.col("id_marca") * 10 + F.col("id_categoria")).alias("id_producto"),
                                      F.concat_ws(" ", "p_brand", "p_type").alias("nombre"),
                                      F.lit(None).cast("string").alias("descripcion"),
                                      F.col("_p").cast(MONEY).alias("precio_venta_actual"),
                                      "id_marca", "id_categoria"))
    t["producto_variante"] = lambda: (raw("part")
                                      .select(F.col("p_partkey").alias("id_variante"),
                                              X.barcode("p_partkey").alias("codigo_barras"),
                                              (brand_id * 10 + cat_id).alias("id_producto"),
                                              F.col("p_size").cast("bigint").alias("id_talle"),
                                              colour.alias("nombre_color"))
                                      .join(tables["colores"], "nombre_color", "left")
                                      .select("id_variante", "codigo_barras", "id_producto", "id_talle", "id_color"))
    # Conformed variant dimension straight from part (one scan + the colour ids).
    t["dim_variante"] = lambda: (raw("part")
                                 .select(F.col("p_partkey").alias("id_variante"),
                                         X.barcode("p_partkey").alias("codigo_barras"),
                                         (brand_id * 10 + cat_id).alias("id_producto"),
                                         F.concat_ws(" ", "p_brand", "p_type").alias("producto"),
                                         brand_id.alias("id_marca"), F.col("p_brand").alias("marca"),
                                         cat_id.alias("id_categoria"),
                                         F.col("p_size").cast("bigint").alias("id_talle"),
                                         F.col("p_size").cast("string").alias("talle"),
                                         colour.alias("color"))
                                 .join(tables["colores"].withColumnRenamed("nombre_color", "color"), "color", "inner")
                                 .select(*DIM_VARIANTE_COLS))
    t["sucursales"] = lambda: (raw("nation").join(raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
                               .select((F.col("n_nationkey") + 1).cast("bigint").alias("id_sucursal"),
                                       F.col("n_name").alias("nombre"),
                                       F.lit(None).cast("string").alias("direccion"),
                                       F.col("r_name").alias("ciudad")))
    t["proveedores"] = lambda: raw("supplier").select(
        F.col("s_suppkey").alias("id_proveedor"), F.col("s_name").alias("razon_social"),
        F.concat(F.lit("30-"), (F.col("s_suppkey") + 71000001).cast("string"), F.lit("-"),
                 (F.col("s_suppkey") % 10).cast("string")).alias("cuit"),
        F.lit(None).cast("string").alias("telefono"), F.lit(None).cast("string").alias("email"))
    t["empleados"] = lambda: raw("customer").select(
        F.col("c_custkey").alias("id_empleado"),
        (F.col("c_custkey") + 20000000).cast("string").alias("documento"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("nombre"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("apellido"),
        _case(F.col("c_custkey") % 3, PROFILE_BY_MOD3).alias("perfil_acceso"))

    origin = (F.col("c_nationkey") + 1).cast("bigint")
    header = {
        "id_movimiento": F.col("o_orderkey"),
        "fecha_hora": F.col("o_orderdate"),
        "tipo_movimiento": _case("o_orderstatus", STATUS_TO_TYPE),
        "id_sucursal_origen": origin,
        "id_sucursal_destino": F.when(F.col("o_orderstatus") == "P", (
            (origin + F.col("o_orderkey") % (N_BRANCHES - 1)) % N_BRANCHES + 1).cast("bigint")),
        "id_empleado": F.col("o_custkey"),
    }

    def orders_of_customers() -> DataFrame:
        o = raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        c = raw("customer").select("c_custkey", "c_nationkey")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "inner")

    def movimientos() -> DataFrame:
        li, orders = lines_raw(), orders_of_customers()
        tasks, large = line_tasks()
        if large:       # both sides, or Spark may deal the rows again by its own number
            li, orders = li.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
        first_supplier = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("_sup"))
        m = orders.join(first_supplier, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        columns = header | {"observaciones": F.lit(None).cast("string"),
                            "id_proveedor": F.when(F.col("o_orderstatus") == "O", F.col("_sup"))}
        return m.select(*[columns[c].alias(c) for c in (
            "id_movimiento", "fecha_hora", "tipo_movimiento", "observaciones", "id_sucursal_origen",
            "id_sucursal_destino", "id_empleado", "id_proveedor")])

    t["movimientos"] = movimientos
    # The same rows without the columns that cost a pass over the lines (one supplier per order at most).
    t["cabeceras"] = lambda: orders_of_customers().select(*[c.alias(n) for n, c in header.items()])

    def lines_raw() -> DataFrame:
        return raw("lineitem")

    def line_tasks() -> tuple[int, bool]:
        """Tasks for a pass over the lines, by their stored size, and whether that is more than Spark would take."""
        from stockflow.sources.files import stored_bytes
        usual = spark.sparkContext.defaultParallelism
        tasks = max(usual, -(-stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // BYTES_A_TASK))
        return tasks, tasks > usual

    t["detalle_lineas"] = lambda: lines_raw().select(
        F.col("l_quantity").cast("int").alias("cantidad"),
        F.col("l_extendedprice").cast(MONEY).alias("precio_unitario"),
        F.col("l_orderkey").alias("id_movimiento"),
        F.col("l_partkey").alias("id_variante"))

    def detalle_ids() -> DataFrame:
        o = raw("orders").select("o_orderkey", "o_orderdate")
        tasks, large = line_tasks()
        li = lines_raw()
        if large:
            li = li.repartition(tasks, "l_orderkey")
        li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        order = [F.col(c).asc_nulls_first() for c in LINE_ORDER]
        # Buckets: (order date, order-key range) is monotone in the line order
        # (date first, then order key), and a busy day splits into many buckets.
        li = (li.withColumn("_sf_day", F.coalesce(F.to_date("o_orderdate"), F.lit("0001-01-01").cast("date")))
                .withColumn("_sf_okr", F.floor(F.col("l_orderkey") / F.lit(ID_BUCKET_ORDERS))))
        li = id_assign(li, order, id_col="id_detalle", bucket=["_sf_day", "_sf_okr"], tasks=tasks if large else None)
        return li.select("id_detalle",
                         F.col("l_quantity").cast("int").alias("cantidad"),
                         F.col("l_extendedprice").cast(MONEY).alias("precio_unitario"),
                         F.col("l_orderkey").alias("id_movimiento"),
                         F.col("l_partkey").alias("id_variante"))

    t["detalle_movimientos"] = detalle_ids

    def inventario() -> DataFrame:
        from stockflow.plans.ledger import final_stock
        # a mapping must not run jobs, so its dips are cut by the day and its tasks by the stored size of the lines
        tasks, large = line_tasks()
        det = tables["detalle_lineas"]
        if large:       # the join's tasks too
            det = det.repartition(tasks, "id_movimiento")
        return final_stock(tables["cabeceras"], det, buffer=OPENING_BUFFER, chunk_lines=None, tasks=tasks)

    t["inventario"] = inventario
    return tables


# Line order on the test data: (orderkey, linenumber) is not unique, so every
# column takes part; full rows are distinct.
LINE_ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def lines(t: Mapping[str, DataFrame]) -> DataFrame:
    """Detail lines for queries that do not need line ids."""
    return t["detalle_lineas"] if "detalle_lineas" in t else t["detalle_movimientos"]


def headers(t: Mapping[str, DataFrame]) -> DataFrame:
    """Movement headers for queries that do not need the supplier or the remarks."""
    return t["cabeceras"] if "cabeceras" in t else t["movimientos"]


def _case(col, mapping: dict):
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr


def _w_order(col: str):
    from pyspark.sql import Window
    return Window.orderBy(col)


# ---------------------------------------------------------------------------
# The same mapping in SQL (DuckDB dialect), used as the WITH prefix of every
# oracle query.
# ---------------------------------------------------------------------------
def _sql_case(expr: str, mapping: dict, quote_values: bool = True) -> str:
    parts = []
    for k, v in mapping.items():
        kk = f"'{k}'" if isinstance(k, str) else str(k)
        vv = f"'{v}'" if isinstance(v, str) and quote_values else str(v)
        parts.append(f"WHEN {expr} = {kk} THEN {vv}")
    return "CASE " + " ".join(parts) + " END"


_BRAND_ID = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)"
_CAT_ID = f"CAST({_sql_case('p_type', CATEGORY_IDS)} AS BIGINT)"
_LINE_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in LINE_ORDER)


def legs_sql(name: str, lines: str, headers: str) -> str:
    """CTE ``name``: the one or two legs (branch, signed units) that each line of ``lines`` puts on the ledger."""
    return f"""{name} AS (
  SELECT * EXCLUDE (pata), pata.sede AS id_sucursal, pata.leg AS leg, pata.unidades AS delta
  FROM (
    SELECT lin.* EXCLUDE (cantidad, precio_unitario), cab.fecha_hora, unnest(list_filter([
             {{'sede': cab.id_sucursal_origen, 'leg': 0,
               'unidades': lin.cantidad * (CASE cab.tipo_movimiento WHEN 'Entrada' THEN 1 ELSE -1 END)}},
             {{'sede': cab.id_sucursal_destino, 'leg': 1, 'unidades': lin.cantidad}}],
           lambda x: x.leg = 0 OR cab.tipo_movimiento = 'Traslado')) AS pata
    FROM {lines} lin JOIN {headers} cab USING (id_movimiento)))"""


MAPPING_SQL = f"""
WITH
marcas AS (
  SELECT DISTINCT {_BRAND_ID} AS id_marca, p_brand AS nombre FROM part),
categorias AS (
  SELECT DISTINCT {_CAT_ID} AS id_categoria, p_type AS nombre, CAST(NULL AS VARCHAR) AS descripcion FROM part),
talles AS (
  SELECT DISTINCT CAST(p_size AS BIGINT) AS id_talle, CAST(p_size AS VARCHAR) AS nomenclatura FROM part),
colores AS (
  SELECT CAST(dense_rank() OVER (ORDER BY nombre_color) AS BIGINT) AS id_color, nombre_color
  FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS nombre_color FROM part) c0),
productos AS (
  SELECT {_BRAND_ID} * 10 + {_CAT_ID} AS id_producto, p_brand || ' ' || p_type AS nombre,
         CAST(NULL AS VARCHAR) AS descripcion, CAST(max(p_retailprice) AS DECIMAL(12,2)) AS precio_venta_actual,
         {_BRAND_ID} AS id_marca, {_CAT_ID} AS id_categoria
  FROM part GROUP BY p_brand, p_type),
producto_variante AS (
  SELECT p_partkey AS id_variante,
         '779' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 9 THEN CAST(p_partkey AS VARCHAR)
                       ELSE lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS codigo_barras,
         {_BRAND_ID} * 10 + {_CAT_ID} AS id_producto, CAST(p_size AS BIGINT) AS id_talle, col.id_color
  FROM part LEFT JOIN colores col ON split_part(p_name, ' ', 1) = col.nombre_color),
sucursales AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id_sucursal, n_name AS nombre, CAST(NULL AS VARCHAR) AS direccion,
         r_name AS ciudad
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
proveedores AS (
  SELECT s_suppkey AS id_proveedor, s_name AS razon_social,
         '30-' || CAST(s_suppkey + 71000001 AS VARCHAR) || '-' || CAST(s_suppkey % 10 AS VARCHAR) AS cuit,
         CAST(NULL AS VARCHAR) AS telefono, CAST(NULL AS VARCHAR) AS email
  FROM supplier),
empleados AS (
  SELECT c_custkey AS id_empleado, CAST(c_custkey + 20000000 AS VARCHAR) AS documento,
         split_part(c_name, '#', 1) AS nombre, split_part(c_name, '#', 2) AS apellido,
         {_sql_case('c_custkey % 3', PROFILE_BY_MOD3)} AS perfil_acceso
  FROM customer),
movimientos AS (
  SELECT o_orderkey AS id_movimiento, o_orderdate AS fecha_hora,
         {_sql_case('o_orderstatus', STATUS_TO_TYPE)} AS tipo_movimiento,
         CAST(NULL AS VARCHAR) AS observaciones,
         CAST(c_nationkey + 1 AS BIGINT) AS id_sucursal_origen,
         CASE WHEN o_orderstatus = 'P'
              THEN CAST((c_nationkey + 1 + o_orderkey % {N_BRANCHES - 1}) % {N_BRANCHES} + 1 AS BIGINT) END
           AS id_sucursal_destino,
         o_custkey AS id_empleado,
         CASE WHEN o_orderstatus = 'O' THEN fs.sup END AS id_proveedor
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey AS fs_key, min(l_suppkey) AS sup FROM lineitem GROUP BY l_orderkey) fs
    ON o_orderkey = fs.fs_key),
detalle_lineas AS (
  SELECT CAST(l_quantity AS INTEGER) AS cantidad, CAST(l_extendedprice AS DECIMAL(12,2)) AS precio_unitario,
         l_orderkey AS id_movimiento, l_partkey AS id_variante
  FROM lineitem),
detalle_movimientos AS (
  SELECT CAST(row_number() OVER (ORDER BY {_LINE_ORDER_SQL}) AS BIGINT) AS id_detalle,
         CAST(l_quantity AS INTEGER) AS cantidad, CAST(l_extendedprice AS DECIMAL(12,2)) AS precio_unitario,
         l_orderkey AS id_movimiento, l_partkey AS id_variante
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
{legs_sql("mov_deltas", "detalle_lineas", "movimientos")},
mov_cell AS (
  SELECT id_sucursal, id_variante, fecha_hora, id_movimiento, sum(delta) AS d
  FROM mov_deltas WHERE id_sucursal IS NOT NULL GROUP BY id_sucursal, id_variante, fecha_hora, id_movimiento),
mov_cell_bal AS (
  SELECT *, sum(d) OVER (PARTITION BY id_sucursal, id_variante ORDER BY fecha_hora, id_movimiento
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS saldo
  FROM mov_cell),
inventario AS (
  SELECT id_sucursal, id_variante,
         CAST(-least(min(saldo), 0) + {OPENING_BUFFER} + sum(d) AS INTEGER) AS cantidad_disponible
  FROM mov_cell_bal GROUP BY id_sucursal, id_variante)
"""


def with_mapping(sql_body: str, recursive: bool = False) -> str:
    """Prefix a query over the 12 model tables with the mapping ``WITH`` clause.

    ``sql_body`` may itself start with ``WITH``; its CTEs are appended.
    ``recursive`` turns the clause into ``WITH RECURSIVE``.
    """
    body = sql_body.strip()
    prefix = MAPPING_SQL.strip()
    if recursive:
        prefix = "WITH RECURSIVE" + prefix[4:]
    if body[:4].upper() == "WITH":
        return prefix + ",\n" + body[4:].lstrip()
    return prefix + "\n" + body
