"""File sources and sinks: CSV and Parquet, versioned publishing, physical layout.

Updates never overwrite the folder being read: every load writes a new
version folder and then moves a small pointer, so readers always see a whole
version (the all-or-nothing transaction of the bulk load).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow import schema as S
from stockflow.functions import exprs as X
from stockflow.sources.testdata import Tables, from_frames

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
CATALOG_SCHEMA = T.StructType([
    T.StructField("nombre", T.StringType()), T.StructField("descripcion", T.StringType()),
    T.StructField("precio_venta_actual", S.MONEY), T.StructField("marca", T.StringType()),
    T.StructField("categoria", T.StringType())])


def _csv_reader(spark: SparkSession):
    return (spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
            .option("timestampNTZFormat", TS_FORMAT).option("mode", "FAILFAST"))


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a header CSV with known column types, mapping columns by *name*.

    Spark maps a given schema by position; the file's header order may differ
    from the table's, so the header is read first (one line) and the typed
    schema is laid out in the file's order, then columns are selected by name.
    """
    header = _csv_reader(spark).csv(path).columns
    by_name = {f.name: f for f in schema.fields}
    file_schema = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    df = _csv_reader(spark).schema(file_schema).csv(path)
    return df.select(*[F.col(f.name) for f in schema.fields])


def src_csv_tables(spark: SparkSession, root: str, names: Iterable[str] = S.TABLE_NAMES) -> Tables:
    """The 12 tables from ``root/<name>.csv`` (header CSV, empty field = NULL)."""
    root = root.rstrip("/")
    return from_frames({n: read_csv_by_name(spark, f"{root}/{n}.csv", S.SCHEMAS[n]) for n in names})


def src_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """The product catalogue CSV (brand and category given by name)."""
    return read_csv_by_name(spark, path, CATALOG_SCHEMA)


def src_inline_rows(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """Literal rows for one table. Values given as integers for text columns
    (a size ``40``, a document, a barcode) are coerced to text first."""
    schema = S.SCHEMAS[table]
    fixed = []
    for r in rows:
        fixed.append(tuple(str(v) if (v is not None and isinstance(f.dataType, T.StringType)
                                      and not isinstance(v, str)) else v
                           for v, f in zip(r, schema.fields, strict=True)))
    return spark.createDataFrame(fixed, schema)


def sink_csv_tables(t: Mapping[str, DataFrame], root: str, names: Iterable[str] | None = None) -> None:
    """One header CSV folder per table; money keeps two decimals, times as yyyy-MM-dd HH:mm:ss."""
    root = root.rstrip("/")
    for n in (names or [k for k in S.TABLE_NAMES if k in t]):
        df = t[n]
        out = df.select(*[X.timestamp_text(c).alias(c) if isinstance(df.schema[c].dataType, T.TimestampNTZType)
                          else F.col(c) for c in df.columns])
        (out.write.mode("overwrite").option("header", True).option("nullValue", "")
         .option("emptyValue", "\"\"").csv(f"{root}/{n}.csv"))


def load_full_refresh(df: DataFrame, path: str) -> None:
    """Replace a table's contents (TRUNCATE + load)."""
    df.write.mode("overwrite").parquet(path)


def new_version_dir(root: str) -> str:
    return f"{root.rstrip('/')}/v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a stored table, as its file system tells it; no job runs."""
    fs, p = _hadoop_fs(spark, path)
    return fs.getContentSummary(p).getLength()


def publish_pointer(spark: SparkSession, root: str, version_dir: str) -> None:
    """Point ``root/_CURRENT`` at a finished version: a small file is written beside
    it and renamed over it in one step, so there is a pointer at every moment."""
    fs, tmp = _hadoop_fs(spark, f"{root.rstrip('/')}/_CURRENT.tmp-{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    out.write(bytearray(version_dir.encode()))
    out.close()
    _, cur = _hadoop_fs(spark, f"{root.rstrip('/')}/_CURRENT")
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(tmp, cur, how)   # raises when it can't


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, cur = _hadoop_fs(spark, f"{root.rstrip('/')}/_CURRENT")
    if not fs.exists(cur):
        return None
    # Read with the file system API: data readers skip files whose name starts with '_'.
    stream = fs.open(cur)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text.strip()


def load_in_dependency_order(spark: SparkSession, t: Mapping[str, DataFrame], root: str,
                             checks=None) -> str:
    """Write all tables (parents first) into a new version folder, run the checks,
    and only then publish the version. A failing check leaves the published
    version untouched (all or nothing). Returns the version folder."""
    vdir = new_version_dir(root)
    for n in S.DEPENDENCY_ORDER:
        if n in t:
            t[n].write.mode("errorifexists").parquet(f"{vdir}/{n}")
    if checks is not None:
        stored = read_version(spark, vdir, [n for n in S.DEPENDENCY_ORDER if n in t])
        problems = checks(stored)
        if problems:
            raise ValueError(f"load rejected, version {vdir} not published: {problems}")
    publish_pointer(spark, root, vdir)
    return vdir


def read_version(spark: SparkSession, vdir: str, names: Iterable[str]) -> Tables:
    return from_frames({n: spark.read.parquet(f"{vdir}/{n}") for n in names})


def ingest_reject_unknown(catalog: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Names in the catalogue that the reference lists do not know (``tipo``, ``nombre``, rows).
    An empty result means the catalogue may be loaded."""
    mb = (catalog.select(F.col("marca").alias("nombre")).where(F.col("nombre").isNotNull())
          .join(brands.select("nombre"), "nombre", "left_anti").groupBy("nombre").count()
          .select(F.lit("marca").alias("tipo"), "nombre", F.col("count").cast("bigint").alias("filas")))
    mc = (catalog.select(F.col("categoria").alias("nombre")).where(F.col("nombre").isNotNull())
          .join(categories.select("nombre"), "nombre", "left_anti").groupBy("nombre").count()
          .select(F.lit("categoria").alias("tipo"), "nombre", F.col("count").cast("bigint").alias("filas")))
    return mb.unionByName(mc)


def write_layout(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str],
                 mode: str = "errorifexists") -> None:
    """Physical layout in place of indexes: directory partitions for the
    selective filters (type, year) and rows sorted by id inside each file so
    Parquet min/max statistics prune row groups for id look-ups.

    Range partitioning on (partition columns, sort columns) rather than hash
    partitioning on the partition columns: a (type, year) holding a third of
    the rows is cut into many contiguous id ranges, one task and file each,
    instead of landing in a single task."""
    (df.repartitionByRange(*[F.col(c) for c in [*partition_by, *sort_by]])
       .sortWithinPartitions(*partition_by, *sort_by)
       .write.mode(mode).partitionBy(*partition_by).parquet(path))


#: Access paths: the columns that look-ups filter on, per table.
ACCESS_PATHS = {
    "detalle_movimientos": ["id_movimiento", "id_variante"],
    "movimientos": ["id_empleado", "id_sucursal_origen"],
    "inventario": ["cantidad_disponible", "id_sucursal"],
    "producto_variante": ["id_producto", "id_talle", "id_color"],
    "productos": ["id_marca", "id_categoria"],
}
_CLUSTER_BITS = 6


def interleaved_key(df: DataFrame, columns: list[str], bits: int = _CLUSTER_BITS) -> F.Column:
    """A number that puts rows near each other which are near in every one of the whole-number ``columns``.

    Each column becomes its place among 2 ** bits ranges of about equally many rows (approximate
    percentiles, summed on the map side; the driver gets their 2 ** bits - 1 bounds a column), and the
    places' bits are interleaved, highest first. NULLs are in the first range."""
    n = 1 << bits
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(*[F.percentile_approx(c, at, n * 100).alias(c) for c in columns]).first()
    places = []
    for c in columns:
        cuts = sorted(set(bounds[c] or []))
        below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>"), F.col(c).__gt__))
        # a value that many rows have leaves fewer ranges: these are spread over all places
        places.append(F.coalesce(F.floor(below * n / (len(cuts) + 1)), F.lit(0)).cast("int"))
    key = F.lit(0).cast("bigint")
    for b in reversed(range(bits)):
        for p in places:
            key = key * 2 + F.shiftright(p, b).bitwiseAND(F.lit(1))
    return key


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, tie: list[str] | None = None) -> None:
    """Rows clustered on several columns at once, in about ``files`` files: a filter on any of the columns reads a
    part of the files only, by Parquet's smallest and largest values. Ranges of (key, columns, ``tie``) spread a
    value that many rows have over files."""
    x = df.withColumn("_sf_z", interleaved_key(df, columns))
    by = ["_sf_z", *columns, *(tie or [])]
    x.repartitionByRange(files, *by).sortWithinPartitions(*by).drop("_sf_z").write.parquet(path)


def movements_layout(mov: DataFrame) -> DataFrame:
    """Movements with the ``anio`` partition column (type x year directories)."""
    return mov.withColumn("anio", F.year("fecha_hora"))


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str, sort_key: str | None = None) -> None:
    """A bucketed catalog table, so joins on ``key`` between tables bucketed the
    same way need no shuffle (header x detail on ``id_movimiento``)."""
    w = df.write.mode("overwrite").bucketBy(buckets, key)
    if sort_key:
        w = w.sortBy(sort_key)
    w.format("parquet").saveAsTable(table)
