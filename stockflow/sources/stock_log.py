"""Stock as a log: a base, deltas of changed cells, and manifests that make versions of them.

A version is a manifest, a small file that names one base folder and the delta folders
after it. ``append`` writes the changed cells of one batch as a delta, then a manifest
with it, then moves the pointer ``_CURRENT`` to the manifest in one step: what it writes
follows the batch. Readers take the newest value of each cell. ``compact`` writes the
newest values as a new base, so that readers have fewer folders; it changes no value.

A batch is published once: its number is in the manifest, and numbers rise. A crash
before the pointer moves leaves folders that no version names; the batch written again
replaces them. Old manifests and folders stay, so any version can be read *as of* its
batch; ``versions`` lists them with their times. There is one writer at a time (the
stream's query, or a job), as with any table that is replaced by a pointer.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import releasing
from stockflow.sources import files as FS

CELL = ["id_sucursal", "id_variante"]
SCHEMA = "id_sucursal long, id_variante long, cantidad_disponible int, version long"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = FS._hadoop_fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = FS._hadoop_fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _exists(spark: SparkSession, pattern: str) -> bool:
    fs, p = FS._hadoop_fs(spark, pattern)
    return bool(len(fs.globStatus(p) or []))


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The current version, None before the first; a log without its pointer is an error."""
    root = root.rstrip("/")
    at = FS.current_version(spark, root)
    if at is None:
        if _exists(spark, f"{root}/manifests/*.json"):
            raise RuntimeError(f"{root} has stock versions but no pointer to one; restore _CURRENT")
        return None
    return json.loads(_read_text(spark, at))


def _publish(spark: SparkSession, root: str, new: dict, name: str) -> None:
    path = f"{root}/manifests/{name}.json"
    _write_text(spark, path, json.dumps(new | {"time": time.time()}))
    FS.publish_pointer(spark, root, path)


def append(spark: SparkSession, root: str, changed: DataFrame, batch_id: int) -> bool:
    """Publish the changed cells (id_sucursal, id_variante, cantidad_disponible) of a batch.

    Returns False, and writes nothing, if the batch, or a later one, is in the log already."""
    root = root.rstrip("/")
    now = manifest(spark, root) or {"batch": -1, "base": None, "deltas": []}
    if batch_id <= now["batch"]:
        return False
    path = f"{root}/delta-{batch_id:012d}"
    rows = changed.select(*[F.col(c).cast("bigint") for c in CELL], F.col("cantidad_disponible").cast("int"),
                          F.lit(batch_id).cast("bigint").alias("version"))
    with releasing(spark):
        rows.write.mode("overwrite").parquet(path)
    _publish(spark, root, {"batch": batch_id, "base": now["base"], "deltas": [*now["deltas"], path]}, f"{batch_id:012d}")
    return True


def compact(spark: SparkSession, root: str) -> None:
    """Write the newest values as a base; the version keeps its batch and its values."""
    root = root.rstrip("/")
    now = manifest(spark, root)
    if now is None or not now["deltas"]:
        return
    path = f"{root}/base-{now['batch']:012d}"
    with releasing(spark):
        _rows(spark, now).write.mode("overwrite").parquet(path)
    _publish(spark, root, {"batch": now["batch"], "base": path, "deltas": []}, f"{now['batch']:012d}-compacted")


def _rows(spark: SparkSession, version: dict) -> DataFrame:
    """Newest row of each cell. A sum on the map side comes first, so a delta's rows are shuffled, not its history."""
    paths = [p for p in (version["base"], *version["deltas"]) if p]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    newest = F.max_by(F.struct("cantidad_disponible", "version"), "version")
    return spark.read.schema(SCHEMA).parquet(*paths).groupBy(*CELL).agg(newest.alias("x")).select(*CELL, "x.*")


def read_stock(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """The stock of the current version, or as it was after batch ``as_of`` (the last one up to that number)."""
    if as_of is None:
        version = manifest(spark, root)
    else:
        named = [v for v in versions(spark, root) if v["batch"] <= as_of]
        version = named[-1] if named else None
    if version is None:
        raise ValueError(f"{root} has no stock version" + ("" if as_of is None else f" as of batch {as_of}"))
    return _rows(spark, version).select(*CELL, "cantidad_disponible")


def versions(spark: SparkSession, root: str) -> list[dict]:
    """All published versions in the order of their batches, each with its time, base and deltas."""
    root = root.rstrip("/")
    now = manifest(spark, root)
    fs, p = FS._hadoop_fs(spark, f"{root}/manifests/*.json")
    out = [json.loads(_read_text(spark, str(f.getPath()))) for f in (fs.globStatus(p) or [])]
    # a manifest beyond the pointer belongs to a batch that wasn't published
    return sorted((v for v in out if now and v["batch"] <= now["batch"]), key=lambda v: (v["batch"], v["base"] or ""))
