"""What a query of several writes keeps on disk: its stored steps, not the shuffles of the steps that have ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockflow.plans import ledger_queries as LQ
from stockflow.session import kept
from stockflow.sources.testdata import load_tables

SF_SMALL = "/root/testdata/sf0.001"


def _shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.length())
            if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffle_bytes(spark)
    x = spark.range(20_000).withColumn("k", F.xxhash64("id") % 1_000)
    stored = kept(x.groupBy("k").agg(F.sum("id").alias("s")).repartition(3, "s"), "step")
    assert not _shuffle_bytes(spark).keys() - before.keys()
    assert stored.agg(F.sum("s")).first()[0] == sum(range(20_000))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_snapshot_numbers_its_lines_once_and_releases_its_steps(spark):
    """The lines' numbering and the inventory are stored; what the query returns reads them, and no shuffle is left of the steps."""
    t = load_tables(spark, SF_SMALL)
    before = _shuffle_bytes(spark)
    out = LQ.snapshot_compare(t)
    left = {k: n for k, n in _shuffle_bytes(spark).items() if k not in before}
    assert sum(left.values()) < 200_000     # counts of hot variants and the bounds of the ids; it was all of the steps' rows
    for name in ("detalle_movimientos", "inventario"):
        assert "Window" not in t[name]._jdf.queryExecution().optimizedPlan().toString()
    states = {r["etapa"]: r["n"] for r in out.groupBy("etapa").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(states) == {"antes", "durante", "despues"} and len(set(states.values())) == 1
