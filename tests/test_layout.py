"""Clustered tables: a filter on any access path reads a part of the files."""

from __future__ import annotations

import glob
import random

import pyarrow.parquet as pq

from stockflow.sources import files as FS


def _ranges(path: str, column: str):
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            at = [group.column(i).path_in_schema for i in range(group.num_columns)].index(column)
            yield group.column(at).statistics.min, group.column(at).statistics.max


def test_a_filter_on_each_path_reads_part_of_the_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(1000), rng.choice([rng.randrange(500), 77, 77]), rng.randrange(300), i) for i in range(20000)]
    rows += [(None, 3, 4, -1), (5, None, None, -2)]
    df = spark.createDataFrame(rows, "a long, b long, c long, id long").repartition(4)
    path = str(tmp_path / "z")
    FS.write_clustered(df, path, ["a", "b", "c"], files=64, tie=["id"])
    back = spark.read.parquet(path)
    assert sorted(back.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    for column, values in (("a", (3, 500, 998)), ("b", (3, 400)), ("c", (10, 150, 290))):
        held = list(_ranges(path, column))
        assert len(held) > 40
        for v in values:
            assert sum(lo <= v <= hi for lo, hi in held) <= 0.5 * len(held), (column, v)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(path + "/*.parquet")]
    assert max(sizes) < 4 * len(rows) / 64          # the value that half the rows have is spread


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "a long, b long")
    FS.write_clustered(empty, str(tmp_path / "e"), ["a", "b"], files=4)
    assert spark.read.schema(empty.schema).parquet(str(tmp_path / "e")).count() == 0
