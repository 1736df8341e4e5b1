"""Operator 6, line dedup, DataFrame functions only.

Line hashes live in levelled sorted runs of (key hash, number of documents,
largest doc_id): partitions of one table, all bucketed by key into the same
number of buckets and sorted inside each. A batch of lines is merge-anti-joined
with the runs, bucket by bucket and without a shuffle of the runs. What the anti
join lets through are first sightings, which make the batch's own sorted run, so
the sighting runs never share a key; the rest become an update run. When a level
has ``fanout`` runs they are merged into one sorted run of the next level.
A key is counted again only where updates name it: all other counts are those of
its one sighting. Batches are disjoint in documents, so counts add up.

Defined cases: null or empty text is one empty line; lines of fewer than
``min_chars`` code points after stripping always stay; a null ``doc_id`` takes
no part (its lines stay and count for nothing); rows that repeat a doc_id count
as one document; a very long text is split into lines like any other; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import WS_CHARS, lower_az, shared_path, table

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 4
BATCHES = 2 * FANOUT    # so that levels fill up and are merged
RUN_SCHEMA = "key binary, n_docs long, max_doc long"


class LineRuns:
    """Runs as partitions of a bucketed table; the driver holds their numbers only.

    There are as many buckets as shuffle partitions, so a batch's keys, shuffled
    once to be counted, meet the runs' buckets where they are.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[int]] = []   # first sightings, no key twice
        self.updates: list[list[int]] = []  # counts of keys sighted before
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = 0
        self._append(spark.createDataFrame([], RUN_SCHEMA + ", run int"), "errorifexists")

    def _append(self, rows: DataFrame, mode: str = "append"):
        w = rows.write.mode(mode).format("parquet").partitionBy("run").bucketBy(self.buckets, "key").sortBy("key")
        if mode != "append":
            w = w.option("path", shared_path(self.spark, "runs"))
        w.saveAsTable(self.name)

    def _number(self, levels: list[list[int]], level: int) -> int:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(self.made)
        self.made += 1
        return self.made - 1

    def _read(self, numbers) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("run").isin(list(numbers))).drop("run")

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (key, doc_id); returns its new keys."""
        keys = batch.select("key", "doc_id").distinct().groupBy("key").agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        older = [run for level in self.levels for run in level]
        new = self._number(self.levels, 0)
        if not older:
            self._append(keys.withColumn("run", F.lit(new)))
            return self._read([new])
        # the anti join keeps the rows it lets through apart from the others, in one pass over the batch
        known = self._read(older).select("key", F.lit(self._number(self.updates, 0)).alias("run"))
        self._append(keys.join(known.hint("merge"), "key", "left")
                     .select("key", "n_docs", "max_doc", F.coalesce("run", F.lit(new)).alias("run")))
        rows = self._read([new])
        self.compact()
        return rows

    def compact(self):
        """Merge each level that has ``fanout`` runs into one run of the next level."""
        for levels in (self.levels, self.updates):
            for level in range(len(levels)):
                if len(levels[level]) >= self.fanout:
                    runs, levels[level] = levels[level], []
                    merged = self._summed(self._read(runs))
                    self._append(merged.withColumn("run", F.lit(self._number(levels, level + 1))))

    @staticmethod
    def _summed(runs: DataFrame) -> DataFrame:
        return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(key, max_doc) of the keys that at least ``min_docs`` documents hold."""
        more = self._summed(self._read(run for level in self.updates for run in level)).select(
            "key", F.col("n_docs").alias("more_docs"), F.col("max_doc").alias("later_doc"))
        return (self._read(run for level in self.levels for run in level)
                .join(more.hint("merge"), "key", "left")
                .filter(F.col("n_docs") + F.coalesce("more_docs", F.lit(0)) >= min_docs)
                .select("key", F.greatest("max_doc", "later_doc").alias("max_doc")))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"),
                       F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               batches: int = BATCHES) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    key = lower_az(F.btrim("line", F.lit(WS_CHARS)))
    path = shared_path(spark, "lines")
    (_lines(docs).filter(F.col("doc_id").isNotNull()).withColumn("line", key)
     .filter(F.length("line") >= min_chars)
     .select(F.unhex(F.sha2("line", 256)).alias("key"), "doc_id", "row", "pos",
             F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
     .write.partitionBy("batch").parquet(path))
    entries = spark.read.schema("key binary, doc_id long, row long, pos int, batch int").parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(entries.filter(F.col("batch") == b).select("key", "doc_id"))
    dropped = (entries.join(runs.frequent(min_docs), "key").filter(F.col("doc_id") < F.col("max_doc"))
               .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("drop")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # kept lines: the pieces between one dropped place and the next
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(
        "array_join(flatten(transform(sequence(0, size(drop)), j -> slice(lines,"
        " if(j = 0, 1, drop[j - 1] + 2),"
        " if(j = size(drop), size(lines), drop[j]) - if(j = 0, 0, drop[j - 1] + 1)))), '\n')"))
    return (docs.withColumn("row", F.xxhash64("doc_id", "text"))
            .join(dropped, ["doc_id", "row"], "left")
            .withColumn("lines", lines)
            .select("doc_id", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")))


def op6_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, f.max_doc IS NOT NULL AND k.doc_id < f.max_doc AS dropped
  FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op6_levelled_line_dedup": (op6_levelled_line_dedup, SQL)}
