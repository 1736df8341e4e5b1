"""Operator 4, exact dedup: a sharded cuckoo-filter index of live digests.

The digest of a text is the SHA-256 of its normal form (each run of white space
as one space, null as empty). Digests are counted per salt
first, so a group of copies of any size reaches its shard as at most ``SALTS``
rows. A shard holds a cuckoo filter (two buckets of four 16-bit tags a key) and
its stored keys, sorted. The filter decides: an insertion or a probe that misses
it is a new text and is looked up nowhere; only hits are searched for in the
stored keys, as different digests may share tags. Hits that are there are
verified by content: their texts alone are read again and grouped in buckets by
hash of the digest and the normal text itself; should one digest stand for
several texts, each is a group of its own. Deletion takes one tag out again. When no
place is found within ``MAX_KICKS`` moves, the filter is made anew at twice the
size from the stored keys.

Defined cases: null text is the empty text; empty tables give empty results; a
null ``doc_id`` counts in ``group_size`` and stays only if its whole group has
no id (``keep_id`` null); rows that repeat id and text all count and are marked
alike. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import WS_CLASS, free_names, stored, table

SLOTS = 4
MAX_KICKS = 500
SALTS = 16
#: Digests that a shard is made for.
SHARD_KEYS = 250_000
KEY_SCHEMA = "shard int, digest string, keep_id long, group_size long, filter binary"
KEYS_ARROW = pa.schema([("shard", pa.int32()), ("digest", pa.string()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64()), ("filter", pa.binary())])
_MAX = np.iinfo(np.int64).max


class CuckooFilter:
    """Tags of 64-bit keys; partial-key cuckoo hashing over a power of two of buckets."""

    def __init__(self, buckets: int = 64):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def from_bytes(cls, blob: bytes) -> "CuckooFilter":
        out = cls(1)
        out.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: int) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        tag = (key & 0xFFFF) or 1
        one = (key >> 16) & mask
        return tag, one, self._other(one, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (len(self.table) - 1)

    def __contains__(self, key: int) -> bool:
        tag, one, two = self._places(key)
        return bool((self.table[one] == tag).any() or (self.table[two] == tag).any())

    def insert(self, key: int) -> bool:
        """False: no place within MAX_KICKS moves; the table is as it was."""
        tag, one, two = self._places(key)
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = tag
                return True
        moved, b = [], one
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + tag) % SLOTS
            moved.append((b, slot, int(self.table[b, slot])))
            self.table[b, slot], tag = tag, int(self.table[b, slot])
            b = self._other(b, tag)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = tag
                return True
        for b, slot, old in reversed(moved):
            self.table[b, slot] = old
        return False

    def delete(self, key: int) -> bool:
        tag, one, two = self._places(key)
        for b in (one, two):
            at = np.flatnonzero(self.table[b] == tag)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False


def filter_of(keys, buckets: int = 64) -> CuckooFilter:
    """A filter that has all ``keys``, doubled until they fit."""
    while True:
        made = CuckooFilter(buckets)
        if all(map(made.insert, keys)):
            return made
        buckets *= 2


def _key(digest: str) -> int:
    return int(digest[:16], 16)


def _filter_in(keys: pd.DataFrame) -> CuckooFilter:
    blob = next((b for b in keys["filter"] if isinstance(b, bytes)), None)
    return filter_of(map(_key, keys["digest"])) if blob is None else CuckooFilter.from_bytes(blob)


def _search(keys: pd.DataFrame, digests) -> np.ndarray:
    """Places of ``digests`` in ``keys``, which are sorted by digest; -1 if absent."""
    have, asked = keys["digest"].to_numpy(object), np.asarray(digests, object)
    if not len(have) or not len(asked):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return np.where(have[at] == asked, at, -1)


def _smaller(a, b):
    """The smaller ids of two nullable columns; an id goes before none."""
    least = np.minimum(a.to_numpy(np.int64, na_value=_MAX), b.to_numpy(np.int64, na_value=_MAX))
    out = pd.array(least, "Int64")
    out[a.isna().to_numpy() & b.isna().to_numpy()] = pd.NA
    return out


def merge_shard(keys: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """Stored keys of one shard (filter in its first row) and changes (digest,
    doc_id, n, op) to its new keys: deletions first, then insertions."""
    shard = int((keys if len(keys) else changes)["shard"].iloc[0])
    known = _filter_in(keys)
    keys = keys[["digest", "keep_id", "group_size"]].sort_values("digest", ignore_index=True)
    gone = [d for d in changes["digest"][changes["op"] == "-"] if _key(d) in known]
    at = _search(keys, gone)
    for place in at[at >= 0]:
        known.delete(_key(keys["digest"][place]))
    keys = keys.drop(index=at[at >= 0])

    new = changes[changes["op"] == "+"].rename(columns={"doc_id": "keep_id", "n": "group_size"})
    new = new[["digest", "keep_id", "group_size"]].reset_index(drop=True)

    def enter(digest, others):
        nonlocal known
        if not known.insert(_key(digest)):  # from the stored keys and those entered so far
            known = filter_of(map(_key, [*keys["digest"], *others, digest]), 2 * len(known.table))

    first, hits = [], []
    for i, digest in enumerate(new["digest"]):
        if _key(digest) in known:
            hits.append(i)
        else:
            enter(digest, new["digest"][first])
            first.append(i)
    keys = pd.concat([keys, new.iloc[first]]).sort_values("digest", ignore_index=True)
    if hits:
        asked = new.iloc[hits].groupby("digest").agg({"keep_id": "min", "group_size": "sum"}).reset_index()
        at = _search(keys, asked["digest"])
        there, at = asked[at >= 0], at[at >= 0]
        false = asked[_search(keys, asked["digest"]) < 0]
        keys.loc[at, "keep_id"] = _smaller(keys["keep_id"].iloc[at], there["keep_id"])
        keys.loc[at, "group_size"] = keys["group_size"].to_numpy()[at] + there["group_size"].to_numpy()
        for i, digest in enumerate(false["digest"]):
            enter(digest, false["digest"][:i])
        keys = pd.concat([keys, false]).sort_values("digest", ignore_index=True)
    keys = keys.assign(shard=shard, filter=None)
    if len(keys):
        keys.at[0, "filter"] = known.to_bytes()
    return keys[["shard", "digest", "keep_id", "group_size", "filter"]]


def ask_shard(keys: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``asked`` (digest) that the filter of their shard has."""
    known = _filter_in(keys)
    return asked.loc[[_key(d) in known for d in asked["digest"]], ["digest"]]


def _in_arrow(function, schema: pa.Schema):
    """``function`` of two pandas frames for ``applyInArrow``: ids stay whole numbers beside nulls."""
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        frames = [t.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for t in (left, right)]
        return pa.Table.from_pandas(function(*frames), schema, preserve_index=False)
    return apply


class CuckooIndex:
    """Live digests in shards; ``keys`` is the stored table that the filters lead to.

    ``n_shards`` is kept for the index's life, so it is to fit the data to come:
    about ``SHARD_KEYS`` digests a shard.
    """

    def __init__(self, spark: SparkSession, n_shards: int | None = None, keys: DataFrame | None = None):
        self.spark = spark
        self.n_shards = n_shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = spark.createDataFrame([], KEY_SCHEMA) if keys is None else keys

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.n_shards)).cast("int")

    def update(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> "CuckooIndex":
        """A new index: first without the digests of ``deletes`` (digest), then
        with the rows of ``inserts`` (digest, doc_id)."""
        parts = []
        if inserts is not None:
            parts.append(inserts.select("digest", F.col("doc_id").cast("long"))
                         .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
                         .groupBy("digest", "salt").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
                         .select("digest", "doc_id", "n", F.lit("+").alias("op")))
        if deletes is not None:
            parts.append(deletes.select("digest").distinct()
                         .select("digest", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"),
                                 F.lit("-").alias("op")))
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        changes = changes.withColumn("shard", self._shard())
        merged = (self.keys.groupBy("shard").cogroup(changes.groupBy("shard"))
                  .applyInArrow(_in_arrow(merge_shard, KEYS_ARROW), KEY_SCHEMA))
        return CuckooIndex(self.spark, self.n_shards, stored(merged, "cuckoo"))

    def probe(self, batch: DataFrame) -> DataFrame:
        """``batch`` (digest, ...) with keep_id and group_size of live digests, null for others.

        The filters are asked once for each distinct digest; only their hits are
        joined with the stored keys.
        """
        asked = batch.select("digest").distinct().withColumn("shard", self._shard())
        hits = (self.keys.groupBy("shard").cogroup(asked.groupBy("shard"))
                .applyInArrow(_in_arrow(ask_shard, pa.schema([("digest", pa.string())])), "digest string"))
        live = hits.join(self.keys.select("digest", "keep_id", "group_size"), "digest")
        return batch.join(live, "digest", "left")


def normal(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " ")


def digest_col(text):
    return F.sha2(normal(text), 256)


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


class _Decided:
    """What the index and the content say of the rows of ``docs`` (doc_id, text).

    ``rows`` has (doc_id, h1, h2, digest) of every row; h1 and h2 are hashes of the
    text as it is, so (doc_id, h1, h2) leads back to the row. ``copies`` has the
    same once for each such place whose text the index holds more than once, with
    n (rows of the place), keep_id and group_size, and ``stays``: the first place
    of its group.
    """

    def __init__(self, docs: DataFrame, n_shards: int | None, digest):
        spark = docs.sparkSession
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *self.hashes(), "text")
        self.rows = stored(self.texts.select("doc_id", "h1", "h2", digest(F.col("text")).alias("digest")), "digests")
        if n_shards is None:
            n_shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.rows.count() // SHARD_KEYS))
        keys = CuckooIndex(spark, n_shards).update(inserts=self.rows).keys
        more = keys.filter(F.col("group_size") > 1).select("digest")
        hits = stored(self.rows.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int"))
                      .join(_salted(more), ["digest", "salt"])
                      # not by digest, so that the join may split a hot one
                      .groupBy("doc_id", "h1", "h2").agg(F.min("digest").alias("digest"), F.count("*").alias("n"))
                      .withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")), "hits")
        # only the hits' texts are read again; copies are counted before the shuffle
        content = (self.texts.join(_as_place(hits, "digest").hint("merge"), _same_place(), "inner")
                   .select("doc_id", "h1", "h2", "p_digest", normal(F.col("text")).alias("content"))
                   .withColumnRenamed("p_digest", "digest"))
        groups = stored(content.groupBy("digest", "content").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("first"),
            F.count("*").alias("group_size")), "content")
        several = stored(groups.groupBy("digest").count().filter("count > 1").select("digest"), "several")
        out = ["first", "group_size"]
        copies = hits.join(_salted(groups.join(several, "digest", "left_anti").select("digest", *out)),
                           ["digest", "salt"]).select(*hits.columns, *out)
        if not several.isEmpty():  # one digest of several texts: by the texts themselves
            apart = (content.join(several, "digest").join(groups, ["digest", "content"])
                     .groupBy("doc_id", "h1", "h2", "digest").agg(
                         F.count("*").alias("n"), F.min("first").alias("first"), F.min("group_size").alias("group_size")))
            copies = copies.unionByName(apart.withColumn("salt", F.lit(0)))
        self.copies = stored(copies.select(
            "doc_id", "h1", "h2", "n", F.col("first.doc_id").alias("keep_id"), "group_size",
            F.struct("doc_id", "h1", "h2").eqNullSafe(F.struct("first.doc_id", "first.h1", "first.h2")).alias("stays")),
            "copies")

    @staticmethod
    def hashes(names=("h1", "h2")):
        text = F.coalesce(F.col("text"), F.lit(""))
        return F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])


def _as_place(places: DataFrame, *more: str) -> DataFrame:
    """doc_id, h1, h2 and further columns under names that no input has."""
    return places.select(*[F.col(c).alias("p_" + c) for c in ("doc_id", "h1", "h2", *more)])


def _same_place():
    return (F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("h1") == F.col("p_h1"))
            & (F.col("h2") == F.col("p_h2")))


def exact_dedup(docs: DataFrame, n_shards: int | None = None, digest=digest_col) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    decided = _Decided(docs, n_shards, digest)
    keep_id = F.when(F.col("p_n").isNull(), F.col("doc_id")).otherwise(F.col("p_keep_id"))
    return (decided.rows.join(_as_place(decided.copies, "n", "keep_id", "group_size"), _same_place(), "left")
            .select("doc_id", keep_id.alias("keep_id"),
                    F.coalesce("p_group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256")))


def drop_copies(docs: DataFrame, digest=digest_col) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    decided = _Decided(docs, None, digest)
    h1, h2, p_id, p_h1, p_h2, p_n, p_stays = free_names(docs, "__h1", "__h2", "__p_id", "__p_h1", "__p_h2", "__n", "__stays")
    marked = docs.withColumns(dict(zip((h1, h2), decided.hashes((h1, h2)))))
    places = decided.copies.select(F.col("doc_id").alias(p_id), F.col("h1").alias(p_h1), F.col("h2").alias(p_h2),
                                   F.col("n").alias(p_n), F.col("stays").alias(p_stays))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col(p_id)) & (F.col(h1) == F.col(p_h1)) & (F.col(h2) == F.col(p_h2)))
    mine = [F.col(f"`{c}`") for c in docs.columns]
    repeated = places.filter(F.col(p_stays) & (F.col(p_n) > 1))
    once = marked.join(places.filter(~F.col(p_stays) | (F.col(p_n) > 1)).hint("merge"), same, "left_anti").select(*mine)
    if repeated.isEmpty():
        return once
    # of rows that repeat both id and text, one
    again = marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", h1, h2])
    return once.unionByName(again.select(*mine))


def op4_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h)
"""

QUERIES = {"op4_cuckoo_exact_dedup": (op4_cuckoo_exact_dedup, SQL)}
