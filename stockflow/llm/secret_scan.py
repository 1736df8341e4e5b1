"""Operator 10, secret scans, DataFrame functions only.

Three fixed patterns give the base spans. Beyond them, maximal runs of 20 or
more characters of ``[A-Za-z0-9+/_-]`` are scored by two character Markov models
(bigrams with both ends): one of random strings, trained from the values that
the patterns mark, and one of ordinary identifiers, trained from the distinct
runs of 8 or more such characters that no pattern marks; both over all rows, or
over labelled samples that the caller gives. A run whose log-likelihood ratio is
at least ``MIN_LLR`` (prior odds of one secret in a million runs) becomes a span
of kind ``model`` unless it overlaps a base span.

Spans count code points, ends are exclusive. The patterns' matches are found once
a text; starts are running sums of gaps and matches within a text. The model has
a row for each pair of the fixed alphabet at most, so it is broadcast.

Defined cases: null text is empty and has no spans; rows that repeat id and text
are reported each; a null ``doc_id`` is reported as null; texts are scanned whole;
with no marked value or no ordinary run the model adds nothing; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import stored, table

ALPHABET = 64 + 2  # characters of a run, and its ends
RUN = "[A-Za-z0-9+/_-]"
LEAST_RUN = 20
LEAST_ORDINARY = 8
MIN_LLR = math.log(1e6)
ADD = 0.5

#: Kind -> pattern, group with the value, least length of the value.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "model": (RUN + "{%d,}" % LEAST_RUN, 0, LEAST_RUN),
}


def _found(kind: str):
    pattern, group, _ = PATTERNS[kind]
    p, text = F.lit(pattern), F.col("text")
    whole = F.regexp_extract_all(text, p, F.lit(0))
    return F.when(text.rlike(pattern), F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        (F.regexp_extract_all(text, p, F.lit(group)) if group else whole).alias("value"))).alias(kind)


def _matches(found: DataFrame) -> DataFrame:
    """doc_id, row, kind, start, end, value of every match that is long enough."""
    w = Window.partitionBy("doc_id", "row", "copy", "kind").orderBy("pos")
    rows = None
    for kind, (_, _, least) in PATTERNS.items():
        one = (found.filter(F.col(kind).isNotNull())
               .select("doc_id", "row", "copy", F.lit(kind).alias("kind"), F.posexplode(
                   F.arrays_zip(F.slice(F.col(kind)["gap"], 1, F.size(F.col(kind)["size"])).alias("gap"),
                                F.col(kind)["size"].alias("size"), F.col(kind)["value"].alias("value")))
                   .alias("pos", "m"))
               .select("doc_id", "row", "copy", "kind", "pos", "m.gap", "m.size", "m.value",
                       F.lit(least).alias("least")))
        rows = one if rows is None else rows.unionByName(one)
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    return (rows.withColumn("end", end).filter(F.length("value") >= F.col("least"))
            .select("doc_id", "row", "copy", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """(token, a, b): neighbouring characters of each token, with ^ and $ for its ends."""
    padded = tokens.withColumn("padded", F.concat(F.lit("^"), "token", F.lit("$")))
    return padded.select("token", "padded", F.explode(F.expr("sequence(1, length(padded) - 1)")).alias("i")).select(
        "token", F.expr("substr(padded, i, 1)").alias("a"), F.expr("substr(padded, i + 1, 1)").alias("b"))


def _in_run(value):
    return F.regexp_replace(value, "[^A-Za-z0-9+/_-]", "")


def llr_model(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(a, b, llr) from labelled samples of distinct tokens (token); no rows if either sample is empty."""
    both = _pairs(random).select("a", "b", F.lit(1).alias("r")).unionByName(
        _pairs(ordinary).select("a", "b", F.lit(0).alias("r")))
    pairs = stored(both.groupBy("a", "b").agg(F.sum("r").alias("n_r"), F.sum(1 - F.col("r")).alias("n_o")), "pairs")
    total = pairs.groupBy("a").agg(F.sum("n_r").alias("t_r"), F.sum("n_o").alias("t_o"))
    some = pairs.agg((F.least(F.sum("n_r"), F.sum("n_o")) > 0).alias("trained"))

    def logp(n, t):
        return F.log((F.coalesce(F.col(n), F.lit(0)) + ADD) / (F.coalesce(F.col(t), F.lit(0)) + ADD * ALPHABET))
    # every pair of the alphabet, so that an unseen pair has its smoothed ratio as well
    letters = F.expr("transform(concat(sequence(48, 57), sequence(65, 90), sequence(97, 122), array(43, 47, 95, 45)),"
                     " c -> char(c))")
    grid = some.filter("trained").select(
        F.explode(F.concat(F.array(F.lit("^")), letters)).alias("a")).select(
        "a", F.explode(F.concat(F.array(F.lit("$")), letters)).alias("b"))
    return (grid.join(F.broadcast(pairs), ["a", "b"], "left").join(F.broadcast(total), "a", "left")
            .select("a", "b", (logp("n_r", "t_r") - logp("n_o", "t_o")).alias("llr")))


def scan(docs: DataFrame, random: DataFrame | None = None, ordinary: DataFrame | None = None) -> DataFrame:
    """doc_id, row and spans (array of start, kind number, end, kind) for every row of
    ``docs`` (doc_id, text). ``random``, ``ordinary``: labelled tokens instead of the rows' own."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"),
                                F.monotonically_increasing_id().alias("copy"), *map(_found, PATTERNS)), "found")
    matches = stored(_matches(found), "matches")
    base = matches.filter("kind <> 'model'")
    if random is None:
        random = base.select(_in_run(F.col("value")).alias("token")).distinct()
    if ordinary is None:
        runs = texts.select(F.explode(F.regexp_extract_all(
            "text", F.lit(RUN + "{%d,}" % LEAST_ORDINARY), F.lit(0))).alias("token"))
        # one sum over both instead of an anti join, which would run on every occurrence of a run
        ordinary = (runs.withColumn("r", F.lit(0)).unionByName(random.withColumn("r", F.lit(1)))
                    .groupBy("token").agg(F.max("r").alias("r")).filter("r = 0").select("token"))
    model = stored(llr_model(random, ordinary), "model")
    runs = matches.filter("kind = 'model'")
    secret = (_pairs(runs.select(F.col("value").alias("token")).distinct()).join(F.broadcast(model), ["a", "b"])
              .groupBy("token").agg(F.sum("llr").alias("llr")).filter(F.col("llr") >= MIN_LLR).select("token"))
    added = runs.join(secret, runs["value"] == secret["token"]).drop("token")
    number = F.create_map(*[F.lit(x) for i, k in enumerate(PATTERNS) for x in (k, i)])
    spans = base.unionByName(added).groupBy("doc_id", "row", "copy").agg(F.array_sort(F.collect_list(F.struct(
        "start", number[F.col("kind")].alias("number"), "end", "kind"))).alias("spans"))
    clear = F.expr("filter(spans, s -> s.kind <> 'model' or not exists(spans,"
                   " t -> t.kind <> 'model' and t.start < s.end and s.start < t.end))")
    none = "array<struct<start:bigint,number:int,end:bigint,kind:string>>"
    return (found.select("doc_id", "row", "copy")
            .join(spans.withColumn("spans", clear).select("copy", "spans"), "copy", "left")
            .select("doc_id", "row", F.coalesce("spans", F.array().cast(none)).alias("spans")))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = {k: F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in PATTERNS}
    return rows.select(
        "doc_id", count["assign"], count["access"], count["hex"],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), count["model"])


QUERIES = {"op10_markov_secret_scan": (op10_markov_secret_scan, None)}
