"""The corpus pipeline: documents in, encoded training texts out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it again, so a
lost executor costs one stage's work at most.

1. language: rows whose text has no letter, or fits no learned language, go
   (Kneser-Ney models; learned from the stage's own labelled rows)
2. exact: of texts that are equal but for white space, the smallest doc_id stays
3. near: of each class of near copies (5-word shingles, Jaccard similarity of 0.8
   or more, transitively) the smallest doc_id stays
4. decontaminate: rows that hold a benchmark item go
5. encode: SentencePiece pieces of each text, and whether they decode to it

Defined cases: null and empty texts go in stage 1; empty tables pass as empty; a
null doc_id is never a near copy; extra columns of documents are kept up to
stage 4. The pieces come from a BPE model and the classes from connected
components, which SQL can't express, so there is no ORACLE_SQL; the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm.common import stored, table
from stockflow.llm.decontaminate import drop_contaminated
from stockflow.llm.exact_dedup import drop_copies
from stockflow.llm.language_id import keep_known_languages, train_documents
from stockflow.llm.minhash_dedup import drop_near_copies
from stockflow.llm.piece_codec import encode_and_decode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs, train_documents(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, pct=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate),
          ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
