"""The queries of this package and their SQL, for the entry module to register."""

from __future__ import annotations

from stockflow.llm import (collocations, context_tree, decontaminate, exact_dedup, hard_negatives, html_extract, language_id,
                           line_dedup, minhash_dedup, piece_codec, secret_scan, toxicity, vantage_search)

MODULES = [context_tree, decontaminate, exact_dedup, html_extract, line_dedup, language_id, minhash_dedup, piece_codec, secret_scan,
           toxicity, collocations, hard_negatives, vantage_search]


def queries():
    return {k: fn for m in MODULES for k, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
