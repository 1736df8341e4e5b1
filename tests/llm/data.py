"""Small tables for the text operators' tests."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = ("digest", "row", "node", "chunk", "keep_id", "score", "n", "label", "kind", "path", "v", "__id", "__digest",
            "__score")


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}x" for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared lines, nulls, empties and one long text."""
    rng = random.Random(seed)
    base = prose(rng, 80)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = f"Edit{i}{rng.random():.5f}"
            text = " ".join(w)
        elif kind == 2:
            text = "A line that many documents share.\n" + prose(rng, 20) + "\n  a LINE that many documents share. "
        else:
            text = prose(rng, rng.randint(1, 50)) + "\n" * (i % 2) + prose(rng, 5)
        rows.append((i * 7 + 3, text, "en", "s", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \t\n", "en", "s", 3),
             (903, prose(rng, 30000), "en", "s", 1), (904, "one", "en", "s", 3), (905, "one  two", "en", "s", 8),
             (906, "one two", "en", "s", 7)]
    return rows


def frame(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        df = df.selectExpr("*", *[f"concat('x', doc_id) AS {c}" for c in CLASHING])
    return df


def empty(spark):
    return frame(spark, [])


def plain(df):
    """Without the clashing columns: for operators that add columns and refuse clashes."""
    return df.select("doc_id", "text", "lang", "source", "n_chars")
