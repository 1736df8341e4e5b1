"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from stockflow.llm import collocations as C
from tests.llm.data import LOWER, empty, frame


def brute(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score from (lang, text) rows."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def _rows(seed: int, n: int):
    rng = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "a", "éa", "x" * 9, "x" * 9 + "y", "z" * 300, "z" * 299 + "q", "12345678",
             "1234567", "o'clock", "nul\x00", "nul"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(["new york city", "of the", "the the the", " ".join(rng.choices(words, k=3))]))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " - "]))
        out.append((rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return out + [("en", None), (None, ""), ("en", " \t "), ("fr", ".,;"), ("de", "alone"), ("en", out[0][1])]


def _got(spark, rows, least, top):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df.selectExpr("*", "doc_id AS phrase", "doc_id AS f", "1 AS words"),
                                                   least, top).collect())


def test_equals_brute_force(spark):
    rows = _rows(1, 60)
    got = _got(spark, rows, 5, 2000)
    assert got == brute(rows, 5, 2000) and len(got) > 50
    assert _got(spark, rows, 3, 4) == brute(rows, 3, 4)  # the report's first rows, and its ties


def test_no_rows(spark):
    assert C.collocations(empty(spark)).count() == 0
    assert C.collocations(frame(spark, [(1, None, None, None, None), (2, "one two", "en", "s", 1)])).count() == 0


def test_windows_of_a_long_text_count_like_the_whole():
    rng = random.Random(3)
    for sep in (" ", " , "):
        text = sep.join(rng.choice(["a", "Bb", "ccc", "w" * 50]) for _ in range(3000))
        for limit in (7, 64, 1000):
            for level, sizes in ((1, [1]), (2, [2]), (3, [3, 4])):
                got = Counter()
                every = np.full(1 << (C.SIEVE_BITS - 3), 255, np.uint8)
                for _, _, data, off, carried in C.blocks(pa.array([text]), limit):
                    words = C.Words(data, off)
                    for n, first, seen in C._count_block(level, words, np.zeros(1, np.int64), ["en"], carried, every):
                        assert n in sizes
                        for p, s in zip(words.phrases(first, n).to_pylist(), seen):
                            got[p] += int(s)
                want = Counter()
                for piece in text.lower().split(","):
                    w = piece.split()
                    for n in sizes:
                        want.update(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
                assert got == want


def test_a_text_without_spaces_is_one_word():
    blocks = list(C.blocks(pa.array(["q" * 5000 + " b"]), 64))
    words = [C.Words(data, off) for _, _, data, off, _ in blocks]
    assert sum(len(w.start) - b[4] for w, b in zip(words, blocks)) == 2


def test_words_are_told_apart_by_their_bytes():
    texts = ["a\x00", "a", "12345678", "123456789", "1234567890123456", "12345678901234567", "z" * 300, "z" * 299 + "q", "é", "e"]
    data = np.frombuffer(" ".join(texts + texts).encode(), np.uint8)
    number = C.Words(data, np.array([0, len(data)])).numbers()
    assert len(set(number)) == len(texts) and (number[:len(texts)] == number[len(texts):]).all()


def test_a_cut_chain_asks_for_its_parts(spark):
    # one first word holds most phrases, so its chain runs over many range partitions
    rows = [("en", ["the"], 5000)] + [("en", ["the", f"w{i:04d}"], 40 + i % 7) for i in range(3000)]
    rows += [("en", ["the", f"w{i:04d}", "x"], 35) for i in range(0, 3000, 3)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    parts, ext = C._stream(counts, "cut")
    f = {tuple(w): n for _, w, n in rows}
    got = {(tuple(r["words"]), r["k"]): r["f"] for r in parts.collect()}
    assert got == {(w, k): f[w[:k]] for w in f for k in range(1, len(w))}
    largest = {tuple(r["words"]): r["ext"] for r in ext.collect()}
    assert largest[("the",)] == 46 and largest[("the", "w0003")] == 35 and len(largest) == 1001


def test_products_past_64_bits(spark):
    counts = spark.createDataFrame([(9 * 10 ** 17, 9 * 10 ** 17 + 5, 9 * 10 ** 17 + 9)], "a long, l long, r long")
    score = C.cut_score()
    assert counts.select(score).first()[0] == 2000000 * 9 * 10 ** 17 // (2 * 9 * 10 ** 17 + 14)
