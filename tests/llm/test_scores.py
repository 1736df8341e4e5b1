"""Scores of language ID, secret scans and the toxicity lexicon against plain versions with dictionaries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockflow.llm import language_id, secret_scan, toxicity


def _strings(rng, letters, n):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def _plain_kneser_ney(texts_by_lang):
    """lang -> function(4 characters) giving the interpolated probability."""
    grams = {x: Counter(s[i - 3:i + 1] for t in ts for s in [f"   {t} "] for i in range(3, len(s))) for x, ts in texts_by_lang.items()}
    everything = {g[-1] for c in grams.values() for g in c}
    out = {}
    for x, top in grams.items():
        by = {4: top}
        for n in (3, 2, 1):
            by[n] = Counter(g[1:] for g in by[n + 1])
        parts = {}
        for n, c in by.items():
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            parts[n] = c, one / (one + 2 * two) if one and two else 0.5, total, kinds

        def prob(g, parts=parts):
            c, d, total, kinds = parts[len(g)]
            if len(g) == 1:
                lower = 1 / (len(everything) + 1)
            else:
                lower = prob(g[1:], parts)
            if not total[g[:-1]]:
                return lower
            return max(c[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * lower
        out[x] = prob
    return out


def test_kneser_ney_cross_entropy_equals_a_dictionary_version():
    rng = random.Random(3)
    learned = {"aa": _strings(rng, "abcdeé", 40), "bb": _strings(rng, "cdefgh", 25), "cc": _strings(rng, "xyz", 3)}
    is_letter = language_id.letters_table()
    counts = {}
    for x, ts in learned.items():
        sym, off, _ = language_id.symbols(ts, is_letter)
        counts[x] = np.unique(language_id.grams(sym, off)[0], return_counts=True)
    model = language_id.KneserNey(counts)
    asked = _strings(rng, "abcdefghxyzéq", 60) + ["a", "q"]
    got = model.entropies(asked, is_letter)[0]
    plain = _plain_kneser_ney(learned)
    for i, t in enumerate(asked):
        s = f"   {t} "
        for j, x in enumerate(model.langs):
            bits = [-math.log2(plain[x](s[k - 3:k + 1])) for k in range(3, len(s))]
            assert got[i, j] == pytest.approx(sum(bits) / len(bits), rel=1e-4), (t, x)


def test_model_spans_equal_a_plain_log_likelihood_ratio(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def noise():
        return "".join(rng.choice(letters) for _ in range(rng.randint(20, 40)))

    def name():
        return "_".join(rng.choice(["get", "user", "account", "balance", "report", "total"]) for _ in range(rng.randint(4, 7)))
    keys, names = sorted({noise() for _ in range(150)}), sorted({name() for _ in range(150)})
    texts = [" ".join(rng.choice([noise, name, lambda: "plain words", lambda: "token=" + noise()])() for _ in range(8)) for _ in range(30)]
    count = {}
    for kind, tokens in (("r", keys), ("o", names)):
        pairs, total = Counter(), Counter()
        for t in tokens:
            for a, b in zip("^" + t, t + "$"):
                pairs[a, b] += 1
                total[a] += 1
        count[kind] = pairs, total

    def logp(kind, a, b):
        pairs, total = count[kind]
        return math.log((pairs[a, b] + 0.5) / (total[a] + 33))
    expected, margins = {}, []
    for i, text in enumerate(texts):
        base = [m.span() for p, g, least in list(secret_scan.PATTERNS.values())[:3] for m in re.finditer(p, text) if len(m[g]) >= least]
        expected[i] = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            llr = sum(logp("r", a, b) - logp("o", a, b) for a, b in zip("^" + m[0], m[0] + "$"))
            margins.append(llr)
            if llr >= secret_scan.MIN_LLR and not any(s < m.end() and m.start() < e for s, e in base):
                expected[i].append(m.span())
    assert any(expected.values()) and min(margins) < secret_scan.MIN_LLR
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.scan(docs, *(spark.createDataFrame([(t,) for t in ts], "token string") for ts in (keys, names))).collect()
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "model"] for r in rows} == expected


def test_a_rich_lexicon_is_learned_whole(spark):
    rng = random.Random(9)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rude, fair = [word() for _ in range(900)], [word() for _ in range(300)]
    held = defaultdict(list)
    for w in rude:
        for k in rng.sample(range(120), 24):
            held[k].append(w)
    rows = [(" ".join(ws), 1) for ws in held.values()] + [(" ".join(rng.sample(fair, 40)), 0) for _ in range(600)]
    words, prefixes = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(w in set(words) or any(w.startswith(p) for p in prefixes) for w in rude)
    assert not any(w in set(words) or any(w.startswith(p) for p in prefixes) for w in fair)
