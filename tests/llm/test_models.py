"""Context-tree scores, language ID, toxicity and secret scans."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from stockflow.llm import context_tree as CT
from stockflow.llm import language_id as LI
from stockflow.llm import toxicity as TX
from stockflow.llm.secret_scan import op10_markov_secret_scan, scan
from tests.llm.data import corpus, empty, frame, plain, words


# -- context trees ----------------------------------------------------------------

def _ctw_brute(train: list[bytes], text: bytes) -> float:
    """log10 probability by the definition, over dictionaries."""
    counts: dict = defaultdict(lambda: [0, 0])

    def steps(t):
        t = b"\n" * CT.DEPTH + t
        for i in range(CT.DEPTH, len(t)):
            for b in range(8):
                yield t[i - CT.DEPTH:i][::-1], (1 << b) | (t[i] >> (8 - b)), t[i] >> (7 - b) & 1
    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(CT.DEPTH + 1):
                counts[ctx[:d], node][bit] += 1
    deeper: dict = defaultdict(list)
    for ctx, node in counts:
        if ctx:
            deeper[ctx[:-1], node].append((ctx, node))

    def kt(n0, n1):
        return (math.lgamma(n0 + .5) + math.lgamma(n1 + .5) - math.lgamma(n0 + n1 + 1)) - math.log(math.pi)
    cache: dict = {}

    def weighted(key):
        if key not in cache:
            e = kt(*counts[key])
            if len(key[0]) == CT.DEPTH:
                cache[key] = e, 1.0
            else:
                below = sum(weighted(k)[0] for k in deeper[key])
                cache[key] = np.logaddexp(e, below) - math.log(2), 1 / (1 + math.exp(min(700, below - e)))
        return cache[key]

    def predict(ctx, node, d):
        key = (ctx[:d], node)
        if key not in counts:
            return None
        n0, n1 = counts[key]
        est = (n1 + .5) / (n0 + n1 + 1)
        below = predict(ctx, node, d + 1) if d < CT.DEPTH else None
        own = weighted(key)[1]
        return est if below is None else own * est + (1 - own) * below
    total = 0.0
    for ctx, node, bit in steps(text):
        p = predict(ctx, node, 0)
        p = 0.5 if p is None else p
        total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree_scores(spark):
    rows = corpus(n=25)[:28] + [(950, "ein ß und É", "en", "s", 3), (None, "no id", "en", "s", 3)]
    got = {r["doc_id"]: r for r in CT.score(frame(spark, rows), buckets=3).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows if r[0] is not None} | {None: False}
    tokens = {r[0]: words(r[1]) for r in rows}
    assert 0 < sum(held.values()) < len(held)
    counts = Counter()
    for i, w in tokens.items():
        if not held[i]:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    train = [(" ".join(w) + "\n").encode() for i, w in tokens.items() if not held[i]]
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), rel_tol=1e-9)
    for i in list(tokens)[:4] + [950]:
        want = _ctw_brute(train, (" ".join(tokens[i]) + "\n").encode())
        assert math.isclose(got[i]["score"], want, rel_tol=1e-4), (i, got[i]["score"], want)


def test_context_tree_edges(spark):
    assert CT.score(empty(spark)).count() == 0
    alone = CT.score(frame(spark, [(5, None, None, None, None), (6, "", "en", "s", 0)])).collect()
    assert {(r["n_tokens"], r["n_known"] <= 1) for r in alone} == {(1, True)}
    held_only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = CT.score(frame(spark, [(held_only, "ab", "en", "s", 2)])).first()
    assert r["train_tokens"] == 0 and math.isclose(r["score"], 3 * 8 * math.log10(0.5), rel_tol=1e-6)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (CT.unpack_sorted(CT.pack_sorted(keys)) == keys).all()
        assert (CT.unpack(CT.pack(keys)) == keys).all()


# -- language ---------------------------------------------------------------------

_LANGS = {"aa": ["banana", "kabana", "nabaka"], "bb": ["stretch", "school", "thrush"], "cc": ["ééàù", "àéùù", "ùùéà"]}


def _speech(rng, lang, n):
    return " ".join(rng.choice(_LANGS[lang]) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(4)
    rows = [(i, _speech(rng, "aabbcc"[2 * (i % 3):2 * (i % 3) + 2], rng.randint(5, 40)), "aabbcc"[2 * (i % 3):2 * (i % 3) + 2], "s", 1)
            for i in range(240)]
    rows += [(900, None, "aa", "s", 0), (901, "12 34 !", "aa", "s", 0), (902, "", None, "s", 0), (903, "banana " * 20000, None, "s", 0),
             (904, "qqq zzz jjj www " * 30, None, "s", 0), (None, "banana kabana", "aa", "s", 0), (905, "b", "aa", "s", 0)]
    docs = plain(frame(spark, rows))
    model = LI.train_documents(docs)
    got = {r["doc_id"]: r for r in LI.classify(docs, model).collect()}
    for r in rows[:240]:
        assert got[r[0]]["lang_pred"] == r[2] and not got[r[0]]["rejected"] and 0 < got[r[0]]["score"] <= 1
    for i in (900, 901, 902):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[903]["lang_pred"] == "aa" and not got[903]["rejected"] and got[None]["lang_pred"] == "aa"
    assert got[904]["rejected"]
    # with their columns, and with clashing ones
    kept = LI.keep_known_languages(frame(spark, rows), model)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {900, 901, 902, 904}
    none = LI.train(docs.filter("false").select("text", "lang"))
    assert {r["lang_pred"] for r in LI.classify(docs, none).collect()} == {"und"}
    assert LI.classify(plain(empty(spark)), model).count() == 0


def test_kneser_ney_sums_to_one():
    is_letter = LI.letters_table()
    sym, off, _ = LI.symbols(["abab cab", "bca abc"], is_letter)
    keys, _ = LI.grams(sym, off)
    keys, n = np.unique(keys, return_counts=True)
    model = LI.KneserNey({"x": (keys, n)})
    alphabet = np.unique(sym)
    for context in ("   ", "aba", " ca", "zzz", "bza"):
        c = np.uint64(sum(ord(x) << 16 * (3 - k) for k, x in enumerate(context)))
        p = np.exp2(model.log2_probs(c | alphabet)).sum() + 2.0 ** float(model.log2_probs(np.array([c | np.uint64(0x1234)]))[0, 0])
        assert math.isclose(p, 1, rel_tol=1e-5), context


# -- toxicity -----------------------------------------------------------------------

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_distance():
    rng = random.Random(8)
    lexicon = ["moron", "idiot", "worthless", "worthy", "scum"]
    auto = TX.LexiconAutomaton(lexicon, ["lowei"])
    pool = ["".join(rng.choice("morniditwhlesyu0") for _ in range(rng.randint(3, 11))) for _ in range(300)]
    for w in lexicon:
        for _ in range(150):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x) + 1)
                x[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "s", "1"])
            pool.append("".join(x))
    for w in pool:
        near = any(_distance(w, t) <= (2 if len(t) >= 8 else 1) for t in lexicon if len(t) >= 5)
        want = 0 if w in lexicon else 1 if near else None
        assert auto.match(w) == want, w
    assert auto.match("loweistadt") == 2 and auto.match("scam") is None


def test_quotation_and_features():
    auto = TX.LexiconAutomaton(["idiot"], [])
    assert TX.features("you are an idiot", auto, {})[0] > 0 and TX.features("you are an idiot", auto, {})[4] > 0
    assert TX.features("the word “idiot” is old", auto, {})[3] > 0 and TX.features("the word “idiot” is old", auto, {})[0] == 0
    assert TX.features("she said idiot", auto, {})[3] > 0
    assert TX.features("an idi0t!", auto, {})[1] > 0
    assert TX.features("", auto, {}) == [0.0] * TX.FEATURES


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = " ".join(rng.choice("tree house river cloud stone".split()) for _ in range(30))
        if toxic:
            text += " you " + rng.choice(["grimblor", "grimblor", "snarkel"])
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "grimblor", "en", "s", 1),
             (902, "what a grimbior you are", "en", "s", 1), (903, "river " * 30000, "en", "s", 1)]
    labels += [(900, None), (None, 1), (0, 0)]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = TX.train(TX.labelled_sample(docs, lab))
    assert {"grimblor", "snarkel"} <= set(model.words)
    got = {r["doc_id"]: r for r in TX.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i in range(400):
        assert (got[i]["score"] >= 0.7) == (i % 5 == 0) == bool(got[i]["predicted"]), i
    assert got[900]["score"] == got[901]["score"] < 0.2 and got[903]["predicted"] == 0
    none = TX.train(TX.labelled_sample(docs, lab.filter("false")))
    assert {r["score"] for r in TX.score(docs, none).collect()} == {0.0}
    assert TX.score(empty(spark), model).count() == 0


# -- secrets ------------------------------------------------------------------------

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base(text):
    text = text or ""
    s = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(s)


def test_secret_scan(spark, tmp_path):
    rng = random.Random(6)
    hexa = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    mixed = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(20)]
    rows = [(i, f"Das É password = {m} and\npassword = token = abcdefghijkl Api_Key:'{h}' AKIA{h[:14].upper()} tail{h}", "en", "s", 1)
            for i, (h, m) in enumerate(zip(hexa, mixed * 2))]
    rows += [(100 + i, " ".join(rng.choice("internationalisation characteristically ordinary_identifier_name some_function "
                                           "understanding".split()) for _ in range(40)), "en", "s", 1) for i in range(40)]
    key = "Zq9Lx7Wm2Kv8Tn4Rb6Yc3Hd5Jf1Gs0"
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, f"see {key} here", "en", "s", 1),
             (903, "internationalisationcharacteristically " * 3000, "en", "s", 1), rows[0], (None, f"token={key}", "en", "s", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_markov_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        base = _base(text[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), r
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        if r["doc_id"] == 902:
            assert r["spans"] == f"model:4:{4 + len(key)}"
        elif r["doc_id"] is not None and r["doc_id"] >= 100:
            assert r["spans"] == said, r
    assert scan(empty(spark)).count() == 0
