"""Exact dedup, line dedup and near-dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd

from pyspark.sql import functions as F

from stockflow.llm import exact_dedup as exact_dedup_module
from stockflow.llm.components import components
from stockflow.llm.exact_dedup import CuckooFilter, CuckooIndex, drop_copies, exact_dedup, filter_of, merge_shard, normal
from stockflow.llm.line_dedup import LineRuns, line_dedup
from stockflow.llm.minhash_dedup import drop_near_copies, near_classes
from tests.llm.data import LOWER, corpus, empty, frame, words


def _normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_cuckoo_filter_inserts_deletes_and_overflows():
    rng = random.Random(5)
    keys = [rng.getrandbits(64) for _ in range(2000)]
    f = filter_of(keys, 64)
    assert all(k in f for k in keys) and len(f.table) >= 512
    for k in keys[:1000]:
        assert f.delete(k)
    assert all(k in f for k in keys[1000:])
    assert sum(k in f for k in keys[:1000]) < 50          # false hits only
    small = CuckooFilter(2)
    before, full = None, False
    for k in keys:
        before = small.table.copy()
        if not small.insert(k):
            full = True
            break
    assert full and (small.table == before).all()         # a failed insertion changes nothing
    again = CuckooFilter.from_bytes(small.to_bytes())
    assert (again.table == small.table).all()


def test_hits_are_verified_against_stored_keys():
    # the same first 64 bits: same tags and buckets, different digests
    one, two = "ab" * 8 + "0" * 48, "ab" * 8 + "1" * 48
    keys = pd.DataFrame({"shard": pd.Series([], dtype="int32"), "digest": [], "keep_id": pd.array([], "Int64"),
                         "group_size": [], "filter": []})
    changes = pd.DataFrame({"shard": 0, "digest": [one, two, one], "doc_id": pd.array([5, 4, 3], "Int64"),
                            "n": [1, 1, 2], "op": "+"})
    out = merge_shard(keys, changes)
    assert out[["digest", "keep_id", "group_size"]].values.tolist() == [[one, 3, 3], [two, 4, 1]]


def test_exact_dedup(spark):
    rows = corpus() + [(903, corpus()[0][1], "en", "s", 1), (None, "alone", "en", "s", 5), (None, None, "en", "s", 5)]
    got = exact_dedup(frame(spark, rows), 5).collect()
    group = defaultdict(list)
    for r in rows:
        group[_normal(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        ids = [i for i in group[_normal(r[1])] if i is not None]
        keep = min(ids) if ids else None
        want[r[0], keep, len(group[_normal(r[1])]), r[0] == keep,
             hashlib.sha256(_normal(r[1]).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup(empty(spark)).count() == 0


def test_index_updates_and_dropping(spark):
    def df(*ids):
        return spark.createDataFrame([(hashlib.sha256(b"%d" % (i % 4)).hexdigest(), i) for i in ids], "digest string, doc_id long")
    index = CuckooIndex(spark, 3).update(inserts=df(4, 5, 6, 8))
    index = index.update(inserts=df(1, 2, 9), deletes=df(0))
    live = {r["keep_id"]: r["group_size"] for r in index.keys.collect()}
    assert live == {1: 3, 2: 2}
    rows = corpus()
    kept = drop_copies(frame(spark, rows + rows[:3]))
    assert set(kept.columns) >= {"digest", "row", "text"}
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(_normal(r[1]), r[0])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())
    assert drop_copies(empty(spark)).count() == 0


def test_a_digest_of_several_texts_is_settled_by_content(spark):
    rows = corpus() + [(None, "one two", "en", "s", 7), (2**60 + 1, "one   two", "en", "s", 9), (906, "one two", "en", "s", 7)]
    weak = lambda text: F.substring(F.sha2(normal(text), 256), 1, 1)  # noqa: E731  16 digests for all texts
    group = defaultdict(list)
    for r in rows:
        group[_normal(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        keep = min(i for i in group[_normal(r[1])] if i is not None)
        want[r[0], keep, len(group[_normal(r[1])]), r[0] == keep] += 1
    got = exact_dedup(frame(spark, rows), 3, weak).drop("text_sha256").collect()
    assert Counter(map(tuple, got)) == want
    kept = drop_copies(frame(spark, rows), weak).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({min(i for i in g if i is not None): 1 for g in group.values()})


def test_only_hits_are_searched_for(spark, monkeypatch):
    asked = []
    search = exact_dedup_module._search
    monkeypatch.setattr(exact_dedup_module, "_search", lambda keys, d: asked.extend(d) or search(keys, d))
    digests = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(3000)]
    none = pd.DataFrame({"shard": pd.Series([], dtype="int32"), "digest": [], "keep_id": pd.array([], "Int64"),
                         "group_size": pd.array([], "Int64"), "filter": []})
    def changes(ds, op="+"):
        return pd.DataFrame({"shard": 0, "digest": ds, "doc_id": pd.array(range(len(ds)), "Int64"), "n": 1, "op": op})
    keys = merge_shard(none, changes(digests + digests[:7]))
    assert set(digests[:7]) <= set(asked) and len(set(asked)) < 60  # the rest: false hits of 16-bit tags
    assert keys["digest"].tolist() == sorted(digests) and keys["group_size"].sum() == 3007
    keys = merge_shard(keys, changes(digests[:2000], "-"))
    assert keys["digest"].tolist() == sorted(digests[2000:])
    keys = merge_shard(keys, changes(digests[1990:2010]))
    assert dict(zip(keys["digest"], keys["group_size"])) == {
        d: 1 + (2000 <= i < 2010) for i, d in enumerate(digests) if i >= 1990}


def test_probe_asks_the_filters(spark):
    def df(*ids):
        return spark.createDataFrame([(hashlib.sha256(b"%d" % i).hexdigest(), i) for i in ids], "digest string, doc_id long")
    index = CuckooIndex(spark, 3).update(inserts=df(*range(20), 4, 5))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in index.probe(df(4, 19, 20, 21)).collect()}
    assert got == {4: (4, 2), 19: (19, 1), 20: (None, None), 21: (None, None)}


def _line_brute(rows, least=20, docs=3):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                holders[key(x)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < docs or i == max(holders[key(x)])]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"Line number {k} of the pool, Éé " + "x" * k for k in range(12)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 9))), "en", "s", 1)
            for i in range(40)]
    rows += corpus() + [(None, pool[1], "en", "s", 1), (5, pool[2], "en", "s", 1), rows[0], (77, "\n" * 4000 + pool[3], "en", "s", 1)]
    for batches in (1, 4):
        got = line_dedup(frame(spark, rows), batches=batches).collect()
        assert Counter(map(tuple, got)) == _line_brute(rows)
    assert line_dedup(empty(spark)).count() == 0


def test_line_runs_compact(spark):
    runs = LineRuns(spark, fanout=3)
    new = []
    for b in range(4):
        batch = spark.createDataFrame([(bytes([k]), 10 * b + k) for k in range(b, b + 3)], "key binary, doc_id long")
        new.append(sorted(bytes(r["key"])[0] for r in runs.add(batch).collect()))
    assert new == [[0, 1, 2], [3], [4], [5]]
    assert len(runs.levels) >= 2 and all(len(level) < 3 for level in runs.levels)
    assert {bytes(r["key"])[0]: r["max_doc"] for r in runs.frequent(3).collect()} == {2: 22, 3: 33}


def test_sighting_runs_are_disjoint_sorted_and_not_shuffled(spark):
    rng = random.Random(8)
    runs, docs = LineRuns(spark, fanout=2), defaultdict(set)
    for b in range(5):
        rows = [(b"%d" % int(200 * rng.random() ** 2), 100 * b + rng.randrange(100)) for _ in range(300)]
        for k, d in rows:
            docs[k].add(d)
        runs.add(spark.createDataFrame(rows, "key binary, doc_id long"))
    sighted = [bytes(r["key"]) for r in runs._read(n for level in runs.levels for n in level).collect()]
    assert len(sighted) == len(set(sighted)) and set(sighted) == set(docs)
    frequent = runs.frequent(3)
    assert {bytes(r["key"]): r["max_doc"] for r in frequent.collect()} == {
        k: max(d) for k, d in docs.items() if len(d) >= 3}
    plan = frequent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def _near_brute(rows, n, pct):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= pct * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_classes(spark):
    rng = random.Random(9)
    rows = corpus(n=90)
    for i in range(40):                                     # a chain: each a step from the one before
        w = rows[1000 + i - 1][1].split(" ") if i and len(rows) > 1000 else None
        if w is None:
            break
    long = corpus()[0][1] + " " + " ".join(f"t{rng.random():.6f}" for _ in range(400))
    for i in range(30):
        w = long.split(" ")
        for _ in range(rng.randint(0, 25)):
            w[rng.randrange(len(w))] = f"e{i}{rng.random():.6f}"
        rows.append((2000 + i, " ".join(w), "en", "s", 1))
    for n, pct in ((3, 85), (5, 80)):
        want = _near_brute(rows, n, pct)
        got = near_classes(frame(spark, rows + [(None, long, "en", "s", 1)]), n, pct).collect()
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
                assert r["kept"] == (r["doc_id"] == r["component_id"])
        assert len({c for _, c in want.values()}) < len(rows) - 20
    kept = drop_near_copies(frame(spark, rows), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert near_classes(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 100), (7, 300), (300, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 10 * (k // 10) for k in range(41)} | {300: 0}
    want[40] = want[39 + 1] = 40
    assert got == {k: v for k, v in want.items() if k != 40}
