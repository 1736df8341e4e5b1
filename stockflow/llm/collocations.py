"""Operator 11, phrase collocations by sorted count streams.

Texts are cut into pieces and words; n-grams of 1 to ``MOST`` words are counted
inside their pieces, per language. Counting is level by level: a phrase can only
reach ``least`` occurrences if all its parts do, so the second pass counts pairs
of frequent words and the third pass phrases of frequent pairs. Which parts are
frequent reaches the tasks as a bit table of fixed size (``SIEVE_BITS``): it may
let a rare part through, whose phrase then falls at the exact count, and never
stops a frequent one; fuller tables prune less and give the same rows. Inside a
task words are told apart by their bytes, not by hashes, and each block of text is
sorted and summed before the shuffle.

The frequent phrases make two count streams, one in prefix order (words as they
stand) and one in suffix order (words reversed), both range-partitioned and sorted.
One walk over a stream in lockstep with the chain of phrases that lead to the
current one gives every phrase the counts of its leading parts (left counts in
prefix order, right counts in suffix order) and every part the largest count of
its extensions by one word. No hash table is kept: memory is the chain, at most
``MOST`` phrases. Where a range boundary cuts a chain, the parts that the task has
not seen are asked for by a sort-merge join with the stream. Left and right counts
then meet in a sort-merge join by phrase and cut. A phrase inside any longer one of
nearly its count is also inside one that is longer by a single word and at least
as frequent, so extensions by one word decide what is dropped.

Defined cases: null texts are empty; a null lang is ``und``, together with rows
that say so; rows that repeat count as often as they stand there; ``doc_id`` and
extra columns are ignored; texts of any length are read whole, in blocks that
share three words; counts are longs and scores integer quotients of decimals, so
products past 64 bits stay exact; ties of a cut go to the fewest words, ties of the
report to the phrase; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockflow.llm.common import mix, stored, table

MOST = 4
LEAST = 30
TOP = 2000
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 1024
#: Bits of the table that tells the tasks which parts are frequent: 8 MB at any input size.
SIEVE_BITS = 26
#: Longest stretch of a word that numpy compares; longer words are compared as Python bytes.
LONG_WORD = 256

_COUNTS = "lang string, phrase string, f long"
_K = np.uint64(0xD6E8FEB86659FD93)

_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- words and phrases of a block (inside tasks) -------------------------------

def blocks(column, limit: int = BLOCK_BYTES):
    """(first row, end row, lower-cased bytes, offsets, carried) over a string column.

    A block has about ``limit`` bytes of whole texts, or a window of one longer text
    whose first ``carried`` words were the last ones of the window before.
    """
    for top in range(0, len(column), BLOCK_ROWS):
        for i, j, *rest in _blocks(column.slice(top, BLOCK_ROWS), limit):
            yield top + i, top + j, *rest


def _blocks(column, limit: int):
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(texts)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        if off[j] - off[i] <= limit:
            yield i, j, _LOWER[data[off[i]:off[j]]], off[i:j + 1] - off[i], 0
        else:
            yield from _windows(data[off[i]:off[j]], i, limit)
        i = j


def _windows(text: np.ndarray, row: int, limit: int):
    at, carried = 0, 0
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text):  # cut between words, further on if a word fills the window
            gap = np.flatnonzero(_KIND[text[at:end]] > 0)
            if len(gap) and _starts(text[at:at + gap[-1]])[0].size > carried:
                end = at + int(gap[-1])
                break
            end = min(len(text), end + limit)
        part = _LOWER[text[at:end]]
        yield row, row + 1, part, np.array([0, len(part)], np.int64), carried
        if end == len(text):
            return
        start, _ = _starts(part)
        carried = min(MOST - 1, len(start))
        at += int(start[-carried]) if carried else len(part)


def _starts(data: np.ndarray, off: np.ndarray | None = None):
    inside = _KIND[data] == 0
    edge = np.zeros(len(data) + 1, bool)
    if off is not None:
        edge[off] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def dense(x: np.ndarray):
    """Numbers from 0 on for the distinct values, a place of each, and how often each is there."""
    if not len(x):
        none = np.empty(0, np.int64)
        return none, none, none
    order = np.argsort(x)
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    ids = np.empty(len(x), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new], np.diff(np.append(np.flatnonzero(new), len(x)))


class Words:
    """The words of a block: spans, texts, pieces, and equal numbers for equal words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.start, self.end = _starts(data, off)
        self.size = self.end - self.start
        self.doc = np.searchsorted(off, self.start, "right") - 1
        cuts = np.searchsorted(np.flatnonzero(_KIND[data] == 2), self.start)
        self.joined = (cuts[1:] == cuts[:-1]) & (self.doc[1:] == self.doc[:-1])  # word i and i + 1 are in one piece
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def _bytes(self, which: np.ndarray, at: int) -> np.ndarray:
        left = np.minimum(self.size[which] - at, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        return self.eight[self.start[which] + at].astype(np.uint64) & mask

    def numbers(self) -> np.ndarray:
        every = np.arange(len(self.start))
        out, _, _ = dense(self._bytes(every, 0))
        longer, at = every[self.size > 8], 8
        while len(longer) and at < LONG_WORD:
            part, _, _ = dense(self._bytes(longer, at))
            self._refine(out, longer, part)
            at += 8
            longer = longer[self.size[longer] > at]
        if len(longer):
            seen: dict[bytes, int] = {}
            rest = [seen.setdefault(self.data[self.start[i]:self.end[i]].tobytes(), len(seen)) for i in longer]
            self._refine(out, longer, np.array(rest))
        if not self.data.all():  # zero bytes of words look like the filling
            out, _, _ = dense(out * (int(self.size.max()) + 1) + self.size)
        return out

    @staticmethod
    def _refine(out: np.ndarray, which: np.ndarray, part: np.ndarray) -> None:
        """Tell apart, among the words ``which``, those of one number and different parts; a word that has
        no such part keeps its number, which no word with one keeps."""
        top = int(out.max()) + 1
        ids, _, _ = dense(out[which] * (int(part.max()) + 1) + part)
        out[which] = top + ids

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """For the sieve only: equal words have equal hashes."""
        h = mix(self.size[which].astype(np.uint64) * _K)
        at, left = 0, np.arange(len(which))
        while len(left) and at < LONG_WORD:
            h[left] = mix(h[left] * _K + self._bytes(which[left], at))
            at += 8
            left = left[self.size[which[left]] > at]
        return h

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on, joined by one space."""
        out_size = sum(self.size[first + k] for k in range(n)) + n - 1
        off = np.concatenate([[0], np.cumsum(out_size)])
        out = np.full(int(off[-1]), 32, np.uint8)
        to = off[:-1].copy()
        for k in range(n):
            size, start = self.size[first + k], self.start[first + k]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to, size) + step] = self.data[np.repeat(start, size) + step]
            to += size + 1
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(off.astype(np.int64)),
                                                                     pa.py_buffer(out)])


def _lang_hash(names: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in names],
                    np.uint64)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _K + b)


def _held(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
    return (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _count_block(level: int, words: Words, lang: np.ndarray, langs: list[str], carried: int, sieve):
    """(n, places of the distinct phrases, counts) of a block; lang: number of each row's language."""
    number = words.numbers()
    of = lang[words.doc]
    u, first, _ = dense(of * (int(number.max()) + 1) + number)
    if level == 1:
        seen = np.bincount(u[carried:], minlength=len(first))
        yield 1, first[seen > 0], seen[seen > 0]
        return
    n_u = len(first)
    h = _pair_hash(_lang_hash(langs)[of[first]], words.hashes(first))
    fine = words.joined
    if level == 2:
        held = _held(sieve, h)[u]
        at = np.flatnonzero(fine & held[:-1] & held[1:])
        at = at[at + 1 >= carried]
        _, rep, seen = dense(u[at] * n_u + u[at + 1])
        yield 2, at[rep], seen
        return
    at = np.flatnonzero(fine)
    b, rep, _ = dense(u[at] * n_u + u[at + 1])
    held = _held(sieve, _pair_hash(h[u[at[rep]]], h[u[at[rep] + 1]]))[b]
    pair = np.full(len(u) + 2, -1, np.int64)  # number of the frequent pair from each word on
    pair[at[held]] = b[held]
    three = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    t, rep, _ = dense(pair[three] * n_u + u[three + 2])
    triple = np.full(len(u) + 2, -1, np.int64)
    triple[three] = t
    own = three + 2 >= carried
    _, rep, seen = dense(t[own])
    yield 3, three[own][rep], seen
    four = three[triple[three + 1] >= 0]
    four = four[four + 3 >= carried]
    _, rep, seen = dense(triple[four] * n_u + u[four + 3])
    yield 4, four[rep], seen


def _counter(level: int, sieve):
    """A mapInArrow function: (lang, text) -> rows (lang, phrase, f) of each block."""
    def run(batches):
        bits = sieve.value if sieve is not None else None
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            langs = names.dictionary.to_pylist()
            code = names.indices.to_numpy(zero_copy_only=False)
            for i, j, data, off, carried in blocks(batch.column(1)):
                words = Words(data, off)
                if not len(words.start):
                    continue
                lang = code[i:j].astype(np.int64)
                for n, first, seen in _count_block(level, words, lang, langs, carried, bits):
                    for a in range(0, len(first), 1 << 17):
                        some = first[a:a + (1 << 17)]
                        yield pa.RecordBatch.from_arrays([
                            names.dictionary.take(pa.array(lang[words.doc[some]])),
                            words.phrases(some, n).cast(pa.string()),
                            pa.array(seen[a:a + (1 << 17)], pa.int64())], names=["lang", "phrase", "f"])
    return run


# -- counting and sieves -------------------------------------------------------

def _counted(texts: DataFrame, level: int, sieve=None) -> DataFrame:
    return texts.mapInArrow(_counter(level, sieve), _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _sieve(frequent: DataFrame):
    """Broadcast bit table with the hash of every (lang, phrase) of one or two words."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).to_pylist()
            data = np.frombuffer("\n".join(batch.column(1).to_pylist()).encode(), np.uint8)
            cut = np.flatnonzero(data == 10) + 1
            words = Words(data, np.concatenate([[0], cut, [len(data)]]))
            h = words.hashes(np.arange(len(words.start)))
            names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            of = _lang_hash(list(names))[[names[x] for x in langs]]
            bound = np.searchsorted(words.doc, np.arange(len(langs)))
            whole = _pair_hash(of, h[bound])
            two = np.flatnonzero(np.diff(np.append(bound, len(h))) == 2)
            whole[two] = _pair_hash(whole[two], _pair_hash(of[two], h[bound[two] + 1]))
            yield pa.RecordBatch.from_arrays([pa.array((whole >> np.uint64(64 - SIEVE_BITS)).astype(np.int64))], names=["at"])
    parts = frequent.select("lang", "phrase").mapInArrow(run, "at long").groupBy(
        F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits")).collect()
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)  # at most 2 ** SIEVE_BITS / 32768 rows of 4 kB came
    for r in parts:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of 1 to ``MOST`` words with f >= ``least``, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.col("text").cast("string").alias("text")).filter("text is not null")
    enough = F.col("f") >= least
    ones = stored(_counted(texts, 1), "words")
    sizes = ones.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = ones.filter(enough)
    sieve = _sieve(frequent)
    pairs = stored(_counted(texts, 2, sieve).filter(enough), "pairs")
    more = _sieve(pairs)
    longer = stored(_counted(texts, 3, more).filter(enough), "longer")
    for b in (sieve, more):
        b.unpersist()
    every = frequent.unionByName(pairs).unionByName(longer)
    return every.select("lang", F.split("phrase", " ").alias("words"), "f"), sizes


# -- the two streams -----------------------------------------------------------

def _walk(batches):
    """One pass over a sorted stream (lang, words, f). Rows out: what = 0: ``f`` is the count of the first ``k``
    words; 1: the same is wanted, the chain began before this task; 2: ``f`` is the count of an extension."""
    chain: list[list] = []  # [lang, words, f, largest extension] of the phrases that lead to this one
    out: dict[str, list] = {x: [] for x in ("what", "lang", "words", "k", "f")}

    def put(*row):
        for column, x in zip(out.values(), row):
            column.append(x)

    def closed(part):
        if part[3]:
            put(2, part[0], part[1], 0, part[3])

    def flushed():
        batch = pa.RecordBatch.from_arrays([
            pa.array(out["what"], pa.int32()), pa.array(out["lang"], pa.string()),
            pa.array(out["words"], pa.list_(pa.string())), pa.array(out["k"], pa.int32()),
            pa.array(out["f"], pa.int64())], names=list(out))
        for column in out.values():
            column.clear()
        return batch

    for batch in batches:
        for lang, words, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
            while chain and not (chain[-1][0] == lang and len(chain[-1][1]) < len(words)
                                 and chain[-1][1] == words[:len(chain[-1][1])]):
                closed(chain.pop())
            known = {len(part[1]): part for part in chain}
            for k in range(1, len(words)):
                put(0, lang, words, k, known[k][2]) if k in known else put(1, lang, words, k, None)
            if len(words) - 1 in known:
                part = known[len(words) - 1]
                part[3] = max(part[3], f)
            elif len(words) > 1:
                put(2, lang, words[:-1], 0, f)
            chain.append([lang, words, f, 0])
            if len(out["what"]) >= 20_000:
                yield flushed()
    while chain:
        closed(chain.pop())
    yield flushed()


def _stream(counts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """From counts in the order of ``words``: (lang, words, k, part) and (lang, words, ext)."""
    keys = ["lang", "words"]
    order = counts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    seen = stored(order.mapInArrow(_walk, "what int, lang string, words array<string>, k int, f long"), name)
    asked = seen.filter("what = 1").select("lang", F.slice("words", 1, F.col("k")).alias("part"), "words", "k")
    answers = asked.join(counts.select("lang", F.col("words").alias("part"), "f").hint("merge"), ["lang", "part"])
    parts = seen.filter("what = 0").select(*keys, "k", "f").unionByName(answers.select(*keys, "k", "f"))
    ext = seen.filter("what = 2").groupBy(*keys).agg(F.max("f").alias("ext"))
    return parts, ext


def _wide(c):
    return F.col(c).cast("decimal(19,0)")


def cut_score():
    """floor(2000000 * a / (l + r)) as a long; the product and the sum are decimals, so nothing is rounded."""
    return F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)))"
                  " div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of ``docs`` (lang, text)."""
    counts, sizes = phrase_counts(docs, least)
    counts = stored(counts, "counts")
    left, right_ext = _stream(counts, "prefix")
    turned, left_ext = _stream(counts.withColumn("words", F.reverse("words")), "suffix")
    back = turned.select("lang", F.reverse("words").alias("words"),
                         (F.size("words") - F.col("k")).alias("k"), F.col("f").alias("r"))
    cuts = left.withColumnRenamed("f", "l").join(back.hint("merge"), ["lang", "words", "k"])
    ext = right_ext.unionByName(left_ext.withColumn("words", F.reverse("words"))).groupBy("lang", "words").agg(
        F.max("ext").alias("ext"))
    phrases = counts.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    best = (phrases.join(cuts.hint("merge"), ["lang", "words"]).withColumn("score", cut_score())
            .groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inside = _wide("ext") * 100 >= _wide("a") * 80
    kept = best.join(ext.hint("merge"), ["lang", "words"], "left").filter(~F.coalesce(inside, F.lit(False)))
    rows = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    return _first(rows, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first rows with their rank: first among shares of its rows, then among what these keep."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for shares in (1024, 32):
        share = F.pmod(F.hash("phrase"), F.lit(shares))
        w = Window.partitionBy("lang", share).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(
        F.col("rank") <= top)


def op11_count_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest([array_to_string(list_slice(w, i, i + m - 1), ' ')
                          for i in generate_series(1, len(w) - m + 1)]) AS phrase
  FROM lists, (VALUES (1), (2), (3), (4)) AS s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT lang, m, phrase, a, w, k, array_to_string(list_slice(w, 1, k), ' ') AS lp,
         array_to_string(list_slice(w, k + 1, m), ' ') AS rp
  FROM cand, (VALUES (1), (2), (3)) AS s(k) WHERE k < m),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a AS longer, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase
  FROM cand, (VALUES (2), (3)) AS p(s), (VALUES (1), (2), (3)) AS q(i) WHERE s < m AND i + s - 1 <= m),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_parts p WHERE p.lang = b.lang AND p.phrase = b.phrase AND 100 * p.longer >= 80 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, score
  FROM kept k JOIN total t ON t.lang = k.lang)
WHERE rank <= 2000
"""

QUERIES = {"op11_count_stream_collocations": (op11_count_stream_collocations, SQL)}
