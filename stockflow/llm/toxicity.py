"""Operator 5, toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from a bounded sample of labelled rows: words, and
prefixes that whole families of words share, whose odds of standing in a toxic
row's text rather than another's are high even at the low end of their interval
(copies of a text count once); all of them, as the sample bounds their number: each
stands in ``MIN_DOCS`` of its toxic rows. Its words (of five letters and more) form a
trie; a Levenshtein automaton (one error, two from eight letters on) intersected
with the trie is made deterministic as far as texts need it: a state is the set
of trie nodes reached with their fewest errors, and a word that leaves all of
them is passed over at once. Each distinct word of a batch is matched once.

Every hit is judged in its context window of ``WINDOW`` words to either side: it
is a quotation when it stands between quote marks opened before and closed after
it inside the window, or after a word of reporting; it is direct when it isn't
quoted and a word of address is near. The counts of exact, misspelled and
prefix hits, of direct ones and of quoted ones are the features of a logistic
regression with a ridge, fitted on the same sample. Labels, lang, source and
doc_id are never inputs of a score.

Defined cases: null and empty texts have no hits and get the score of none; no
labelled row gives score 0 to all; labels of one kind give their share, which is
then 0 or 1; a label repeated for a doc_id counts once, the highest; rows with
null doc_id are never trained on and are scored; null labels are left out; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import stored, table

SAMPLE_ROWS = 8000     # labelled rows that the model is fitted on, in expectation
MIN_DOCS = 4           # toxic rows of the sample that hold a term
MIN_SHARE = 0.03       # of the toxic rows; terms below need the higher odds
MIN_ODDS, HIGH_ODDS = 4.0, 12.0  # of the low ends of a 90 % and of a 99 % interval
PREFIXES = range(4, 8)
WINDOW = 8
THRESHOLD = 0.7
RIDGE = 0.1
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›¡¿…–—"
_OPEN, _CLOSE = "\"'“„«‘‚‹”", "\"'”“»’‘›"
REPORTING = frozenset(
    "said says wrote writes called calls quoted quotes claimed replied shouted sagte sagt schrieb nannte zitierte "
    "rief dit disait écrit écrivait appelé cité dijo dice escribió llamó citó".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr sie tu te toi ton vous votre usted tú ti tus".split())
FEATURES = 6


def words_of(text: str) -> tuple[list[str], list[str]]:
    """Raw words and their lower-cased cores without punctuation at the ends."""
    raw = text.split()
    return raw, [w.strip(_EDGES) for w in text.lower().split()]


class LexiconAutomaton:
    """The Levenshtein automaton of all lexicon words at once, over their trie, made deterministic as needed."""

    def __init__(self, words, prefixes):
        self.children, self.ends = [{}], [None]
        self.prefixes = frozenset(prefixes)
        self.exact = frozenset(words)
        self.depths = sorted({len(p) for p in prefixes})
        longest = []
        for w in sorted(self.exact):
            if len(w) < 5:
                continue
            node, path = 0, [0]
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
                path.append(node)
            self.ends[node] = (w, 2 if len(w) >= 8 else 1)
            longest.append((path, 2 if len(w) >= 8 else 1))
        #: Most errors that a word below each node allows.
        self.allow = [0] * len(self.children)
        for path, k in longest:
            for node in path:
                self.allow[node] = max(self.allow[node], k)
        self.states, self.nodes, self.step, self.hit = {}, [], [], []
        self.start = self._state({0: 0}) if longest else None

    def _state(self, reached: dict[int, int]):
        """The number of the state of these nodes and errors, after skipping lexicon letters; None if it is empty."""
        best: dict[int, int] = {}
        todo = list(reached.items())
        while todo:
            node, k = todo.pop()
            if k <= self.allow[node] and k < best.get(node, 99):
                best[node] = k
                todo += [(child, k + 1) for child in self.children[node].values()]
        if not best:
            return None
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.step)
            self.nodes.append(key)
            self.step.append({})
            ends = [(k, *self.ends[n]) for n, k in best.items() if self.ends[n] and k <= self.ends[n][1]]
            self.hit.append(min(ends)[:2] if ends else None)
        return self.states[key]

    def _next(self, state: int, char: str):
        reached: dict[int, int] = {}
        for node, k in self.nodes[state]:
            reached[node] = min(reached.get(node, 99), k + 1)  # a letter too many
            for c, child in self.children[node].items():
                more = k + (c != char)
                reached[child] = min(reached.get(child, 99), more)
        to = self.step[state][char] = self._state(reached)
        return to

    def match(self, word: str):
        """None, or the kind of hit: 0 exact, 1 misspelled, 2 prefix of a family."""
        if word in self.exact:
            return 0
        for n in self.depths:
            if word[:n] in self.prefixes:
                return 2
        state = self.start
        for c in word:
            if state is None:
                return None
            step = self.step[state]
            state = step[c] if c in step else self._next(state, c)
        return 1 if state is not None and self.hit[state] else None


def _quoted(raw: list[str], core: list[str], i: int) -> bool:
    lo, hi = max(0, i - WINDOW), min(len(raw), i + WINDOW + 1)
    opened = any(raw[j][:1] in _OPEN for j in range(lo, i + 1))
    closed = any(raw[j].rstrip(".,;:!?")[-1:] in _CLOSE for j in range(i, hi) if raw[j].rstrip(".,;:!?"))
    return (opened and closed) or any(core[j] in REPORTING for j in range(lo, i))


def features(text: str, automaton: LexiconAutomaton, cache: dict) -> list[float]:
    core = [w.strip(_EDGES) for w in text.lower().split()]
    kinds = []
    for i, w in enumerate(core):
        if w in cache:
            kind = cache[w]
        else:
            kind = cache[w] = automaton.match(w) if len(w) > 2 else None
        if kind is not None:
            kinds.append((i, kind))
    out = [0.0] * FEATURES
    if kinds:
        raw = text.split()
        for i, kind in kinds:
            if _quoted(raw, core, i):
                out[3] += 1
                continue
            out[kind] += 1
            if any(c in ADDRESS for c in core[max(0, i - WINDOW):i + WINDOW + 1]):
                out[4] += 1
        out[5] = float(out[0] > 0)
    return [math.log1p(x) for x in out[:5]] + out[5:]


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and prefixes of toxic rows of ``sample`` (text, toxic)."""
    def count(batches):
        for batch in batches:
            tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                core = {w.strip(_EDGES) for w in (text or "").lower().split()}
                terms = {w for w in core if 3 <= len(w) <= 30 and w.isalpha()}
                tally[int(y > 0)].update(terms | {w[:n] + "*" for w in terms for n in PREFIXES if len(w) > n})
            terms = sorted(set(tally[0]) | set(tally[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([tally[1][t] for t in terms], pa.int64()),
                 pa.array([tally[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])
    sample = sample.select("text", "toxic").distinct()
    n = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return [], []
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    strong = (odds - 2.58 * error >= math.log(HIGH_ODDS)) | (
        (odds - 1.64 * error >= math.log(MIN_ODDS)) & (F.col("pos") >= MIN_SHARE * pos))
    rows = (sample.select("text", "toxic").mapInArrow(count, "term string, pos long, neg long").groupBy("term")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter((F.col("pos") >= MIN_DOCS) & strong)
            .orderBy(F.desc("pos"), "term").collect())  # words of the bounded sample only
    terms = {r["term"]: r["pos"] for r in rows}
    most: dict[str, int] = {}  # of the words that begin with each prefix, the rows of the most frequent one
    for t, v in terms.items():
        if not t.endswith("*"):
            for n in PREFIXES:
                most[t[:n]] = max(v, most.get(t[:n], 0))
    prefixes: list[str] = []
    families: set[str] = set()
    for p in sorted((t[:-1] for t in terms if t.endswith("*")), key=lambda p: (len(p), p)):
        # a family, not one word and its endings: no word of the lexicon makes most of its rows
        if most.get(p, 0) < 0.5 * terms[p + "*"] and not any(p[:n] in families for n in PREFIXES):
            families.add(p)
            prefixes.append(p)
    words = [t for t in terms if not t.endswith("*") and not any(t[:n] in families for n in PREFIXES)]
    return words, prefixes


class Model:
    def __init__(self, words=(), prefixes=(), weights=None, constant: float | None = 0.0):
        self.words, self.prefixes, self.weights, self.constant = list(words), list(prefixes), weights, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _featured(docs: DataFrame, words, prefixes, out_schema: str, finish):
    """Features of column 0 in each batch, passed to ``finish(batch, matrix)``."""
    held = docs.sparkSession.sparkContext.broadcast((words, prefixes))  # bounded by the sample

    def run(batches):
        automaton = LexiconAutomaton(*held.value)
        for batch in batches:
            cache: dict = {}
            x = np.array([features(t.as_py() or "", automaton, cache) for t in batch.column(0)], float)
            yield finish(batch, x.reshape(-1, FEATURES))
    return docs.mapInArrow(run, out_schema)


def train(labelled: DataFrame) -> Model:
    """A model from rows (text, toxic); a bounded sample is to be given."""
    words, prefixes = learn_lexicon(labelled)

    def finish(batch, x):
        cols = [pa.array(x[:, k]) for k in range(FEATURES)]
        return pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *cols],
                                          names=["y", *[f"x{k}" for k in range(FEATURES)]])
    schema = ", ".join(["y int", *[f"x{k} double" for k in range(FEATURES)]])
    got = _featured(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), words, prefixes, schema,
                    finish).toArrow()
    y = (got.column("y").to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    x = np.column_stack([np.ones(len(y)), *[got.column(f"x{k}").to_numpy() for k in range(FEATURES)]])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(words, prefixes, w)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents that aren't held out, by hash of the id."""
    usable = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    total = usable.count()
    share = min(1.0, rows / max(1, total))
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = usable.filter(place < share).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("__id")).select("text", "toxic")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text)."""
    def finish(batch, x):
        s = model.score(x)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "score"])
    rows = _featured(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), model.words, model.prefixes,
                     "doc_id long, score double", finish)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(stored(labelled_sample(docs, table(spark, sf_dir, "labels")), "sample"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_levenshtein_toxicity": (op5_levenshtein_toxicity, None)}
