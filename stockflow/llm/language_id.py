"""Operator 7, language ID by interpolated Kneser-Ney character models.

Texts are lower-cased; letters stay and each run of other characters is one
space. For each language the counts of character 4-grams of a training sample
give interpolated Kneser-Ney models of orders 4 to 1 (absolute discounts,
continuation counts below the top). A language's model is made in one task from
its sample's counts and holds its own n-grams alone: for each order a sorted
array of n-gram hashes beside log probabilities, and one of context hashes
beside back-off weights, so all models together are as large as their sum. A
look-up goes to the place that the top bits of the hash tell and steps on from
there; the distinct 4-grams of a step of text are looked up once. A text gets the language of the
lowest cross-entropy in bits per character.

Rejection is calibrated on a part of the sample that isn't counted: the excess
of a text's cross-entropy over its language's mean, times the root of its length
(up to ``LENGTH_CAP``), may be ``SLACK`` times the ``HIGH`` quantile of the excesses
seen there, so that single mislabelled or mixed rows don't set the limit. The quantile
counts as ``LEAST_EXCESS`` bits of a long text at least, as a small sample sees few odd texts.

The sample is bounded: of the distinct texts of a language whole ones by hash, about
``SAMPLE_CHARS`` characters in expectation, so the model that goes to the executors
is bounded too. The texts that calibrate come to the driver: of each their first
``SAMPLE_CHARS / CALIBRATION`` characters, and twice that in all for a language at most. All
documents are scored over their whole texts.

Defined cases: null text, or text without a letter, gives ``und`` with score 0
and is rejected; with no labelled document every text is ``und`` with score 0
and texts with letters aren't rejected; equal cross-entropies go to the first
language by name; a text that a language's rows repeat counts once;
extra columns are kept by ``classify``; empty tables give no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.llm.common import HashArray, free_names, stored, table

ORDER = 4
SAMPLE_CHARS = 3_000_000
CALIBRATION = 10      # one in so many sampled documents calibrates
SLACK = 2.0
HIGH = 0.99
LENGTH_CAP = 400
LEAST_EXCESS = 0.5
STEP_CHARS = 1 << 20
UND = "und"


def letters_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list, is_letter: np.ndarray):
    """16-bit symbols of all texts in one row, each text after ORDER - 1 spaces
    and before one, its offsets, and the number of letters of each text."""
    parts = [(" " * (ORDER - 1)) + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    letter = is_letter[points]
    sym = np.where(points < 0xFFFF, points, 0xE000 + points % 0x1000)
    sym = np.where(letter, sym, 32).astype(np.uint64)
    first = np.zeros(len(points) + 1, bool)
    for k in range(ORDER - 1):
        first[off[:-1] + k] = True
    keep = letter | np.concatenate([[True], letter[:-1]]) | first[:-1]
    sums = np.concatenate([[0], np.cumsum(keep)])
    n_letters = np.concatenate([[0], np.cumsum(letter)])
    return sym[keep], sums[off], n_letters[off[1:]] - n_letters[off[:-1]]


def grams(sym: np.ndarray, off: np.ndarray):
    """The 4-grams that end in each symbol after a text's first spaces, and the texts' offsets in them."""
    key = sym.copy()
    for k in range(1, ORDER):
        key[k:] |= sym[:-k] << np.uint64(16 * k)
    real = np.ones(len(sym), bool)
    for k in range(ORDER - 1):
        real[off[:-1] + k] = False
    return key[real], off - (ORDER - 1) * np.arange(len(off))


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` symbols of each key."""
    return keys & np.uint64((1 << (16 * n)) - 1)


class LanguageModel:
    """One language's n-grams in sorted hash arrays, from its 4-grams and their
    counts. It holds its own n-grams only; ``n_symbols`` is how many symbols all
    languages have, whose share the least order spreads evenly."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_symbols: int):
        by = {ORDER: (keys, counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # how many kinds of symbols come before
            low, at = np.unique(_low(by[n + 1][0], n), return_inverse=True)
            by[n] = low, np.bincount(at, minlength=len(low)).astype(np.float64)
        self.arrays, self.logp, self.contexts, self.backoff = [], [], [None], [None]
        for n in range(1, ORDER + 1):
            keys, c = by[n]
            ctx_keys, ctx = np.unique(keys >> np.uint64(16), return_inverse=True)
            one, two = (c == 1).sum(), (c == 2).sum()
            d = one / (one + 2 * two) if one and two else 0.5
            total = np.bincount(ctx, c, len(ctx_keys))
            weight = d * np.bincount(ctx, minlength=len(ctx_keys)) / total
            if n == 1:  # an unknown symbol has the rest of the least order
                lower = 1 / (n_symbols + 1)
                self.unknown = np.float32(np.log2(weight[0] * lower))
            else:
                lower = below[np.searchsorted(by[n - 1][0], _low(keys, n - 1))]
            below = np.maximum(c - d, 0) / total[ctx] + weight[ctx] * lower
            self.arrays.append(self._sorted(keys, below, self.logp))
            if n > 1:
                self.contexts.append(self._sorted(ctx_keys, np.maximum(weight, 1e-9), self.backoff))

    def plain(self) -> dict:
        """The model as arrays and numbers alone; ``of_plain`` turns it back."""
        tables = {k: [a and vars(a) for a in getattr(self, k)] for k in ("arrays", "contexts")}
        return vars(self) | tables

    @classmethod
    def of_plain(cls, held: dict) -> "LanguageModel":
        out = cls.__new__(cls)
        vars(out).update(held)
        for k in ("arrays", "contexts"):
            tables = [a and HashArray.__new__(HashArray) for a in held[k]]
            for table_, a in zip(tables, held[k]):
                if a:
                    vars(table_).update(a)
            setattr(out, k, tables)
        return out

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray, logs: list) -> HashArray:
        out = HashArray(keys)
        logs.append(np.log2(values[out.order]).astype(np.float32))
        out.order = None
        return out

    def log2_probs(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        at = self.arrays[n - 1].find(keys)
        out = self.logp[n - 1][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if n == 1:
                out[miss] = self.unknown
            else:
                gone = keys[miss]
                c = self.contexts[n - 1].find(gone >> np.uint64(16))
                out[miss] = self.log2_probs(_low(gone, n - 1), n - 1) + np.where(c >= 0, self.backoff[n - 1][c], 0)
        return out


class KneserNey:
    """The models of all languages: from ``counts``, language -> (sorted 4-gram
    keys, counts), or as they are. Their size is the sum of the languages' own."""

    def __init__(self, counts: dict, models: dict | None = None):
        if models is None:
            n_symbols = len(np.unique(np.concatenate([_low(k, 1) for k, _ in counts.values()]))) if counts else 0
            models = {x: LanguageModel(*counts[x], n_symbols) for x in counts}
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.mean = self.most = None

    @property
    def logp(self) -> list:
        return [p for model in self.models for p in model.logp]

    def log2_probs(self, keys: np.ndarray) -> np.ndarray:
        """Rows of log2 probabilities, a column for each language."""
        return np.stack([model.log2_probs(keys) for model in self.models], axis=1)

    def entropies(self, texts: list, is_letter: np.ndarray):
        """Cross-entropy in bits per symbol (a row for each text, a column for each
        language), numbers of symbols and of letters."""
        sym, off, letters = symbols(texts, is_letter)
        keys, off = grams(sym, off)
        total = np.zeros((len(texts), len(self.langs)))
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        for i in range(0, len(keys), STEP_CHARS):
            kinds, place = np.unique(keys[i:i + STEP_CHARS], return_inverse=True)
            own = doc[i:i + STEP_CHARS]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for k, model in enumerate(self.models):
                total[own[heads], k] += np.add.reduceat(model.log2_probs(kinds)[place], heads, dtype=np.float64)
        n = np.diff(off)
        return -total / np.maximum(n, 1)[:, None], n, letters

    def calibrate(self, texts: list, langs: list, is_letter: np.ndarray):
        """Mean cross-entropy of each language and a high excess, from texts that weren't counted."""
        ce, n, letters = self.entropies(texts, is_letter)
        own = np.array([self.langs.index(x) for x in langs], np.int64)
        ok = letters > 0
        self.mean, self.most = np.full(len(self.langs), np.inf), np.zeros(len(self.langs))
        for i in range(len(self.langs)):
            mine = ok & (own == i)
            if mine.any():
                self.mean[i] = np.average(ce[mine, i], weights=n[mine])
                excess = (ce[mine, i] - self.mean[i]) * np.sqrt(np.minimum(n[mine], LENGTH_CAP))
                self.most[i] = max(LEAST_EXCESS * LENGTH_CAP ** 0.5, np.quantile(excess, HIGH, method="lower"))

    def predict(self, texts: list, is_letter: np.ndarray):
        """Lists of language, score, cross-entropy and rejection."""
        if not self.langs:
            letters = symbols(texts, is_letter)[2]
            return [UND] * len(texts), [0.0] * len(texts), [None] * len(texts), (letters == 0).tolist()
        ce, n, letters = self.entropies(texts, is_letter)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(best)), best]
        z = np.exp2(-(ce - low[:, None]) * np.minimum(n, 30)[:, None])
        excess = (low - self.mean[best]) * np.sqrt(np.minimum(n, LENGTH_CAP))
        none = letters == 0
        rejected = none | (excess > SLACK * self.most[best])
        score = np.where(none, 0.0, 1 / z.sum(axis=1))
        lang = [UND if e else self.langs[b] for b, e in zip(best, none)]
        return lang, score.tolist(), low.tolist(), rejected.tolist()


def _batches(column, limit: int = STEP_CHARS):
    out, size = [], 0
    for t in column:
        out.append(t.as_py() or "")
        size += len(out[-1])
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def calibrating(sample: DataFrame, room: int) -> DataFrame:
    """(text, lang) of the rows of ``sample`` (text, lang, place, cal) that calibrate: the first
    ``room`` characters of each, by place, and at most twice ``room`` of a language in all."""
    room = max(1, room)
    cal = sample.filter("cal").select(F.substring("text", 1, room).alias("text"), "lang", "place")
    sizes = cal.select("lang", "place", F.length("text").alias("n")).collect()
    held, end = {}, {}  # characters of each language, and the first place that is over
    for lang, place, n in sorted((r["lang"], r["place"], r["n"]) for r in sizes):
        held[lang] = held.get(lang, 0) + n
        if held[lang] > 2 * room:
            end.setdefault(lang, place)
    if end:
        limit = F.create_map(*[F.lit(x) for pair in end.items() for x in pair])
        cal = cal.filter(F.col("place") < F.coalesce(limit[F.col("lang")], F.lit(2.0)))
    return cal.select("text", "lang")


def train(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> KneserNey:
    """A model from rows (text, lang); rows with null text or lang are left out."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    kinds = rows.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    sizes = {r["lang"]: r["n"] for r in kinds.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return KneserNey({})
    share = F.create_map(*[F.lit(y) for k, n in sizes.items() for y in (k, min(1.0, sample_chars / max(1, n)))])
    place = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(place < share[F.col("lang")]).distinct().withColumn("place", place).withColumn(
        "cal", F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(CALIBRATION)) == 0)

    def count(batches):
        is_letter = letters_table()
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for x in sorted(set(langs)):
                own = [t for t, y in zip(texts, langs) if y == x]
                done = 0
                for part in _batches(pa.array(own, pa.large_string())):
                    done += len(part)
                    keys, _ = grams(*symbols(part, is_letter)[:2])
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                        names=["lang", "key", "n"])

    got = stored(sample.filter(~F.col("cal")).select("text", "lang").mapInArrow(count, "lang string, key long, n long")
                 .groupBy("lang", "key").agg(F.sum("n").alias("n")), "grams")
    n_symbols = got.select(F.expr("key & 65535").alias("symbol")).distinct().count()

    def fit(rows: pa.Table) -> pa.Table:  # one language, bounded by its sample
        key, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(key)
        made = pickle.dumps(LanguageModel(key[order], n[order], n_symbols).plain(), 5)
        return pa.table({"lang": rows["lang"].slice(0, 1).cast(pa.string()), "model": pa.array([made], pa.binary())})

    models = {r["lang"]: LanguageModel.of_plain(pickle.loads(r["model"]))
              for r in got.groupBy("lang").applyInArrow(fit, "lang string, model binary").toLocalIterator()}
    model = KneserNey({}, models)
    if model.langs:
        cal = [r for r in calibrating(sample, sample_chars // CALIBRATION).toArrow().to_pylist() if r["lang"] in models]
        model.calibrate([r["text"] for r in cal] or [""], [r["lang"] for r in cal] or [model.langs[0]], letters_table())
    return model


_OUT = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()),
        ("rejected", T.BooleanType())]


def classify(docs: DataFrame, model: KneserNey, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected (names after ``prefix``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    at = docs.columns.index(text)
    names = [prefix + n for n, _ in _OUT]
    if set(names) & set(docs.columns):
        raise ValueError(f"the table has one of the columns {names} already; give a prefix")

    def run(batches):
        is_letter = letters_table()
        for batch in batches:
            cols = [[], [], [], []]
            for texts in _batches(batch.column(at)):
                for c, got in zip(cols, held.value.predict(texts, is_letter)):
                    c.extend(got)
            extra = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, _OUT)]])
    return docs.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train_documents(docs: DataFrame) -> KneserNey:
    return train(docs.filter(~held_out()).select("text", "lang"))


def keep_known_languages(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    prefix = free_names(docs, *["__" + n for n, _ in _OUT])[0].removesuffix(_OUT[0][0])
    out = classify(docs, model, prefix=prefix)
    return out.filter(~F.col(prefix + "rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_documents(docs)
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op7_kneser_ney_language": (op7_kneser_ney_language, None)}
