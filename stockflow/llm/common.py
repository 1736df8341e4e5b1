"""Helpers shared by the text operators: shared storage, and word spans and
word hashes of Arrow text columns computed over raw UTF-8 bytes with numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import ensure_checkpoint_dir

#: White space of all contracts: space and 0x09 to 0x0D.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of a batch that are copied at once.
ROWS = 512

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without the setting; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps don't depend on lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as ``df`` has columns of these names already."""
    taken = {c.lower() for c in df.columns}
    while {n.lower() for n in names} & taken:
        names = tuple("_" + n for n in names)
    return list(names)


def lower_az(col):
    """A-Z lower-cased and nothing else (``lower`` alone would also change other scripts)."""
    ascii_only = F.length(col) == F.octet_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# -- numpy side (inside tasks) ------------------------------------------------

def text_steps(column, limit: int | None = None):
    """Yield (first row, end row, bytes, offsets) over a string column, nulls as
    empty texts; a step has about ``limit`` bytes, or one longer text."""
    limit = STEP_BYTES if limit is None else limit
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for top in range(0, len(column), ROWS):
        part = pc.fill_null(column.slice(top, ROWS).cast(pa.large_string()), "")
        n = len(part)
        buffers = part.buffers()
        off = np.frombuffer(buffers[1], np.int64)[part.offset: part.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield top + i, top + j, data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def word_spans(data: np.ndarray, off: np.ndarray):
    """Start, end and text number of each word: a run of bytes outside the white space."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~_WS[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of byte spans, all at once: differences of prefix sums of a
    polynomial with an odd base modulo 2**64, shifted back by the base's inverse."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base & _M64, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) <= 2 * STEP_BYTES or not len(start):
            return self._hash(data, start, end)
        out, i = [], 0  # a long text in blocks of words
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + STEP_BYTES, "right")))
            a = start[i]
            out.append(self._hash(data[a:end[j - 1]], start[i:j] - a, end[i:j] - a))
            i = j
        return np.concatenate(out)

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int):
    """63-bit hashes of the n-word shingles of each text and the texts' bounds in them.

    ``bounds`` has the word offsets of the texts. A text of fewer than n words,
    but at least one, has its whole sequence as its one shingle.
    """
    count = np.diff(bounds)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out = np.concatenate([[0], np.cumsum(made)])
    if not len(words):
        return np.empty(0, np.int64), out
    total = len(words)
    h = mix(words + np.uint64(n))
    width = np.repeat(np.minimum(count, n), count)  # words of the shingle at each place
    for k in range(1, n):
        nxt = np.zeros(total, np.uint64)
        nxt[:max(0, total - k)] = words[k:]
        more = mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt + np.uint64(k))
        h = np.where(width > k, more, mix(h + np.uint64(k)))
    place = np.arange(total) - np.repeat(bounds[:-1], count)
    keep = place < np.repeat(made, count)
    return (h[keep] >> np.uint64(1)).astype(np.int64), out


def word_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n_docs + 1))


class HashArray:
    """A sorted array of hashes; ``find`` gives places, -1 for keys that aren't there."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(mix(keys))
        self.hash = mix(keys)[self.order]
        self.bits = max(1, int(len(keys)).bit_length() + 2)
        tops = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hash):
            return out
        h = mix(keys)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hash[at] == h
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, h = todo[more], at[more] + 1, end[more], h[more]
        return out
