"""Operator 9, SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (a run of marks for spaces and what follows up
to the next) are concatenated; pieces never have a mark after another character,
so no piece reaches over a segment's start. A suffix array of that text, to the
depth of the longest piece, is searched for every piece at once, character by
character, which gives each piece's range of occurrences. The occurrences are the
edges (start, length, piece); they are put in order of position and length.
Relaxing then contracts edges: in each round every stretch takes, of the edges
that join two neighbouring symbols, the one of the best score (the leftmost of
equals), until no edge is left, which is what the library does with its queue. A
stretch ends where no edge crosses. Characters without a piece become their
bytes' pieces. The result equals the library's own encoding.

Defined cases: null text gives null ids and null decoded text; empty text gives
no pieces; a text that holds the mark itself decodes to a space in its place, as
with the library, so it doesn't round-trip; stretches of over ``LONG`` symbols
are contracted with a queue; extra columns are kept; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stockflow.llm.common import table

#: Where this machine has the public vocabulary; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
STEP_CHARS = 512 << 10
CHUNK_CHARS = 512 << 10
KEEP_SEGMENTS = 100_000   # encoded segments that a task keeps between steps
LONG = 400
_NONE = np.int64(1) << 40


class Vocabulary:
    """Pieces of a BPE model with byte fallback, as arrays that travel to the tasks."""

    def __init__(self, model_file: str):
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.vocab_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.surface, pieces, scores = [], [], []
        for i in range(size):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i):
                self.surface.append(b"")
            elif m.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(p.replace(MARK, " ").encode())
                pieces.append((p, i))
                scores.append(m.get_score(i))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces):
            raise ValueError("a piece has a mark after another character")
        self.ids = np.array([i for _, i in pieces], np.int32)
        #: Order of contraction: 0 is the best score; equal scores are equal.
        self.order = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64)
        self.lengths = np.array([len(p) for p, _ in pieces], np.int64)
        self.depth = int(self.lengths.max())
        #: The characters of all pieces, in order.
        self.alphabet = np.unique(np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le"), np.uint32))
        if len(self.alphabet) > 65000:
            raise ValueError("more characters than 16-bit codes")
        self.codes = np.zeros((len(pieces), self.depth), np.int32)
        for k, (p, _) in enumerate(pieces):
            self.codes[k, :len(p)] = self.coded(np.frombuffer(p.encode("utf-32-le"), np.uint32))

    def coded(self, points: np.ndarray) -> np.ndarray:
        """2 and up: characters that pieces have, in order; 1: all others. 0 ends a segment."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, 1).astype(np.int32)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (codes below 2**16) in order of their next ``depth``
    symbols or more: four at once first, then by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(4, text.dtype)]).astype(np.uint64)
    key = (padded[:n] << np.uint64(48)) | (padded[1:n + 1] << np.uint64(32)) | (padded[2:n + 2] << np.uint64(16)) | padded[3:n + 3]
    h = 4
    while True:
        order = np.argsort(key)
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        if h >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        nxt = np.zeros(n, np.int64)
        nxt[:max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 2) + nxt
        h *= 2


def occurrences(text: np.ndarray, vocab: Vocabulary):
    """Edges of all pieces in ``text``: start and number of the piece."""
    sa = suffix_array(text, vocab.depth)
    padded = np.concatenate([text, np.zeros(vocab.depth, text.dtype)])
    live = np.arange(len(vocab.codes))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    starts, which = [], []
    for j in range(vocab.depth + 1):
        done = vocab.lengths[live] == j
        if done.any():
            a, b = lo[done], hi[done]
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            starts.append(sa[at])
            which.append(np.repeat(live[done], n))
        keep = ~done & (lo < hi)
        live, lo, hi = live[keep], lo[keep], hi[keep]
        if not len(live):
            break
        want = vocab.codes[live, j]
        bounds = []
        for past in (False, True):  # first place not below, first place above
            a, b = lo.copy(), hi.copy()
            while (todo := np.flatnonzero(a < b)).size:
                mid = (a[todo] + b[todo]) >> 1
                got = padded[sa[mid] + j]
                up = got <= want[todo] if past else got < want[todo]
                a[todo[up]] = mid[up] + 1
                b[todo[~up]] = mid[~up]
            bounds.append(a)
        lo, hi = bounds
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(which)


def _contract_long(first: int, n: int, edges: np.ndarray, order: np.ndarray, begins: np.ndarray):
    """Contract one long stretch with a queue of edges; clears ``begins`` in place."""
    depth = edges.shape[1]
    size = [1] * n
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []

    def offer(i):
        j = right[i]
        if i >= 0 and j < n and size[i] + size[j] <= depth:
            e = edges[first + i, size[i] + size[j] - 1]
            if e >= 0:
                heapq.heappush(queue, (order[e], i, size[i], size[j]))
    for i in range(n):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        if size[i] != a or right[i] >= n or size[right[i]] != b:
            continue
        j = right[i]
        size[i], size[j] = a + b, 0
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        begins[first + j] = False
        if left[i] >= 0:
            offer(left[i])
        offer(i)


def contract(text: np.ndarray, edges: np.ndarray, order: np.ndarray, crossed: np.ndarray) -> np.ndarray:
    """True where a symbol begins once no edge can be contracted any more."""
    n, depth = edges.shape
    begins = text > 0
    # a stretch begins where no edge of two or more characters crosses from the left
    heads = np.flatnonzero(begins & ~crossed)
    tails = np.flatnonzero(begins & ~np.concatenate([crossed[1:], [False]])) + 1
    length = tails - heads
    for i in np.flatnonzero(length > LONG):
        _contract_long(int(heads[i]), int(length[i]), edges, order, begins)
    mine = (length > 1) & (length <= LONG)
    heads, length = heads[mine], length[mine]
    while len(heads):
        total = int(length.sum())
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        pos = np.repeat(heads - first, length) + np.arange(total)
        pos = pos[begins[pos]]
        stretch_of = np.searchsorted(heads, pos, "right") - 1
        pair = np.flatnonzero(stretch_of[1:] == stretch_of[:-1])
        end = (heads + length)[stretch_of]
        nxt = np.append(pos[1:], 0)
        last = np.append(stretch_of[1:] != stretch_of[:-1], True)
        stop = np.where(last, end, nxt)  # where each symbol ends
        joined = stop[pair + 1] - pos[pair]
        fits = joined <= depth
        pair, joined = pair[fits], joined[fits]
        edge = edges[pos[pair], joined - 1].astype(np.int64)
        real = edge >= 0
        pair, edge = pair[real], edge[real]
        if not len(pair):
            break
        own = stretch_of[pair]
        groups = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        key = order[edge] * _NONE + pair
        best = np.minimum.reduceat(key, groups) % _NONE
        begins[pos[best + 1]] = False
        heads, length = heads[own[groups]], length[own[groups]]
    return begins


def encode_segments(segments: list[str], vocab: Vocabulary):
    """Piece ids of all segments in one row and the segments' offsets in it."""
    points = np.frombuffer("\0".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    seg_start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(lens) else np.empty(0, np.int64)
    text = vocab.coded(points)
    ends = (seg_start + lens)[:-1]
    text[ends] = 0
    start, piece = occurrences(text, vocab)
    n, length = len(text), vocab.lengths[piece]
    edges = np.full((n, vocab.depth), -1, np.int16 if len(vocab.ids) < 32768 else np.int32)
    edges[start, length - 1] = piece
    over = np.zeros(n + 1, np.int64)
    np.add.at(over, start + 1, 1)
    np.add.at(over, start + length, -1)
    crossed = np.cumsum(over)[:n] > 0
    begins = contract(text, edges, vocab.order, crossed)
    pos = np.flatnonzero(begins)
    stop = np.append(pos[1:], n)
    if len(ends):  # the separator after a segment ends its last symbol
        at = np.searchsorted(pos, seg_start[1:]) - 1
        stop[at[lens[:-1] > 0]] = ends[lens[:-1] > 0]
    got = edges[pos, np.minimum(stop - pos, vocab.depth) - 1].astype(np.int64)
    ids = np.where(got >= 0, vocab.ids[got], -1)
    unknown = np.flatnonzero(ids < 0)
    counts = np.ones(len(ids), np.int64)
    if len(unknown):
        raw = [chr(c).encode("utf-8", "replace") for c in points[pos[unknown]]]
        counts[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, counts)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])[unknown]
        where = np.concatenate([np.arange(a, a + len(r)) for a, r in zip(at, raw)])
        out[where] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    else:
        out = ids
    cum = np.concatenate([[0], np.cumsum(counts)])
    bounds = cum[np.searchsorted(pos, np.append(seg_start, n))]
    return out.astype(np.int32), bounds


def _split(text: str) -> list[str]:
    """Keys of a text's segments: the word after a single mark, or the segment itself when it begins with more."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    runs = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
    return [s if s[1:2] == MARK else s[1:] for s in runs]


class SegmentCoder:
    """Encodes texts; the segments of earlier texts are kept, up to KEEP_SEGMENTS of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self):
        self.index: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32)]
        self.bounds = [np.zeros(1, np.int64)]

    def _learn(self, keys: list[str]):
        segments = [k if k[:1] == MARK else MARK + k for k in keys]
        first = size = 0
        for i, s in enumerate(segments):
            size += len(s) + 1
            if size >= CHUNK_CHARS or i == len(segments) - 1:
                flat, b = encode_segments(segments[first:i + 1], self.vocab)
                self.flat.append(flat)
                self.bounds.append(b[1:] + self.bounds[-1][-1])
                first, size = i + 1, 0
        self.flat, self.bounds = [np.concatenate(self.flat)], [np.concatenate(self.bounds)]

    def __call__(self, texts: list):
        """Flat ids and offsets for a list of texts (None as empty)."""
        if len(self.index) > KEEP_SEGMENTS:
            self._forget()
        index, known = self.index, len(self.index)
        words, counts = [], []
        for t in texts:
            own = _split(t or "")
            counts.append(len(own))
            words += own
        for w in words:
            if w not in index:
                index[w] = len(index)
        self._learn(list(islice(index, known, None)))
        flat, bounds = self.flat[0], self.bounds[0]
        seg = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        del words
        start = bounds[seg]
        n = bounds[seg + 1] - start
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start - ends + n, n) + np.arange(total)] if total else flat[:0]
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[cuts]


def encode_texts(texts: list, vocab: Vocabulary):
    return SegmentCoder(vocab)(texts)


def _steps(column):
    """Lists of texts of about STEP_CHARS, as Python strings."""
    out, size = [], 0
    for t in column:
        out.append(t.as_py())
        size += len(out[-1] or "")
        if size >= STEP_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    if name in schema.fieldNames():
        raise ValueError(f"the table has a column {name} already; name another")
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", out: str = "piece_ids", model_file: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of column ``text`` in a new column ``out`` (array<int>)."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))  # of the vocabulary's size
    at = docs.columns.index(text)

    def run(batches):
        coder = SegmentCoder(vocab.value)
        for batch in batches:
            done = 0
            for texts in _steps(batch.column(at)):
                flat, off = coder(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()),
                                                 mask=pc.is_null(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])
    return docs.mapInArrow(run, _with(docs.schema, out, T.ArrayType(T.IntegerType())))


class Surfaces:
    """The bytes of all pieces, and once more as the first of a text: without the space put before every text."""

    def __init__(self, surface: list[bytes]):
        both = surface + [s[1:] if s[:1] == b" " else s for s in surface]
        self.n = len(surface)
        self.bytes = np.frombuffer(b"".join(both), np.uint8)
        self.size = np.array([len(s) for s in both], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def texts(self, lists):
        """Texts of a list column of piece ids."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = np.array(lists.flatten()).astype(np.int64)
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(n)])
        flat[off[:-1][n > 0]] += self.n
        size = self.size[flat]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.start[flat] - ends + size, size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[off].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.array(out, pa.string(), mask=np.asarray(pc.is_null(lists)))


def decode(rows: DataFrame, ids: str = "piece_ids", out: str = "decoded", model_file: str = MODEL) -> DataFrame:
    """``rows`` with the text of the piece ids in column ``ids`` in a new column ``out``."""
    held = rows.sparkSession.sparkContext.broadcast(Surfaces(Vocabulary(model_file).surface))  # of its size
    at = rows.columns.index(ids)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, held.value.texts(part.column(at))],
                                                 names=[*part.schema.names, out])
    return rows.mapInArrow(run, _with(rows.schema, out, T.StringType()))


def encode_and_decode(docs: DataFrame, text: str = "text", model_file: str = MODEL) -> DataFrame:
    """``docs`` with piece_ids, n_pieces and round_trip: the text decoded from the
    pieces equals the text. Both ways run in one task, so no text is sent back."""
    vocab = Vocabulary(model_file)
    held = docs.sparkSession.sparkContext.broadcast((vocab, Surfaces(vocab.surface)))  # of the vocabulary's size
    at = docs.columns.index(text)

    def run(batches):
        coder, surfaces = SegmentCoder(held.value[0]), held.value[1]
        for batch in batches:
            done = 0
            for texts in _steps(batch.column(at)):
                flat, off = coder(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                null = pc.is_null(part.column(at))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, pa.int32()), mask=null)
                same = [a == b for a, b in zip(surfaces.texts(lists).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists, pa.array(np.diff(off)), pa.array(same, pa.bool_())],
                    names=[*part.schema.names, "piece_ids", "n_pieces", "round_trip"])
    schema = _with(_with(_with(docs.schema, "piece_ids", T.ArrayType(T.IntegerType())), "n_pieces", T.LongType()),
                   "round_trip", T.BooleanType())
    return docs.mapInArrow(run, schema)


def op9_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_and_decode(docs).select("doc_id", "n_pieces", "round_trip", "piece_ids")


QUERIES = {"op9_suffix_array_pieces": (op9_suffix_array_pieces, None)}
