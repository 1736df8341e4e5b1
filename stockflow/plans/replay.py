"""Parallel replay of hot variants: chunks of lines, summaries, and rounds until all chunks agree.

The reject rule (``s -> s - q`` only if ``s >= q``) makes a line depend on all lines of
its variant before it. Lines are cut into chunks by row counts, and each chunk gets a
summary per branch: the net change and the lowest balance that its consuming lines leave,
were all its valid lines accepted. A *covered* chunk, whose start leaves no balance below
zero, is accepted as a whole: its end is its start plus the net. The others must be
replayed line by line, from a start that the chunks before them decide.

A round has two steps. The *walk* streams each variant's summaries (one row a chunk) and
carries the stock along: covered chunks by their net, others by the end of their last
replay if it began from this start. Where there is no such replay, the walk goes on with
a guess (the end of the last replay, else the balance that rejects just the missing
units), and the chunk is put down for the second step, which replays all these chunks at
once, each in the task of its own (variant, chunk). The first chunk put down has its true
start, so each round settles one chunk of a variant at least; as replays from different
starts mostly meet (a shortage forgets what was there before), a few rounds settle all.
The rounds end when the walk puts nothing down: then every start is the end before it,
and the replay is exact. Where replays don't meet (transfers tie many branches together,
or few lines fall short), a round would settle little; after ``SURE`` rounds the work goes
on only while each halves what is open. What is open then is streamed line by line from
its true start, as a cold variant is. Variants without destinations are cut further: each
of their branches is a replay of its own.

At the end, the lines of covered chunks of valid lines get their balances from windows
inside (chunk, branch), without Python; other chunks are folded line by line from their
starts, in parallel.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.operators import windows as W
from stockflow.plans import ledger as L
from stockflow.schema import CONSUMING_TYPES
from stockflow.session import kept

ROUNDS, SURE = 16, 3
_UNIT = ["id_variante", "_unit"]
_CHUNK = [*_UNIT, "_sf_chunk"]
_NONE = L._NONE


def _valid() -> Column:
    """Lines whose acceptance is a matter of stock alone; they move stock when accepted."""
    t, o, d, q = (F.col(c) for c in ("tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino", "cantidad"))
    return (F.col("_pre").isNull() & F.col("_late").isNull() & F.col("_null").isNull() & (q > 0) & (o != _NONE)
            & F.coalesce((t == "Entrada") | (t == "Salida") | ((t == "Traslado") & (d != _NONE)), F.lit(False)))


def _legs(lines: DataFrame, *keep: str) -> DataFrame:
    """A row for each branch that a line names: its units if the line is accepted, NULL if it can't be."""
    t, q, valid = F.col("tipo_movimiento"), F.col("cantidad").cast("bigint"), _valid()
    takes = t.isin(*CONSUMING_TYPES)
    first = F.struct(F.col("id_sucursal_origen").alias("b"), F.when(valid, F.when(takes, -q).otherwise(q)).alias("delta"),
                     (valid & takes).alias("takes"), F.lit(0).alias("leg"))
    other = F.struct(F.col("id_sucursal_destino").alias("b"), F.when(valid & (t == "Traslado"), q).alias("delta"),
                     F.lit(False).alias("takes"), F.lit(1).alias("leg"))
    return lines.select(*_CHUNK, "_sf_row", *keep, F.inline(F.array(first, other))).where(F.col("b") != _NONE)


def summaries(lines: DataFrame) -> DataFrame:
    """A row per (variant, chunk): branches ``b`` with ``net`` and ``low``; ``plain``: it has valid lines only, each
    with the balances that its type has."""
    run = Window.partitionBy(*_CHUNK, "b").orderBy("_sf_row", "leg").rowsBetween(Window.unboundedPreceding, 0)
    each = (_legs(lines).withColumn("run", F.sum("delta").over(run)).groupBy(*_CHUNK, "b")
            .agg(F.sum("delta").alias("net"), F.min(F.when(F.col("takes"), F.col("run"))).alias("low")))
    branches = each.groupBy(*_CHUNK).agg(F.array_sort(F.collect_list(F.struct("b", "net", "low"))).alias("x"))
    usual = _valid() & ((F.col("tipo_movimiento") == "Traslado") == (F.col("id_sucursal_destino") != _NONE))
    plain = lines.groupBy(*_CHUNK).agg(F.min(F.coalesce(usual, F.lit(False))).alias("plain"))
    return plain.join(branches, _CHUNK, "left").select(
        *_CHUNK, "plain", *[F.coalesce(F.col("x")[c], F.array().cast("array<bigint>")).alias(c) for c in ("b", "net", "low")])


_WALK = "id_variante long, _unit long, _sf_chunk long, covered boolean, todo boolean, s array<long>, all_b array<long>, all_s array<long>"


def _walk(batches):
    """Carry each variant's stock over its chunks (see the module's text); the first chunk put down also
    tells the whole stock of the variant there."""
    now, stock, settled = None, {}, True
    for batch in batches:
        out = {name.split()[0]: [] for name in _WALK.split(", ")}
        for v, unit, kind, chunk, b, net, low, was, end in zip(*(c.to_pylist() for c in batch.columns)):
            if (v, unit) != now:
                now, stock, settled = (v, unit), {}, True
            if kind == 0:
                stock.update(zip(b, net))
                continue
            start = [stock.get(x) for x in b]
            covered = all(lo is None or (s or 0) + lo >= 0 for s, lo in zip(start, low))
            known = was == start and end is not None
            todo = not covered and not known
            whole = todo and settled
            for column, value in zip(out.values(), (v, unit, chunk, covered, todo, start, list(stock) if whole else None,
                                                    list(stock.values()) if whole else None)):
                column.append(value)
            if todo:
                settled = False
            if covered or end is None:
                for x, n, lo in zip(b, net, low):
                    if n is not None:
                        s = stock.get(x, 0)
                        stock[x] = s + n + max(0, -(s + lo) if lo is not None else 0)
            else:
                stock.update((x, e) for x, e in zip(b, end) if e is not None)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(out[c], pa.int64()) for c in _CHUNK], pa.array(out["covered"], pa.bool_()), pa.array(out["todo"], pa.bool_()),
             *[pa.array(out[c], pa.list_(pa.int64())) for c in ("s", "all_b", "all_s")]], names=list(out))


def _ends(batches):
    """The branches and stocks at the end of each (variant, chunk) of sorted events."""
    now, stock = None, {}

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([list(stock)], pa.list_(pa.int64())),
             pa.array([list(stock.values())], pa.list_(pa.int64()))], names=["id_variante", "_sf_chunk", "branches", "stocks"])

    for batch in batches:
        for kind, chunk, v, t, o, d, q, pre, late, null, init in zip(*(c.to_pylist() for c in batch.columns)):
            if (v, chunk) != now:
                if now is not None:
                    yield row()
                now, stock = (v, chunk), {}
            if kind == 0:
                stock[o] = init
            else:
                L.replay_line(stock, t, None if o == _NONE else o, None if d == _NONE else d, q, pre, null, late)
    if now is not None:
        yield row()


def _replayed(todo: DataFrame, lines: DataFrame) -> DataFrame:
    """(variant, chunk, was, end): the line-by-line ends of the chunks of ``todo`` from their starts."""
    events = L.line_events(lines.join(todo.select(*_CHUNK), _CHUNK, "left_semi"), F.col("_sf_chunk"), F.col("_sf_row"))
    events = events.unionByName(L.start_events(_start_rows(todo, "b", "s"), F.col("_sf_chunk")))
    ends = L.in_replay_order(events).select(
        "_kind", "_ck", "id_variante", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino", "cantidad", "_pre",
        "_late", "_null", "_init").mapInArrow(
        _ends, "id_variante long, _sf_chunk long, branches array<long>, stocks array<long>")
    at = F.map_from_arrays("branches", "stocks")
    return todo.join(ends, ["id_variante", "_sf_chunk"]).select(*_CHUNK, F.col("s").alias("was"),
                                          F.transform("b", lambda x: F.try_element_at(at, x)).alias("end"))


def _start_rows(chunks: DataFrame, b: str, s: str) -> DataFrame:
    """Cells that are there at a chunk's start, as stock rows with the chunk's number."""
    return chunks.select(*_CHUNK, F.inline(F.arrays_zip(F.col(b).alias("id_sucursal"),
                                                        F.col(s).alias("cantidad_disponible")))).where(
        F.col("cantidad_disponible").isNotNull())


def replay_in_chunks(lines: DataFrame, stock: DataFrame | None, chunk_lines: int = 1 << 12, rounds: int = ROUNDS) -> DataFrame:
    """Decided lines (``FOLD_SCHEMA``) of prepared ``lines``, whole variants, from their starting ``stock``."""
    alone = lines.groupBy("id_variante").agg((F.max("id_sucursal_destino") == _NONE).alias("alone"))
    lines = lines.join(alone, "id_variante").withColumn(
        "_unit", F.when(F.col("alone"), F.col("id_sucursal_origen")).otherwise(F.lit(_NONE))).drop("alone")
    lines = W.ordered_chunks(lines, _UNIT, ["id_detalle", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino",
                                            "cantidad"], chunk_lines)
    chunks = kept(summaries(lines), "summaries")
    none = F.lit(None).cast("array<bigint>")
    start = None
    if stock is not None:
        cells = stock.withColumn("id_variante", F.col("id_variante").cast("bigint")).join(alone, "id_variante").select(
            "id_variante", F.when(F.col("alone"), F.col("id_sucursal").cast("bigint")).otherwise(F.lit(_NONE)).alias("_unit"),
            F.struct(F.col("id_sucursal").cast("bigint").alias("b"),
                     F.coalesce(F.col("cantidad_disponible").cast("bigint"), F.lit(0)).alias("s")).alias("x"))
        start = cells.groupBy(*_UNIT).agg(F.collect_list("x").alias("x")).select(
            *_UNIT, F.lit(0).alias("kind"), F.lit(_NONE).alias("_sf_chunk"), F.col("x.b").alias("b"),
            F.col("x.s").alias("net"), none.alias("low"), none.alias("was"), none.alias("end"))
    known = chunks.limit(0).select(*_CHUNK, none.alias("was"), none.alias("end"))
    before = None
    for turn in range(rounds):
        steps = chunks.join(known, _CHUNK, "left").select(*_UNIT, F.lit(1).alias("kind"), "_sf_chunk", "b", "net", "low",
                                                          "was", "end")
        steps = steps if start is None else steps.unionByName(start)
        walked = kept(steps.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "kind", "_sf_chunk")
                      .mapInArrow(_walk, _WALK), "walk")
        todo = walked.where("todo").join(chunks.select(*_CHUNK, "b"), _CHUNK)
        left = walked.where("todo").count()
        if not left or turn == rounds - 1 or (turn >= SURE and 2 * left > before):
            break
        before = left
        new = kept(_replayed(todo, lines), "ends")
        known = kept(new.unionByName(known.join(new.select(*_CHUNK), _CHUNK, "left_anti")), "known")
    return _decided(lines, chunks.join(walked, _CHUNK))


def _decided(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    open_from = chunks.where("todo").groupBy(*_UNIT).agg(F.min("_sf_chunk").alias("_open"))
    chunks = chunks.join(open_from, _UNIT, "left")
    late = F.coalesce(F.col("_sf_chunk") >= F.col("_open"), F.lit(False))     # after the last round's first open chunk
    kind = F.when(late, F.lit("stream")).when(F.col("plain") & F.col("covered"), F.lit("plain")).otherwise(F.lit("line"))
    chunks = chunks.withColumn("how", kind)
    of = lines.join(chunks.select(*_CHUNK, "how"), _CHUNK)
    by_unit = F.when(F.col("_unit") == _NONE, F.lit(_NONE)).otherwise(-2 - F.col("_unit"))   # no chunk's number
    by_line = F.when(F.col("how") == "line", F.col("_sf_chunk")).otherwise(by_unit)
    events = L.line_events(of.where("how <> 'plain'"), by_line, F.col("_sf_row"))
    events = events.unionByName(L.start_events(_start_rows(chunks.where("how = 'line'"), "b", "s"), F.col("_sf_chunk")))
    events = events.unionByName(L.start_events(
        _start_rows(chunks.where("how = 'stream' and all_b is not null"), "all_b", "all_s"), by_unit))
    return _balances(of.where("how = 'plain'"), chunks).unionByName(L.fold(events))


def _balances(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """All of ``lines`` accepted, with the balances of their branches."""
    run = Window.partitionBy(*_CHUNK, "b").orderBy("_sf_row", "leg").rowsBetween(Window.unboundedPreceding, 0)
    keep = ["id_detalle", "tipo_movimiento", "id_sucursal_origen", "id_sucursal_destino", "cantidad"]
    legs = _legs(lines, *keep).withColumn("run", F.sum("delta").over(run))
    start = _start_rows(chunks, "b", "s").withColumnsRenamed({"id_sucursal": "b", "cantidad_disponible": "s"})
    after = legs.join(start, [*_CHUNK, "b"], "left").withColumn("saldo", F.coalesce("s", F.lit(0)) + F.col("run"))
    # a transfer to its own branch has two legs on one cell: both columns show the balance after the second
    line = after.groupBy(*_CHUNK, "_sf_row", *keep).agg(
        F.max(F.when(F.col("leg") == 0, F.col("saldo"))).alias("so"), F.max(F.when(F.col("leg") == 1, F.col("saldo"))).alias("sd"))
    o, d, q, t = (F.col(c) for c in ("id_sucursal_origen", "id_sucursal_destino", "cantidad", "tipo_movimiento"))
    return line.select(
        "id_detalle", F.when(F.col("id_variante") != _NONE, F.col("id_variante")).alias("id_variante"), "tipo_movimiento",
        "id_sucursal_origen", F.when(d != _NONE, d).alias("id_sucursal_destino"), "cantidad",
        (F.col("so") - F.when(t == "Entrada", q).otherwise(-q)).cast("bigint").alias("disponible"),
        F.lit(True).alias("aceptado"), F.lit(None).cast("string").alias("motivo"),
        F.when(o == d, F.col("sd")).otherwise(F.col("so")).cast("bigint").alias("saldo_origen"),
        F.col("sd").cast("bigint").alias("saldo_destino"))


# The walk and the fold run in Python workers, which may not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
