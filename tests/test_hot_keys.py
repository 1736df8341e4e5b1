"""Hot keys: measured cuts, the (lowest prefix, total) fold, and what lands in one window partition."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stockflow.operators import windows as W
from stockflow.plans import ledger as L

T0 = dt.datetime(2026, 1, 1)


def _history(spark, n: int, one_day: bool, far: bool):
    """A third of all movements on one cell; optionally all on one day, or ids far apart."""
    rng = random.Random(n)
    movs, lines = [], []
    for i in range(n):
        v = 1 if i % 3 == 0 else rng.randint(2, 40)
        t = rng.choice(["Entrada", "Salida", "Traslado"])
        at = T0 + dt.timedelta(minutes=rng.randint(0, 500 if one_day else 500_000))
        o = 1 if v == 1 else rng.randint(1, 3)
        movs.append((i, at, t, o, rng.randint(1, 3) if t == "Traslado" else None))
        lines.append((1 if far and i == 0 else 10 ** 12 + i if far else i, rng.randint(1, 9), i, v))
        if i % 5 == 0:
            lines.append(((10 ** 12 if far else 0) + n + i, rng.randint(1, 9), i, v))    # two lines of one movement
    lines += [(10 ** 13, 3, 1, None), (10 ** 13 + 1, None, 1, 2)]
    m = spark.createDataFrame(movs, "id_movimiento long, fecha_hora timestamp_ntz, tipo_movimiento string, "
                                    "id_sucursal_origen long, id_sucursal_destino long")
    d = spark.createDataFrame(lines, "id_detalle long, cantidad int, id_movimiento long, id_variante long")
    legs = []
    head = {r[0]: r for r in movs}
    for i, q, mid, v in lines:
        _, at, t, o, to = head[mid]
        legs.append(((o, v), (at, mid), i, 0, None if q is None else q if t == "Entrada" else -q))
        if t == "Traslado":
            legs.append(((to, v), (at, mid), i, 1, q))
    return m, d, legs


@pytest.mark.parametrize("one_day,far", [(True, False), (False, True)])
def test_running_balance_and_dips_of_hot_cells(spark, one_day, far):
    m, d, legs = _history(spark, 600, one_day, far)
    for limit in (16, 1 << 16):
        got = {(r["id_detalle"], r["leg"]): ((r["id_sucursal"], r["id_variante"]), r["saldo"])
               for r in L.running_balance(m, d, chunk_lines=limit).collect()}
        run, want = {}, {}
        for cell, _, i, leg, x in sorted(legs, key=lambda r: (r[2], r[3])):
            run[cell] = run.get(cell) if x is None else (run.get(cell) or 0) + x
            want[i, leg] = (cell, run[cell])
        assert got == want

        dips = {(r["id_sucursal"], r["id_variante"]): (r["worst"], r["net"]) for r in L.dips(m, d, limit).collect()}
        by_place = {}
        for cell, place, _, _, x in legs:
            by_place.setdefault(cell, {}).setdefault(place, []).append(x)
        for cell, places in by_place.items():
            total, low = 0, None
            for place in sorted(places):
                total += sum(x for x in places[place] if x is not None)
                low = total if low is None else min(low, total)
            assert dips[cell] == (low, total)
        assert len(dips) == len(by_place)


def test_chunks_hold_no_more_than_the_limit_for_any_spread_of_ids(spark):
    rows = [(1, 0, 1)] + [(1, 10 ** 12 + i, 1) for i in range(5000)] + [(2, i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    x = W.ordered_chunks(df, ["k"], ["i"], 64)
    sizes = x.groupBy("k", "_sf_chunk").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    parts = sorted((r["k"], r["_sf_chunk"], r["lo"], r["hi"], r["n"]) for r in sizes.collect())
    assert max(p[4] for p in parts) <= 64 and sum(p[4] for p in parts) == len(rows)
    for a, b in zip(parts, parts[1:]):                     # contiguous in the order
        assert a[0] != b[0] or a[3] < b[2]
    got = {(r["k"], r["i"]): r["running"] for r in W.running_sum_split(df, ["k"], ["i"], "v", limit=64).collect()}
    assert got[1, 10 ** 12 + 4999] == 5001 and got[1, 0] == 1 and got[2, 39] == 40 and len(got) == len(rows)


def test_the_tree_merges_like_one_fold(spark):
    rng = random.Random(2)
    rows = [(k, (rng.randrange(4) << 33 | c) if k else c << 20, rng.randint(-9, 0), rng.randint(-5, 6))
            for k in (None, 0, 1) for c in rng.sample(range(5000), 400)]
    rows = [(k, c, min(low, tot), tot) for k, c, low, tot in {(k, c): (k, c, lo, t) for k, c, lo, t in rows}.values()]
    df = spark.createDataFrame(rows, "k long, _sf_chunk long, _sf_low long, _sf_tot long")
    got = {r["k"]: (r["_sf_low"], r["_sf_tot"]) for r in W.merge_up(df, ["k"]).collect()}
    for key in (None, 0, 1):
        off, low = 0, None
        for _, _, lo, t in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            low = off + lo if low is None else min(low, off + lo)
            off += t
        assert got[key] == (low, off)


def _hot_lines(spark, n: int, receipts: int):
    """A third of the lines on variant 1; ``receipts`` in ten of its lines bring stock, so most sales fall short."""
    from decimal import Decimal
    rng = random.Random(n)
    rows = []
    for i in range(n):
        v = 1 if i % 3 == 0 else rng.randint(2, 60)
        t = "Entrada" if rng.randint(1, 10) <= receipts else rng.choice(["Salida", "Salida", "Traslado"])
        o, d = rng.randint(1, 4), rng.randint(1, 4)
        q = rng.randint(1, 9)
        if rng.random() < 0.01:
            q, d = rng.choice([(0, d), (None, d), (q, None), (-2, d)])
        rows.append((i + 1, v, q, Decimal(rng.choice(["1.00"] * 60 + ["-1.00"])), t, o, d if t == "Traslado" else None))
    return spark.createDataFrame(rows, "id_detalle long, id_variante long, cantidad int, precio_unitario decimal(12,2), "
                                       "tipo_movimiento string, id_sucursal_origen long, id_sucursal_destino long")


@pytest.mark.parametrize("receipts,with_stock", [(2, False), (3, True), (6, True)])
def test_chunked_replay_of_a_hot_variant_equals_the_streamed_one(spark, receipts, with_stock):
    df = _hot_lines(spark, 6000, receipts)
    stock = spark.createDataFrame([(b, v, 40) for b in (1, 2, 3) for v in range(1, 50)],
                                  "id_sucursal long, id_variante long, cantidad_disponible int") if with_stock else None
    cols = [f.name for f in L.FOLD_SCHEMA.fields]
    plain = sorted(tuple(r) for r in L.validate_stock(df, stock).select(*cols).collect())
    hot = L.validate_stock(df, stock, hot_lines=500, chunk_lines=64)
    assert sorted(tuple(r) for r in hot.select(*cols).collect()) == plain
    assert sum(not r[7] for r in plain) > 200


def test_rounds_settle_shortages_and_what_is_left_is_streamed(spark):
    from stockflow.plans import replay as R
    df = L._prepare(_hot_lines(spark, 3000, 3).where("id_variante = 1"), None)
    cols = [f.name for f in L.FOLD_SCHEMA.fields]
    want = sorted(tuple(r) for r in L._whole_variants(df, None, 4).select(*cols).collect())
    for rounds in (1, 2, 16):
        got = R.replay_in_chunks(df, None, 32, rounds).select(*cols)
        assert sorted(tuple(r) for r in got.collect()) == want
    lines = W.ordered_chunks(df, ["id_variante"], ["id_detalle"], 32)
    assert lines.groupBy("_sf_chunk").count().agg(F.max("count")).first()[0] <= 32


def test_covered_chunks_need_no_python(spark):
    from stockflow.plans import replay as R
    df = L._prepare(_hot_lines(spark, 900, 3).where("id_variante = 1 and cantidad > 0 and precio_unitario > 0 and "
                                                    "(tipo_movimiento <> 'Traslado' or id_sucursal_destino is not null)"), None)
    stock = spark.createDataFrame([(b, 1, 10 ** 6) for b in (1, 2, 3, 4)],
                                  "id_sucursal long, id_variante long, cantidad_disponible int")
    seen = []
    kept = R.L.fold
    try:
        R.L.fold = lambda events, n=None: seen.append(events.where("_kind = 1").count()) or kept(events, n)
        got = R.replay_in_chunks(df, stock, 16).where("aceptado")
        assert got.count() == df.count() and seen == [0]
    finally:
        R.L.fold = kept
