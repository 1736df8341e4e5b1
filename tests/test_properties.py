"""Properties of the ledger, checked against a plain-Python replay written for the test."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockflow.operators import windows as W
from stockflow.operators.ids import id_assign
from stockflow.operators.sorts import global_rank
from stockflow.plans import ledger as L

LINE_SCHEMA = ("id_detalle long, id_variante long, cantidad int, precio_unitario decimal(12,2), "
               "tipo_movimiento string, id_sucursal_origen long, id_sucursal_destino long")

line = st.tuples(st.integers(1, 3),                      # variant
                 st.sampled_from(["Entrada", "Salida", "Traslado"]),
                 st.integers(1, 3), st.integers(1, 3),    # origin, destination
                 st.integers(1, 6))                       # quantity


def brute_force(lines, start):
    """Straight replay in id order: the rule, independent of the Spark fold."""
    stock = dict(start)
    out = {}
    for i, v, t, o, d, q in sorted(lines):
        avail = stock.get((o, v), 0)
        ok = not (t in ("Salida", "Traslado") and avail < q)
        if ok:
            if t == "Entrada":
                stock[(o, v)] = avail + q
            else:
                if (o, v) in stock:
                    stock[(o, v)] -= q
                if t == "Traslado":
                    stock[(d, v)] = stock.get((d, v), 0) + q
        out[i] = (ok, avail)
    return out, stock


def _frame(spark, raw):
    rows = [(i + 1, v, q, Decimal("1.00"), t, o, d if t == "Traslado" else None) for i, (v, t, o, d, q) in
            enumerate(raw)]
    return spark.createDataFrame(rows, LINE_SCHEMA), [(r[0], r[1], r[4], r[5], r[6], r[2]) for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line, min_size=1, max_size=40), st.integers(0, 4))
def test_fold_matches_brute_force_any_partitioning(spark, raw, start_qty):
    df, plain = _frame(spark, raw)
    start = {(b, v): start_qty for b in (1, 2) for v in (1, 2, 3)}
    stock = spark.createDataFrame([(b, v, q) for (b, v), q in start.items()],
                                  "id_sucursal long, id_variante long, cantidad_disponible int")
    expect, final = brute_force(plain, start)
    for parts, split in ((1, False), (5, False), (3, True)):
        got = {r["id_detalle"]: (r["aceptado"], r["disponible"])
               for r in L.validate_stock(df, stock=stock, num_partitions=parts, split=split, chunk_lines=8).collect()}
        assert got == expect
    # accepted lines applied to the start never leave a cell below zero, and equal the replay
    dec = L.validate_stock(df, stock=stock)
    new = {(r["id_sucursal"], r["id_variante"]): r["cantidad_disponible"]
           for r in L.apply_accepted(stock, dec).collect()}
    assert all(q >= 0 for q in new.values())
    assert {k: v for k, v in new.items() if v} == {k: v for k, v in final.items() if v}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line, min_size=1, max_size=40), st.integers(0, 4), st.booleans())
def test_split_replay_equals_plain_fold_row_for_row(spark, raw, start_qty, with_stock):
    """The split path (window-decided prefix + replayed suffix) gives exactly
    the rows of the plain fold, balances and reasons included."""
    df, _ = _frame(spark, raw)
    stock = None
    if with_stock:
        stock = spark.createDataFrame([(b, v, start_qty) for b in (1, 2) for v in (1, 2, 3)],
                                      "id_sucursal long, id_variante long, cantidad_disponible int")
    cols = [f.name for f in L.FOLD_SCHEMA.fields]
    plain = sorted(tuple(r) for r in L.validate_stock(df, stock=stock, split=False).select(*cols).collect())
    split = sorted(tuple(r) for r in L.validate_stock(df, stock=stock, split=True, chunk_lines=4)
                   .select(*cols).collect())
    assert split == plain


T0 = dt.datetime(2026, 1, 1)


def _history(spark, raw):
    movs, lines = [], []
    for i, (v, t, o, d, q) in enumerate(raw):
        mid = 100 + i
        movs.append((mid, T0 + dt.timedelta(hours=i % 7), t, o, d if t == "Traslado" else None))
        lines.append((i + 1, q, mid, v))
    m = spark.createDataFrame(movs, "id_movimiento long, fecha_hora timestamp_ntz, tipo_movimiento string, "
                                    "id_sucursal_origen long, id_sucursal_destino long")
    d = spark.createDataFrame(lines, "id_detalle long, cantidad int, id_movimiento long, id_variante long")
    return m, d


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(line, min_size=1, max_size=30))
def test_net_equals_last_running_balance_and_opening_covers_dips(spark, raw):
    m, d = _history(spark, raw)
    net = {(r["id_sucursal"], r["id_variante"]): r["cantidad"] for r in L.net_stock(m, d).collect()}
    rb = L.running_balance(m, d, chunk_lines=3).collect()
    last = {}
    for r in sorted(rb, key=lambda r: (r["id_detalle"], r["leg"])):
        last[(r["id_sucursal"], r["id_variante"])] = r["saldo"]
    assert last == net
    # opening = -worst dip + buffer: replaying with it never goes below the buffer
    op = {(r["id_sucursal"], r["id_variante"]): r["cantidad_apertura"] for r in L.opening_stock(m, d, 2).collect()}
    assert all(v >= 2 for v in op.values())
    fin = {(r["id_sucursal"], r["id_variante"]): r["cantidad_disponible"] for r in L.final_stock(m, d, 2).collect()}
    assert all(v >= 2 for v in fin.values())
    assert all(fin[k] == op[k] + net[k] for k in fin)


def test_chunked_running_sum_equals_plain(spark):
    rows = [(k % 3, i, (i * 7) % 11 - 5) for i, k in enumerate(range(200))]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    plain = {(r["k"], r["o"]): r["running"] for r in W.running_sum(df, ["k"], ["o"], "v").collect()}
    chunked = {(r["k"], r["o"]): r["running"]
               for r in W.running_sum(df, ["k"], ["o"], "v", chunk=F.floor(F.col("o") / 16)).collect()}
    assert plain == chunked
    pm = {r["k"]: (r["worst"], r["net"]) for r in
          W.prefix_min_and_total(df, ["k"], ["o"], "v", chunk=F.floor(F.col("o") / 7)).collect()}
    for k in range(3):
        run, lo = 0, None
        for _, o, v in sorted(r for r in rows if r[0] == k):
            run += v
            lo = run if lo is None else min(lo, run)
        assert pm[k] == (lo, run)


def test_id_assign_two_pass_is_dense_and_ordered(spark):
    rows = [(i % 5, (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "day long, x long, payload long")
    out = id_assign(df, ["day", "x", "payload"], "id", bucket=["day"]).collect()
    ids = sorted(r["id"] for r in out)
    assert ids == list(range(1, 301))
    by_id = sorted(out, key=lambda r: r["id"])
    keys = [(r["day"], r["x"], r["payload"]) for r in by_id]
    assert keys == sorted(keys)


def test_global_rank_bucketed_equals_plain(spark):
    rows = [(f"b{i % 4}", (i * 13) % 9) for i in range(120)]
    df = spark.createDataFrame(rows, "b string, v long")
    order = [F.col("b").asc(), F.col("v").desc()]
    a = sorted(tuple(r) for r in global_rank(df, order).collect())
    b = sorted(tuple(r) for r in global_rank(df, order, bucket=[F.col("b")]).collect())
    assert a == b
