"""What a task gets, and how many rounds a job takes, must not follow the size of the tables."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from stockflow import registry
from stockflow.operators.ids import id_assign
from stockflow.plans import jobs as J
from stockflow.plans import ledger as L
from stockflow.plans import ledger_queries as LQ
from stockflow.sources import testdata as TD
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_inventory_is_dealt_by_the_stored_size_of_the_lines(spark, monkeypatch):
    size = os.path.getsize(f"{SF_SMALL}/lineitem.parquet")
    usual = _rows(TD.load_tables(spark, SF_SMALL)["inventario"])
    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-size // 40))
    t = TD.load_tables(spark, SF_SMALL)
    plan = t["inventario"]._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(dealt) == 3 and set(dealt) == {40}
    assert _rows(t["inventario"]) == usual
    assert _rows(L.final_stock(t["movimientos"], t["detalle_lineas"], TD.OPENING_BUFFER)) == usual


def test_the_line_ids_are_dealt_by_the_stored_size_of_the_lines(spark, monkeypatch):
    size = os.path.getsize(f"{SF_SMALL}/lineitem.parquet")
    usual = _rows(TD.load_tables(spark, SF_SMALL)["detalle_movimientos"])
    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-size // 40))
    numbered = TD.load_tables(spark, SF_SMALL)["detalle_movimientos"]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#\w+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert set(dealt) == {("l_orderkey", "40"), ("_sf_b", "40")}        # the join with the headers, the numbering
    assert _rows(numbered) == usual


@pytest.fixture()
def many_partitions(spark):
    """More of Spark's own partitions than a size deals, and no side small enough to broadcast."""
    own = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _dealt(df, key):
    """Why rows are dealt by ``key`` (the sums of counts left out), and to how many partitions at least."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = [re.search(rf"Exchange hashpartitioning\({key}#\w+, (\d+)\), (\w+)", line) for line in plan]
    found = [m.groups() for m, below in zip(found, plan[1:]) if m and "partial_" not in below]
    return {why for _, why in found}, min(int(n) for n, _ in found)


#: Dealt to 40 partitions or more, that Spark doesn't join to larger ones.
BY_SIZE = ({"REPARTITION_BY_NUM"}, 40)


def test_numbered_rows_are_dealt_once(spark, many_partitions):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    df = df.withColumn("a", F.floor(F.col("k") / 100)).withColumn("b", F.floor(F.col("k") / 10))
    numbered = id_assign(df, ["k"], bucket=["a", "b"], tasks=40)
    why, least = _dealt(numbered, "_sf_b")
    assert why == {"REPARTITION_BY_NUM"} and least >= 40
    assert _rows(numbered.select("k", "id")) == sorted(((k, k + 1) for k in range(1000)), key=str)


@pytest.mark.parametrize("tipo", ["Entrada", "Traslado", "Salida"])
def test_requests_are_dealt_by_the_stored_size_of_the_lines(spark, monkeypatch, many_partitions, tipo):
    usual = _rows(LQ._requests(TD.load_tables(spark, SF_SMALL), tipo))
    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-os.path.getsize(f"{SF_SMALL}/lineitem.parquet") // 40))
    requests = LQ._requests(TD.load_tables(spark, SF_SMALL), tipo)
    assert _dealt(requests, "id_movimiento") == BY_SIZE
    assert _rows(requests) == usual


@pytest.mark.parametrize("name", ["job_receive", "job_reject_policy", "job_reject_policy_rows", "job_result_messages",
                                  "job_sell", "job_transfer"])
def test_a_job_numbers_its_requests_in_tasks_by_size(spark, monkeypatch, name):
    """In buckets that spread over the tasks."""
    class Numbered(Exception):
        pass

    def id_continue(df, *args, **how):
        raise Numbered(how.get("tasks"), len(how["bucket"]))

    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-os.path.getsize(f"{SF_SMALL}/lineitem.parquet") // 40))
    monkeypatch.setattr(J, "id_continue", id_continue)
    with pytest.raises(Numbered) as e:
        registry.queries()[name](spark, SF_SMALL)
    assert e.value.args == (40, 2)


def test_a_job_dealt_by_size_has_the_same_rows(spark, monkeypatch):
    usual = _rows(registry.queries()["job_transfer"](spark, SF_SMALL))
    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-os.path.getsize(f"{SF_SMALL}/lineitem.parquet") // 40))
    assert _rows(registry.queries()["job_transfer"](spark, SF_SMALL)) == usual


def test_the_movements_are_dealt_by_the_stored_size_of_the_lines(spark, monkeypatch, many_partitions):
    usual = _rows(TD.load_tables(spark, SF_SMALL)["movimientos"])
    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-os.path.getsize(f"{SF_SMALL}/lineitem.parquet") // 40))
    movements = TD.load_tables(spark, SF_SMALL)["movimientos"]
    assert _dealt(movements, "l_orderkey") == _dealt(movements, "o_orderkey") == BY_SIZE
    assert _rows(movements) == usual


#: Queries that take their stock from the derived inventory.
OF_THE_INVENTORY = [
    "chk_generated_invariants", "chk_no_negative_stock", "chk_no_negative_stock_dirty", "chk_not_null",
    "chk_not_null_dirty", "chk_numeric", "chk_numeric_dirty", "chk_tables_present", "flt_cell", "flt_low_stock",
    "job_receive", "job_reject_policy", "job_reject_policy_rows", "job_result_messages", "job_sell", "job_transfer"]


@pytest.mark.parametrize("name", OF_THE_INVENTORY)
def test_a_query_deals_its_inventory_by_the_stored_size_of_the_lines(spark, monkeypatch, name):
    class Dealt(Exception):
        pass

    def final_stock(mov, det, **how):
        raise Dealt(how.get("tasks"))

    monkeypatch.setattr(TD, "BYTES_A_TASK", -(-os.path.getsize(f"{SF_SMALL}/lineitem.parquet") // 40))
    monkeypatch.setattr(L, "final_stock", final_stock)
    with pytest.raises(Dealt, match="^40$"):
        registry.queries()[name](spark, SF_SMALL)


def test_headers_are_the_movements_without_the_suppliers(spark):
    t = TD.load_tables(spark, SF_SMALL)
    columns = t["cabeceras"].columns
    assert _rows(t["cabeceras"]) == _rows(t["movimientos"].select(*columns))
    assert "id_proveedor" not in columns and "observaciones" not in columns


def test_lines_of_one_movement_count_together(spark):
    """Also in chunks, and where the movement, its day or a quantity is null, or the header is there twice."""
    mov = spark.sql("""select * from values
        (1L, timestamp'2001-01-01 10:00:00', 'Salida', 1L, null), (2L, timestamp'2001-01-01 10:00:00', 'Entrada', 1L, null),
        (3L, timestamp'2001-01-03 10:00:00', 'Traslado', 1L, 2L), (4L, null, 'Salida', 2L, null), (4L, null, 'Salida', 2L, null),
        (5L, timestamp'2001-01-03 10:00:00', 'Salida', null, null)
        t(id_movimiento, fecha_hora, tipo_movimiento, id_sucursal_origen, id_sucursal_destino)""")
    det = spark.sql("""select * from values (1L, 7L, 3), (1L, 7L, 2), (2L, 7L, 9), (2L, 7L, null), (3L, 7L, 8), (3L, 7L, 1),
        (4L, 7L, 1), (4L, 7L, null), (5L, 7L, 4) t(id_movimiento, id_variante, cantidad)""")
    want = [(1, 7, -5, -5), (2, 7, -2, 7)]
    for how in ({}, {"chunk_lines": None}, {"chunk_lines": None, "tasks": 5}):
        assert _rows(L.worst_dip(mov, det, **how)) == want


def test_the_opening_and_the_history_are_made_once_for_the_replay(spark, monkeypatch):
    """Headers, numbered lines, the count of hot variants and the replay read what was stored."""
    from stockflow.plans import operator_queries as OQ
    seen = {}

    def validate(lines, **how):
        seen["plan"] = lines._jdf.queryExecution().optimizedPlan().toString()
        seen["count_on"] = how.get("count_on")
        return validate_stock(lines, **how)

    validate_stock = L.validate_stock
    monkeypatch.setattr(L, "validate_stock", validate)
    assert OQ.opening_replay(TD.load_tables(spark, SF_SMALL)).collect()[0]["rechazadas"] == 0
    assert seen["count_on"] is not None and "l_orderkey" not in seen["plan"] and "l_suppkey" not in seen["plan"]


def test_a_stream_makes_few_calls_and_keeps_its_static_side(spark, monkeypatch):
    """The state is keyed by buckets of variants, and what doesn't arrive isn't made again in each micro-batch."""
    from stockflow.streaming import ledger_stream as LS
    from stockflow.streaming import queries as SQ
    plans = []
    run = SQ._run_to_parquet
    monkeypatch.setattr(SQ, "_run_to_parquet", lambda df, what: plans.append(
        df._jdf.queryExecution().analyzed().toString()) or run(df, what))
    t = TD.load_tables(spark, SF_SMALL)
    assert SQ.stream_fill_price(t).count() == t["detalle_lineas"].count()
    assert "p_partkey" not in plans[0] and "Aggregate" not in plans[0]
    path, stream = SQ._land(SQ._lines(t).select(*LS.LINE_COLUMNS), "few", order="id_detalle")
    decided = LS.stream_stock_ledger(stream, pv=SQ._variants(t))
    text = decided._jdf.queryExecution().analyzed().toString()
    assert "ev_bucket" in text and "p_partkey" not in text
