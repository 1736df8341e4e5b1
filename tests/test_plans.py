"""Plan shape of the five reports on stored tables.

The lines are the one fact that grows with the data: no report may broadcast
them (or a set derived from them without an aggregation first). Spark
estimates an inner join as the product of its inputs, so a header side built
with inner joins can look bigger than the lines and make Spark pick the lines
as the build side; these checks catch that.
"""

from __future__ import annotations

import re

import pytest

from stockflow.plans import ledger as L
from stockflow.plans import quality as Q
from stockflow.plans import reports as R
from stockflow.session import ensure_checkpoint_dir
from stockflow.sources import files as FS
from stockflow.sources.testdata import AS_OF, REPORT3_BRANCH, REPORT3_YEAR, from_frames, load_tables

from .conftest import SF_SMALL

STORED = ["marcas", "categorias", "talles", "colores", "sucursales", "proveedores", "empleados", "productos",
          "producto_variante", "inventario", "movimientos", "detalle_movimientos", "dim_variante"]


@pytest.fixture(scope="module")
def stored(spark):
    src = load_tables(spark, SF_SMALL)
    vdir = FS.new_version_dir(ensure_checkpoint_dir(spark).rstrip("/") + "/plan-tests")
    for n in STORED:
        src[n].write.mode("errorifexists").parquet(f"{vdir}/{n}")
    return from_frames({n: spark.read.parquet(f"{vdir}/{n}") for n in STORED})


def _kids(p):
    c = p.children()
    return [c.apply(i) for i in range(c.size())]


def _unwrap(p):
    return p.initialPlan() if p.nodeName().startswith("AdaptiveSparkPlan") else p


def _tables_read_unaggregated(p) -> set[str]:
    """Stored tables scanned below ``p`` without an aggregation in between."""
    p = _unwrap(p)
    if "Aggregate" in p.nodeName():
        return set()
    out = set()
    if "Scan" in p.nodeName():
        roots = p.relation().location().rootPaths()     # the plan text shortens long paths
        out |= {roots.apply(i).getName() for i in range(roots.size())}
    for k in _kids(p):
        out |= _tables_read_unaggregated(k)
    return out


def _broadcast_sides(p, found=None) -> list[set[str]]:
    found = [] if found is None else found
    p = _unwrap(p)
    if p.nodeName() == "BroadcastExchange":
        found.append(_tables_read_unaggregated(p))
    for k in _kids(p):
        _broadcast_sides(k, found)
    return found


REPORTS = {
    "revenue_by_brand": lambda t: R.revenue_by_brand(t, as_of=AS_OF),
    "unsold_variants": lambda t: R.unsold_variants(t, as_of=AS_OF),
    "employee_tickets": lambda t: R.employee_tickets(t, REPORT3_BRANCH, REPORT3_YEAR),
    "low_stock": lambda t: R.low_stock(t, 35),
    "brand_by_branch": lambda t: R.brand_by_branch(t),
}


LEDGER_AND_CHECKS = {
    "view_stock": lambda t: R.view_stock(t),
    "view_movement_audit": lambda t: R.view_movement_audit(t),
    "final_stock": lambda t: L.final_stock(t["movimientos"], t["detalle_movimientos"], 2),
    "validate_stock": lambda t: L.validate_stock(
        L.lines_with_header(t["movimientos"], t["detalle_movimientos"],
                            ["id_detalle", "id_movimiento", "id_variante", "cantidad", "precio_unitario"]),
        stock=None, pv=t["producto_variante"], split=False),
    "foreign_key": lambda t: Q.foreign_key(t),
    "reconcile": lambda t: Q.reconcile(t["inventario"], L.net_stock(t["movimientos"], t["detalle_movimientos"])),
}
PLANS = {**REPORTS, **LEDGER_AND_CHECKS}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_lines_are_never_broadcast(stored, name):
    plan = PLANS[name](stored)._jdf.queryExecution().executedPlan()
    sides = _broadcast_sides(plan)
    assert all("detalle_movimientos" not in s for s in sides), (name, sides)


def test_report_3_broadcasts_the_filtered_headers(stored):
    plan = REPORTS["employee_tickets"](stored)._jdf.queryExecution().executedPlan()
    assert any("movimientos" in s for s in _broadcast_sides(plan))


def test_report_2_anti_joins_distinct_variants(stored):
    plan = REPORTS["unsold_variants"](stored)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "LeftAnti" in text
    assert re.search(r"HashAggregate\(keys=\[id_variante", text), text
