"""Registered report and view queries (§ reports/views) with their SQL oracles."""

from __future__ import annotations

from stockflow.plans import report_sql as SQL
from stockflow.plans import reports as R
from stockflow.registry import register
from stockflow.sources.testdata import AS_OF, REPORT3_BRANCH, REPORT3_YEAR


@register("report_revenue_by_brand", SQL.plain(SQL.REVENUE_BY_BRAND))
def report_revenue_by_brand(t):
    """Report 1: revenue by brand over the last quarter before as_of."""
    return R.revenue_by_brand(t, as_of=AS_OF, months=3)


@register("report_unsold_variants", SQL.plain(SQL.UNSOLD_VARIANTS))
def report_unsold_variants(t):
    """Report 2: variants without a sale in the year of as_of."""
    return R.unsold_variants(t, as_of=AS_OF)


@register("report_employee_tickets", SQL.plain(SQL.EMPLOYEE_TICKETS))
def report_employee_tickets(t):
    """Report 3: tickets and revenue per employee of one branch in one year."""
    return R.employee_tickets(t, branch=REPORT3_BRANCH, year=REPORT3_YEAR)


@register("report_low_stock", SQL.plain(SQL.LOW_STOCK))
def report_low_stock(t):
    """Report 4: cells below 35 units."""
    return R.low_stock(t, max_stock=35)


@register("report_brand_by_branch", SQL.plain(SQL.BRAND_BY_BRANCH))
def report_brand_by_branch(t):
    """Report 5: units and revenue per branch name and brand name."""
    return R.brand_by_branch(t)


@register("view_stock", SQL.plain(SQL.VIEW_STOCK))
def view_stock(t):
    """View 1: simplified stock with names only."""
    return R.view_stock(t)


@register("view_movement_audit", SQL.plain(SQL.VIEW_MOVEMENT_AUDIT))
def view_movement_audit(t):
    """View 2: movement audit with masked document and tax id."""
    return R.view_movement_audit(t)


@register("report_filter_selectivity", """
SELECT CAST(count(*) AS BIGINT) AS celdas,
       CAST(sum(CASE WHEN cantidad_disponible < 35 THEN 1 ELSE 0 END) AS BIGINT) AS celdas_bajo_stock,
       round(avg(CASE WHEN cantidad_disponible < 35 THEN 1.0 ELSE 0.0 END), 6) AS selectividad
FROM inventario
""")
def report_filter_selectivity(t):
    """Share of stock cells kept by the low-stock filter."""
    return R.filter_selectivity(t, max_stock=35)
