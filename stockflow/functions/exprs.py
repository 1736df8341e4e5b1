"""Scalar column functions (built-in Spark expressions only, all codegen'd).

Each takes and returns ``Column`` objects so they compose inside
``select``/``withColumn`` and stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockflow.schema import MONEY

ColOrName = Column | str


def _c(x: ColOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_null_skip(*parts: ColOrName) -> Column:
    """Concatenation that skips NULL parts (PostgreSQL CONCAT), unlike Spark ``concat``."""
    return F.concat_ws("", *[_c(p) for p in parts])


def left(s: ColOrName, n: int) -> Column:
    """LEFT(s, n): the first n characters."""
    return F.substring(_c(s), 1, n)


def substring(s: ColOrName, start: int, length: int) -> Column:
    """SUBSTRING(s FROM start FOR length), 1-based."""
    return F.substring(_c(s), start, length)


def full_name(first: ColOrName, last: ColOrName) -> Column:
    """Name + blank + surname; NULL parts are skipped as in CONCAT."""
    return concat_null_skip(first, F.lit(" "), last)


def mask_document(doc: ColOrName) -> Column:
    """First two characters followed by six asterisks."""
    return concat_null_skip(left(doc, 2), F.lit("******"))


def mask_tax_id(cuit: ColOrName) -> Column:
    """``30-71000001-1`` -> ``30-7100****-*``; a NULL id gives ``-****-*``."""
    return concat_null_skip(left(cuit, 2), F.lit("-"), substring(cuit, 4, 4), F.lit("****-*"))


def format_message(fmt: str, *args: ColOrName) -> Column:
    """printf-style message column (``format('%s ...')``)."""
    return F.format_string(fmt, *[_c(a) for a in args])


def rpad(s: ColOrName, n: int, pad: str = " ") -> Column:
    return F.rpad(_c(s), n, pad)


def barcode(variant_id: ColOrName, prefix: str = "779", width: int = 9) -> Column:
    """Prefix + id left-padded with zeros. Ids wider than ``width`` keep all digits
    (``lpad`` alone would cut them)."""
    s = _c(variant_id).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def timestamp_text(ts: ColOrName) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def year_of(ts: ColOrName) -> Column:
    return F.year(_c(ts)).cast("bigint")


def months_back(as_of: _dt.date | str, n: int) -> Column:
    """``as_of - INTERVAL 'n months'`` as a timestamp; clips to month end."""
    return F.add_months(F.lit(_to_date(as_of)), -n).cast("timestamp_ntz")


def ntz(value) -> Column:
    """A TIMESTAMP WITHOUT TIME ZONE literal built from text, so neither the
    Python process's nor the session's time zone can shift it."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def year_range(year: int) -> tuple[Column, Column]:
    """Half-open [Jan 1 of year, Jan 1 of year+1) so Parquet min/max stats can prune."""
    return ntz(_dt.date(year, 1, 1)), ntz(_dt.date(year + 1, 1, 1))


def in_year(ts: ColOrName, year: int) -> Column:
    lo, hi = year_range(year)
    return (_c(ts) >= lo) & (_c(ts) < hi)


def date_shift(d: ColOrName, days: ColOrName | int = 0, seconds: ColOrName | int = 0) -> Column:
    """Date + days + seconds -> timestamp."""
    days_c = F.lit(days) if isinstance(days, int) else _c(days)
    secs_c = F.lit(seconds) if isinstance(seconds, int) else _c(seconds)
    base = F.date_add(_c(d).cast("date"), days_c).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs_c.cast("decimal(18,6)"))


def days_between(end: ColOrName, start: ColOrName) -> Column:
    return F.datediff(_c(end), _c(start))


def percent_adjust(price: ColOrName, pct: ColOrName | float) -> Column:
    """``price * (1.0 + pct/100.0)`` rounded half-up into DECIMAL(12,2)."""
    pct_c = F.lit(pct) if not isinstance(pct, Column) else pct
    factor = F.lit(1).cast("decimal(10,6)") + pct_c.cast("decimal(5,2)") / F.lit(100).cast("decimal(5,2)")
    return (_c(price) * factor.cast("decimal(10,6)")).cast(MONEY)


def round_to(x: ColOrName, digits: int) -> Column:
    """HALF_UP rounding on decimals (``round(x, 2)``, ``round(x, -2)``)."""
    return F.round(_c(x), digits)


def clip_max_zero(x: ColOrName) -> Column:
    """``minimum(x, 0)``."""
    return F.least(_c(x), F.lit(0))


def cost_price(list_price: ColOrName, ratio: str = "0.60") -> Column:
    """List price x cost ratio, two decimals."""
    return (_c(list_price) * F.lit(ratio).cast("decimal(3,2)")).cast(MONEY)


def line_amount(qty: ColOrName = "cantidad", price: ColOrName = "precio_unitario") -> Column:
    return _c(qty) * _c(price)


def line_amount_cents(qty: ColOrName = "cantidad", price: ColOrName = "precio_unitario") -> Column:
    """Line amount in whole cents as a 64-bit integer (exact for DECIMAL(12,2) prices).

    ``int * decimal(12,2)`` has precision 23, past the 18 digits Spark keeps
    in a long, so every row would go through BigDecimal; cents stay in
    primitive longs (ANSI mode raises on overflow instead of wrapping).
    """
    return _c(qty).cast("bigint") * (_c(price) * F.lit(100)).cast("bigint")


def cents_to_money(cents: ColOrName) -> Column:
    """Sum of cents back to DECIMAL(38,2), exactly."""
    return (_c(cents).cast("decimal(38,0)") / F.lit(100)).cast("decimal(38,2)")


def signed_delta(tipo: ColOrName = "tipo_movimiento", qty: ColOrName = "cantidad") -> Column:
    """+quantity for Entrada, -quantity for any other type."""
    return F.when(_c(tipo) == "Entrada", _c(qty)).otherwise(-_c(qty))


def to_text(x: ColOrName) -> Column:
    return _c(x).cast("string")


def pmod(x: ColOrName, n: int) -> Column:
    return F.pmod(_c(x), F.lit(n))


def _to_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d))
