"""Scalar column helpers (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schemas import DEFAULT


def is_blank(c: Column) -> Column:
    """True for null, empty or all-whitespace text."""
    return c.isNull() | ~c.rlike(r"\S")


def or_default(c: Column) -> Column:
    return F.when(is_blank(c), F.lit(DEFAULT)).otherwise(c)


def dcx_key(code: Column, flow_type: Column, modem_type: Column) -> Column:
    """Composite key ``code,flow,modem``; a blank part becomes ``DEFAULT``."""
    return F.concat_ws(",", or_default(code), or_default(flow_type), or_default(modem_type))


def starts_with_zero(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("0")), F.lit(False))


def same_text(a: Column, b: str) -> Column:
    """Case-insensitive equality that is false (not null) for a null left side."""
    return F.coalesce(F.lower(a) == b.lower(), F.lit(False))


def canonical(c: Column, values: tuple[str, ...]) -> Column:
    """The member of ``values`` equal to ``c`` ignoring case, else null."""
    out = F.when(F.lower(c) == values[0].lower(), F.lit(values[0]))
    for v in values[1:]:
        out = out.when(F.lower(c) == v.lower(), F.lit(v))
    return out


def day_start(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def pending(total: Column, completed: Column, failed: Column) -> Column:
    return total - completed - failed
