"""Predicate catalog with pandas null semantics.

pandas evaluates ``!=`` and ``~isin`` to *true* on a missing value and every
other comparison to *false*; SQL would give null.  Each predicate therefore
returns a non-null boolean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def predicate(column, op: str, value) -> Column:
    c = _col(column)
    if op == "eq":
        return F.coalesce(c == F.lit(value), F.lit(False))
    if op == "neq":
        return ~c.eqNullSafe(F.lit(value))
    if op == "in":
        vals = [v for v in value if v is not None]
        return F.coalesce(c.isin(vals), F.lit(False)) if vals else F.lit(False)
    if op == "not_in":
        vals = [v for v in value if v is not None]
        return (~F.coalesce(c.isin(vals), F.lit(False))) if vals else F.lit(True)
    if op == "gt":
        return F.coalesce(c > F.lit(value), F.lit(False))
    if op == "gte":
        return F.coalesce(c >= F.lit(value), F.lit(False))
    if op == "lt":
        return F.coalesce(c < F.lit(value), F.lit(False))
    if op == "lte":
        return F.coalesce(c <= F.lit(value), F.lit(False))
    raise ValueError(f"unknown operator {op!r}; expected one of {OPERATORS}")


def filter_predicate(column, op: str, value) -> Column:
    """The same truth table as :func:`predicate` for use inside ``filter``:
    a null result drops the row exactly like ``false`` does, so the plain
    comparison is kept and Parquet can push it down to the scan."""
    c = _col(column)
    if op == "eq":
        return c == F.lit(value)
    if op == "neq":
        return c.isNull() | (c != F.lit(value))
    if op == "in":
        vals = [v for v in value if v is not None]
        return c.isin(vals) if vals else F.lit(False)
    if op == "not_in":
        vals = [v for v in value if v is not None]
        return (c.isNull() | ~c.isin(vals)) if vals else F.lit(True)
    if op == "gt":
        return c > F.lit(value)
    if op == "gte":
        return c >= F.lit(value)
    if op == "lt":
        return c < F.lit(value)
    if op == "lte":
        return c <= F.lit(value)
    raise ValueError(f"unknown operator {op!r}; expected one of {OPERATORS}")


def conjunction(filters) -> Column:
    """AND of ``(column, op, value)`` triples; empty -> true."""
    out = F.lit(True)
    for column, op, value in filters:
        out = out & predicate(column, op, value)
    return out
