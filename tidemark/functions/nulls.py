"""Null, NaN and logic rules that differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def and_(a: Column, b: object) -> Column:
    """Null if either side is null, unlike SQL's three-valued AND."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def or_(a: Column, b: object) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def if_else(condition: Column, a: object, b: object) -> Column:
    """A null condition gives null."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, _c(a)).otherwise(_c(b))


def compare(a: Column, op: str, b: object, floating: bool = False) -> Column:
    """IEEE comparison: NaN equals nothing and is unordered; nulls give null."""
    a, b = _c(a), _c(b)
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not floating:
        return plain
    odd = F.isnan(a) | F.isnan(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(odd, F.lit(op == "!=")).otherwise(plain)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def divide(a: Column, b: object, integral: bool = False) -> Column:
    """Integers truncate (by zero: an error); floats follow IEEE: x/0 is infinite, 0/0 NaN."""
    a, b = _c(a), _c(b)
    if integral:
        return F.call_function("div", a, b)
    sign = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.when(F.isnan(a), F.lit(NAN)).otherwise(sign)).otherwise(F.try_divide(a, b))


def skip_null(aggregate: Column, x: Column, skip: bool = True) -> Column:
    """An aggregate that is null if any input is null, unless nulls are skipped."""
    return aggregate if skip else F.when(F.count(x) == F.count(F.lit(1)), aggregate)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == INF


def true_unless_null(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lit(True))
