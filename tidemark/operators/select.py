"""Rows by position, label or condition; masks and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import IDX, POS, ROW, Frame, Series
from ..functions import nulls
from .align import paste


def where(frame: Frame, mask: Series, emit_null: bool = False) -> Frame:
    """Rows where the mask holds; with ``emit_null`` a null mask keeps the row with null values."""
    if emit_null:
        kept = frame.df.where(F.coalesce(mask.expr, F.lit(True)))
        known = mask.expr.isNotNull()
        return Frame(kept.select(IDX, POS, *[F.when(known, F.col(f"`{c}`")).alias(c) for c in frame.columns]))
    return Frame(frame.df.where(F.coalesce(mask.expr, F.lit(False))))


def where_else(frame: Frame, condition: Frame, other: object = None) -> Frame:
    """Values where the condition's column holds, else those of a frame, a series or a scalar; null conditions give null."""
    names = {c: f"__c{k}" for k, c in enumerate(condition.columns)}
    both = paste(frame, condition.rename(names))
    rest: dict[str, Column] = {}
    if isinstance(other, Frame):
        others = {c: f"__o{k}" for k, c in enumerate(other.columns)}
        both = paste(both, other.rename(others))
        rest = {c: F.col(others[c]) for c in frame.columns}
    elif isinstance(other, Series):
        both = paste(both, other.to_frame("__o"))
        rest = dict.fromkeys(frame.columns, F.col("__o"))
    else:
        rest = {c: F.lit(other).cast(frame.df.schema[c].dataType) for c in frame.columns}
    return Frame(both.df.select(IDX, POS, *[nulls.if_else(F.col(names[c]), F.col(f"`{c}`"), rest[c]).alias(c) for c in frame.columns]))


def take(frame: Frame, positions: Series) -> Frame:
    """Rows at positions, in their order, with repeats."""
    wanted = positions.to_frame("__at").df.select(F.col("__at"), F.col(POS).alias("__order"))
    rows = frame.dense()
    return Frame(wanted.join(rows, F.col("__at") == F.col(ROW)).select(IDX, F.col("__order").alias(POS), *frame.columns))


def slice_rows(frame: Frame, start: int, stop: int | None = None, columns: Sequence[str] | None = None) -> Frame:
    """Half-open positions; negatives count from the end."""
    rows = frame.dense()
    if start < 0 or stop is not None and stop < 0:
        n = frame.df.count()
        start, stop = start + n * (start < 0), stop + n if stop is not None and stop < 0 else stop
    if start < 0:
        raise IndexError("a slice begins before the first row")
    kept = rows.where(F.col(ROW) >= start) if stop is None else rows.where(F.col(ROW).between(start, stop - 1))
    return Frame(kept.select(IDX, POS, *(columns or frame.columns)))


def row(frame: Frame, at: int) -> Frame:
    """The row at a position, columns in name order."""
    return slice_rows(frame, at, at + 1 if at != -1 else None, sorted(frame.columns))


def by_label(frame: Frame, label: object) -> Frame:
    """The first row with a label."""
    return Frame(frame.df.where(F.col(IDX) == F.lit(label)).orderBy(POS).limit(1))


def at(frame: Frame, row_number: int, column: str | int) -> object:
    """One value, by position and column."""
    if row_number < 0 or isinstance(column, int) and column < 0:
        raise IndexError("positions can't be negative")
    name = frame.columns[column] if isinstance(column, int) else column
    found = slice_rows(frame, row_number, row_number + 1, [name]).df.select(name).first()
    if found is None:
        raise IndexError("no such row")
    return found[0]


def between(frame: Frame, start: object = None, stop: object = None, closed: bool = False) -> Frame:
    """Rows whose label is in [start, stop), or in [start, stop] if closed; one end may be missing."""
    if start is None and stop is None:
        raise ValueError("a slice needs an end")
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(IDX) >= F.lit(start))
    if stop is not None:
        keep = keep & ((F.col(IDX) <= F.lit(stop)) if closed else (F.col(IDX) < F.lit(stop)))
    return Frame(frame.df.where(keep))


def label_slice(frame: Frame, start: str | None = None, stop: str | None = None, closed: bool = False) -> Frame:
    """From the first row with one label to the first with another, by position; a missing label is an error."""
    ends = frame.df.where(F.col(IDX).isin(*[x for x in (start, stop) if x is not None])).groupBy(IDX).agg(F.min(POS).alias("p"))
    found = {r[0]: r[1] for r in ends.collect()}
    if gone := [x for x in (start, stop) if x is not None and x not in found]:
        raise KeyError(f"no labels {gone}")
    keep = F.lit(True)
    literal = lambda v: F.struct(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    if start is not None:
        keep = keep & (F.col(POS) >= literal(found[start]))
    if stop is not None:
        keep = keep & ((F.col(POS) <= literal(found[stop])) if closed else (F.col(POS) < literal(found[stop])))
    return Frame(frame.df.where(keep))


def head(frame: Frame, n: int = 5) -> Frame:
    return Frame(frame.df.orderBy(POS).limit(n))


def tail(frame: Frame, n: int = 5) -> Frame:
    return Frame(frame.df.orderBy(F.col(POS).desc()).limit(n))


def preview(frame: Frame, most: int = 1000, index: str = "index") -> DataFrame:
    """The rows that are printed: all, or the first and the last half of ``most``; ``end`` tells head from tail."""
    half = most // 2
    first = frame.df.orderBy(POS).limit(most - half)
    # rows of a short frame are in the head already
    last = frame.df.join(F.broadcast(first.agg(F.max(POS).alias("__last"))), F.col(POS) > F.col("__last")).orderBy(F.col(POS).desc()).limit(half)
    named = lambda df, end: df.select(F.col(IDX).alias(index), *frame.columns, F.lit(end).alias("end"), POS)
    return named(first, "head").union(named(last, "tail")).orderBy(POS).drop(POS)


def drop_na(frame: Frame) -> Frame:
    """Rows without a null value or label."""
    return Frame(frame.df.dropna("any", subset=[IDX, *frame.columns]))


def indices_nonzero(series: Series) -> Frame:
    """Positions whose value is neither zero, false nor null."""
    x = series.to_frame("x").dense()
    return Frame(x.where(F.col("x").cast("double") != 0).select(IDX, POS, F.col(ROW).cast("long").alias("position")))


def coalesce(frame: Frame, columns: Sequence[str] | None = None) -> Series:
    return Series(frame, F.coalesce(*(columns or frame.columns)), "coalesce")


def replace_with_mask(series: Series, mask: Series, other: Series) -> Frame:
    """The k-th true of the mask takes the k-th value of ``other``; a null in the mask gives null."""
    from .window import cumulative

    base = Frame(series.frame.df.select(IDX, POS, series.expr.alias("x"), mask.expr.alias("m"), F.coalesce(mask.expr, F.lit(False)).cast("long").alias("n")))
    counted = cumulative(base, "n", "sum", "k")
    values = other.to_frame("__v").dense().select(F.col(ROW).alias("__r"), "__v")
    joined = counted.df.join(values, F.col("m") & (F.col("k") - 1 == F.col("__r")), "left")
    return Frame(joined.select(IDX, POS, F.when(F.col("m").isNull(), F.lit(None)).when(F.col("m"), F.col("__v")).otherwise(F.col("x")).alias(series.name)))


def fill(frame: Frame, forward: bool = True, by: Sequence[str] = ()) -> Frame:
    """Nulls take the last value before them (or the next after)."""
    from .window import ordered

    if by:
        # a frame that ends at the last row would be computed anew for every row
        w = Window.partitionBy(*by).orderBy(F.col(POS).asc() if forward else F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return Frame(frame.df.select(IDX, POS, *by, *[F.last(f"`{c}`", True).over(w).alias(c) for c in frame.columns if c not in by]))
    return ordered(frame, {c: c for c in frame.columns}, forward)
