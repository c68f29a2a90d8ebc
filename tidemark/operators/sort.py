"""Orders and top-k.  Nulls come last either way, NaN just before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import IDX, POS, ROW, Frame
from ..order import Key, with_position


def keys(frame: Frame, by: Sequence[str], ascending: bool = True) -> list[Key]:
    out: list[Key] = []
    for c in by:
        x = F.col(f"`{c}`")
        if isinstance(frame.df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            # numbers, NaN, nulls
            out.append(Key(F.when(x.isNull(), 2).otherwise(F.isnan(x).cast("int"))))
        out.append(Key(x, ascending, nulls_first=False))
    return [*out, Key(F.col(POS))]


def _sorts(frame: Frame, by: Sequence[str], ascending: bool) -> list[Column]:
    return [k.sort for k in keys(frame, by, ascending)]


def sort_values(frame: Frame, by: Sequence[str], ascending: bool = True) -> Frame:
    """Whole rows by columns, ties in their old order; a distributed sort.  The old order key stays: see ``ranked``."""
    return Frame(frame.df.orderBy(*_sorts(frame, by, ascending)))


def ranked(frame: Frame, by: Sequence[str], ascending: bool = True) -> Frame:
    """``sort_values`` with the new place as order key.

    Places come from ranges of all keys, so no task sorts all rows.
    """
    out = with_position(frame.df.drop(ROW), keys(frame, by, ascending), ROW)
    return Frame(out.withColumn(POS, F.col(ROW)).drop(ROW))


def argsort(frame: Frame, by: Sequence[str], ascending: bool = True) -> DataFrame:
    """(place, position): the old position of the row at each place of the order."""
    old = Frame(frame.dense().withColumn(IDX, F.col(ROW)).drop(ROW))
    return ranked(old, by, ascending).df.select(F.col(POS).cast("long").alias("place"), F.col(IDX).cast("long").alias("position"))


def sort_index(frame: Frame, ascending: bool = True, ignore_index: bool = False) -> Frame:
    named = Frame(frame.df.withColumn("__label", F.col(IDX)))
    out = ranked(named, ["__label"], ascending).drop("__label")
    return Frame(out.df.withColumn(IDX, F.col(POS).cast("long"))) if ignore_index else out


def largest(frame: Frame, column: str, n: int) -> Frame:
    """Top n: each task keeps its own n."""
    return Frame(frame.df.orderBy(*_sorts(frame, [column], False)).limit(n))


def smallest(frame: Frame, column: str, n: int) -> Frame:
    return Frame(frame.df.orderBy(*_sorts(frame, [column], True)).limit(n))


def nth_element(frame: Frame, column: str, n: int) -> DataFrame:
    """The row at place n of the order: (position, value)."""
    old = Frame(frame.dense().withColumn(IDX, F.col(ROW)).drop(ROW))
    return ranked(old, [column]).df.where(F.col(POS) == n).select(F.col(IDX).cast("long").alias("position"), F.col(column).alias("value"))
