"""Alignment by label or position, row concatenation and sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import IDX, POS, ROW, Frame, Series


def last_by_label(frame: Frame) -> DataFrame:
    """One row per label: the last in order."""
    row = F.struct(*frame.columns)
    return frame.df.groupBy(IDX).agg(F.max_by(row, POS).alias("v"), F.max(POS).alias(POS)).select(IDX, POS, "v.*")


def align_series(a: Series, b: Series) -> Frame:
    """Columns a and b on the sorted union of labels; a label that is missing gives null."""
    left = last_by_label(a.to_frame("a")).select(IDX, "a")
    right = last_by_label(b.to_frame("b")).select(IDX, "b")
    return Frame(left.join(right, IDX, "full_outer").select(IDX, F.col(IDX).alias(POS), "a", "b"))


def paste(left: Frame, right: Frame, same_length: bool = False) -> Frame:
    """Columns side by side by position; the left label stays."""
    a, b = left.dense(), right.dense().select(F.col(ROW).alias("__r"), *right.columns)
    if same_length:
        joined = a.join(b, a[ROW] == b["__r"], "full_outer")
        bad = F.raise_error(F.lit("the frames differ in length")).cast("long")
        joined = joined.withColumn(ROW, F.when(F.col(ROW).isNull() | F.col("__r").isNull(), bad).otherwise(F.col(ROW)))
    else:
        joined = a.join(b, a[ROW] == b["__r"], "left")
    return Frame(joined.select(IDX, F.col(ROW).alias(POS), *left.columns, *right.columns))


def distinct_names(frames: Sequence[Frame]) -> list[list[str]]:
    """Names for all columns side by side: a repeated name gets a number."""
    seen: dict[str, int] = {}
    out = []
    for f in frames:
        names = []
        for c in f.columns:
            seen[c] = seen.get(c, -1) + 1
            names.append(c if not seen[c] else f"{c}_{seen[c]}")
        out.append(names)
    return out


def concat_columns(frames: Sequence[Frame], how: str = "outer", sort: bool = False, ignore_names: bool = False) -> Frame:
    """Columns side by side by label: all labels in order of appearance (or sorted), or the common ones."""
    if not frames:
        raise ValueError("nothing to concatenate")
    named = [f.set_columns(n) for f, n in zip(frames, distinct_names(frames))]
    parts = [last_by_label(f).withColumnRenamed(POS, f"__pos{k}") for k, f in enumerate(named)]
    joined = reduce(lambda a, b: a.join(b, IDX, "full_outer" if how == "outer" else "inner"), parts)
    places = [F.col(f"__pos{k}") for k in range(len(parts))]
    # order of appearance: the first frame that has the label, then the place there
    kinds = {f.df.schema[POS].dataType.simpleString() for f in frames}
    if sort or len(kinds) > 1:
        key: Column = F.col(IDX)
    else:
        first = reduce(lambda rest, k: F.when(places[k].isNotNull(), F.lit(k)).otherwise(rest), reversed(range(len(places))), F.lit(None).cast("int"))
        key = F.struct(first, F.coalesce(*places))
    names = [c for f in named for c in f.columns]
    out = Frame(joined.select(IDX, key.alias(POS), *names))
    return out.set_columns([str(k) for k in range(len(names))]) if ignore_names else out


def common_type(kinds: Sequence[T.DataType]) -> str:
    """Numbers widen, timestamps count as longs, anything else becomes a string."""
    if not kinds:
        return "void"
    if len({k.simpleString() for k in kinds}) == 1:
        return kinds[0].simpleString()
    rank = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    names = [k.simpleString() for k in kinds]
    if all(n in rank or n.startswith("timestamp") for n in names):
        stamps = [n for n in names if n.startswith("timestamp")]
        return stamps[0] if stamps else max(names, key=rank.index)
    return "string"


def concat_rows(frames: Sequence[Frame], how: str = "outer", ignore_index: bool = False) -> Frame:
    """Rows one frame after the other: all columns (missing ones null), or the common ones; labels may repeat."""
    if not frames:
        raise ValueError("nothing to concatenate")
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if how == "inner":
        names = [c for c in names if all(c in f.columns for f in frames)]
    kinds = {c: common_type([f.df.schema[c].dataType for f in frames if c == IDX or c in f.columns]) for c in [IDX, *names]}
    alike = len({f.df.schema[POS].dataType.simpleString() for f in frames}) == 1
    parts = []
    for k, f in enumerate(frames):
        values = [F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in f.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
        # order keys of one type stay; others give way to the place in their own frame
        rows, place = (f.df, POS) if alike else (f.dense(), ROW)
        parts.append(rows.select(F.col(IDX).cast(kinds[IDX]).alias(IDX), F.struct(F.lit(k).alias("f"), F.col(place).alias("r")).alias(POS), *values))
    out = Frame(reduce(DataFrame.union, parts))
    return out.reset_index(drop=True) if ignore_index else out


def append(a: Series, b: Series, ignore_index: bool = False) -> Frame:
    return concat_rows([a.to_frame("x"), b.to_frame("x")], ignore_index=ignore_index).rename({"x": a.name})


def reindex(frame: Frame, labels: DataFrame, label: str, order: str | None = None, fill: object = None) -> Frame:
    """The rows of new labels; values of labels that are missing are ``fill``, existing nulls stay."""
    new = labels.select(F.col(label).alias("__new"), F.col(order or label).alias("__order"))
    old = last_by_label(frame).withColumn("__hit", F.lit(True)).drop(POS)
    joined = new.join(old, F.col("__new") == F.col(IDX), "left")
    values = [F.when(F.col("__hit").isNull(), F.lit(fill).cast(frame.df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) for c in frame.columns]
    return Frame(joined.select(F.col("__new").alias(IDX), F.col("__order").alias(POS), *values))


def _distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias(order))


def union(a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """Different values of both, in order of first appearance: column ``value`` and its place."""
    both = a.select(F.col(value), F.struct(F.lit(0).alias("f"), F.col(order).alias("r")).alias("place")).union(b.select(F.col(value), F.struct(F.lit(1).alias("f"), F.col(order).alias("r")).alias("place")))
    return _distinct(both, value, "place")


def intersection(a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """Different values of ``a`` that are in ``b``, with the place of the last in ``a``."""
    return a.join(b.select(value), value, "left_semi").groupBy(value).agg(F.max(order).alias("place"))


def index_in(df: DataFrame, value: str, values: DataFrame, of: str, order: str) -> DataFrame:
    """``df`` with the first place of its value in a table of values, however large; null if absent."""
    first = values.groupBy(F.col(of).alias("__of")).agg(F.min(order).alias("place"))
    return df.join(first, F.col(value).eqNullSafe(F.col("__of")), "left").drop("__of")
