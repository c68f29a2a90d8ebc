"""User functions over values, in Arrow batches; expressions are faster wherever they exist."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Frame, Series


def mapped(x: Column, function: Callable, kind: str, *arguments: object) -> Column:
    """function(value, *arguments) of each value; a null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v, *arguments), na_action="ignore")

    return run(x)


def map_series(series: Series, function: Callable, kind: str, *arguments: object) -> Series:
    return Series(series.frame, mapped(series.expr, function, kind, *arguments), series.name)


def map_frame(frame: Frame, function: Callable, kind: str) -> Frame:
    """The function of every cell; columns in name order."""
    out = frame.unary(lambda x: mapped(x, function, kind))
    return out[sorted(out.columns)]


def filter_rows(series: Series, function: Callable) -> Frame:
    """Rows whose value satisfies a function."""
    return Frame(series.frame.df.where(mapped(series.expr, function, "boolean")))
