"""Labelled, ordered tables over Spark DataFrames.

A ``Frame`` has value columns, a label column and an order key.  Nothing relies
on the order in which Spark reads rows: positional operators use the order key,
and the dense position 0..n-1 is computed only where an operator needs it.
Methods return new frames; nothing runs until a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import maths, nulls
from .order import PART, Key, Ranges, with_position

IDX, POS, ROW = "__idx", "__pos", "__row"


class Series:
    """A column of a frame as an expression; series of one frame combine without a join."""

    def __init__(self, frame: Frame, expr: Column, name: str) -> None:
        self.frame, self.expr, self.name = frame, expr, name

    @property
    def dtype(self) -> T.DataType:
        return self.frame.df.select(self.expr.alias("x")).schema["x"].dataType

    def to_frame(self, name: str | None = None) -> Frame:
        return Frame(self.frame.df.select(F.col(IDX), F.col(POS), self.expr.alias(name or self.name)))

    def map_expr(self, function: Callable[[Column], Column], name: str | None = None) -> Series:
        """An element-wise expression, such as those of ``tidemark.functions``."""
        return Series(self.frame, function(self.expr), name or self.name)

    def size(self) -> int:
        return self.frame.df.count()

    def empty(self) -> bool:
        return self.frame.df.isEmpty()

    def nbytes(self) -> Column:
        """An aggregate: bytes of the values, without validity; strings with four more for each, and four."""
        width = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}.get(type(self.dtype), 8)
        if isinstance(self.dtype, (T.StringType, T.BinaryType)):
            return F.coalesce(F.sum(F.octet_length(self.expr)), F.lit(0)) + 4 * F.count("*") + 4
        return width * F.count("*")

    def values(self) -> list:
        """The values in order, on the driver; nulls of doubles become NaN, others are an error."""
        rows = self.frame.df.select(self.expr.alias("x"), POS).orderBy(POS).collect()
        return [as_value(r.x, self.dtype.simpleString()) for r in rows]

    def rename(self, name: str) -> Series:
        return Series(self.frame, self.expr, name)

    def add_prefix(self, prefix: str) -> Series:
        return self.rename(prefix + self.name)

    def add_suffix(self, suffix: str) -> Series:
        return self.rename(self.name + suffix)

    def cast(self, to: str, safe: bool = True) -> Series:
        """A safe cast fails where a value would change."""
        out = self.expr.cast(to)
        if safe and not isinstance(self.dtype, T.StringType):
            back = out.cast(self.dtype)
            out = F.when(back.eqNullSafe(self.expr), out).otherwise(F.raise_error(F.concat(F.lit("lossy cast: "), self.expr.cast("string"))).cast(to))
        return Series(self.frame, out, self.name)

    def _pair(self, other: object) -> tuple[Frame, Column, Column]:
        if not isinstance(other, Series):
            return self.frame, self.expr, F.lit(other)
        if other.frame.df is self.frame.df:
            return self.frame, self.expr, other.expr
        from .operators.align import align_series

        joined = align_series(self, other)
        return joined, F.col("a"), F.col("b")

    def _binary(self, other: object, op: Callable[[Column, Column], Column]) -> Series:
        frame, a, b = self._pair(other)
        return Series(frame, op(a, b), self.name)

    def _integral(self, other: object) -> bool:
        kinds = [self.dtype] + ([other.dtype] if isinstance(other, Series) else [])
        return all(isinstance(k, T.IntegralType) for k in kinds) and (isinstance(other, Series) or isinstance(other, int))

    def _floating(self, other: object) -> bool:
        kinds = [self.dtype] + ([other.dtype] if isinstance(other, Series) else [])
        return all(isinstance(k, T.NumericType) for k in kinds) and (isinstance(other, float) or any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds))

    def __add__(self, other):
        return self._binary(other, lambda a, b: a + b)

    def __radd__(self, other):
        return self._binary(other, lambda a, b: b + a)

    def __sub__(self, other):
        return self._binary(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self._binary(other, lambda a, b: b - a)

    def __mul__(self, other):
        return self._binary(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        whole = self._integral(other)
        return self._binary(other, lambda a, b: nulls.divide(a, b, whole))

    def __rtruediv__(self, other):
        whole = self._integral(other)
        return self._binary(other, lambda a, b: nulls.divide(b, a, whole))

    def _bits(self, other: object, op: Callable, logical: Callable) -> Series:
        return self._binary(other, logical if isinstance(self.dtype, T.BooleanType) else op)

    def __and__(self, other):
        return self._bits(other, maths.bit_and, nulls.and_)

    def __or__(self, other):
        return self._bits(other, maths.bit_or, nulls.or_)

    def __xor__(self, other):
        return self._bits(other, maths.bit_xor, lambda a, b: a != b)

    def __lshift__(self, n: int):
        return self.map_expr(lambda x: maths.shift_left(x, n))

    def __rshift__(self, n: int):
        return self.map_expr(lambda x: maths.shift_right(x, n))

    def __invert__(self):
        return self.map_expr(lambda x: ~x if isinstance(self.dtype, T.BooleanType) else F.bitwise_not(x))

    def __neg__(self):
        return self.map_expr(lambda x: -x)

    def _compare(self, op: str, other: object) -> Series:
        floating = self._floating(other)
        return self._binary(other, lambda a, b: nulls.compare(a, op, b, floating))

    def __eq__(self, other):  # noqa: PLW1641
        return self._compare("==", other)

    def __ne__(self, other):
        return self._compare("!=", other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __le__(self, other):
        return self._compare("<=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    __hash__ = None

    def where(self, condition: Series, other: object) -> Series:
        """The series where the condition holds, else other; null where it is null."""
        return Series(self.frame, nulls.if_else(condition.expr, self.expr, other.expr if isinstance(other, Series) else other), self.name)


class Frame:
    """Value columns with a label and an order key."""

    def __init__(self, df: DataFrame, root: DataFrame | None = None, exprs: Mapping[str, Column] | None = None) -> None:
        self.df = df
        self.columns = [c for c in df.columns if c not in (IDX, POS, ROW, PART)]
        self._ranges: dict[int | None, Ranges] = {}
        # frames that are expressions over one table combine without a join
        self._root = df if root is None else root
        self._exprs = dict(exprs or {c: F.col(f"`{c}`") for c in self.columns})

    # ------------------------------------------------------------- making

    @classmethod
    def of(cls, df: DataFrame, index: str | None = None, order: Sequence[str] | None = None, keep: bool = False) -> Frame:
        """A frame of a DataFrame; ``order`` names a total order (default: the label).

        Without a label, rows are labelled 0..n-1 in that order.
        """
        keys = list(order or ([index] if index else df.columns[:1]))
        key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
        if index is None:
            numbered = with_position(df.withColumn(POS, key), [POS], ROW)
            return cls(numbered.select(F.col(ROW).cast("long").alias(IDX), POS, *df.columns))
        values = [c for c in df.columns if keep or c != index]
        return cls(df.select(F.col(index).alias(IDX), key.alias(POS), *values))

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: Mapping[str, Sequence[Any]], index: Sequence[Any] | None = None, schema: str | None = None) -> Frame:
        """Of literal columns of one length; the label defaults to 0..n-1; NaN becomes null."""
        lengths = {len(v) for v in columns.values()} | ({len(index)} if index is not None else set())
        if len(lengths) > 1:
            raise ValueError("columns differ in length")
        n = lengths.pop() if lengths else 0
        clean = lambda v: None if isinstance(v, float) and v != v else v
        labels = list(index) if index is not None else list(range(n))
        rows = [(labels[i], i, *(clean(v[i]) for v in columns.values())) for i in range(n)]
        kind = schema or (", ".join(f"`{c}` {_kind(v)}" for c, v in columns.items()))
        return cls(spark.createDataFrame(rows, f"{IDX} {_kind(labels)}, {POS} long" + (f", {kind}" if kind else "")))

    @classmethod
    def from_scalars(cls, spark: SparkSession, values: Mapping[str, Any]) -> Frame:
        return cls.from_columns(spark, {k: [v] for k, v in sorted(values.items())})

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: Any, index: str | None = None, order: Sequence[str] | None = None) -> Frame:
        return cls.of(spark.createDataFrame(table), index, order)

    @classmethod
    def from_struct(cls, df: DataFrame, column: str, index: str | None = None, order: Sequence[str] | None = None) -> Frame:
        return cls.of(df.select(f"{column}.*"), index, order)

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df)

    def _values(self, f: Callable[[Column, str], Column]) -> Frame:
        """A function of each column's expression and name."""
        out = {c: f(e, c) for c, e in self._exprs.items()}
        return Frame(self._root.select(IDX, POS, *[e.alias(c) for c, e in out.items()]), self._root, out)

    def ranges(self, block: int | None = None) -> Ranges:
        """The frame's rows cut in order, into as many ranges as the session has tasks for or of about ``block`` rows."""
        if block not in self._ranges:
            self._ranges[block] = Ranges.of(self.df, [Key(F.col(POS))], block and max(1, -(-self.df.count() // block)))
        return self._ranges[block]

    def parted(self, block: int | None = None) -> DataFrame:
        """The frame's DataFrame with the number of each row's range; ranges follow the order."""
        return self.ranges(block).mark(self.df)

    def dense(self) -> DataFrame:
        """The frame's DataFrame with ``__row``, the position 0..n-1."""
        return self.df if ROW in self.df.columns else self.ranges().number(self.df, ROW).drop(PART)

    # ------------------------------------------------------- columns and index

    def __getitem__(self, key: Any) -> Any:
        from .operators import select

        if isinstance(key, str):
            self._check([key])
            return Series(self, F.col(f"`{key}`"), key)
        if isinstance(key, list):
            self._check(key)
            return Frame(self.df.select(IDX, POS, *key))
        if isinstance(key, Series):
            return select.where(self, key) if isinstance(key.dtype, T.BooleanType) else select.take(self, key)
        if isinstance(key, slice):
            return select.slice_rows(self, key.start or 0, key.stop)
        raise TypeError(f"can't select by {type(key).__name__}")

    def _check(self, names: Sequence[str]) -> None:
        if unknown := [n for n in names if n not in self.columns]:
            raise KeyError(f"no columns {unknown}; there are {self.columns}")

    def contains(self, name: str) -> bool:
        return name in self.columns

    def rename(self, names: Mapping[str, str]) -> Frame:
        self._check(list(names))
        return Frame(self.df.withColumnsRenamed(dict(names)))

    def set_columns(self, names: Sequence[str]) -> Frame:
        if len(names) != len(self.columns):
            raise ValueError("as many names as columns are needed")
        return Frame(self.df.select(IDX, POS, *[F.col(f"`{c}`").alias(n) for c, n in zip(self.columns, names)]))

    def add_prefix(self, prefix: str, excludes: Sequence[str] = ()) -> Frame:
        return self.set_columns([c if c in excludes else prefix + c for c in self.columns])

    def add_suffix(self, suffix: str, excludes: Sequence[str] = ()) -> Frame:
        return self.set_columns([c if c in excludes else c + suffix for c in self.columns])

    def add_column(self, name: str, value: Series | Column) -> Frame:
        """Appends or replaces; a series of another frame is pasted by position."""
        if isinstance(value, Series) and value.frame.df is not self.df:
            from .operators.align import paste

            return paste(self, value.to_frame("__new")).rename_or_replace("__new", name)
        return Frame(self.df.withColumn(name, value.expr if isinstance(value, Series) else value))

    def rename_or_replace(self, old: str, new: str) -> Frame:
        return Frame((self.df.drop(new) if new in self.columns else self.df).withColumnRenamed(old, new))

    def drop(self, *names: str) -> Frame:
        return Frame(self.df.drop(*[n for n in names if n in self.columns]))

    def set_index(self, name: str) -> Frame:
        self._check([name])
        return Frame(self.df.withColumn(IDX, F.col(name)).drop(name))

    def reset_index(self, name: str = "index", drop: bool = False) -> Frame:
        numbered = self.dense().withColumn(name, F.col(IDX)) if not drop else self.dense()
        return Frame(numbered.withColumn(IDX, F.col(ROW).cast("long")).select(IDX, POS, *([] if drop else [name]), *self.columns))

    def index(self) -> DataFrame:
        return self.df.select(IDX)

    def index_as_datetime(self) -> Frame:
        return Frame(self.df.withColumn(IDX, F.col(IDX).cast("timestamp_ntz")))

    def normalize_index(self) -> Frame:
        """A timestamp label at its midnight."""
        if not isinstance(self.df.schema[IDX].dataType, (T.TimestampNTZType, T.TimestampType)):
            raise TypeError("the label isn't a timestamp")
        return Frame(self.df.withColumn(IDX, F.date_trunc("day", IDX).cast("timestamp_ntz")))

    def transpose(self, most: int = 1000) -> DataFrame:
        """Labels as column names, names as the column ``key``; a display operation on at most ``most`` rows."""
        rows = self.df.select(F.col(IDX).cast("string").alias("label"), POS, *self.columns).orderBy(POS).limit(most + 1)
        labels = [r.label for r in rows.select("label", POS).orderBy(POS).collect()]
        if len(labels) > most:
            raise ValueError(f"more than {most} rows can't become columns")
        kinds = {type(self.df.schema[c].dataType) for c in self.columns}
        numbers = all(issubclass(k, T.NumericType) for k in kinds)
        to = self.df.schema[self.columns[0]].dataType.simpleString() if len(kinds) == 1 else "double" if numbers else "string"
        long = rows.select("label", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in self.columns]), F.array(*[F.col(f"`{c}`").cast(to) for c in self.columns]))).alias("key", "value"))
        return long.groupBy("key").pivot("label", labels).agg(F.first("value"))

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: self.df.schema[c].dataType.simpleString() for c in self.columns}

    # -------------------------------------------------------------- arithmetic

    def _binary(self, other: object, op: Callable[[Column, Column, str], Column]) -> Frame:
        """Column by column: with a scalar, a series of this frame, or a frame (by position)."""
        if isinstance(other, Series):
            if other.frame.df is self.df:
                return Frame(self.df)._values(lambda e, c: op(e, other.expr, c))
            other = other.to_frame("__other")
        if isinstance(other, Frame):
            if other._root is self._root and len(other.columns) == len(self.columns):
                pairs = dict(zip(self.columns, other._exprs.values()))
                return self._values(lambda e, c: op(e, pairs[c], c))
            from .operators.align import paste

            names = {c: f"__{k}" for k, c in enumerate(other.columns)}
            both = paste(self, other.rename(names), same_length=True)
            right = list(names.values()) * (len(self.columns) if len(names) == 1 else 1)
            if len(right) != len(self.columns):
                raise ValueError("the frames differ in their number of columns")
            return Frame(both.df.select(IDX, POS, *[op(F.col(f"`{c}`"), F.col(r), c).alias(c) for c, r in zip(self.columns, right)]))
        return self._values(lambda e, c: op(e, F.lit(other), c))

    def _is(self, name: str, kind: type) -> bool:
        return isinstance(self.df.schema[name].dataType, kind)

    def __add__(self, other):
        return self._binary(other, lambda a, b, _: a + b)

    __radd__ = __add__

    def __sub__(self, other):
        return self._binary(other, lambda a, b, _: a - b)

    def __rsub__(self, other):
        return self._binary(other, lambda a, b, _: b - a)

    def __mul__(self, other):
        return self._binary(other, lambda a, b, _: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._binary(other, lambda a, b, c: nulls.divide(a, b, self._is(c, T.IntegralType) and not isinstance(other, float)))

    def __and__(self, other):
        return self._binary(other, lambda a, b, c: (nulls.and_ if self._is(c, T.BooleanType) else maths.bit_and)(a, b))

    def __or__(self, other):
        return self._binary(other, lambda a, b, c: (nulls.or_ if self._is(c, T.BooleanType) else maths.bit_or)(a, b))

    def __xor__(self, other):
        return self._binary(other, lambda a, b, _: maths.bit_xor(a, b))

    def __neg__(self):
        return self._values(lambda e, _: -e)

    def __invert__(self):
        return self._values(lambda e, c: ~e if self._is(c, T.BooleanType) else F.bitwise_not(e))

    def compare(self, op: str, other: object) -> Frame:
        return self._binary(other, lambda a, b, c: nulls.compare(a, op, b, self._is(c, T.FractionalType)))

    def unary(self, function: Callable[[Column], Column]) -> Frame:
        return self._values(lambda e, _: function(e))

    # ------------------------------------------------------------------ results

    def to_df(self, index: str = "index") -> DataFrame:
        """Label and values as a plain DataFrame."""
        return self.df.select(F.col(IDX).alias(index), *self.columns)

    def equals(self, other: Frame) -> bool:
        """Same names, labels and values in the same order."""
        if self.columns != other.columns:
            return False
        a, b = (f.dense().select(ROW, IDX, *f.columns) for f in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def approx_equals(self, other: Frame, tolerance: float = 1e-9) -> bool:
        from .operators.align import paste

        if self.columns != other.columns or self.df.count() != other.df.count():
            return False
        names = {c: f"__{k}" for k, c in enumerate(other.columns)}
        both = paste(self, other.rename(names))
        close = [F.coalesce(F.abs(F.col(f"`{c}`") - F.col(n)) <= tolerance, F.col(f"`{c}`").isNull() & F.col(n).isNull()) for c, n in names.items()]
        return both.df.where(~F.coalesce(F.greatest(F.lit(False), F.least(F.lit(True), *close)), F.lit(False))).isEmpty()

    def show(self, n: int = 20, columns: int = 100) -> None:
        """Prints at most ``n`` rows and as many ``columns``, of either the first and the last."""
        from .operators.select import preview

        half = columns // 2
        names = self.columns if len(self.columns) <= columns else [*self.columns[: columns - half], *self.columns[-half:]]
        preview(self[names], n).show(n + 1)


def as_value(value: Any, kind: str) -> Any:
    """A scalar as a value of a type: a null is NaN as a number with a fraction, and an error as anything else."""
    if value is None:
        if kind in ("double", "float"):
            return float("nan")
        raise ValueError(f"a null can't be a {kind}")
    to = {"double": float, "float": float, "string": str, "boolean": bool}.get(kind, int if kind in ("bigint", "long", "int", "smallint", "tinyint") else None)
    if to is int and int(value) != float(value):
        raise ValueError(f"{value} isn't whole")
    return to(value) if to else value


def _kind(values: Sequence[Any]) -> str:
    import datetime

    kinds = {type(v) for v in values if v is not None and not (isinstance(v, float) and v != v)}
    if not kinds:
        return "double" if any(isinstance(v, float) for v in values) else "long"
    if kinds <= {int, float} and float in kinds:
        return "double"
    names = {bool: "boolean", int: "long", str: "string", bytes: "binary", datetime.datetime: "timestamp_ntz", datetime.date: "date"}
    return names[kinds.pop()] if len(kinds) == 1 else "string"
