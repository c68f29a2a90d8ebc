"""Aggregates of a column, of all cells, per column, per row and per group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import IDX, POS, Frame
from ..functions import nulls
from ..order import PART, Key, Ranges, with_position


#: Values that one task multiplies or sorts as an array.
LIST = 10_000
#: Different values of a column up to which its quantiles are found in one aggregation.
DIFFERENT = 200_000
#: Rows of the frame in a run of a chunk function that combines.
CHUNK = 500_000


def product(x: Column) -> Column:
    """The product as a double; ``integer_product`` is exact."""
    return F.product(x)


def integer_product(frame: Frame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The keys and ``column``, the exact product of its longs; an overflow is an error.

    Rows are multiplied in lists of about ``LIST``, their products again, until
    one is left: no list holds a group, however large.
    """
    lists = max(1, -(-frame.df.count() // LIST))
    x = F.col(f"`{column}`").cast("long").alias(column)
    rows = frame.df.select(*by, x, F.pmod(F.xxhash64(POS), F.lit(lists)).alias("__list"))
    whole = F.when(F.count(column) > 0, F.aggregate(F.collect_list(column), F.lit(1).cast("long"), lambda a, v: a * v)).alias(column)
    while lists > 1:
        rows = rows.groupBy(*by, "__list").agg(whole)
        lists = -(-lists // LIST)
        rows = rows.withColumn("__list", F.pmod("__list", F.lit(lists)))
    return rows.groupBy(*by).agg(whole)


def _between(q: float, interpolation: str, n: int) -> tuple[int, int, float]:
    """The two places of an exact quantile among n values, and the share of the second."""
    rank = q * (n - 1)
    low, high = floor(rank), ceil(rank)
    return {"linear": (low, high, rank - low), "lower": (low, low, 0.0), "higher": (high, high, 0.0), "nearest": (round(rank), round(rank), 0.0), "midpoint": (low, high, 0.5)}[interpolation]


def exact_quantiles(frame: Frame, column: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """One row: name -> exact (quantile, interpolation) of a column of any size.

    Values are cut into ranges and counted; only the ranges that hold a wanted
    place are sorted.
    """
    values = frame.df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x is not null")
    ranges = Ranges.of(values, [Key(F.col("x"))])
    ranges.sizes(values)
    if not ranges.total:
        return frame.df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in wanted])
    places = {n: _between(q, how, ranges.total) for n, (q, how) in wanted.items()}
    needed = sorted({p for low, high, _ in places.values() for p in (low, high)})
    numbered = ranges.number(values, "at", needed).where(F.col("at").isin(needed))
    at = lambda p: F.max(F.when(F.col("at") == p, F.col("x")))
    return numbered.agg(*[(at(low) if low == high else at(low) + (at(high) - at(low)) * share).alias(n) for n, (low, high, share) in places.items()])


def variance(x: Column, ddof: int = 1) -> Column:
    if ddof == 1:
        return F.var_samp(x)
    if ddof == 0:
        return F.var_pop(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def deviation(x: Column, ddof: int = 1) -> Column:
    return F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x) if ddof == 0 else F.sqrt(variance(x, ddof))


def quantile(x: Column, q: float, interpolation: str = "linear") -> Column:
    """An exact quantile as an aggregate: linear, lower, higher, nearest or midpoint.

    Linear keeps a count per different value, the others a group's values: for
    groups of bounded size.  ``exact_quantiles`` is for whole columns.
    """
    if interpolation == "linear":
        return F.percentile(x, q)
    values = F.sort_array(F.collect_list(x))
    rank = (F.size(values) - 1) * F.lit(float(q))
    at = lambda k: F.get(values, k.cast("int"))
    low, high = F.floor(rank), F.ceil(rank)
    return {
        "lower": at(low),
        "higher": at(high),
        "nearest": at(F.rint(rank)),
        "midpoint": (at(low) + at(high)) / 2,
    }[interpolation].cast("double")


def tdigest(x: Column, q: float = 0.5, accuracy: int = 100_000) -> Column:
    """An approximate quantile in bounded memory."""
    return F.percentile_approx(x, q, accuracy).cast("double")


def mode(x: Column) -> Column:
    """The most frequent value; of ties the smallest."""
    return F.mode(x, True)


def first(x: Column, order: Column, skip_nulls: bool = True) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), order)) if skip_nulls else F.min_by(F.struct(x.alias("v")), order)["v"]


def last(x: Column, order: Column, skip_nulls: bool = True) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order)) if skip_nulls else F.max_by(F.struct(x.alias("v")), order)["v"]


#: Name -> aggregate of (value, order key).
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda x, o: F.sum(x),
    "mean": lambda x, o: F.avg(x),
    "min": lambda x, o: F.min(x),
    "max": lambda x, o: F.max(x),
    "product": lambda x, o: product(x),
    "count": lambda x, o: F.count(x),
    "count_na": lambda x, o: F.count_if(x.isNull()),
    "nunique": lambda x, o: F.count_distinct(x),
    "std": lambda x, o: deviation(x),
    "var": lambda x, o: variance(x),
    "stddev_pop": lambda x, o: F.stddev_pop(x),
    "variance_pop": lambda x, o: F.var_pop(x),
    "median": lambda x, o: F.median(x),
    "tdigest": lambda x, o: tdigest(x),
    "mode": lambda x, o: mode(x),
    "first": lambda x, o: first(x, o),
    "last": lambda x, o: last(x, o),
    "all": lambda x, o: F.bool_and(x),
    "any": lambda x, o: F.bool_or(x),
    "min_max": lambda x, o: F.struct(F.min(x).alias("min"), F.max(x).alias("max")),
    "first_last": lambda x, o: F.struct(first(x, o).alias("first"), last(x, o).alias("last")),
}


def agg(frame: Frame, aggregates: Mapping[str, tuple[str, str]], skip_nulls: bool = True) -> DataFrame:
    """One row: name -> (column, aggregate)."""
    return frame.df.agg(*[nulls.skip_null(REGISTRY[how](F.col(f"`{c}`"), F.col(POS)), F.col(f"`{c}`"), skip_nulls).alias(n) for n, (c, how) in aggregates.items()])


def agg_cells(frame: Frame, aggregates: Sequence[str]) -> DataFrame:
    """One row: aggregates over all cells of all columns as one sequence, column after column."""
    cells = F.array(*[F.struct(F.lit(k).alias("c"), F.col(f"`{c}`").alias("v")) for k, c in enumerate(frame.columns)])
    long = frame.df.select(POS, F.explode(cells).alias("x")).select(F.col("x.v").alias("v"), F.struct("x.c", POS).alias("o"))
    return long.agg(*[REGISTRY[how](F.col("v"), F.col("o")).alias(how) for how in aggregates])


def sum_cells(frame: Frame) -> Column:
    """The sum of all cells, from one aggregate per column: no row is multiplied."""
    return sum((F.coalesce(F.sum(f"`{c}`"), F.lit(0)) for c in frame.columns), F.lit(0))


def top_modes(frame: Frame, column: str, n: int = 1) -> DataFrame:
    """The n most frequent values with their counts; ties by the smaller value."""
    x = frame.df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("mode")).agg(F.count("*").alias("count"))
    return x.orderBy(F.col("count").desc(), "mode").limit(n)


def value_counts(frame: Frame, column: str) -> DataFrame:
    """values, counts and the first place of each value, null included."""
    return frame.df.groupBy(F.col(column).alias("values")).agg(F.count("*").alias("counts"), F.min(POS).alias("place"))


def is_unique(frame: Frame, column: str) -> DataFrame:
    counted = frame.df.groupBy(column).count()
    return counted.agg(F.coalesce(F.max("count") == 1, F.lit(True)).alias("is_unique"))


def dictionary_encode(frame: Frame, column: str) -> Frame:
    """The number of each value in order of first appearance; null stays null."""
    firsts = frame.df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.min(POS).alias("__at"))
    codes = with_position(firsts, ["__at"], "code").select("__v", F.col("code").cast("long").alias("code"))
    return Frame(frame.df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v"))


def index_of(frame: Frame, column: str, value: object) -> DataFrame:
    """The position of the first equal value, or -1."""
    return frame.dense().agg(F.coalesce(F.min(F.when(F.col(column) == F.lit(value), F.col("__row"))), F.lit(-1)).cast("long").alias("index"))


def arg_extremes(frame: Frame, column: str) -> DataFrame:
    """Positions and labels of the first smallest and the first largest value."""
    x = F.col(column)
    key = F.when(x.isNotNull(), F.struct(x.alias("x"), F.col("__row").alias("p")))
    high = F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col("__row")).alias("p")))
    return frame.dense().agg(F.min_by("__row", key).cast("long").alias("argmin"), F.max_by("__row", high).cast("long").alias("argmax"), F.min_by(IDX, key).alias("idxmin"), F.max_by(IDX, high).alias("idxmax"))


def describe(frame: Frame, columns: Sequence[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75), different: int = DIFFERENT) -> DataFrame:
    """A row per column: count, mean, std, min, nunique, percentiles and max.

    A first pass counts different values approximately.  Columns of at most
    about ``different`` get the rest from one more aggregation; for others values are made
    distinct by a shuffle and percentiles come from ranges.
    """
    names = list(columns or frame.columns)
    for c in names:
        if not isinstance(frame.df.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c} isn't numeric")
    told = {f"p{round(100 * p)}": (p, "linear") for p in percentiles}
    values = {c: F.col(f"`{c}`").cast("double") for c in names}
    kinds = frame.df.agg(*[F.approx_count_distinct(x).alias(c) for c, x in values.items()]).first()
    few, many = ([c for c in names if (kinds[c] <= different) == small] for small in (True, False))

    def row(c: str, nunique: Column, quantiles: Mapping[str, Column]) -> Column:
        x = values[c]
        ends = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min")]
        return F.struct(F.lit(c).alias("column"), *ends, nunique.cast("long").alias("nunique"), *[q.alias(n) for n, q in quantiles.items()], F.max(x).alias("max"))

    parts = [row(c, F.size(F.collect_set(values[c])), {n: F.percentile(values[c], p) for n, (p, _) in told.items()}) for c in few]
    for c in many:
        nunique = frame.df.select(values[c].alias("x")).where("x is not null").distinct().agg(F.count("*")).scalar()
        found = exact_quantiles(frame, c, told)
        parts.append(row(c, F.first(nunique), {n: F.first(found.select(n).scalar()) for n in told}))
    return frame.df.agg(F.array(*parts).alias("d")).select(F.inline("d"))


def covariance(frame: Frame, a: str, b: str, ddof: int = 1) -> Column:
    return F.covar_samp(a, b) if ddof == 1 else F.covar_pop(a, b)


def correlation(frame: Frame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """One row: Pearson's, or Spearman's (Pearson's of average ranks)."""
    if method == "pearson":
        return frame.df.agg(F.corr(a, b).alias("corr"))
    if method != "spearman":
        raise ValueError("pearson or spearman")
    both = frame.df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))

    def ranks(name: str) -> DataFrame:
        """Average rank of each value: counts per value, then a running sum of counts."""
        from .window import running

        counts = Frame(both.groupBy(name).agg(F.count("*").alias("n")).select(F.col(name).alias(IDX), F.col(name).alias(POS), "n"))
        upto = running(counts, {"upto": (F.col("n"), "sum")}, [])
        return upto.select(F.col(IDX).alias(f"v{name}"), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{name}"))

    joined = both.join(ranks("a"), F.col("a") == F.col("va")).join(ranks("b"), F.col("b") == F.col("vb"))
    return joined.agg(F.corr("ra", "rb").alias("corr"))


# ------------------------------------------------------------------- by axis


def per_column(frame: Frame, how: str, **options: object) -> DataFrame:
    """A row per column: (column, value); an empty sum is 0, an empty product 1."""
    out = []
    for c in frame.columns:
        x = F.col(f"`{c}`")
        value = {"quantile": lambda: quantile(x, options.get("q", 0.5), options.get("interpolation", "linear")), "std": lambda: deviation(x, options.get("ddof", 1)), "var": lambda: variance(x, options.get("ddof", 1))}.get(how, lambda: REGISTRY[how](x, F.col(POS)))()
        if how in ("sum", "product"):
            value = F.coalesce(value, F.lit(int(how == "product")))
        out.append(F.struct(F.lit(c).alias("column"), value.alias("value")))
    return frame.df.agg(F.array(*out).alias("d")).select(F.inline("d"))


def per_row(frame: Frame, how: str, name: str | None = None, columns: Sequence[str] | None = None, **options: object) -> Frame:
    """An aggregate of each row's values; null values are left out."""
    cells = [F.col(f"`{c}`") for c in (columns or frame.columns)]
    kept = F.array_compact(F.array(*cells))
    n = F.size(kept)
    # longs stay longs: a double would lose digits beyond 2^53
    whole = all(isinstance(frame.df.schema[c].dataType, T.IntegralType) for c in (columns or frame.columns))
    one = (lambda k: F.lit(k).cast("long")) if whole else (lambda k: F.lit(float(k)))
    total = F.aggregate(kept, one(0), lambda a, v: a + v)
    mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), n)
    ordered = F.sort_array(kept)
    ddof = options.get("ddof", 1)
    spread = lambda: F.aggregate(kept, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    var = lambda: F.when(n > ddof, spread() / (n - ddof))

    def at_rank(q: float) -> Column:
        rank = (n - 1) * F.lit(float(q))
        low, high = F.get(ordered, F.floor(rank).cast("int")), F.get(ordered, F.ceil(rank).cast("int"))
        return low + (high - low) * (rank - F.floor(rank))

    def digest(q: float) -> Column:
        """A digest of so few values keeps each as a cluster of its own and answers with a value, or the middle of two."""
        at = n * F.lit(float(q))
        place = F.floor(at).cast("int")
        value = F.get(ordered, place)
        middle = (F.get(ordered, place - 1) + value) / 2
        return F.when(at <= 1, F.get(ordered, F.lit(0))).when(at >= n - 1, F.get(ordered, n - 1)).when(at == place, middle).otherwise(value).cast("double")

    value = {
        "all": lambda: F.forall(kept, lambda v: v),
        "any": lambda: F.exists(kept, lambda v: v),
        "median": lambda: at_rank(0.5),
        "count": lambda: n.cast("long"),
        "count_na": lambda: (F.lit(len(cells)) - n).cast("long"),
        "nunique": lambda: F.size(F.array_distinct(kept)).cast("long"),
        "first": lambda: F.coalesce(*cells),
        "last": lambda: F.coalesce(*cells[::-1]),
        "max": lambda: F.array_max(kept),
        "min": lambda: F.array_min(kept),
        "mean": lambda: mean,
        "sum": lambda: total,
        "product": lambda: F.aggregate(kept, one(1), lambda a, v: a * v),
        "std": lambda: F.sqrt(var()),
        "var": var,
        "quantile": lambda: at_rank(options.get("q", 0.5)),
        "tdigest": lambda: digest(options.get("q", 0.5)),
    }[how]()
    return Frame(frame.df.select(IDX, POS, value.alias(name or how)))


# ------------------------------------------------------------------- by group


class Grouped:
    """A frame grouped by one key; null is a key of its own."""

    def __init__(self, frame: Frame, key: str) -> None:
        self.frame, self.key = frame, key
        self.by = frame.df.groupBy(F.col(key).alias("key"))

    def agg(self, aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
        """key and name -> (column, aggregate); std and var divide by n, as grouped ones do.

        first and last are positional: a null counts.
        """
        special = {
            "std": lambda x: F.stddev_pop(x),
            "var": lambda x: F.var_pop(x),
            "first": lambda x: first(x, F.col(POS), False),
            "last": lambda x: last(x, F.col(POS), False),
        }
        out = []
        for n, (c, how) in aggregates.items():
            x = F.col(f"`{c}`")
            out.append((special[how](x) if how in special else REGISTRY[how](x, F.col(POS))).alias(n))
        return self.by.agg(*out)

    def min_max(self, columns: Sequence[str]) -> DataFrame:
        return self.agg({f"{c}_{how}": (c, how) for c in columns for how in ("min", "max")})

    def quantile(self, quantiles: Mapping[str, float], interpolation: str = "linear") -> DataFrame:
        return self.by.agg(*[quantile(F.col(f"`{c}`"), q, interpolation).alias(c) for c, q in quantiles.items()])

    def product(self, column: str, integral: bool) -> DataFrame:
        if integral:
            return integer_product(self.frame.add_column("key", F.col(self.key)), column, ["key"])
        return self.by.agg(product(F.col(column)).alias(column))

    def sizes(self) -> DataFrame:
        """key, the group's rows and its place in order of first appearance."""
        return self.by.agg(F.count("*").alias("size"), F.min(POS).alias("place"))

    def group(self, key: object) -> Frame:
        return Frame(self.frame.df.where(F.col(self.key).eqNullSafe(F.lit(key))))

    def unique(self) -> DataFrame:
        return self.by.agg(F.min(POS).alias("place"))

    # Python functions: a group must fit in a task, so expressions come first

    def apply_scalar(self, function: Callable, name: str = "value", kind: str = "double") -> DataFrame:
        """key and one value of a function of the group's rows (pandas, in order)."""
        key_kind = self.frame.df.schema[self.key].dataType.simpleString()
        columns, key = self.frame.columns, self.key

        def run(pdf):
            import pandas as pd

            pdf = pdf.sort_values(POS, kind="stable")
            return pd.DataFrame({"key": [pdf[key].iloc[0]], name: [function(pdf[columns])]})

        return self.frame.df.groupBy(self.key).applyInPandas(run, f"key {key_kind}, `{name}` {kind}")

    def apply_array(self, function: Callable, name: str = "value", kind: str = "double") -> Frame:
        """A value per row, of a function of the group's rows that gives as many."""
        label, place = (self.frame.df.schema[c].dataType.simpleString() for c in (IDX, POS))
        columns = self.frame.columns

        def run(pdf):
            pdf = pdf.sort_values(POS, kind="stable")
            out = list(function(pdf[columns]))
            if len(out) != len(pdf):
                raise ValueError("a group's result must have its length")
            return pdf[[IDX, POS]].assign(**{name: out})

        return Frame(self.frame.df.groupBy(self.key).applyInPandas(run, f"{IDX} {label}, {POS} {place}, `{name}` {kind}"))

    def apply_chunk(self, function: Callable, schema: str, combine: Callable | None = None, block: int = CHUNK) -> DataFrame:
        """The rows that a function makes of each group's.

        With ``combine`` no task holds a group: the function gets runs of a
        group's rows, of about ``block`` rows of the frame, and ``combine`` its
        rows of all runs, in order.
        """
        columns = self.frame.columns
        if combine:
            return self._apply_runs(function, schema, combine, block)

        def run(pdf):
            return function(pdf.sort_values(POS, kind="stable")[columns])

        return self.frame.df.groupBy(self.key).applyInPandas(run, schema)

    def _apply_runs(self, function: Callable, schema: str, combine: Callable, block: int) -> DataFrame:
        columns, key, kinds = self.frame.columns, self.key, T.StructType.fromDDL(schema)
        rows = self.frame.parted(block).withColumn("__of", F.col(f"`{key}`"))

        def run(pdf):
            out = function(pdf.sort_values(POS, kind="stable")[columns])
            return out.assign(**{"__of": pdf["__of"].iloc[0], PART: pdf[PART].iloc[0]})

        def merge(pdf):
            return combine(pdf.sort_values(PART, kind="stable")[kinds.names])

        marks = T.StructType([T.StructField("__of", rows.schema["__of"].dataType), T.StructField(PART, T.IntegerType())])
        return rows.groupBy("__of", PART).applyInPandas(run, T.StructType(kinds.fields + marks.fields)).groupBy("__of").applyInPandas(merge, kinds)

    def apply_columns(self, function: Callable, columns: Sequence[str] | None = None) -> DataFrame:
        """A function of each column of each group, to one double."""
        names = list(columns or self.frame.columns)
        key_kind = self.frame.df.schema[self.key].dataType.simpleString()
        key = self.key

        def run(pdf):
            import pandas as pd

            pdf = pdf.sort_values(POS, kind="stable")
            return pd.DataFrame({"key": [pdf[key].iloc[0]]} | {c: [float(function(pdf[c]))] for c in names})

        return self.frame.df.groupBy(self.key).applyInPandas(run, f"key {key_kind}, " + ", ".join(f"`{c}` double" for c in names))


def group_by(frame: Frame, key: str | Column) -> Grouped:
    """By a column, or by an expression or key of another origin (column ``__key``)."""
    if isinstance(key, str):
        return Grouped(frame, key)
    return Grouped(Frame(frame.df.withColumn("__key", key)), "__key")
