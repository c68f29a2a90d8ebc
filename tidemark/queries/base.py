"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
#: ``events`` with nulls put in, as a Spark expression and as SQL.
V = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
EV = f"(SELECT *, {V} AS v FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``v``, the value with some nulls."""
    return table(spark, sf_dir, "events").withColumn("v", F.expr(V))


def event_frame(spark: SparkSession, sf_dir: str, *columns: str, index: str = "ts") -> Frame:
    """Events labelled by time, in the order of their ids."""
    df = events(spark, sf_dir)
    picked = df.select(index, "event_id", *[c for c in columns if c not in (index, "event_id")])
    return Frame.of(picked, index, ["event_id"], keep=index in columns)[list(columns)]


def rounded(x: Column | str, digits: int) -> Column:
    """Doubles rounded as SQL's engines do: the product with a power of ten, half away from zero.

    ``F.round`` rounds the shortest decimal of a double, which may be a tie that the double isn't.
    """
    x, ten = F.col(x) if isinstance(x, str) else x, F.lit(10.0**digits)
    scaled = x * ten
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), x).otherwise(F.round(scaled) / ten)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in FOUND:
            raise ValueError(name)
        FOUND[name] = run, sql
        return run

    return add


def scalar(name: str, source: str, keys: list[str], columns: Mapping[str, tuple[Callable[[], Column], str]], source_sql: str | None = None) -> None:
    """A query of expressions over a table: column -> (expression, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir) if source == "events" else table(spark, sf_dir, source)
        return df.select(*keys, *[make().alias(n) for n, (make, _) in columns.items()])

    origin = source_sql or (EV + " AS e" if source == "events" else source)
    FOUND[name] = run, f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {n}' for n, (_, sql) in columns.items())} FROM {origin}"
