"""Parquet, CSV, JSON and Arrow streams.

Paths may be local, ``hdfs://`` or ``s3a://``; credentials are the cluster's, or
those of ``s3_options``.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame


def read_parquet(spark: SparkSession, path: str, index: str | None = None, order: Sequence[str] | None = None) -> Frame:
    return Frame.of(spark.read.parquet(path), index, order)


def write_parquet(frame: Frame, path: str, index: str = "index", compression: str = "gzip") -> None:
    """The label is the last column."""
    _last_index(frame, index).write.option("compression", compression).parquet(path)


def _last_index(frame: Frame, index: str) -> DataFrame:
    return frame.to_df(index).select(*frame.columns, index)


def read_csv(spark: SparkSession, path: str, index: str | None = None, order: Sequence[str] | None = None, schema: str | None = None) -> Frame:
    """With a header; give a schema at scale, since inferring one is another pass."""
    reader = spark.read.option("header", True)
    return Frame.of(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path), index, order)


def write_csv(frame: Frame, path: str, index: str = "index") -> None:
    _last_index(frame, index).write.option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, index: str | None = None, order: Sequence[str] | None = None) -> Frame:
    return Frame.of(spark.read.schema(schema).json(path), index, order)


def rows_of_json(df: DataFrame, column: str, schema: str, columnar: bool = False) -> DataFrame:
    """The rows of JSON text: ``[{..}, ..]``, or with ``columnar`` ``{c: [..], ..}``."""
    if not columnar:
        return df.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))
    fields = [part.strip().split(":", 1) if ":" in part else part.strip().split(None, 1) for part in schema.split(",")]
    lists = ", ".join(f"{n.strip()}: array<{t.strip()}>" for n, t in fields)
    parsed = df.select(F.from_json(column, f"struct<{lists}>").alias("j"))
    return parsed.select(F.inline(F.arrays_zip(*[F.col(f"j.{n.strip()}").alias(n.strip()) for n, _ in fields])))


def to_json(frame: Frame, index: str = "index") -> DataFrame:
    """A line of JSON per row."""
    return frame.to_df(index).select(F.to_json(F.struct("*")).alias("json"))


def to_json_columns(df: DataFrame, order: str) -> DataFrame:
    """One text ``{c: [..], ..}``: for results that fit in a value."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    return df.agg(rows.alias("r")).select(F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in df.columns])).alias("json"))


def to_binary(frame: Frame, columns: Sequence[str] | None = None, index: str = "index") -> bytes:
    """An Arrow stream of the rows in order: for results that fit on the driver."""
    df = frame.df.orderBy("__pos").select(*(columns or frame.columns), F.col("__idx").alias(index))
    table = df.toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue()


def read_binary(spark: SparkSession, blob: bytes, index: str | None = "index") -> Frame:
    with pa.ipc.open_stream(blob) as stream:
        table = stream.read_all()
    table = table.append_column("__place", pa.array(range(table.num_rows), pa.int64()))
    frame = Frame.of(spark.createDataFrame(table), index, ["__place"])
    return frame.drop("__place")


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modified): a listing by the storage's own interface, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def s3_options(spark: SparkSession, key: str, secret: str, endpoint: str | None = None) -> None:
    """Credentials of ``s3a://`` paths for this session."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", key)
    conf.set("fs.s3a.secret.key", secret)
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)
