"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

#: Spark's setting by which a finished query deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Parquet tables under a folder of their own; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "part") -> str:
        self._n += 1
        return f"{self.folder}/{name}-{self._n}"

    def save(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back: cuts the lineage."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def named(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """``df``, which reads nothing but a saved table: dropping it drops that."""
        df._tidemark_path = getattr(table, "_tidemark_path", None)
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``save`` returned; nothing may read it later."""
        if path := getattr(df, "_tidemark_path", None):
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Queries that end inside delete their shuffle files; their results are written tables."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
