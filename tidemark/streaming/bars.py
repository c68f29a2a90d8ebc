"""Event bars over a stream: closed-left buckets counted from the epoch.

Anchors such as the first day need a global minimum, which a stream doesn't
have.  State is a row per open bucket and key; the watermark bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, ts: str, value: str, order: Sequence[str], width: str = "1 hour", late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """bucket (and keys) with open, high, low, close, total and n."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    place = F.struct(*order)
    grouped = timed.withWatermark("__ts", late).groupBy(F.window("__ts", width).alias("w"), *by)
    x = F.col(value)
    out = grouped.agg(F.min_by(x, place).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, place).alias("close"), F.sum(x).alias("total"), F.count(x).alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *by, "open", "high", "low", "close", "total", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all that a stream's source holds and gives the result as a table of that name."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
