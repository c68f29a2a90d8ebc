"""Reading, writing and making tables (survey rows S1-S20, S29-S33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import dates
from ..operators import select
from ..session import scratch
from ..sources import arrays
from ..sources import files as s
from .base import query, table

c = F.col
PART = "SELECT p_partkey AS \"index\", p_name, p_size, p_retailprice FROM part"


def parts(spark, sf_dir) -> Frame:
    return Frame.of(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey")


@query("s01_read_parquet", "SELECT p_partkey AS \"index\", p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s01(spark, sf_dir):
    return s.read_parquet(spark, f"{sf_dir}/part.parquet", "p_partkey").to_df()


@query("s02_parquet_round_trip", PART)
def s02(spark, sf_dir):
    path = scratch(spark, "io")
    s.write_parquet(parts(spark, sf_dir), path)
    return s.read_parquet(spark, path, "index").to_df()


@query("s03_s04_csv_round_trip", PART)
def s03(spark, sf_dir):
    path = scratch(spark, "io")
    s.write_csv(parts(spark, sf_dir), path)
    return s.read_csv(spark, path, "index", schema="p_name string, p_size int, p_retailprice double, index long").to_df()


@query("s05_s06_arrow_stream_round_trip", "SELECT s_suppkey AS \"index\", s_name, s_acctbal FROM supplier")
def s05(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")
    return s.read_binary(spark, s.to_binary(f)).to_df()


@query("s07_json_lines_round_trip", PART)
def s07(spark, sf_dir):
    path = scratch(spark, "io")
    s.to_json(parts(spark, sf_dir)).select("json").write.text(path)
    return s.read_json(spark, path, "index long, p_name string, p_size int, p_retailprice double", "index").to_df()


@query("s08_json_rows_and_columns", "SELECT r_regionkey AS k, r_name AS n, 'rows' AS form FROM region UNION ALL SELECT r_regionkey, r_name, 'columns' FROM region")
def s08(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(c("r_regionkey").alias("k"), c("r_name").alias("n"))
    columns = s.to_json_columns(region, "k")
    rows = region.agg(F.to_json(F.collect_list(F.struct("k", "n"))).alias("json"))
    made = s.rows_of_json(rows, "json", "k int, n string").withColumn("form", F.lit("rows"))
    return made.union(s.rows_of_json(columns, "json", "k int, n string", columnar=True).withColumn("form", F.lit("columns")))


@query("s09_to_json", "SELECT '{\"index\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def s09(spark, sf_dir):
    return s.to_json(Frame.of(table(spark, sf_dir, "region"), "r_regionkey"))


@query("s10_array_of_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s10(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k: long>>"), 1)["k"].alias("k"))


@query("s12_list_files", "SELECT true AS some, true AS parquet")
def s12(spark, sf_dir):
    found = s.list_files(spark, sf_dir, "*.parquet")
    return found.agg((F.count("*") >= 14).alias("some"), F.bool_and(F.endswith("path", F.lit(".parquet"))).alias("parquet"))


@query("s13_s14_from_rows_and_arrow", "SELECT n_nationkey AS \"index\", n_name FROM nation")
def s13(spark, sf_dir):
    return Frame.from_arrow(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow(), "n_nationkey").to_df()


@query("s15_s18_from_columns", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), 1.5, 'x'), (8, NULL, 'y'), (9, 2.5, NULL)) t(\"index\", a, b)")
def s15(spark, sf_dir):
    return Frame.from_columns(spark, {"a": [1.5, float("nan"), 2.5], "b": ["x", "y", None]}, [7, 8, 9]).to_df()


@query("s17_from_scalars", "SELECT CAST(0 AS BIGINT) AS \"index\", 'v' AS a, CAST(2 AS BIGINT) AS b")
def s17(spark, sf_dir):
    return Frame.from_scalars(spark, {"b": 2, "a": "v"}).to_df()


@query("s19_from_struct", PART)
def s19(spark, sf_dir):
    packed = table(spark, sf_dir, "part").select(F.struct("p_partkey", "p_name", "p_size", "p_retailprice").alias("s"))
    return Frame.from_struct(packed, "s", "p_partkey").to_df()


@query("s20_s31_series_to_frame", "SELECT p_partkey AS \"index\", p_size AS size FROM part")
def s20(spark, sf_dir):
    return parts(spark, sf_dir)["p_size"].to_frame("size").to_df()


@query("s30_to_arrow", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def s30(spark, sf_dir):
    return spark.createDataFrame(parts(spark, sf_dir).to_df().toArrow()).agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


@query("s33_times_from_numbers", "SELECT event_id, make_timestamp(epoch_us(ts)) AS a, epoch_us(ts) AS t, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events")
def s33(spark, sf_dir):
    t = dates.micros(c("ts"))
    return table(spark, sf_dir, "events").select("event_id", dates.from_micros(t).alias("a"), t.alias("t"), c("ts").cast("date").cast("timestamp_ntz").alias("d"))


@query("s29_typed_arrays", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), DATE '2022-01-01', TIMESTAMP '2022-01-01 00:00:01', CAST(7 AS BIGINT), 2.5), (1, NULL, NULL, NULL, 2.5), (2, DATE '2022-01-03', TIMESTAMP '2022-01-03 00:00:00', 9, 2.5)) t(\"index\", d, t, n, c)")
def s29(spark, sf_dir):
    mask = [True, False, True]
    made = {"d": arrays.dates([18993, 0, 18995], mask), "t": arrays.times([1640995201, 0, 1641168000], "second", mask), "n": arrays.typed([7, 8, 9], "long", mask), "c": arrays.constant(2.5, 3, "double")}
    return arrays.frame(spark, made).to_df()


@query("s32_preview", "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part) SELECT p_partkey AS \"index\", p_size, CASE WHEN r <= 5 THEN 'head' ELSE 'tail' END AS \"end\" FROM p WHERE r <= 5 OR r > n - 5")
def s32(spark, sf_dir):
    return select.preview(parts(spark, sf_dir)[["p_size"]], 10)
