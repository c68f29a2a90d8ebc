"""Alignment by label, concatenation and sets (survey rows J, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import IDX, POS, Frame
from ..operators import align as a
from .base import EV, event_frame, query, table

c = F.col


def orders(spark, sf_dir, *columns: str) -> Frame:
    return Frame.of(table(spark, sf_dir, "orders").select("o_orderkey", *columns), "o_orderkey")


def customers(spark, sf_dir, *columns: str) -> Frame:
    return Frame.of(table(spark, sf_dir, "customer").select("c_custkey", *columns), "c_custkey")


BOTH = "SELECT coalesce(c_custkey, p_partkey) AS \"index\", c_acctbal AS x, p_retailprice AS x_1 FROM customer {how} JOIN (SELECT p_partkey * 3 AS p_partkey, p_retailprice FROM part) ON c_custkey = p_partkey"


def _two(spark, sf_dir):
    left = Frame.of(table(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("x")), "c_custkey")
    right = Frame.of(table(spark, sf_dir, "part").select((c("p_partkey") * 3).alias("p_partkey"), c("p_retailprice").alias("x")), "p_partkey")
    return left, right


@query("j01_concat_columns_outer", BOTH.format(how="FULL"))
def j01(spark, sf_dir):
    return a.concat_columns(_two(spark, sf_dir)).to_df()


@query("j01_concat_columns_numbered", BOTH.format(how="FULL").replace("AS x_1", 'AS "1"').replace("AS x,", 'AS "0",'))
def j01_numbered(spark, sf_dir):
    return a.concat_columns(_two(spark, sf_dir), sort=True, ignore_names=True).to_df()


@query("j01_order_of_appearance", f"WITH b AS ({BOTH.format(how='FULL')}) SELECT \"index\", row_number() OVER (ORDER BY CASE WHEN x IS NULL THEN 1 ELSE 0 END, \"index\") - 1 AS place FROM b")
def j01_order(spark, sf_dir):
    rows = a.concat_columns(_two(spark, sf_dir)).dense()
    return rows.select(c(IDX).alias("index"), c("__row").cast("long").alias("place"))


@query("j02_concat_columns_inner", BOTH.format(how="INNER"))
def j02(spark, sf_dir):
    return a.concat_columns(_two(spark, sf_dir), "inner").to_df()


@query("j03_paste", "WITH a AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), b AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) SELECT c_custkey AS \"index\", c_acctbal AS x, p_retailprice AS y FROM a LEFT JOIN b USING (r)")
def j03(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return a.paste(left, right.rename({"x": "y"})).to_df()


@query("j04_j05_reindex", "SELECT o_custkey * 2 AS \"index\", CASE WHEN c_custkey IS NULL THEN -1.0 ELSE c_acctbal END AS bal FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer) ON c_custkey = o_custkey * 2")
def j04(spark, sf_dir):
    f = Frame.of(table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END").alias("bal")), "c_custkey")
    labels = table(spark, sf_dir, "orders").select((c("o_custkey") * 2).alias("k")).distinct()
    return a.reindex(f, labels, "k", fill=-1.0).to_df()


@query("j04_reindex_series_of_times", f"SELECT g.ts AS \"index\", v FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS ts) g LEFT JOIN (SELECT h AS ts, arg_max(v, event_id) FILTER (v IS NOT NULL OR v IS NULL) AS v FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, coalesce(v, -1) AS v, event_id FROM {EV}) GROUP BY 1) USING (ts)")
def j04_series(spark, sf_dir):
    from datetime import datetime

    from ..sources.ranges import date_range

    f = event_frame(spark, sf_dir, "v")
    f = Frame(f.df.withColumn(IDX, F.date_trunc("hour", IDX).cast("timestamp_ntz")).withColumn("v", F.coalesce("v", F.lit(-1.0))))
    return a.reindex(f, date_range(spark, datetime(2024, 1, 1), datetime(2024, 1, 31), freq="1H"), "ts").to_df()


@query("j06_align_series", "SELECT coalesce(c_custkey, p_partkey) AS \"index\", round(c_acctbal + p_retailprice, 4) AS x FROM customer FULL JOIN (SELECT p_partkey * 3 AS p_partkey, p_retailprice FROM part) ON c_custkey = p_partkey")
def j06(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return (left["x"] + right["x"]).map_expr(lambda x: F.round(x, 4)).to_frame().to_df()


@query("j09_index_in_table", "WITH f AS (SELECT s_nationkey, min(s_suppkey) AS place FROM supplier GROUP BY 1) SELECT c_custkey, place FROM customer LEFT JOIN f ON c_nationkey = s_nationkey")
def j09(spark, sf_dir):
    return a.index_in(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey").select("c_custkey", "place")


@query("frame_plus_frame_by_position", "WITH a AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part), b AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT a.p_partkey AS \"index\", a.p_size + b.p_size AS p_size FROM a JOIN b USING (r)")
def by_position(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    left = Frame.of(df.select("p_partkey", "p_size"), "p_partkey")
    right = Frame(df.select(c("p_partkey").alias(IDX), F.struct((-c("p_retailprice")).alias("o"), c("p_partkey").alias("k")).alias(POS), "p_size"))
    return (left + right).to_df()


@query("u01_u03_concat_rows_outer", "SELECT c_custkey AS \"index\", CAST(c_acctbal AS DOUBLE) AS v, c_mktsegment AS seg, NULL AS size FROM customer UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE), NULL, p_size FROM part")
def u01(spark, sf_dir):
    x = Frame.of(table(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("v"), c("c_mktsegment").alias("seg")), "c_custkey")
    y = Frame.of(table(spark, sf_dir, "part").select("p_partkey", c("p_size").alias("v"), c("p_size").alias("size")), "p_partkey")
    return a.concat_rows([x, y]).to_df()


@query("u01_concat_rows_numbered", "SELECT row_number() OVER (ORDER BY f, k) - 1 AS \"index\", v FROM (SELECT 0 AS f, c_custkey AS k, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 1, p_partkey, p_name FROM part)")
def u01_numbered(spark, sf_dir):
    x = Frame.of(table(spark, sf_dir, "customer").select("c_custkey", c("c_custkey").alias("v")), "c_custkey")
    y = Frame.of(table(spark, sf_dir, "part").select("p_partkey", c("p_name").alias("v")), "p_partkey")
    return a.concat_rows([x, y], ignore_index=True).to_df()


@query("u02_concat_rows_inner", "SELECT c_custkey AS \"index\", c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def u02(spark, sf_dir):
    x = Frame.of(table(spark, sf_dir, "customer").select("c_custkey", c("c_acctbal").alias("v"), "c_name"), "c_custkey")
    y = Frame.of(table(spark, sf_dir, "supplier").select("s_suppkey", c("s_acctbal").alias("v"), "s_name"), "s_suppkey")
    return a.concat_rows([x, y], "inner").to_df()


@query("u04_u05_append", "SELECT c_custkey AS \"index\", c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def u05(spark, sf_dir):
    x, y = customers(spark, sf_dir, "c_acctbal"), Frame.of(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return a.append(x["c_acctbal"].rename("bal"), y["s_acctbal"]).to_df()


@query("u06_union", "WITH b AS (SELECT 0 AS f, s_suppkey AS r, s_nationkey AS k FROM supplier UNION ALL SELECT 1, c_custkey, c_nationkey FROM customer), d AS (SELECT k, min((f, r)) AS m FROM b GROUP BY 1) SELECT k, row_number() OVER (ORDER BY m) - 1 AS place FROM d")
def u06(spark, sf_dir):
    from ..order import with_position

    x = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("k"), c("s_suppkey").alias("o"))
    y = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("k"), c("c_custkey").alias("o"))
    return with_position(a.union(x, y, "k", "o"), ["place"], "n").select("k", c("n").cast("long").alias("place"))


@query("u07_intersection", "SELECT o_custkey AS k, max(o_orderkey) AS place FROM orders WHERE o_custkey IN (SELECT l_suppkey FROM lineitem) GROUP BY 1")
def u07(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("o"))
    y = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("k"), c("l_orderkey").alias("o"))
    return a.intersection(x, y, "k", "o")
