"""The library's fixtures over the shared tables: lines from order lines, points, a graph and areas, by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linenet.operators import lines as L


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def vertices(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        return self.lineitem.select(
            F.col("l_orderkey").alias("line_id"), F.row_number().over(order).alias("seq"),
            ((F.col("l_partkey") * 37) % 1000 + F.col("l_quantity")).alias("x"), ((F.col("l_suppkey") * 53) % 1000 + F.col("l_discount") * 100).alias("y"), "l_returnflag", "l_shipdate",
        )

    def lines(self) -> DataFrame:
        return L.collect_lines(self.vertices(), ["line_id"])

    def segments(self) -> DataFrame:
        return L.segments(self.lines(), ["line_id"])

    def customers(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 1009).cast("double").alias("x"), ((F.col("c_custkey") * 101) % 997).cast("double").alias("y"), "c_nationkey", "c_acctbal", "c_mktsegment")

    def suppliers(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("rid"), ((F.col("s_suppkey") * 211) % 1009).cast("double").alias("x"), ((F.col("s_suppkey") * 307) % 997).cast("double").alias("y"), "s_name")

    def edges(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 997).alias("b"), F.col("o_totalprice").alias("length_m"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"))

    def boxes(self) -> DataFrame:
        k = F.col("r_regionkey").cast("double") * 200
        return self.region.select(F.col("r_regionkey").cast("long").alias("area_id"), "r_name", k.alias("x0"), k.alias("y0"), (k + 250).alias("x1"), (k + 250).alias("y1"))


# The same as DuckDB's common table expressions.
V = """v AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
    ((l_partkey * 37) % 1000 + l_quantity)::DOUBLE AS x, ((l_suppkey * 53) % 1000 + l_discount * 100)::DOUBLE AS y, l_returnflag, l_shipdate FROM lineitem),
  w AS (SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py FROM v WINDOW p AS (PARTITION BY line_id ORDER BY seq)),
  k AS (SELECT * FROM w WHERE px IS NULL OR px <> x OR py <> y),
  c AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, lead(x) OVER p AS nx, lead(y) OVER p AS ny, row_number() OVER p AS rn FROM k WINDOW p AS (PARTITION BY line_id ORDER BY seq)),
  l AS (SELECT * FROM c WHERE n > 1),
  s AS (SELECT line_id, rn - 1 AS seg, x AS x1, y AS y1, nx AS x2, ny AS y2, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM l WHERE nx IS NOT NULL)"""
CU = "cu AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1009)::DOUBLE AS x, ((c_custkey * 101) % 997)::DOUBLE AS y, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
SU = "su AS (SELECT s_suppkey AS rid, ((s_suppkey * 211) % 1009)::DOUBLE AS x, ((s_suppkey * 307) % 997)::DOUBLE AS y, s_name FROM supplier)"
ED = "ed AS (SELECT o_orderkey AS edge_id, o_custkey AS a, (o_custkey * 7 + o_orderkey) % 997 AS b, o_totalprice AS length_m, o_orderpriority AS source, o_orderstatus AS status FROM orders)"
BX = "bx AS (SELECT r_regionkey::BIGINT AS area_id, r_name, r_regionkey * 200.0::DOUBLE AS x0, r_regionkey * 200.0::DOUBLE AS y0, (r_regionkey * 200 + 250)::DOUBLE AS x1, (r_regionkey * 200 + 250)::DOUBLE AS y1 FROM region)"
