"""The operators' input relations drawn from the driver's tables, in Spark and, word for word alike, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as definitions: many share a name."""
    kind = F.lower("p_type")
    file = F.concat(F.lit("libs/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/"), F.col("p_size").cast("string"), F.lit(".ts"))
    return read(spark, sf_dir, "part").select(
        F.col("p_name").alias("symbol"), kind.alias("kind"), file.alias("file"), F.col("p_partkey").alias("line"),
        F.concat(kind, F.lit(" "), F.col("p_name")).alias("signature"), F.col("p_partkey").alias("ord"),
    )


DEFS = """v_defs AS (SELECT p_name AS symbol, lower(p_type) AS kind,
  'libs/' || replace(lower(p_brand), '#', '') || '/' || p_size || '.ts' AS file, p_partkey AS line,
  lower(p_type) || ' ' || p_name AS signature, p_partkey AS ord FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as imports: the supplier's file imports the part's type and brand."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("@"), F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("specifier"))
    items = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("file"), "l_partkey")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("file", "specifier")


EDGES = """v_edges AS (SELECT 'supp/' || l_suppkey || '.ts' AS file, '@' || lower(p_type) || '/' || lower(p_brand) AS specifier
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation pairs (supplier's to customer's) that trade over a tenth more than pairs do on average."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # at most a row per pair of nations, so one task is enough, and the join runs once
    marked = pairs.select("src", "dst", "n", F.count(F.lit(1)).over(whole).alias("pairs"), F.sum("n").over(whole).alias("total"))
    strong = (F.col("src") != F.col("dst")) & (F.col("n") * F.col("pairs") * 10 > F.col("total") * 11)
    return marked.filter(strong).select("src", "dst", "n")


TRADE = """pairs AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
v_graph AS (SELECT src, dst, n FROM pairs, (SELECT count(*) AS pairs, sum(n) AS total FROM pairs)
  WHERE src <> dst AND n * pairs * 10 > total * 11)"""

REACH = """reach AS (SELECT src AS a, dst AS b FROM v_graph UNION SELECT r.a, g.dst FROM reach r JOIN v_graph g ON r.b = g.src)"""
