"""Driver tables with explicit schemas, and the frames that the queries build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key, nation, region: a dimension of fixed size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, the denominator of per-head values."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").cast("bigint").alias("population"))


def regional_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by segment (the indicator), year, nation and region; orders are summed by customer key first."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    by_customer = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    cells = by_customer.join(c, by_customer.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment"), "year", F.col("c_nationkey").alias("nationkey")).agg(F.sum("v").alias("value"))
    return cells.join(F.broadcast(geography(spark, sf_dir)), "nationkey").select("segment", "year", "nation", "region", "value", "nationkey")


CELLS = """cells AS (
  SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INT) AS year, n_name AS nation, r_name AS region, n_nationkey AS nationkey, sum(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL), pop AS (SELECT c_nationkey AS nationkey, count(*) AS population FROM customer GROUP BY ALL)"""
