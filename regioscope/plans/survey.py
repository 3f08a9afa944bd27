"""Survey microdata: decode and join, pivot by function, shares, grouping sets, deciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import decode as D
from ..functions import measures as M
from ..sources.tables import geography, table

#: Code books and the product types as functions.
STATUS = {"F": "filled", "O": "open"}
FLAG = {"R": "returned", "A": "accepted"}
OVERRIDES = {1001: 9, 1500: 9}


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order as household: size = lines, weight = quantity; orders without lines have no weight and stay out."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("bigint").alias("size"), F.sum("l_quantity").alias("weight"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    h = o.join(lines, o.o_orderkey == lines.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    return h.join(F.broadcast(geography(spark, sf_dir)), h.c_nationkey == F.col("nationkey")).select(
        F.col("o_orderkey").alias("hh_id"), "size", "weight", F.col("c_mktsegment").alias("segment"), "nation", "region",
        "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("total"), F.try_divide("o_totalprice", "size").alias("per_head"),
    )


HH = """hh AS (SELECT o_orderkey AS hh_id, l.size, l.weight, c_mktsegment AS segment, n_name AS nation, r_name AS region, o_orderstatus, o_orderpriority, o_totalprice AS total, o_totalprice / l.size AS per_head
 FROM orders JOIN (SELECT l_orderkey, count(*) AS size, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL) l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("microdata_decode_join", """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status, n_name AS nation, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority,
 CAST(count(*) AS BIGINT) AS n, round_even(avg(o_totalprice), 8) AS mean_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def microdata_decode_join(spark, sf_dir) -> DataFrame:
    """Rename, decode (an unmapped code is null), safe cast and many-to-one left joins."""
    o = D.rename(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), {"o_orderstatus": "status", "o_orderpriority": "priority"})
    o = D.decode_frame(o, {"status": STATUS}).withColumn("priority", D.number(F.split_part("priority", F.lit("-"), F.lit(1))))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(geography(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey"), "left")
    return j.groupBy("status", "nation", "priority").agg(F.count("*").cast("bigint").alias("n"), F.bround(F.avg("o_totalprice"), 8).alias("mean_total"))


@query("product_classification", """SELECT CAST(CASE p_partkey WHEN 1001 THEN 9 WHEN 1500 THEN 9 ELSE CASE WHEN p_partkey < 1000 THEN p_partkey // 100 ELSE p_partkey // 1000 END END AS INT) AS function_code,
 CAST(count(*) AS BIGINT) AS products, round_even(avg(p_retailprice * p_size / 1000), 6) AS annual FROM part GROUP BY ALL""")
def product_classification(spark, sf_dir) -> DataFrame:
    """Main group by hundreds or thousands of the code with exceptions; amount times frequency over 1000."""
    p = table(spark, sf_dir, "part").withColumn("function_code", D.classify(F.col("p_partkey"), OVERRIDES))
    return p.groupBy("function_code").agg(F.count("*").cast("bigint").alias("products"), M.publish(F.avg(F.col("p_retailprice") * F.col("p_size") / 1000)).alias("annual"))


_TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


def _pivot_sql() -> str:
    cols = ", ".join(f"round_even(coalesce(sum(v) FILTER (t = '{t}'), 0), 4) AS exp_{t.lower()}" for t in _TYPES)
    shares = ", ".join(f"round_even(coalesce(sum(v) FILTER (t = '{t}'), 0) / nullif(sum(v), 0), 6) AS share_{t.lower()}" for t in _TYPES)
    return f"SELECT hh_id, {cols}, {shares}, round_even(sum(v), 4) AS exp_total FROM (SELECT l_orderkey AS hh_id, split_part(p_type, ' ', 1) AS t, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY hh_id"


@query("function_pivot_shares", _pivot_sql())
def function_pivot_shares(spark, sf_dir) -> DataFrame:
    """Wide spending by function with explicit columns and shares of the total; one shuffle, on the household."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("t"))
    x = l.join(p, l.l_partkey == p.p_partkey)
    part = {t: F.coalesce(F.sum(F.when(F.col("t") == t, F.col("l_extendedprice"))), F.lit(0.0)) for t in _TYPES}
    total = F.sum("l_extendedprice")
    return x.groupBy(F.col("l_orderkey").alias("hh_id")).agg(
        *[F.bround(v, 4).alias(f"exp_{t.lower()}") for t, v in part.items()], *[M.publish(F.try_divide(v, total)).alias(f"share_{t.lower()}") for t, v in part.items()], F.bround(total, 4).alias("exp_total"),
    )


@query("household_composition", """SELECT o_orderkey AS hh_id, CAST(count(l_orderkey) AS BIGINT) AS size, CAST(count(*) FILTER (l_quantity < 15) AS BIGINT) AS n_small, CAST(count(*) FILTER (l_quantity BETWEEN 15 AND 35) AS BIGINT) AS n_middle,
 CAST(count(*) FILTER (l_quantity > 35) AS BIGINT) AS n_large, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def household_composition(spark, sf_dir) -> DataFrame:
    """Conditional counts of members by household, joined on the left; a household without members counts 0."""
    n = lambda c: F.count_if(c).cast("bigint")
    q = F.col("l_quantity")
    members = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("bigint").alias("size"), n(q < 15).alias("n_small"), n(q.between(15, 35)).alias("n_middle"), n(q > 35).alias("n_large"), n(F.col("l_returnflag") == "R").alias("n_returned"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hh_id"))
    return o.join(members, o.hh_id == members.l_orderkey, "left").drop("l_orderkey").fillna(0)


_EMIT = "round_even(sum(weight * per_head) / sum(weight), 4) AS mean_per_head, round_even(100 * sum(CASE WHEN per_head < 20000 THEN weight ELSE 0 END) / sum(weight), 6) AS poor_share, CAST(count(*) AS BIGINT) AS n"


@query("indicator_panel_grouping_sets", f"""WITH {HH} SELECT CASE WHEN GROUPING(region) = 0 AND GROUPING(segment) = 0 THEN 'region_segment' WHEN GROUPING(region) = 0 THEN 'region' WHEN GROUPING(segment) = 0 THEN 'segment' ELSE 'national' END AS level,
 coalesce(region, 'all') AS region, coalesce(segment, 'all') AS segment, {_EMIT} FROM hh GROUP BY GROUPING SETS ((), (segment), (region), (region, segment))""")
def indicator_panel_grouping_sets(spark, sf_dir) -> DataFrame:
    """One indicator set at every level of the hierarchy, in one grouped pass."""
    h = households(spark, sf_dir).select("region", "segment", "weight", "per_head")
    a, b = F.grouping("region"), F.grouping("segment")
    level = F.when((a == 0) & (b == 0), "region_segment").when(a == 0, "region").when(b == 0, "segment").otherwise("national")
    g = h.groupingSets([[], ["segment"], ["region"], ["region", "segment"]], "region", "segment").agg(
        level.alias("level"), F.bround(M.weighted_mean(F.col("per_head"), F.col("weight")), 4).alias("mean_per_head"),
        M.publish(M.weighted_share(F.col("per_head") < 20000, F.col("weight"))).alias("poor_share"), F.count("*").cast("bigint").alias("n"),
    )
    return g.fillna("all", ["region", "segment"])


@query("category_shares", f"""WITH {HH}, s AS (SELECT segment, o_orderpriority AS category, sum(weight) AS w FROM hh GROUP BY ALL) SELECT segment, category, round_even(100 * w / sum(w) OVER (PARTITION BY segment), 6) AS share FROM s""")
def category_shares(spark, sf_dir) -> DataFrame:
    """Weighted shares of categories within a group."""
    s = households(spark, sf_dir).groupBy("segment", F.col("o_orderpriority").alias("category")).agg(F.sum("weight").alias("w"))
    return s.select("segment", "category", M.publish(F.try_divide(100 * F.col("w"), F.sum("w").over(Window.partitionBy("segment")))).alias("share"))


@query("outlet_value_shares", """WITH s AS (SELECT p_brand AS product, l_returnflag AS outlet, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT product, outlet, round_even(100 * v / sum(v) OVER (PARTITION BY product), 6) AS share FROM s""")
def outlet_value_shares(spark, sf_dir) -> DataFrame:
    """Value-weighted shares of outlets by product; lines are summed by part before the dictionary is joined."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    s = by.join(p, by.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("product"), F.col("l_returnflag").alias("outlet")).agg(F.sum("v").alias("v"))
    return s.select("product", "outlet", M.publish(F.try_divide(100 * F.col("v"), F.sum("v").over(Window.partitionBy("product")))).alias("share"))


@query("decile_distribution", f"""WITH {HH}, d AS (SELECT *, ntile(10) OVER (PARTITION BY region ORDER BY per_head, hh_id) AS decile FROM hh), s AS (SELECT region, CAST(decile AS INT) AS decile, sum(total) AS v, sum(weight * per_head) / sum(weight) AS m FROM d GROUP BY ALL)
SELECT region, decile, round_even(100 * v / sum(v) OVER (PARTITION BY region), 6) AS share, round_even(m, 4) AS mean_per_head FROM s""")
def decile_distribution(spark, sf_dir) -> DataFrame:
    """Deciles over a total order within each region, with value shares and weighted means."""
    d = M.tiles(households(spark, sf_dir).select("region", "per_head", "hh_id", "total", "weight"), ["region"], 10, "per_head", "hh_id", "decile")
    s = d.groupBy("region", "decile").agg(F.sum("total").alias("v"), M.weighted_mean(F.col("per_head"), F.col("weight")).alias("m"))
    return s.select("region", "decile", M.publish(F.try_divide(100 * F.col("v"), F.sum("v").over(Window.partitionBy("region")))).alias("share"), F.bround("m", 4).alias("mean_per_head"))


@query("household_gini_weighted", f"""WITH {HH}, s AS (SELECT region, per_head AS y, weight / sum(weight) OVER (PARTITION BY region) AS w, weight FROM hh), r AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY y, weight ROWS UNBOUNDED PRECEDING) AS c, sum(w * y) OVER (PARTITION BY region) AS mu FROM s)
SELECT region, CAST(count(*) AS BIGINT) AS n, round_even(200 / any_value(mu) * sum(w * y * (c - w / 2 - 0.5)), 6) AS gini FROM r GROUP BY region""")
def household_gini_weighted(spark, sf_dir) -> DataFrame:
    """Weighted Gini (0 to 100) over microdata."""
    g = M.split_gini(households(spark, sf_dir).select("region", "per_head", "weight"), ["region"], "per_head", "weight")
    return g.select("region", F.col("n").cast("bigint").alias("n"), M.publish(100 * F.col("gini")).alias("gini"))


@query("unpivot_long", """UNPIVOT (SELECT c_nationkey AS nationkey, round_even(avg(c_acctbal), 4) AS mean_balance, CAST(count(*) AS DOUBLE) AS customers, round_even(max(c_acctbal), 4) AS highest FROM customer GROUP BY ALL) ON mean_balance, customers, highest INTO NAME indicator VALUE value""")
def unpivot_long(spark, sf_dir) -> DataFrame:
    wide = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.bround(F.avg("c_acctbal"), 4).alias("mean_balance"), F.count("*").cast("double").alias("customers"), F.bround(F.max("c_acctbal"), 4).alias("highest"))
    return wide.unpivot(["nationkey"], ["mean_balance", "customers", "highest"], "indicator", "value")


@query("top_products_by_value", """WITH s AS (SELECT r_name AS region, p_brand AS brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY v DESC, brand) AS k FROM s) SELECT region, brand, round_even(v, 2) AS v, CAST(k AS INT) AS k FROM r WHERE k <= 3""")
def top_products_by_value(spark, sf_dir) -> DataFrame:
    """The three largest in each region (a top-k report)."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    p, s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = by.join(p, by.l_partkey == p.p_partkey).join(s, by.l_suppkey == s.s_suppkey).join(F.broadcast(geography(spark, sf_dir)), F.col("s_nationkey") == F.col("nationkey"))
    x = x.groupBy("region", "brand").agg(F.sum("v").alias("v"))
    k = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("v"), "brand"))
    return x.withColumn("k", k).where("k <= 3").withColumn("v", F.bround("v", 2))


