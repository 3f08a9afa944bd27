"""Survey modules: individuals and dwellings from tables that share keys and columns, an index of value labels, labels with leaked numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..functions import decode as D
from ..functions import measures as M
from ..operators import microdata as MD
from ..sources.tables import regional_cells, table
from .survey import HH, function_pivot_shares, households, _pivot_sql

#: Code books of the modules.
LEVELS = {0: "none", 1: "primary", 2: "secondary", 3: "higher"}
COVER = {"R": "insured", "A": "assisted", "N": "none"}
TENURE = {"1-URGENT": "owner", "2-HIGH": "tenant", "3-MEDIUM": "lodged"}


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as persons of a household (the order); lines of one number are one person."""
    most = [F.max(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_returnflag")]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hh_id"), F.col("l_linenumber").alias("person_id")).agg(*most)


def roster(people: DataFrame) -> DataFrame:
    return people.select("hh_id", "person_id", F.floor("l_quantity").cast("int").alias("age"), (F.col("l_partkey") % 2).cast("int").alias("sex"))


def education(people: DataFrame) -> DataFrame:
    """One module: an exact age under the roster's name for it, the same sex, a level; persons of odd suppliers did not answer."""
    level = D.decode((F.col("l_partkey") % 5).cast("int"), LEVELS)
    return people.where("l_suppkey % 2 = 0").select("hh_id", "person_id", F.col("l_quantity").alias("age"), (F.col("l_partkey") % 2).cast("int").alias("sex"), level.alias("level"))


def health(people: DataFrame) -> DataFrame:
    """Another: the roster's age again, and insurance."""
    return people.where("person_id < 6").select("hh_id", "person_id", F.floor("l_quantity").cast("int").alias("age"), D.decode(F.col("l_returnflag"), COVER).alias("cover"))


_PEOPLE = "pp AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"
_COVER = "CASE l_returnflag WHEN 'R' THEN 'insured' WHEN 'A' THEN 'assisted' WHEN 'N' THEN 'none' END"


@query("individuals", f"""WITH {HH}, {_PEOPLE} SELECT l_orderkey AS hh_id, l_linenumber AS person_id, region, segment, weight, size AS hh_size, CAST(floor(l_quantity) AS INT) AS age, CAST(l_partkey % 2 AS INT) AS sex, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END AS exact_age,
 CASE WHEN l_suppkey % 2 = 0 THEN CASE l_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'higher' END END AS level, CASE WHEN l_linenumber < 6 THEN {_COVER} END AS cover FROM pp LEFT JOIN hh ON l_orderkey = hh_id""")
def individuals(spark, sf_dir) -> DataFrame:
    """Persons on two keys: the roster with education (its age renamed, its sex held against the roster's) and health, then what a household carries."""
    source = persons(spark, sf_dir)
    people = MD.joined(roster(source), education(source), ["hh_id", "person_id"], rename={"age": "exact_age"})
    people = MD.joined(people, health(source), ["hh_id", "person_id"])
    hh = households(spark, sf_dir).select("hh_id", "region", "segment", "weight", F.col("size").alias("hh_size"))
    return D.lead_columns(MD.joined(people, hh, ["hh_id"]), ["hh_id", "person_id", "region", "segment", "weight", "hh_size"])


@query("dwelling", f"""WITH {HH}, x AS ({_pivot_sql()}) SELECT hh_id, nation, CASE o_orderpriority WHEN '1-URGENT' THEN 'owner' WHEN '2-HIGH' THEN 'tenant' WHEN '3-MEDIUM' THEN 'lodged' END AS tenure, hh.size AS hh_size, round_even(per_head, 6) + 0.0 AS per_head, share_promo, share_economy, exp_total FROM hh JOIN x USING (hh_id)""")
def dwelling(spark, sf_dir) -> DataFrame:
    """Households with their tenure and the shares of their spending."""
    hh = households(spark, sf_dir).select("hh_id", "nation", D.decode(F.col("o_orderpriority"), TENURE).alias("tenure"), F.col("size").alias("hh_size"), M.publish(F.col("per_head")).alias("per_head"))
    shares = function_pivot_shares(spark, sf_dir).select("hh_id", "share_promo", "share_economy", "exp_total")
    return MD.joined(hh, shares, ["hh_id"])


@query("individual_indicators", f"""WITH {HH}, {_PEOPLE}, i AS (SELECT region, weight, l_quantity AS age, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey % 5 = 3 AS INT) END AS higher, CASE WHEN l_linenumber < 6 THEN CAST(l_returnflag = 'R' AS INT) END AS insured FROM pp JOIN hh ON l_orderkey = hh_id)
SELECT region, CAST(count(*) AS BIGINT) AS persons, CAST(count(higher) AS BIGINT) AS answered, round_even(100 * sum(weight * higher) / sum(weight) FILTER (higher IS NOT NULL), 6) AS higher_share, round_even(100 * sum(weight * insured) / sum(weight) FILTER (insured IS NOT NULL), 6) AS insured_share FROM i GROUP BY region""")
def individual_indicators(spark, sf_dir) -> DataFrame:
    """Weighted shares over persons, each over those who answered the module."""
    people = individuals(spark, sf_dir).where("region is not null")
    share = lambda on, known: M.publish(F.try_divide(100 * F.sum(F.when(known & on, F.col("weight")).otherwise(0.0)), F.sum(F.when(known, F.col("weight")))))
    asked, seen = F.col("exact_age").isNotNull(), F.col("cover").isNotNull()
    return people.groupBy("region").agg(
        F.count("*").alias("persons"), F.count_if(asked).alias("answered"), share(F.coalesce(F.col("level") == "higher", F.lit(False)), asked).alias("higher_share"), share(F.col("cover") == "insured", seen).alias("insured_share")
    )


_BOOKS = """b AS (SELECT 'size' AS col, p_partkey % 3 AS origin, p_size AS code, min(split_part(p_type, ' ', 1)) AS label FROM part WHERE p_size <= 30 + 5 * (p_partkey % 3) AND (p_partkey % 3 > 0 OR p_size > 2) GROUP BY ALL
 UNION ALL SELECT 'brand', 1 + p_partkey % 2, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT), min(p_brand) FROM part GROUP BY ALL),
e AS (SELECT DISTINCT 'size' AS col, p_size AS code, 'size ' || p_size AS label FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT DISTINCT 'brand', CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT), 'brand' FROM part WHERE p_partkey % 4 = 0)"""


@query("value_label_index", f"""WITH {_BOOKS}, o AS (SELECT col, min(origin) AS origin FROM b GROUP BY col), f AS (SELECT b.col, code, label FROM b JOIN o ON b.col = o.col AND b.origin = o.origin), c AS (SELECT col, code, count(DISTINCT label) > 1 AS conflict FROM b GROUP BY ALL),
k AS (SELECT col, code FROM f UNION SELECT col, code FROM e UNION SELECT col, code FROM c WHERE conflict)
SELECT k.col AS "column", k.code, o.origin, coalesce(f.label, '') AS label, coalesce(e.label, '{MD.UNMAPPED}') AS other_label, coalesce(conflict, false) AND (f.label IS NOT NULL OR conflict) AS conflict FROM k JOIN o ON k.col = o.col LEFT JOIN f ON k.col = f.col AND k.code = f.code LEFT JOIN e ON k.col = e.col AND k.code = e.code LEFT JOIN c ON k.col = c.col AND k.code = c.code""")
def value_label_index(spark, sf_dir) -> DataFrame:
    """Labels of coded columns from three files and a second language: the first file that has a column is its origin."""
    p = table(spark, sf_dir, "part")
    part3, brand = F.col("p_partkey") % 3, F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    sizes = p.where((F.col("p_size") <= 30 + 5 * part3) & ((part3 > 0) | (F.col("p_size") > 2))).groupBy(F.lit("size").alias("column"), part3.alias("origin"), F.col("p_size").alias("code")).agg(F.min(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("label"))
    brands = p.groupBy(F.lit("brand").alias("column"), (1 + F.col("p_partkey") % 2).alias("origin"), brand.alias("code")).agg(F.min("p_brand").alias("label"))
    english = p.where("p_size % 3 <> 0").select(F.lit("size").alias("column"), F.col("p_size").alias("code"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("label")).union(p.where("p_partkey % 4 = 0").select(F.lit("brand"), brand, F.lit("brand"))).distinct()
    wanted = spark.createDataFrame([("size",), ("brand",)], "column string")
    return MD.label_index(sizes.unionByName(brands), english, wanted)


@query("stray_digits", """WITH c AS (SELECT DISTINCT c_mktsegment AS title, n_nationkey AS k, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT title, CASE WHEN k % 3 = 1 THEN k || '     ' || nation ELSE '12   3  ' || nation END AS row_label, CASE WHEN k % 4 > 0 THEN nation ELSE CASE WHEN k % 3 = 1 THEN k || '     ' || nation ELSE '12   3  ' || nation END END AS rejoined, CASE WHEN k % 4 > 0 THEN 'repaired' ELSE 'refused' END AS repair FROM c WHERE k % 3 > 0
UNION ALL SELECT title, nation, nation, 'untouched' FROM c WHERE k % 3 = 0 OR k % 4 > 0 UNION ALL SELECT DISTINCT title, '123   STATISTIQUES', '123   STATISTIQUES', 'refused' FROM c""")
def stray_digits(spark, sf_dir) -> DataFrame:
    """Labels behind one or two leaked numbers, some without a clean printing in their table, and a footer."""
    c = regional_cells(spark, sf_dir).select(F.col("segment").alias("title"), F.col("nationkey").alias("k"), "nation").distinct()
    leaked = F.when(F.col("k") % 3 == 1, F.concat(F.col("k").cast("string"), F.lit("     "), "nation")).otherwise(F.concat(F.lit("12   3  "), "nation"))
    rows = c.where("k % 3 > 0").select("title", leaked.alias("row_label")).union(c.where("k % 3 = 0 or k % 4 > 0").select("title", "nation")).union(c.select("title", F.lit("123   STATISTIQUES")).distinct())
    return MD.rejoined(rows, ["title"], "row_label")
