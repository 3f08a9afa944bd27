"""Text normalisation, page parsing, catalogues of headings, canonical titles, file manifests."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..functions import text as T
from ..operators import pages, titles
from ..sources import files
from ..sources.tables import CELLS, geography, regional_cells, table

_SQL_FOLD = f"regexp_replace(lower(translate(replace(replace({{x}}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{T.ACCENTED}', '{T.PLAIN}')), '[^a-z]', '', 'g')"


@query("text_normalise", f"""WITH t AS (SELECT doc_id, text || ' ' || CAST(doc_id AS VARCHAR) || '.2' AS x FROM documents)
SELECT doc_id, {_SQL_FOLD.format(x="x")} AS folded, lower(trim(regexp_replace(regexp_replace(x, '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS latin_title,
 trim(lower(translate(replace(replace(regexp_replace(x, '\\s+[\\d.]+$', ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{T.ACCENTED}', '{T.PLAIN}')), ' ') AS stem,
 array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(x, '[؀-ۿ]+', ' ', 'g'), ' '), '\\s+'), lambda t: regexp_matches(t, '[A-Za-zÀ-ÿ0-9]')), ' ') AS latin_tokens FROM t""")
def text_normalise(spark, sf_dir) -> DataFrame:
    """Whole texts as labels, with a table number behind."""
    x = F.concat("text", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".2"))
    t = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return t.select("doc_id", T.fold(F.col("x")).alias("folded"), T.latin_title(F.col("x")).alias("latin_title"), T.stem(F.col("x")).alias("stem"), T.latin_tokens(F.col("x")).alias("latin_tokens"))


@query("number_repair", """WITH t AS (SELECT p_partkey AS product, CAST(p_partkey * 7 + 1000 AS VARCHAR) AS n FROM part) SELECT product, CAST(n AS DOUBLE) + 0.5 AS doubled, CAST(n AS DOUBLE) + 0.2 AS split_decimal, CAST(n AS DOUBLE) + 0.25 AS comma FROM t""")
def number_repair(spark, sf_dir) -> DataFrame:
    """Numbers rendered with doubled glyphs, a split decimal and a decimal comma, read back."""
    n = (F.col("p_partkey") * 7 + 1000).cast("string")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), n.alias("n"))
    doubled = F.regexp_replace(F.concat("n", F.lit(".5")), "(.)", "$1$1")
    split = F.concat("n", F.lit(" .2"))
    return t.select("product", T.number(doubled).alias("doubled"), T.number(T.rejoin_decimal(split)).alias("split_decimal"), T.number(F.concat("n", F.lit(",25"))).alias("comma"))


def amount(x) -> Column:
    """A value as the books print it: thousands set off by a blank, two decimals."""
    return F.replace(F.format_string("%,.2f", F.coalesce(x, F.lit(0.0))), F.lit(","), F.lit(" "))


def one_page(rows: DataFrame, keys: list[str], order: list[str], head: Column) -> DataFrame:
    """(page, text): the head, then the lines of each group in order."""
    body = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n").alias("body"))
    return body.select(F.xxhash64(*keys).alias("page"), F.concat(head, "body").alias("text"))


def table_line(title: Column) -> Column:
    return F.concat(F.lit("2."), (F.length("segment") % 9 + 1).cast("string"), F.lit(" "), title)


YEARS = list(range(2001, 1994, -1))


def by_year(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values of all years as printed columns."""
    wide = cells.groupBy(*keys).pivot("year", YEARS).agg(F.sum("value"))
    return wide.select(*keys, F.concat_ws("   ", *[amount(F.col(str(y))) for y in YEARS]).alias("numbers"))


def rendered_pages(cells: DataFrame) -> DataFrame:
    """One page by indicator: heading, unit line, reversed years, a row by unit, as a yearbook prints them."""
    line = F.concat(F.rpad(F.concat("nation", F.lit(" région")), 24, " "), "numbers", F.lit("   الولاية"))
    head = F.concat(table_line(F.concat(F.lit("Valeur par gouvernorat "), F.lower("segment"))), F.lit("  4.2\nUnité : dinars\nGouvernorat  " + "  ".join(map(str, YEARS)) + "  الولاية\n"))
    return one_page(by_year(cells, ["segment", "nation"]).withColumn("line", line), ["segment"], ["nation"], head)


@query("table_page_parse", """WITH c AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS y, n_name AS nation, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT segment, nation, CAST(y AS INT) AS y FROM (SELECT DISTINCT segment, nation FROM c), generate_series(1995, 2001) AS t(y))
SELECT '2.' || (length(segment) % 9 + 1) AS table_number, 'Valeur par gouvernorat ' || lower(segment) AS title, nation || ' région' AS row_label, 'data' AS row_kind, y AS year, round_even(coalesce(v, 0), 2) AS value FROM g LEFT JOIN c USING (segment, nation, y)""")
def table_page_parse(spark, sf_dir) -> DataFrame:
    """Round trip: cells are rendered as fixed-layout pages and parsed back."""
    got = pages.parse_pages(rendered_pages(regional_cells(spark, sf_dir)))
    return got.where("reason is null").select("table_number", "title", "row_label", "row_kind", "year", F.bround("value", 2).alias("value"))


_GRID = f"""WITH {CELLS}, v AS (SELECT segment, nation, year, sum(value) AS v FROM cells GROUP BY ALL),
g AS (SELECT segment, nation, CAST(y AS INT) AS y FROM (SELECT DISTINCT segment, nation FROM v), generate_series(1995, 2001) AS t(y)), f AS (SELECT g.*, round_even(coalesce(v.v, 0), 2) AS value FROM g LEFT JOIN v ON g.segment = v.segment AND g.nation = v.nation AND g.y = v.year)"""


@query("school_page_parse", f"""{_GRID} SELECT '2.' || (length(segment) % 9 + 1) AS table_number, nation || ' région' AS row_label, y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS column_label, y AS year, value FROM f""")
def school_page_parse(spark, sf_dir) -> DataFrame:
    """Columns headed by school years, printed end first, in two digits and for the last in four."""
    spans = "  ".join(f"{y + 1}-{y % 100:02d}" if y == YEARS[-1] else f"{(y + 1) % 100:02d}-{y % 100:02d}" for y in YEARS)
    line = F.concat("nation", F.lit(" région   "), "numbers")
    head = F.concat(table_line(F.concat(F.lit("Élèves par gouvernorat "), F.lower("segment"))), F.lit(f"\nGouvernorat   {spans}   الولاية\n"))
    got = pages.parse_pages(one_page(by_year(regional_cells(spark, sf_dir), ["segment", "nation"]).withColumn("line", line), ["segment"], ["nation"], head))
    return got.where("reason is null").select("table_number", "row_label", "column_label", "year", F.bround("value", 2).alias("value"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("category_page_parse", f"""WITH {CELLS}, v AS (SELECT segment, nation, year, sum(value) AS v FROM cells GROUP BY ALL), r AS (SELECT DISTINCT year, nation FROM v)
SELECT r.nation || ' région' AS row_label, left(s, 4) || '.' AS column_label, r.year, round_even(coalesce(v.v, 0), 2) AS value FROM r CROSS JOIN (VALUES {', '.join(f"('{x}')" for x in _SEGMENTS)}) AS t(s) LEFT JOIN v ON v.segment = s AND v.year = r.year AND v.nation = r.nation
WHERE r.year IN (SELECT year FROM r GROUP BY year HAVING count(*) >= 5)""")
def category_page_parse(spark, sf_dir) -> DataFrame:
    """Columns headed by codes under a stated year; a page of fewer than five rows does not confirm its codes."""
    wide = regional_cells(spark, sf_dir).groupBy("year", "nation").pivot("segment", list(_SEGMENTS)).agg(F.sum("value"))
    line = F.concat("nation", F.lit(" région   "), F.concat_ws("   ", *[amount(F.col(c)) for c in _SEGMENTS]))
    head = F.concat(F.lit("3.1 Valeur par gouvernorat et secteur\nAnnée : "), F.col("year").cast("string"), F.lit("\n" + "  ".join(f"{c[:4]}." for c in _SEGMENTS) + "\n"))
    got = pages.parse_pages(one_page(wide.withColumn("line", line), ["year"], ["nation"], head))
    return got.where("reason is null").select("row_label", "column_label", "year", F.bround("value", 2).alias("value"))


_PARTS = ("premier semestre", "second semestre")


@query("stacked_page_parse", f"""WITH v AS (SELECT c_mktsegment AS segment, r_name AS region, CAST(month(o_orderdate) > 6 AS INT) AS part, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
n AS (SELECT segment, region, part, CASE WHEN count(DISTINCT region) OVER s > 1 THEN region || ' / ' ELSE '' END || CASE part WHEN 0 THEN '{_PARTS[0]}' ELSE '{_PARTS[1]}' END AS row_label FROM (SELECT DISTINCT segment, region, part FROM v) WINDOW s AS (PARTITION BY segment, part))
SELECT n.segment, row_label, CAST(y AS INT) AS year, round_even(coalesce(v.v, 0), 2) AS value FROM n CROSS JOIN generate_series(1995, 2001) AS t(y) LEFT JOIN v ON v.segment = n.segment AND v.region = n.region AND v.part = n.part AND v.year = y""")
def stacked_page_parse(spark, sf_dir) -> DataFrame:
    """Panels one above the other, whose rows have the same labels: each is named by its panel."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    by_customer = o.groupBy("o_custkey", F.year("o_orderdate").alias("year"), (F.month("o_orderdate") > 6).cast("int").alias("part")).agg(F.sum("o_totalprice").alias("v"))
    cells = by_customer.join(c, by_customer.o_custkey == c.c_custkey).join(F.broadcast(geography(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey"))
    cells = cells.groupBy(F.col("c_mktsegment").alias("segment"), "region", "part", "year").agg(F.sum("v").alias("value"))
    rows = by_year(cells, ["segment", "region", "part"])
    first = F.col("part") == F.min("part").over(Window.partitionBy("segment", "region"))
    panel = F.concat(F.chr(F.dense_rank().over(Window.partitionBy("segment").orderBy("region")) + 64), F.lit(") "), "region", F.lit("\n"))
    label = F.when(F.col("part") == 0, _PARTS[0]).otherwise(_PARTS[1])
    line = F.concat(F.when(first, panel).otherwise(""), label, F.lit("   "), "numbers")
    head = F.concat(table_line(F.lit("Valeur par semestre et région")), F.lit("\nUnité : dinars\nSemestre  " + "  ".join(map(str, YEARS)) + "\n"))
    pages_of = one_page(rows.withColumn("line", line), ["segment"], ["region", "part"], head)
    got = pages.parse_pages(pages_of).where("reason is null")
    names = cells.select(F.xxhash64("segment").alias("page"), "segment").distinct()
    return got.join(F.broadcast(names), "page").select("segment", "row_label", "year", F.bround("value", 2).alias("value"))


@query("page_refusals", f"""WITH {CELLS}, r AS (SELECT DISTINCT segment, nation, nationkey % 6 AS k FROM cells), x AS (SELECT segment, CASE k WHEN 1 THEN '6 values under 7 columns' WHEN 2 THEN 'label ends in a digit, so a footnote mark may shift the columns' WHEN 3 THEN 'a caption or a page footer, not a row'
 WHEN 4 THEN 'no words in the label' WHEN 5 THEN 'label repeats without a panel above it' END AS reason FROM r, generate_series(1, CASE WHEN k = 5 THEN 2 ELSE 1 END)),
y AS (SELECT segment, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL) SELECT segment, reason, n FROM y UNION ALL SELECT segment, 'no table heading above the columns', 1 FROM (SELECT DISTINCT segment FROM r)""")
def page_refusals(spark, sf_dir) -> DataFrame:
    """Pages with a fault in five rows of six, by kind, and a table without a heading behind each: what is refused, and why."""
    rows = by_year(regional_cells(spark, sf_dir), ["segment", "nation", "nationkey"])
    k, label = F.col("nationkey") % 6, F.concat("nation", F.lit(" région"))
    faulty = (
        F.when(k == 1, F.concat(label, F.lit("   "), F.regexp_replace("numbers", " {3}[^ ]+(?: \\d{3})*[.]\\d\\d$", "")))
        .when(k == 2, F.concat(label, F.lit("5   "), "numbers")).when(k == 3, F.concat(F.lit("Source : "), label, F.lit("   "), "numbers")).when(k == 4, F.concat(F.lit("R.   "), "numbers"))
        .when(k == 5, F.concat(label, F.lit("   "), "numbers", F.lit("\n"), label, F.lit("   "), "numbers")).otherwise(F.concat(label, F.lit("   "), "numbers"))
    )
    head = F.concat(table_line(F.lit("Valeur par gouvernorat du pays")), F.lit("\nGouvernorat  " + "  ".join(map(str, YEARS)) + "\n"))
    bad = one_page(rows.withColumn("line", faulty), ["segment"], ["nation"], head)
    loose = rows.select("segment").distinct().select(F.xxhash64("segment").alias("page"), F.lit("Tableau sans titre\nAn 2001 2000\nTunis centre 1 2\n").alias("text"))
    got = pages.parse_pages(bad.union(loose)).where("reason is not null").groupBy("page", "reason").agg(F.count("*").alias("n"))
    names = rows.select(F.xxhash64("segment").alias("page"), "segment").distinct()
    return got.join(F.broadcast(names), "page").select("segment", "reason", "n")


@query("heading_catalogue", """SELECT DISTINCT '2.' || (length(c_mktsegment) % 9 + 1) AS table_number, 'Valeur par gouvernorat ' || lower(c_mktsegment) AS title FROM customer JOIN orders ON o_custkey = c_custkey""")
def heading_catalogue(spark, sf_dir) -> DataFrame:
    """Headings of all pages: a number in parts, then a title without numbers behind it."""
    lines = rendered_pages(regional_cells(spark, sf_dir)).select(F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select(pages.heading(pages.words(F.col("line"))).alias("head")).where("head is not null")
    return found.select("head.table_number", "head.title").distinct()


@query("canonical_titles")
def canonical_titles(spark, sf_dir) -> DataFrame:
    """Titles that grow over editions (a prefix of one another, agreeing on their shared cells) get one name."""
    cells = regional_cells(spark, sf_dir)
    title = F.concat(F.lit("Valeur des commandes "), F.lower("segment"), F.when(F.col("year") % 3 == 1, F.lit(" par gouvernorat")).when(F.col("year") % 3 == 2, F.lit(" par gouvernorat 2.4")).otherwise(F.lit("")))
    printed = cells.select(F.lit("2").alias("chapter"), title.alias("title"), F.col("nation").alias("row_label"), "year", "value")
    later = cells.select(F.lit("2"), F.concat(F.lit("Valeur des commandes "), F.lower("segment")), "nation", "year", "value")
    return titles.canonical(printed.union(later), ["row_label", "year"])


@query("manifest_verify")
def manifest_verify(spark, sf_dir) -> DataFrame:
    """Digests of all files against a manifest: ok, mismatch, missing, unlisted."""
    found = files.scan(spark, sf_dir)
    table_file = F.substring_index("name", "/", 1)  # a table is a file or a folder of files
    planted = table_file.isin("nation.parquet", "documents.parquet")
    known = found.select("name", F.when(planted, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256")).where(~table_file.isin("region.parquet", "orders.parquet"))
    absent = spark.createDataFrame([("absent.parquet", "1" * 64)], "name string, sha256 string")
    return files.verify(found, known.unionByName(absent))


