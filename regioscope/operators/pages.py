"""Fixed-layout text pages to cells: a strict line scan in DataFrame functions.

A page is exploded to lines and a line to tokens; every token has a type, one letter, and a line's types in a
row are a string. What a line is, is a pattern on that string: a header is a run of years (Y), spans (S) or codes;
a row is a run of values (N, Y, Z) with nothing but words behind it. Where tables begin and end, is a matter of islands: a
heading closes what is open, a header opens a section, running counts number both. Headings, captions and panels are
carried to the lines below them by the last known value, repeated labels are counted in their section. All windows lie on
the page, so lines are shuffled once and never leave their page's partition.

Words that mean something in one series of books are data, see ``Layout``. Refused rows leave with a reason, beside the kept ones.

Edge cases: a null or empty text has no lines; pages of equal number are pages of their own; a page of any length is scanned whole; lines without
a type of their own are skipped; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Layout:
    """Words and measures of the printed books."""

    aggregates: tuple[str, ...] = ("total", "ensemble", "sous total", "dont", "district", "grand tunis", "pib")
    regions: tuple[str, ...] = ("nord", "centre", "sud")  # aggregates when a dash follows
    notes: tuple[str, ...] = ("unite", "base", "source", "nb", "n.b", "champ")  # with a colon or a bracket after them
    running_titles: tuple[str, ...] = ("statistiques tunisie", "annuaire statistique")
    caption_heads: tuple[str, ...] = ("gouvernorat", "station", "categorie", "designation", "secteur", "branche", "pays", "nationalite", "libelle", "indicateur", "rubrique")
    captions: tuple[str, ...] = ("Masculin", "Féminin", "Masculin et Féminin")
    caption_gap: int = 8  # blanks between a row heading and a caption of the page
    caption_reach: int = 3
    heading_reach: int = 12
    least_rows: int = 5  # distinct rows that confirm a header of codes
    least_title: int = 9
    least_years: int = 2
    least_label: int = 3
    century: int = 50  # two-digit years up to here are of this century
    codes: tuple[int, int, int] = (3, 20, 9)  # least and most tokens of a header of codes, and a token's most characters


YEARBOOK = Layout()

#: Stands for the blank inside a number, so that the number is one token.
JOINT = "\ue000"
_DECIMAL = r"(?<=\d) {1,2}(?=\.\d)"
_THOUSANDS = r"(?<=(?<!\S)-?\d{1,3}(?: \d{3}){0,5}) (?=\d{3}(?![\d-]))"
#: Types of tokens: year, number, nil, mark of a provisional value, span of years; anything else is a word.
TYPES = {"Y": r"^(19|20)\d\d\**$", "N": rf"^-?\d+({JOINT}\d+)*(\.\d+)?\**$", "Z": r"^-\**$", "M": r"^\*+$", "S": r"^(\d{2}|\d{4})-\d{2}\**$"}
_VALUES = r"^(.*?)([NYZ][NYZM]*)[WS]*$"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER_SCRIPT = "[؀-ۿﭐ-ﻼ]"
_ENUMERATED = r"^\s*(?:[IVX]{1,4}|[A-Z]|\d{1,2})\s*[–—.)-]\s*(\S.*?)\s*$"


def _none(x: Column) -> Column:
    """An empty text as null."""
    return F.when(x != "", x)


def clean(x: Column) -> Column:
    return F.trim(x, F.lit(" .:-\t"))


def has_word(x: Column, least: int = 3) -> Column:
    return x.rlike(f"[{_LETTERS}]{{{least}}}")


def latin(x: Column) -> Column:
    """Without the rendering in another script beside it: tokens that keep a letter or a digit."""
    kept = F.filter(F.split(F.trim(F.regexp_replace(x, _OTHER_SCRIPT, " ")), r"\s+"), lambda t: t.rlike(f"[{_LETTERS}0-9]"))
    return F.array_join(kept, " ")


def folded(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(T.unaccent(x))), r"\s+", " ")


def words(line: Column) -> Column:
    """Tokens of a line; groups of thousands and split decimals are one number."""
    one = F.regexp_replace(F.regexp_replace(line, _DECIMAL, ""), _THOUSANDS, JOINT)
    return F.filter(F.split(one, r"\s+"), lambda t: t != "")


def token_type(token: Column) -> Column:
    out = F.lit("W")
    for name, pattern in reversed(TYPES.items()):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def types(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, token_type), "")


def number(token: Column) -> Column:
    """A value: a dash alone is nil, a mark alone is none."""
    body = F.replace(F.rtrim(token, F.lit("*")), F.lit(JOINT), F.lit(""))
    return F.when(body == "-", 0.0).otherwise(body.try_cast("double"))


def enumerated(x: Column) -> Column:
    """What stands behind an enumerator ("I - ", "A)", "5."), which opens a panel; else null."""
    return _none(F.regexp_extract(x, _ENUMERATED, 1))


def is_furniture(x: Column, layout: Layout = YEARBOOK) -> Column:
    notes = "|".join(n.replace(".", r"\.") for n in layout.notes)
    return folded(x).rlike(rf"^(?:{notes})(?:\.? ?:| ?\()|{'|'.join(layout.running_titles)}")


def row_kind(x: Column, layout: Layout = YEARBOOK) -> Column:
    """aggregate for totals and groups of regions, else data; letters set apart are read together."""
    one = F.regexp_replace(folded(x), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    plain = F.regexp_replace(F.regexp_replace(one, "-", " "), " +", " ")
    total = plain.rlike(rf"^(?:{'|'.join(layout.aggregates)})(?![a-z0-9])") | one.rlike(rf"^(?:{'|'.join(layout.regions)})\s*-")
    return F.when(total, "aggregate").otherwise("data")


def page_year(text: Column) -> Column:
    """The year a page states for itself: the first of "Année 2019" and a date after "au"."""
    year = r"(?:(?i:ann[ée]e)\s*:?\s*|\bau\s*:?\s*\d{1,2}[./]\d{1,2}[./])((?:19|20)\d\d)(?!\d)"
    return _none(F.regexp_extract(text, year, 1)).cast("int")


def heading(tokens: Column, layout: Layout = YEARBOOK) -> Column:
    """(table_number, title) or null: a number in two or three parts, then a title; numbers behind the title are cut, dotted leaders are contents."""
    figure = lambda t: F.trim(t, F.lit(".")).rlike(r"^(\d{1,3}(\.\d{1,2})*)?$")
    last = F.array_max(F.transform(tokens, lambda t, i: F.when((i > 0) & ~figure(t), i)))
    title = clean(F.replace(F.array_join(F.slice(tokens, 2, F.coalesce(last, F.lit(0))), " "), F.lit(JOINT), F.lit(" ")))
    first = F.get(tokens, F.lit(0))
    ok = first.rlike(r"^\d{1,2}(\.\d{1,2}){1,2}$") & ~F.exists(tokens, lambda t: t.contains("....")) & (F.length(title) >= layout.least_title) & has_word(title)
    return F.when(ok, F.struct(first.alias("table_number"), title.alias("title")))


def school_year(span: Column, layout: Layout = YEARBOOK) -> Column:
    """First year of a school year printed end first ("24-23", "2000-99"); null for other spans (such as ages)."""
    part = lambda i: F.get(F.split(F.rtrim(span, F.lit("*")), "-"), F.lit(i)).try_cast("int")
    end = F.when(F.length(F.get(F.split(span, "-"), F.lit(0))) == 4, part(0)).otherwise(part(0) + F.when(part(0) <= layout.century, 2000).otherwise(1900))
    return F.when((end - 1) % 100 == part(1), end - 1)


def header(tokens: Column, kinds: Column, layout: Layout = YEARBOOK) -> Column:
    """(labels, years, strict) of a line that heads columns, or null. Years and school years hold by themselves; codes have to be confirmed by rows."""
    none = F.lit(None).cast("int")
    of = lambda letter: F.filter(tokens, lambda t: t.rlike(TYPES[letter]))
    run = lambda letter: kinds.rlike(f"^[^{letter}]?{letter}{{{layout.least_years},}}[^{letter}]?$")
    years = F.transform(of("Y"), lambda t: F.substring(t, 1, 4).try_cast("int"))
    starts = F.transform(of("S"), lambda t: school_year(t, layout))
    low, high, short = layout.codes
    code = lambda t: t.rlike(r"[\d./-]") | (t.rlike("[A-ZÀ-ÖØ-Þ]") & ~t.rlike("[a-zà-öø-ÿ]"))
    codes = F.size(tokens).between(low, high) & F.forall(tokens, lambda t: F.length(t) <= short) & (2 * F.size(F.filter(tokens, code)) >= F.size(tokens))
    made = lambda labels, years, strict: F.struct(labels.alias("labels"), years.alias("years"), F.lit(strict).alias("strict"))
    return (
        F.when(run("Y"), made(F.transform(years, lambda y: y.cast("string")), years, True))
        .when(run("S") & F.forall(starts, lambda y: y.isNotNull()), made(F.transform(starts, lambda y: F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))), starts, True))
        .when(codes, made(F.transform(tokens, lambda t: F.replace(t, F.lit(JOINT), F.lit(" "))), F.transform(tokens, lambda t: none), False))
    )


def split_row(tokens: Column, kinds: Column) -> Column:
    """(label, values, provisional): the last run of values, whatever words stand behind it; null without values."""
    at = F.length(F.regexp_extract(kinds, _VALUES, 1))
    cells = F.slice(tokens, at + 1, F.greatest(F.length(F.regexp_extract(kinds, _VALUES, 2)), F.lit(0)))
    label = clean(F.replace(F.array_join(F.slice(tokens, F.lit(1), at), " "), F.lit(JOINT), F.lit(" ")))
    values = F.filter(F.transform(cells, number), lambda v: v.isNotNull())
    return F.when(kinds.rlike(_VALUES), F.struct(label.alias("label"), values.alias("values"), F.exists(cells, lambda t: t.endswith("*")).alias("provisional")))


def _extra(layout: Layout, page) -> Column:
    """1 where an undated column is named to the right of the years, on their line or under it."""
    last_year = F.length(F.regexp_extract("line", r"^(.*)(?<!\S)(?:19|20)\d\d(?!\S)", 1))
    plain = lambda x: (F.length(x) >= 4) & ~x.rlike(r"\d")
    beside = plain(latin(F.regexp_extract("line", r"(?<!\S)(?:19|20)\d\d(?!\S)(?!.*(?<!\S)(?:19|20)\d\d(?!\S))(.*)$", 1)))
    clear = lambda x: F.regexp_replace(x, _OTHER_SCRIPT, " ")
    under = [F.lead("line", i).over(page) for i in (1, 2)]
    below = [F.coalesce(plain(x) & has_word(clear(x), 4) & (F.length(F.regexp_extract(clear(x), r"^(\s*)", 1)) > last_year), F.lit(False)) for x in under]
    return F.when(F.col("kinds").contains("Y") & (beside | below[0] | below[1]), 1).otherwise(0)


def _lines(df: DataFrame, page: str, text: str, layout: Layout) -> DataFrame:
    """One row by line with its tokens, types and what it could be."""
    pages = df.select(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("pid", F.monotonically_increasing_id())
    lines = pages.select("pid", "page", page_year(F.col("text")).alias("stated"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("tokens", words(F.col("line"))).withColumn("kinds", types(F.col("tokens")))
    t, k = F.col("tokens"), F.col("kinds")
    return lines.withColumns({"head": heading(t, layout), "columns": header(t, k, layout), "row": split_row(t, k), "numbered": k.rlike("[NY]"), "latin": latin(F.col("line"))}).drop("tokens")


def _sections(lines: DataFrame, layout: Layout) -> DataFrame:
    """The lines of open sections with what their header and the lines above it say."""
    page = Window.partitionBy("pid").orderBy("at")
    upto, above = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    n = F.coalesce(F.size("row.values"), F.lit(0))
    strict = F.coalesce(F.col("columns.strict"), F.lit(False))
    codes = F.col("columns").isNotNull() & ~strict & F.col("head").isNull()
    lines = lines.withColumns({"n": n, "strict": strict, "codes": codes, "headed": F.col("head").isNotNull() & ~strict})

    def opened(df: DataFrame, closes: Column, span: str) -> DataFrame:
        """Numbers the stretches between closing lines; years open a section anywhere, codes where nothing is open."""
        within = Window.partitionBy("pid", span).orderBy("at")
        df = df.withColumn(span, F.count_if(closes).over(page.rowsBetween(*upto)))
        first = F.count_if(F.col("strict") | F.col("codes")).over(within.rowsBetween(*above)) == 0
        return df.withColumn("opens", F.col("strict") | (F.col("codes") & first))

    # a heading that ends in as many values as the header above has columns is a row: widths first, from headings that cannot be rows
    lines = opened(lines, F.col("headed") & (F.col("n") < layout.least_years), "rough")
    width = F.last(F.when(F.col("opens"), F.size("columns.labels")), ignorenulls=True).over(Window.partitionBy("pid", "rough").orderBy("at").rowsBetween(*above))
    lines = lines.withColumn("closes", F.col("headed") & ~F.coalesce((F.col("n") >= layout.least_years) & (F.col("n") == width), F.lit(False)))
    lines = opened(lines, F.col("closes"), "span")
    near = F.last(F.when(F.trim("line") != "", F.col("line")), ignorenulls=True).over(page.rowsBetween(-layout.caption_reach, -1))
    near = F.trim(F.regexp_replace(near, _OTHER_SCRIPT, " "))
    caption = F.regexp_replace(F.regexp_extract(near, rf"^\S+\s{{{layout.caption_gap},}}(.*)$", 1), r"\s+", " ")
    known = folded(F.regexp_extract(near, r"^(\S+)", 1)).isin(*layout.caption_heads) & caption.isin(*layout.captions)
    table = F.struct(
        "columns.labels", "columns.years", "strict", F.last("head", ignorenulls=True).over(page.rowsBetween(-layout.heading_reach, -1)).alias("head"),
        F.when(known, caption).alias("caption"), _extra(layout, page).alias("extra"),
    )
    lines = lines.withColumns({"section": F.count_if("opens").over(page.rowsBetween(*upto)), "table": F.when(F.col("opens"), table)})
    # what a row without a label can borrow
    rest = F.filter(F.array(*[F.struct(F.lead("latin", i).over(page).alias("latin"), F.lead("numbered", i).over(page).alias("numbered"), F.lead("line", i).over(page).alias("line")) for i in (1, 2, 3)]), lambda x: F.trim(x["line"]) != "")
    before = F.last(F.when(F.trim("line") != "", F.struct("latin", "numbered")), ignorenulls=True).over(page.rowsBetween(-2, -1))
    lines = lines.withColumns({"rest": rest, "before": before})
    within = Window.partitionBy("pid", "span").orderBy("at")
    lines = lines.withColumn("table", F.last("table", ignorenulls=True).over(within.rowsBetween(*upto)))
    return lines.where(F.col("table").isNotNull() & ~F.col("opens") & ~F.col("closes"))


def _borrowed(layout: Layout) -> Column:
    """A label for a row of bare numbers: the words above it, carried on below in lower case."""
    ok, parts = F.lit(True), []
    for i in range(3):
        x = F.get("rest", F.lit(i))
        ok = ok & F.coalesce(x["latin"].rlike("^[a-zà-öø-ÿ]") & ~x["numbered"], F.lit(False))
        parts.append(F.when(ok, x["latin"]))
    up = F.col("before")
    good = ~up["numbered"] & (F.length(up["latin"]) > layout.least_label) & has_word(up["latin"])
    return F.when(good, clean(F.concat_ws(" ", up["latin"], *parts)))


def _rows(lines: DataFrame, layout: Layout) -> DataFrame:
    """Rows with label, panel and the reason for which they are refused; lines that only name a panel are used up."""
    section = Window.partitionBy("pid", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    width = F.size("table.labels")
    lines = lines.withColumns({"width": width, "text": clean(F.col("latin")), "item": enumerated(F.col("line"))})
    numeric = F.col("row").isNotNull() & (F.col("numbered") | (F.col("n") == F.col("width")))  # a dash alone may belong to a panel's name
    fits = (F.col("n") == F.col("width")) | (F.col("n") == F.col("width") + F.col("table.extra"))
    label = F.coalesce(_none(latin(F.col("row.label"))), F.col("row.label"))
    lines = lines.where(F.trim("line") != "").withColumns({"numeric": numeric, "fits": fits, "label": label, "bare": F.col("row.label") == ""})
    # an enumerated line whose numbers are not those of a row names a panel
    item = clean(latin(F.col("item")))
    listed = F.col("numeric") & ~F.col("fits") & (F.col("bare") | (F.col("item").isNotNull() & ~types(words(F.col("item"))).rlike("[NY]")))
    named = listed & F.coalesce((F.length(item) >= layout.least_label) & has_word(item), F.lit(False))
    furniture = is_furniture(F.when(F.col("line").contains(":"), F.col("line")).otherwise(F.col("text")), layout)
    text = F.coalesce(_none(latin(F.col("item"))), F.col("item"), F.col("text"))
    lines = lines.withColumns({"names": ~F.col("numeric") & (F.col("text") != "") & ~furniture, "lists": named})
    lines = lines.withColumn("borrowed", F.when(F.col("numeric") & F.col("fits") & F.col("bare"), _borrowed(layout)))
    final = F.coalesce("borrowed", "label")
    why = (
        F.when(~F.col("fits"), F.concat(F.col("n").cast("string"), F.lit(" values under "), F.col("width").cast("string"), F.lit(" columns")))
        .when(F.col("bare"), F.when(F.col("borrowed").isNull(), "no label"))
        .when(is_furniture(F.col("row.label"), layout), "a caption or a page footer, not a row")
        .when(F.col("label").rlike(r"\d$"), "label ends in a digit, so a footnote mark may shift the columns")
        .when((F.length("label") < layout.least_label) | ~has_word(F.col("label")), "no words in the label")
    )
    lines = lines.withColumns({"why": why, "label": final})
    opens = F.when(F.col("names"), text).when(F.col("lists"), item).when(F.col("numeric") & ~F.col("bare") & F.col("why").isNull(), enumerated(F.col("label")))
    lines = lines.withColumn("opens_panel", opens).withColumn("panel", F.last("opens_panel", ignorenulls=True).over(section))
    # words that turn out to be the label of the row under them were no panel
    own = F.col("borrowed").isNotNull() & F.col("borrowed").startswith(F.col("panel"))
    lines = lines.withColumn("own", F.coalesce(own, F.lit(False)))
    panel = F.last(F.when(F.col("own"), F.lit("")).otherwise(F.col("opens_panel")), ignorenulls=True).over(section)
    lines = lines.withColumn("panel", F.when(~F.col("own"), _none(panel)))
    return lines.where(F.col("numeric") & ~F.col("lists"))


def _judged(rows: DataFrame, layout: Layout) -> DataFrame:
    """Repeated labels are named by their panel or refused; then the sections are judged."""
    table = Window.partitionBy("pid", "section")
    of = lambda label: Window.partitionBy("pid", "section", label)
    inferred = F.col("borrowed").isNotNull()
    twice = inferred & (F.count_if(F.col("why").isNull() & inferred).over(of("label")) > 1)
    rows = rows.withColumn("why", F.coalesce("why", F.when(twice, "inferred label is not unique within the table")))
    times = F.count_if(F.col("why").isNull()).over(of("label"))
    rows = rows.withColumn("repeats", F.col("why").isNull() & (times > 1))
    rows = rows.withColumn("why", F.coalesce("why", F.when(F.col("repeats") & F.col("panel").isNull(), "label repeats without a panel above it")))
    rows = rows.withColumn("label", F.when(F.col("repeats") & F.col("why").isNull(), F.concat("panel", F.lit(" / "), "label")).otherwise(F.col("label")))
    again = F.count_if(F.col("why").isNull()).over(of("label"))
    rows = rows.withColumn("why", F.coalesce("why", F.when(F.col("repeats") & (again > 1), "label repeats within one panel")))
    distinct = F.size(F.collect_set(F.when(F.col("why").isNull(), F.col("label"))).over(table))
    rows = rows.withColumn("distinct", distinct).where(F.col("table.head").isNull() | F.col("table.strict") | (F.col("distinct") >= layout.least_rows))
    undated = F.get("table.years", F.lit(0)).isNull() & F.col("stated").isNull()
    why = F.when(F.col("table.head").isNull(), "no table heading above the columns").when(undated, "no year on the page")
    return rows.withColumn("why", F.coalesce("why", why))


def parse_pages(df: DataFrame, page: str = "page", text: str = "text", layout: Layout = YEARBOOK) -> DataFrame:
    """All pages, kept cells and refused rows (with a reason, without a value) in one frame."""
    rows = _judged(_rows(_sections(_lines(df, page, text, layout), layout), layout), layout)
    cells = F.arrays_zip(F.col("table.labels").alias("label"), F.col("table.years").alias("year"), F.slice("row.values", F.lit(1), F.col("width")).alias("value"))
    cell = "struct<label:string,year:int,value:double>"
    rows = rows.withColumn("cell", F.explode(F.when(F.col("why").isNull(), cells.cast(f"array<{cell}>")).otherwise(F.array(F.lit(None).cast(cell)))))
    kept = lambda x: F.when(F.col("why").isNull(), x)
    return rows.select(
        F.col("page").cast("bigint").alias("page"), "table.head.table_number", "table.head.title", F.col("label").alias("row_label"), kept(row_kind(F.col("label"), layout)).alias("row_kind"),
        F.col("cell.label").alias("column_label"), kept(F.coalesce("cell.year", "stated")).alias("year"), "cell.value", kept(F.col("row.provisional")).alias("provisional"),
        kept(F.col("borrowed").isNotNull()).alias("label_inferred"), F.col("table.caption").alias("panel"), F.col("why").alias("reason"),
    )
