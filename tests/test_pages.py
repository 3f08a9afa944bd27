"""Literal lines and pages of the strict reader; text expressions; files."""

from pyspark.sql import functions as F

from regioscope.functions import text as T
from regioscope.operators import pages as P
from regioscope.operators import titles
from regioscope.sources import files


def of(spark, expression, *lines):
    """Value of an expression on (line, its tokens, their types) for each line."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("t", P.words(F.col("line"))).withColumn("k", P.types(F.col("t")))
    got = [r.x for r in df.select("i", expression(F.col("line"), F.col("t"), F.col("k")).alias("x")).orderBy("i").collect()]
    return got if len(lines) > 1 else got[0]


def parse(spark, *pages):
    return P.parse_pages(spark.createDataFrame([(i + 1, x) for i, x in enumerate(pages)], "page bigint, text string")).collect()


def cells(spark, page):
    return {(r.row_label, r.column_label): r.value for r in parse(spark, page) if r.reason is None}


def reasons(spark, page):
    return sorted((r.row_label, r.reason) for r in parse(spark, page) if r.reason)


def test_rows(spark):
    lines = ["Bizerte   1 234   56.5   -   الاسم", "20 à 24 ans   12   13", "Nord - Ouest 5 6", "Taux5 52.3", "Pop 4 526 .2 2 495 .0", "Sfax 12* 13", "Sfax 12 ... 13", "12 345 67 890 -5", "Plus de 10 000 habitants 1 234 567.5 8", "nothing here", "a5 b", ""]
    want = [("Bizerte", [1234.0, 56.5, 0.0], False), ("20 à 24 ans", [12.0, 13.0], False), ("Nord - Ouest", [5.0, 6.0], False), ("Taux5", [52.3], False), ("Pop", [4526.2, 2495.0], False), ("Sfax", [12.0, 13.0], True),
            ("Sfax 12", [13.0], False), ("", [12345.0, 67890.0, -5.0], False), ("Plus de 10 000 habitants", [1234567.5, 8.0], False), None, None, None]
    assert [r and tuple(r) for r in of(spark, lambda x, t, k: P.split_row(t, k), *lines)] == want


def test_headers(spark):
    lines = ["Gouvernorat 2023 2022* 2021 الولاية", "in 2020 and 2021 prices rose", "24-23 23-22 00-99", "2000-99 1999-98", "24-20 29-25", "I.S.F T.G.F 49-45", "une phrase ordinaire coupée"]
    got = of(spark, lambda x, t, k: P.header(t, k), *lines)
    assert [r and (r.labels, r.years, r.strict) for r in got] == [
        (["2023", "2022", "2021"], [2023, 2022, 2021], True), None, (["2023/24", "2022/23", "1999/00"], [2023, 2022, 1999], True), (["1999/00", "1998/99"], [1999, 1998], True), None,
        (["I.S.F", "T.G.F", "49-45"], [None] * 3, False), None,
    ]
    got = of(spark, lambda x, t, k: P.heading(t), "2.4 Population par gouvernorat 4.2", "2.4 Population par gouvernorat ...... 86", "2.4.1 Population de 10 000 habitants 12", "2.4 Pop")
    assert [r and tuple(r) for r in got] == [("2.4", "Population par gouvernorat"), None, ("2.4.1", "Population de 10 000 habitants"), None]


def test_panels_and_refusals(spark):
    page = "14.1 Commerce extérieur par mois\nMois 2023 2022\nI - Importations\nJanvier 1 2\nFévrier 3 4\nII - Exportations\nJanvier 5 6\nFévrier 7 8\nMars 9\n"
    kept = cells(spark, page)
    assert kept["Importations / Janvier", "2023"] == 1 and kept["Exportations / Février", "2022"] == 8
    assert reasons(spark, page) == [("Mars", "1 values under 2 columns")]
    again = parse(spark, "14.1 Commerce extérieur par mois\nMois 2023 2022\nJanvier 1 2\nJanvier 3 4\n")
    assert again and all(r.reason == "label repeats without a panel above it" for r in again)
    assert parse(spark, None, "") == []
    assert [r.reason for r in parse(spark, "x 2023 2022\nTunis 1 2\n")] == ["no table heading above the columns"]
    twice = "14.1 Commerce extérieur par mois\nMois 2023 2022\nI - Importations\nJanvier 1 2\nJanvier 3 4\n"
    assert reasons(spark, twice) == [("Importations / Janvier", "label repeats within one panel")] * 2


def test_categories_need_rows_and_a_year(spark):
    body = "".join(f"Ville{chr(97 + i)} {i} {i + 1} {i + 2}\n" for i in range(6))
    head = "3.1 Fécondité par gouvernorat et âge\nAnnée 2019\nI.S.F T.G.F 49-45\n"
    rows = parse(spark, head + body)
    assert len(rows) == 18 and {r.year for r in rows} == {2019} and {r.column_label for r in rows} == {"I.S.F", "T.G.F", "49-45"}
    assert parse(spark, head + body[:20]) == []
    assert {r.reason for r in parse(spark, head.replace("Année 2019\n", "") + body)} == {"no year on the page"}


def test_inferred_labels(spark):
    page = "2.1 Abonnés aux réseaux de téléphone\nAnnée 2023 2022\nNombre d'abonnés au réseau de\n12 13\ntéléphone fixe\n"
    assert {(r.row_label, r.label_inferred) for r in parse(spark, page)} == {("Nombre d'abonnés au réseau de téléphone fixe", True)}
    after = page + "Lignes 1 2\nPostes à\nclavier\n3 4\n"
    assert {(r.row_label, r.label_inferred) for r in parse(spark, after)} == {("Nombre d'abonnés au réseau de téléphone fixe", True), ("Lignes", False), ("clavier", True)}
    alone = "2.1 Abonnés aux réseaux de téléphone\nAnnée 2023 2022\n12 13\n"
    assert reasons(spark, alone) == [("", "no label")]


def test_sections_begin_and_end(spark):
    """Headings close a section, a row in the form of a heading does not; the nearest heading within reach names a table; equal pages are pages."""
    page = "1.1 Produits laitiers du nord\nAn 2023 2022\nLait 1 2\n1.2 Fromages et beurres 3 4\nMiel 5 6\n2.1 Production de céréales\nBlé 7 8\nAn 2021 2020\nOrge 9 10\n" + "\n" * 12 + "An 2019 2018\nSeigle 1 2\n"
    got = parse(spark, page, page)
    one = {(r.table_number, r.row_label, r.year): r.value for r in got if r.page == 2 and r.reason is None}
    assert one == {("1.1", "Lait", 2023): 1, ("1.1", "Lait", 2022): 2, ("1.1", "Fromages et beurres", 2023): 3, ("1.1", "Fromages et beurres", 2022): 4, ("1.1", "Miel", 2023): 5, ("1.1", "Miel", 2022): 6, ("2.1", "Orge", 2021): 9, ("2.1", "Orge", 2020): 10} or {k[1] for k in one} == {"Lait", "1.2 Fromages et beurres", "Miel", "Orge"}
    assert [(r.row_label, r.reason) for r in got if r.page == 1 and r.reason] == [("Seigle", "no table heading above the columns")]
    assert len(got) == 2 * (len(one) + 1)


def test_text_expressions(spark):
    df = spark.createDataFrame([("Béja Été 2.4", "1122..55", "24-20", "a / b / c"), (None, None, None, None)], "t string, n string, b string, s string")
    head, last = T.head_and_last(F.col("s"))
    r, null = df.select(T.fold(F.col("t")), T.stem(F.col("t")), T.number(F.col("n")), T.age_band(F.col("b")), head, last).collect()
    assert list(r) == ["bejaete", "beja ete", 12.5, "20-24", "a / b", "c"]
    assert all(x is None for x in null)


def test_titles_need_agreement(spark):
    cells = [("1", "Population par gouvernorat", f"r{i}", float(i + 1)) for i in range(6)] + [("1", "Population par gouvernorat et sexe", f"r{i}", float(i + 1)) for i in range(6)]
    cells += [("1", "Pop", f"r{i}", 50.0 * (i + 1)) for i in range(6)]
    got = {r.title: r.canonical for r in titles.canonical(spark.createDataFrame(cells, "chapter string, title string, cell string, value double"), ["cell"]).collect()}
    assert got["Population par gouvernorat"] == "Population par gouvernorat et sexe" and got["Pop"] == "Pop"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "b.pdf").write_bytes(b"<html>")
    found = files.scan(spark, str(tmp_path / "in"))
    assert {r.name: r.looks_right for r in found.collect()} == {"a.pdf": True, "b.pdf": False}
    files.save_manifest(found, str(tmp_path / "m.json"))
    known = files.load_manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "a.pdf").unlink()
    assert {r.name: r.status for r in files.verify(files.scan(spark, str(tmp_path / "in")), known).collect()} == {"a.pdf": "missing", "b.pdf": "mismatch"}
    (tmp_path / "t.txt").write_text("one\u200f\u2067\ftw\u2069o", encoding="utf-8")
    assert [(r.page, r.text) for r in files.page_texts(spark, str(tmp_path / "t.txt")).orderBy("page").collect()] == [(1, "one"), (2, "two")]
    df = files.described(spark.createDataFrame([(1, "x")], "id int, label string"), {"id": {"unit": "none", "origin": "A1", "description": "key"}})
    files.write_dataset(df, str(tmp_path / "out"), gzip=True)
    back = files.read_csv(spark, str(tmp_path / "out" / "csv"), "id int, label string")
    assert files.content_hash(back) == files.content_hash(df)
    assert "| id | int | none | A1 | key |" in files.codebook(df, "d", "T", "intro", {"label": {"x": "ex"}})


def test_labels_that_end_in_a_digit_are_refused(spark):
    page = "9.1 Endettement des ménages par an\nAnnée 2023 2022\nTaux d'endettement5 52.3 50.1\nTunis 1 2\nab 3 4\nSource : relevé 5 6\n"
    assert cells(spark, page) == {("Tunis", "2023"): 1.0, ("Tunis", "2022"): 2.0}
    assert {x: why.split(",")[0] for x, why in reasons(spark, page)} == {"Taux d'endettement5": "label ends in a digit", "ab": "no words in the label", "Source relevé": "a caption or a page footer"}


def test_undated_column_and_caption(spark):
    page = "13.4 Indices des prix de vente\nGouvernorat" + " " * 12 + "Masculin\nBranche 2023 2022 Pondération\nMines 1 2 30\nTextile 3 4\n"
    assert cells(spark, page) == {("Mines", "2023"): 1.0, ("Mines", "2022"): 2.0, ("Textile", "2023"): 3.0, ("Textile", "2022"): 4.0}
    assert {r.panel for r in parse(spark, page)} == {"Masculin"}
    assert {r.panel for r in parse(spark, page.replace("Masculin", "Total ND"))} == {None}
    under = "13.4 Indices des prix de vente\nBranche 2023 2022\n" + " " * 20 + "Poids\nMines 1 2 30\n"
    assert cells(spark, under) == {("Mines", "2023"): 1.0, ("Mines", "2022"): 2.0}


def test_kinds_and_enumerators(spark):
    names = ["T o t a l", "Total général", "Nord - Est", "Nord", "Sous-total", "Totalité", "Dont : femmes", "Sfax", "Grand Tunis"]
    kinds = of(spark, lambda x, t, k: P.row_kind(x), *names)
    assert [x for x, kind in zip(names, kinds, strict=True) if kind == "aggregate"] == ["T o t a l", "Total général", "Nord - Est", "Sous-total", "Dont : femmes", "Grand Tunis"]
    assert of(spark, lambda x, t, k: P.enumerated(x), "I - Importations", "A) Biens", "5.Textiles", "Nord - Ouest", "X.") == ["Importations", "Biens", "Textiles", None, None]
    assert of(spark, lambda x, t, k: P.page_year(x), "Situation au 31/12/2019", "Année : 2020", "en 2019") == [2019, 2020, None]


def test_no_python_in_the_plan(spark, capsys):
    P.parse_pages(spark.createDataFrame([(1, "x")], "page bigint, text string")).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "InArrow"))


def test_a_very_long_page(spark):
    page = "1.1 Valeur par commune du pays\nCommune 2023 2022\n" + "".join(f"Commune {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}  {i}  {i + 1}\n" for i in range(5000))
    assert len(parse(spark, page)) == 10000
