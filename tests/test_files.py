import zipfile

from pyspark.sql import functions as F

from quirework.operators import structure
from quirework.sources import files, sinks


def test_texts_of_any_encoding(spark, tmp_path):
    (tmp_path / "unit-0001.md").write_bytes("café".encode())
    (tmp_path / "unit-0002.md").write_bytes("\ufeffcafé".encode())
    (tmp_path / "unit-0003.md").write_bytes("café – x".encode("cp1252"))
    (tmp_path / "notes.txt").write_text("x")
    got = {r.unit_id: r.text for r in files.units_in(spark, str(tmp_path)).collect()}
    assert got == {"unit-0001": "café", "unit-0002": "café", "unit-0003": "café – x"}
    assert files.hashes(spark, str(tmp_path), "*.txt").first().sha256.startswith("2d711642b726b044")


def test_formats(spark):
    rows = spark.createDataFrame([("a/b.PDF", None), ("a.txt", None), ("a.txt", "epub"), ("noext", "bad")], "p string, c string")
    assert [r.x for r in rows.select(files.source_format(F.col("p"), F.col("c")).alias("x")).collect()] == ["pdf", None, "epub", None]


def test_json_lines_round_trip(spark, tmp_path):
    rows = [("b", "1", 1, "paragraph", 'a "q"\n', None, None, None, "en", None), ("b", "1", 1, "paragraph", 'a "q"\n', None, None, None, "en", None), ("b", "2", 2, None, None, 1, "T", "n", None, None)]
    sinks.write_segments(spark.createDataFrame(rows, files.SEGMENT), str(tmp_path / "s"))
    (tmp_path / "s" / "part-bad.json").write_text("{broken\n")
    got = files.json_lines(spark, str(tmp_path / "s")).cache()
    assert got.where("_corrupt is not null").count() == 1
    assert sorted((r.id, r.text) for r in got.where("_corrupt is null").collect()) == [("1", 'a "q"\n'), ("2", None)]


CONTENTS = '<ul><li><object type="text/sitemap"><param name="Name" value="One &amp; two"><param name="Local" value="b\\Two.htm#x"></object><li><object><param name="Name" value="Again"><param name="Local" value="B/two.htm"></object><li><object><param name="Local" value="a.htm"></object></ul>'


def test_topics(spark):
    contents = spark.createDataFrame([("k", CONTENTS)], "book_id string, text string")
    pages = spark.createDataFrame([("k", "a.htm"), ("k", "b/Two.htm"), ("k", "z.htm"), ("k", "C.htm")], "book_id string, path string")
    rows = files.topics(contents, pages).orderBy("place").collect()
    assert [(r.path, r.title) for r in rows] == [("b/Two.htm", "One & two"), ("a.htm", ""), ("C.htm", None), ("z.htm", None)]
    whole = files.combined(spark.createDataFrame([("k", 2, "y.htm", "plain"), ("k", 1, "x.htm", "<html><body class='c'> one </body></html>")], "book_id string, place int, path string, html string")).first().html
    assert whole == '<section data-topic="x.htm">\none\n</section>\n<section data-topic="y.htm">\nplain\n</section>'
    sizes = spark.createDataFrame([("k", "big.html", 9), ("k", "index.htm", 1), ("m", "a.html", 1), ("m", "b.html", 2), ("m", "c.css", 99)], "book_id string, path string, size int")
    assert sorted(r.path for r in files.primary_page(sizes).collect()) == ["b.html", "index.htm"]


def package(path, members, first=True):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if first:
            z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        for name, text in members.items():
            z.writestr(name, text)


PAGE = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:e="http://www.idpf.org/2007/ops"><body><a id="r1" e:type="noteref" href="#n1">1</a><table/><p id="n1">note {}</p></body></html>'
OPF = '<package><manifest><item id="p" href="p.xhtml"/><item id="q" href="{}"/></manifest><spine><itemref idref="p"/><itemref idref="{}"/></spine></package>'


def test_packages(spark, tmp_path):
    good = {"META-INF/container.xml": "<c/>", "OEBPS/b.opf": OPF.format("i.png", "q"), "OEBPS/p.xhtml": PAGE.format('<a href="#r1">back</a>'), "OEBPS/i.png": "x"}
    bad = {"OEBPS/b.opf": OPF.format("gone.png", "none"), "OEBPS/p.xhtml": PAGE.format('<i id="n1"/>').replace("#n1", "#lost")}
    package(tmp_path / "good.epub", good)
    package(tmp_path / "bad.epub", bad, first=False)
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    package(tmp_path / "evil.epub", {"../../x": "y"})
    members = files.package_members(spark, str(tmp_path)).cache()
    found = sorted((r.archive.rsplit("/", 1)[1], r.problem) for r in files.package_problems(members).collect())
    assert found == [("bad.epub", "container"), ("bad.epub", "mimetype"), ("bad.epub", "missing_resource"), ("bad.epub", "unknown_spine_item"), ("broken.epub", "unreadable"), ("evil.epub", "unreadable")]
    pages = members.where("name like '%.xhtml'")
    problems = {(r.archive.rsplit("/", 1)[1], r.problem) for r in files.xhtml_problems(pages).collect()}
    assert ("bad.epub", "dangling_link") in problems and ("bad.epub", "duplicate_id") in problems and not {p for p in problems if p[0] == "good.epub"}
    inventory = {r.archive.rsplit("/", 1)[1]: r for r in files.inventory(members).collect()}
    assert inventory["good.epub"].n_tables == 1 and inventory["good.epub"].images and not inventory["bad.epub"].images


def test_sinks(spark, tmp_path):
    seg = spark.createDataFrame([("b", "1", "x"), ("b", "2", "y\n"), ("b", "1", "x")], "book_id string, id string, text string")
    units = spark.createDataFrame([("b", "u", 0, "n", ["1", "2"], "old")], "book_id string, unit_id string, ord int, book_node_id string, segment_ids array<string>, source_hash string")
    assert sinks.merged(units, seg).first().text == "x\n\ny\n"
    entry = sinks.manifest(units, seg).first()
    assert entry.draft_file == "draft/u.md" and entry.source_hash == structure.unit_hashes(units, seg).first().current_hash
    sinks.write_texts(sinks.merged(units, seg), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t"), wholetext=True).count() == 1
    checks = spark.createDataFrame([("a|b", None)], "id string, message string")
    assert sinks.report_lines(checks).first().line == "| a/b |  |"
    put = lambda t: spark.createDataFrame([(t,)], "t string").select(sinks.insert_notice(F.col("t"), F.lit("Rights")).alias("x")).first().x
    once = put("# Title\n\nText")
    assert once == "# Title\n\n<!-- notice -->\nRights\n\nText" and put(once) == once and put("Text").startswith("<!-- notice -->\nRights")
