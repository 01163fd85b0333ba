"""Readers: text of unknown encoding, JSON lines, packages, tables of contents."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quirework.session import ship

FORMATS = {"pdf": "pdf", "docx": "docx", "epub": "epub", "chm": "chm"}
#: One member of a package is unpacked to at most so many bytes.
MEMBER_BYTES = 64 << 20

#: Windows-1252 is Latin-1 with printable characters in place of these controls.
WESTERN = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}

SEGMENT = "book_id string, id string, ord int, kind string, text string, heading_level int, title string, book_node_id string, lang string, ingested_at timestamp"


def source_format(path: Column, configured: Column | None = None) -> Column:
    """The format a path's suffix names, unless one is configured; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    found = F.when(suffix.isin(*FORMATS), suffix)
    return found if configured is None else F.when(F.lower(configured).isin(*FORMATS), F.lower(configured)).otherwise(found)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without a mark if they are well-formed, else Western European."""
    western = F.translate(F.decode(content, "iso-8859-1"), "".join(map(chr, WESTERN)), "".join(WESTERN.values()))
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)
    return F.regexp_replace(text, "^\\x{feff}", "")


def texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, name, text`` of files in a folder, whatever their encoding."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), decoded(F.col("content")).alias("text"))


def hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256`` of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: str = SEGMENT) -> DataFrame:
    """Segments from JSON lines; a broken line keeps its text in ``_corrupt`` and nothing else."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def units_in(spark: SparkSession, path: str) -> DataFrame:
    """``unit_id, text`` of the unit files of a folder."""
    return texts(spark, path, "unit-*.md").select(F.regexp_extract("name", "^(unit-[0-9]+)\\.md$", 1).alias("unit_id"), "text").where(F.col("unit_id") != "")


def primary_page(files: DataFrame) -> DataFrame:
    """The page that stands for a set: a default page if there is one, else the largest."""
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    default = name.isin("index.html", "index.htm", "default.html", "default.htm")
    best = Window.partitionBy("book_id").orderBy(F.desc(default), F.desc("size"), "path")
    return files.where(name.rlike("\\.html?$")).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


class _Contents(HTMLParser):
    """Entries of a help file's table of contents, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries: list[tuple[str, str]] = []
        self.open: dict[str, str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "object":
            self.open = {}
        elif tag == "param" and self.open is not None:
            self.open.setdefault(values.get("name", "").lower(), values.get("value", ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "object" and self.open is not None:
            if self.open.get("local"):
                self.entries.append((self.open["local"].replace("\\", "/"), self.open.get("name", "")))
            self.open = None


def contents_entries(text: str) -> list[tuple[str, str]]:
    parser = _Contents()
    parser.feed(text)
    parser.close()
    return parser.entries


@F.pandas_udf(ArrayType(StructType([StructField("local", StringType()), StructField("title", StringType())])))
def contents_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"local": a, "title": b} for a, b in contents_entries(t)] if t else [])


def topics(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Topic files in the order of the contents, each where it is named first, then the others by name.

    ``contents``: book_id, text of the contents file. ``files``: book_id, path.
    """
    ship(contents.sparkSession)
    named = contents.select("book_id", F.posexplode(contents_udf("text")).alias("pos", "e")).select("book_id", "pos", F.lower(F.regexp_replace("e.local", "#.*$", "")).alias("key"), F.col("e.title").alias("title"))
    first = named.groupBy("book_id", "key").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))
    rows = files.withColumn("key", F.lower("path")).join(first, ["book_id", "key"], "left")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("pos").asc_nulls_last(), "key"))
    return rows.select("book_id", "path", "title", place.alias("place"))


def combined(pages: DataFrame) -> DataFrame:
    """Bodies of topic pages in order as one text a book, each in a section of its own."""
    body = F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<body[^>]*>(.*?)</body>", 1), F.lit("")), F.col("html"))
    item = F.struct("place", F.concat(F.lit('<section data-topic="'), F.col("path"), F.lit('">\n'), F.trim(body), F.lit("\n</section>")).alias("text"))
    return pages.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), "\n").alias("html"))


def _members(data: bytes) -> list[tuple[str, bytes]]:
    """Files of a zip package; names that leave it and members that are too large are refused."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            name = posixpath.normpath(info.filename.replace("\\", "/"))
            if info.is_dir():
                continue
            if name.startswith(("/", "../")) or name == ".." or info.file_size > MEMBER_BYTES:
                raise ValueError(f"refused member {info.filename!r}")
            out.append((info.filename, z.read(info)))
    return out


def package_members(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """``archive, pos, name, stored, size, md5, content`` of the files in packages; a broken package gives one row with its error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def unpack(batches):
        for batch in batches:
            rows = []
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        stored = {i.filename: i.compress_type == zipfile.ZIP_STORED for i in z.infolist()}
                    for pos, (name, content) in enumerate(_members(data)):
                        text = content.decode("utf-8", "replace") if name.endswith((".xml", ".xhtml", ".html", ".htm", ".opf", ".ncx", ".rels", "mimetype")) else None
                        rows.append((archive, pos, name, stored[name], len(content), hashlib.md5(content, usedforsecurity=False).hexdigest(), text, None))
                except (ValueError, zipfile.BadZipFile, OSError) as e:
                    rows.append((archive, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["archive", "pos", "name", "stored", "size", "md5", "content", "error"])

    return files.mapInPandas(unpack, "archive string, pos int, name string, stored boolean, size long, md5 string, content string, error string")


def inventory(members: DataFrame) -> DataFrame:
    """Tables, images and words of each package: what editions are compared by."""
    page = F.col("name").rlike("(?i)\\.(xhtml|html|htm)$|word/document\\.xml$")
    image = F.col("name").rlike("(?i)\\.(png|jpe?g|gif|svg|webp|bmp)$")
    tables = F.regexp_count("content", F.lit("(?i)<(?:w:tbl|table)\\b"))
    words = F.regexp_count(F.regexp_replace("content", "<[^>]+>", " "), F.lit("[\\p{L}\\p{N}]+"))
    return members.where(F.col("error").isNull()).groupBy("archive").agg(
        F.sum(F.when(page, tables).otherwise(0)).alias("n_tables"),
        F.array_join(F.sort_array(F.collect_set(F.when(image, F.col("md5")))), ",").alias("images"),
        F.sum(F.when(page, words).otherwise(0)).alias("n_words"),
    )


def xhtml_rows(text: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """``tag, id, href, type`` of the elements of an XHTML text that have any of them."""
    out = []
    for e in ElementTree.fromstring(text).iter():
        names = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
        if names.keys() & {"id", "href", "src", "type"}:
            out.append((str(e.tag).rpartition("}")[2], names.get("id"), names.get("href") or names.get("src"), names.get("type")))
    return out


def xhtml_problems(pages: DataFrame) -> DataFrame:
    """What is wrong with pages ``archive, name, content``: broken XML, repeated ids, links to nowhere, notes without a way back."""
    ship(pages.sparkSession)

    def parse(batches):
        for batch in batches:
            rows = []
            for archive, name, content in zip(batch["archive"], batch["name"], batch["content"], strict=True):
                try:
                    rows += [(archive, name, *r, None) for r in xhtml_rows(content or "")]
                except ElementTree.ParseError as e:
                    rows.append((archive, name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["archive", "name", "tag", "id", "href", "type", "error"])

    elements = pages.select("archive", "name", "content").mapInPandas(parse, "archive string, name string, tag string, id string, href string, type string, error string")
    ids = elements.where(F.col("id").isNotNull()).select("archive", "name", "id")
    problem = lambda df, what, detail: df.select("archive", "name", F.lit(what).alias("problem"), F.expr(detail).alias("detail"))
    broken = problem(elements.where(F.col("error").isNotNull()), "not_well_formed", "error")
    twice = problem(ids.groupBy("archive", "name", "id").count().where("count > 1"), "duplicate_id", "id")
    links = elements.where(F.col("href").rlike("^[^:]*#.+")).withColumn("id", F.regexp_extract("href", "#(.+)$", 1)).withColumn("file", F.regexp_extract("href", "^([^#]*)", 1))
    folder = F.regexp_extract("name", "^(.*/)?[^/]*$", 1)
    links = links.withColumn("to", F.when(F.col("file") == "", F.col("name")).otherwise(F.concat(folder, "file")))
    lost = problem(links.join(ids.select("archive", F.col("name").alias("to"), "id"), ["archive", "to", "id"], "left_anti"), "dangling_link", "href")
    notes = elements.where(F.col("type") == "noteref").withColumn("id", F.regexp_extract("href", "#(.+)$", 1)).select("archive", "name", "id").distinct()
    back = links.where(F.coalesce("type", F.lit("")) != "noteref").select("archive", "name").distinct()
    oneway = problem(notes.join(back, ["archive", "name"], "left_anti"), "note_without_backlink", "id")
    return broken.unionByName(twice).unionByName(lost).unionByName(oneway)


def package_problems(members: DataFrame) -> DataFrame:
    """What an EPUB lacks: its type first and stored, a container, a package file, the files that names.

    ``members`` as ``package_members`` gives them.
    """
    good = members.where(F.col("error").isNull())
    problem = lambda df, what, detail: df.select("archive", F.lit(what).alias("problem"), F.expr(detail).alias("detail"))
    out = problem(members.where(F.col("error").isNotNull()), "unreadable", "error")
    head = good.groupBy("archive").agg(
        F.bool_or((F.col("pos") == 0) & (F.col("name") == "mimetype") & F.col("stored") & (F.trim("content") == "application/epub+zip")).alias("typed"),
        F.bool_or(F.col("name") == "META-INF/container.xml").alias("contained"),
        F.bool_or(F.col("name").endswith(".opf")).alias("packaged"),
    )
    for flag, what in (("typed", "mimetype"), ("contained", "container"), ("packaged", "package_file")):
        out = out.unionByName(problem(head.where(~F.col(flag)), what, "null"))
    opf = good.where(F.col("name").endswith(".opf")).select("archive", F.regexp_extract("name", "^(.*/)?[^/]*$", 1).alias("folder"), "content")
    item = F.explode(F.regexp_extract_all("content", F.lit("(<item\\b[^>]*>)"), F.lit(1))).alias("item")
    manifest = opf.select("archive", "folder", item).select("archive", F.regexp_extract("item", "\\bid=[\"']([^\"']+)", 1).alias("id"), F.concat("folder", F.regexp_extract("item", "\\bhref=[\"']([^\"'#]+)", 1)).alias("name"))
    missing = manifest.join(good.select("archive", "name"), ["archive", "name"], "left_anti")
    spine = opf.select("archive", F.explode(F.regexp_extract_all("content", F.lit("<itemref\\b[^>]*\\bidref=[\"']([^\"']+)"), F.lit(1))).alias("id"))
    unknown = spine.join(manifest.select("archive", "id"), ["archive", "id"], "left_anti")
    return out.unionByName(problem(missing, "missing_resource", "name")).unionByName(problem(unknown, "unknown_spine_item", "id"))


def visible_text(html: str) -> str:
    """Text of an HTML page without its tags, entities read."""
    return re.sub(r"\s+", " ", unescape(re.sub(r"<(script|style)\b.*?</\1>|<[^>]+>", " ", html, flags=re.S | re.I))).strip()
