"""Small stated tables: input that the test tables have no counterpart of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# book_id, page, block, page_width, x0, y0, x1, y1, text
BLOCKS = [
    ("a", 1, 1, 600.0, 40.0, 40.0, 560.0, 60.0, "A wide title over both columns"),
    ("a", 1, 2, 600.0, 40.0, 80.0, 260.0, 400.0, "The left column of the first page"),
    ("a", 1, 3, 600.0, 340.0, 80.0, 560.0, 400.0, "The right column of the first page"),
    ("a", 1, 4, 600.0, 40.0, 700.0, 560.0, 720.0, "A wide note below both columns"),
    ("a", 2, 1, 600.0, 40.0, 80.0, 260.0, 400.0, "The left column of the second page"),
    ("a", 2, 2, 600.0, 340.0, 120.0, 560.0, 420.0, "The right column of the second page"),
    ("a", 3, 1, 600.0, 40.0, 80.0, 560.0, 400.0, "One block as wide as the page is"),
    ("a", 3, 2, 600.0, 40.0, 420.0, 200.0, 440.0, "short"),
    ("a", 4, 1, 600.0, 40.0, 80.0, 260.0, 200.0, "A left block that ends high up here"),
    ("a", 4, 2, 600.0, 340.0, 500.0, 560.0, 600.0, "A right block that begins far below"),
    ("b", 2, 1, 600.0, 40.0, 80.0, 560.0, 400.0, "The one column of another book"),
]
BLOCK_SCHEMA = "book_id string, page int, block int, page_width double, x0 double, y0 double, x1 double, y1 double, text string"

# book_id, page, line, text, size, bold, in_margin
LINES = [
    *[("a", p, 1, text, 9.0, False, True) for p, text in ((1, "THE FACTORY"), (2, "12 A History of Work"), (3, "THE FACTORY"), (4, "14 A History of Work"), (5, "THE FACTORY"), (6, "16 A History of Work"), (7, "Problem 7"), (8, "Problem 9"))],
    *[("a", p, 9, str(p + 10), 9.0, False, True) for p in range(1, 8)],
    *[("b", p, 9, t, 9.0, False, True) for p, t in ((1, "xii"), (2, "xiii"), (3, "xiv"), (4, "civil"), (5, "1998"))],
    ("a", 1, 2, "Chapter One", 18.0, False, False),
    ("a", 1, 3, "The mill stood beside the river for two hundred years and more.", 10.5, False, False),
    ("a", 1, 4, "A bold run-in title", 10.5, True, False),
    ("a", 1, 5, "A bold sentence that ends.", 10.5, True, False),
    ("a", 1, 6, "1998", 18.0, False, False),
    ("b", 1, 2, "Everything in this book is set in one and the same size.", 11.0, False, False),
]
LINE_SCHEMA = "book_id string, page int, line int, text string, size double, bold boolean, in_margin boolean"

# book_id, page, image_sha, n_chars, risk
PAGES = [("c", 1, "s9", 0, 0), ("c", 2, "s9", 30, 0), ("a", 1, "s1", 100, 0), ("a", 2, "s2", 90, 2), ("a", 3, "s1", 80, 0), ("a", 4, "s1", 70, 3), ("a", 5, "s2", 0, 0), ("b", 1, "s1", 60, 2)]
PAGE_SCHEMA = "book_id string, page int, image_sha string, n_chars int, risk int"

CAPTIONS = [("d", 3, "Figure 1"), ("d", 12, "Figure 2"), ("e", 5, "Table 1"), ("f", 0, "Map 1")]
IMAGES = [("d", 1, "a.png"), ("d", 7, "b.png"), ("d", 8, "c.png"), ("d", 14, "d.png"), ("d", 40, "e.png"), ("e", 9, "f.png"), ("e", 10, "g.png"), ("f", 4, "h.png")]
CAPTION_SCHEMA, IMAGE_SCHEMA = "doc string, line int, caption string", "doc string, line int, image string"

SOURCE_EXHIBITS = [("figure", "1.1"), ("figure", "1.2"), ("table", "2"), ("exhibit", "3"), ("figure", "4")]
TARGET_CAPTIONS = [("figure", "1.1", 1, 0), ("table", "1.2", 1, 0), ("table", "2", 0, 5), ("figure", "3", 1, 0), ("figure", "4", 0, 1)]
EXHIBIT_SCHEMA, TARGET_SCHEMA = "class string, key string", "class string, key string, n_images int, n_rows int"

TSV = [
    ("a", 1, 1, "\t".join(["level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text"])),
    ("a", 1, 2, "\t".join(["4", "1", "1", "1", "1", "0", "0", "0", "9", "9", "-1", ""])),
    ("a", 1, 3, "\t".join(["5", "1", "1", "1", "1", "1", "0", "0", "9", "9", "91.5", "Bearing"])),
    ("a", 1, 4, "\t".join(["5", "1", "1", "1", "1", "2", "0", "0", "9", "9", "88", "preload"])),
    ("a", 1, 5, "\t".join(["5", "1", "1", "1", "1", "3", "0", "0", "9", "9", "70", " "])),
    ("a", 2, 1, "\t".join(["5", "1", "1", "1", "1", "1", "0", "0", "9", "9", "0", "x"])),
    ("b", 1, 3, "\t".join(["5", "1", "1", "1", "1", "1", "0", "0", "9", "9", "50", "other"])),
]
TSV_SCHEMA = "book_id string, page int, pos int, line string"

BREAKS = [("op", "erators"), ("customer", "driven"), ("data", "base"), ("Smith", "Jones"), ("busi", "ness")]
WORDS = [("operators",), ("customer-driven",), ("business",), ("Business",), ("customerdriven",)]
BREAK_SCHEMA, WORD_SCHEMA = "first string, second string", "word string"

WRAPS = [
    ("a", 1, 1, 1, "The belts ran along the whole of the ceiling and could"), ("a", 1, 1, 2, "stop for hours when one of them had broken, which it did"), ("a", 1, 1, 3, "often."), ("a", 1, 1, 4, "A new line."),
    ("a", 1, 2, 1, "O mill, beside the water low,"), ("a", 1, 2, 2, "And all thy wheels that used to go,"), ("a", 2, 1, 1, "It ended here, as everything that was begun must end."), ("a", 2, 1, 2, "and a line that seems to go on"),
    ("b", 1, 1, 1, "A line of another book that is as full as it can be and"),
    ("b", 1, 1, 2, "goes on below."),
]
WRAP_SCHEMA = "book_id string, page int, block int, line int, text string"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(name: str, rows: list[tuple], schema: str) -> str:
    """SQL: the same rows as a common table."""

    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)

    names = ", ".join(part.strip().split(" ")[0] for part in schema.split(","))
    return f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"

# book_id, page, block, is_image, text, size, median, x0, y0, x1, y1, page_width, page_height, layout
ROLES = [
    ("a", 1, 1, True, "", 0.0, 10.0, 40.0, 80.0, 560.0, 780.0, 600.0, 800.0, "single_column"),
    ("a", 1, 2, False, "12", 9.0, 10.0, 280.0, 770.0, 320.0, 790.0, 600.0, 800.0, "single_column"),
    ("a", 2, 1, False, "E = m", 10.0, 10.0, 40.0, 100.0, 560.0, 120.0, 600.0, 800.0, "single_column"),
    ("a", 2, 2, False, "Figure 3 A mill", 9.0, 10.0, 40.0, 200.0, 560.0, 220.0, 600.0, 800.0, "single_column"),
    ("a", 2, 3, False, "1 See the ledger.", 8.0, 10.0, 40.0, 700.0, 560.0, 720.0, 600.0, 800.0, "single_column"),
    ("a", 2, 4, False, "The Mill", 14.0, 10.0, 40.0, 300.0, 560.0, 330.0, 600.0, 800.0, "single_column"),
    ("a", 2, 5, False, "A note beside the text that runs on for more than forty characters", 10.0, 10.0, 400.0, 400.0, 560.0, 500.0, 600.0, 800.0, "single_column"),
    ("a", 2, 6, False, "The body of the page.", 10.0, 10.0, 40.0, 400.0, 380.0, 600.0, 600.0, 800.0, "single_column"),
    ("a", 3, 1, False, "One column of the page.", 10.0, 10.0, 40.0, 100.0, 280.0, 600.0, 600.0, 800.0, "multi_column"),
    ("b", 2, 1, False, "The other body.", 10.0, 10.0, 40.0, 400.0, 380.0, 600.0, 600.0, 800.0, "single_column"),
]
ROLE_SCHEMA = "book_id string, page int, block int, is_image boolean, text string, size double, median double, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, layout string"

FOLIOS = [*[("a", p, 0.05 + p / 1000) for p in range(6)], *[("b", p, 0.95) for p in range(7)], ("c", 1, 0.05)]
FOLIO_SCHEMA = "book_id string, page int, y double"

HEADINGS = [("a", 1, 1, 1, "The History"), ("a", 1, 2, 1, "of Work"), ("a", 1, 3, 2, "Part one"), ("a", 1, 5, 2, "Part two"), ("a", 2, 1, 1, "Alone"), ("b", 1, 2, 1, "Of another book")]
HEADING_SCHEMA = "book_id string, page int, line int, level int, text string"

ENDS = [("a", 1, "A first page", "that could stop for ho-"), ("a", 2, "urs when a belt had broken", "It ended."), ("a", 3, "In the spring", "with expenditures,"), ("a", 4, "2006 and later", "in the"), ("a", 5, "Exhibit 4", "x")]
END_SCHEMA = "book_id string, page int, head string, tail string"

LEVELS = [("x", 1, 1), ("x", 2, 2), ("x", 3, 3), ("y", 1, 1), ("y", 2, 1), ("z", 1, 2), ("z", 2, 1), ("w", 1, 1)]
LEVEL_SCHEMA = "doc string, pos int, level int"

EDITIONS = [("one", "docx", 7, 5), ("one", "epub", 7, 5), ("two", "docx", 5, 5), ("two", "epub", 5, 3), ("three", "pdf", 7, 3), ("four", "docx", 3, 4)]
EDITION_SCHEMA = "edition string, format string, expected int, actual int"
