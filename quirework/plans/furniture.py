"""Queries over the furniture of a stated book: eight pages with heads, page numbers and what only looks like them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import furniture as U
from quirework.operators import layout as L
from quirework.plans import fixtures as X
from quirework.plans.registry import query

SCHEMA = "book_id string, page int, block int, line int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double, page_height double"
BODY_LINES = ("The mill stood beside the river for two hundred years and more,", "and its wheel turned by day and by night while there was water.")


def _book() -> list[tuple]:
    rows = []
    for p in range(1, 9):
        line = lambda block, n, text, size, y, bold=False, p=p: rows.append(("a", p, block, n, text, size, bold, 40.0, y, 40.0 + 5.0 * len(text), y + size, 600.0))
        if p in (1, 5):
            line(1, 1, "The Factory" if p == 1 else "The River", 20.0, 60.0)
        else:
            line(1, 1, f"{p + 10} A History of Work" if p % 2 == 0 else "THE FACTORY", 9.0, 20.0)
        line(2, 1, BODY_LINES[0], 10.5, 120.0)
        line(2, 2, BODY_LINES[1], 10.5, 140.0)
        line(3, 1, str(p + 10), 9.0, 575.0)
    rows += [("a", 4, 4, 1, "1998", 9.0, False, 40.0, 30.0, 60.0, 39.0, 600.0), ("a", 6, 4, 1, "O mill, beside the water low,", 9.0, False, 40.0, 25.0, 200.0, 34.0, 600.0), ("a", 6, 4, 2, "and on it goes", 9.0, False, 40.0, 50.0, 200.0, 59.0, 600.0)]
    rows += [("b", p, 1, 1, t, 9.0, False, 40.0, 575.0, 60.0, 584.0, 600.0) for p, t in ((1, "xii"), (2, "xiii"), (3, "xiv"), (4, "civil"), (5, "2"))]
    return [*rows, ("b", 1, 2, 1, BODY_LINES[0], 10.5, False, 40.0, 200.0, 400.0, 210.0, 600.0)]


BOOK = _book()
LINES = X.values("l", BOOK, SCHEMA)
#: What a reader of that book would call furniture.
WANTED = X.values("w", [*[("a", p, 1, 1, "header") for p in (2, 3, 4, 6, 7, 8)], *[("a", p, 3, 1, "page_number") for p in range(1, 9)], *[("b", p, 1, 1, "page_number") for p in (1, 2, 3)]], "book_id string, page int, block int, line int, kind string")


def _lines(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    lines = X.frame(spark, BOOK, SCHEMA)
    return lines, L.body_size(lines)


@query("furniture_lines", f"WITH {WANTED} SELECT * FROM w")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads and page numbers; a lone year, verse at the top and a word in roman letters are none."""
    return U.kinds(spark, *_lines(spark))


@query("furniture_roles", f"WITH {WANTED} SELECT book_id, page, block, kind AS role FROM w")
def furniture_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, body = _lines(spark)
    return U.block_roles(lines, U.kinds(spark, lines, body))


@query("furniture_unproven", "SELECT 'a' AS book_id, CAST(3 AS INTEGER) AS page, '9' AS missing, '8' AS unexpected")
def furniture_unproven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose log names another number than was removed."""
    lines, body = _lines(spark)
    removed = lines.join(U.kinds(spark, lines, body), ["book_id", "page", "block", "line"])
    left = lines.join(removed, ["book_id", "page", "block", "line"], "left_anti")
    wrong = (F.col("book_id") == "a") & (F.col("page") == 3) & (F.col("kind") == "page_number")
    logged = removed.withColumn("text", F.when(wrong, F.lit("18")).otherwise(F.col("text")))
    changed = lines.withColumn("text", F.when((F.col("page") == 3) & (F.col("text") == "13"), F.lit("19")).otherwise(F.col("text")))
    return U.unproven(changed, left, logged)


@query(
    "furniture_heading_blocks",
    f"""WITH {LINES}, body AS (SELECT book_id, arg_max(size, (n, size)) AS body FROM (SELECT book_id, round(size * 2) / 2 AS size, sum(length(text)) AS n FROM l GROUP BY ALL) GROUP BY book_id),
h AS (SELECT l.*, body, regexp_matches(text, '\\p{{L}}') AND ((size >= body * 1.15 AND length(text) <= 120) OR (bold AND size >= body * 0.95 AND length(text) <= 80 AND NOT regexp_matches(text, '[.,;:!?。，；：！？]$'))) AS head FROM l JOIN body USING (book_id))
SELECT book_id, page, block, max(size) AS level_size FROM h GROUP BY ALL HAVING bool_and(head) AND (count(*) <= 2 OR max(size) >= any_value(body) * 1.15)""".replace("GROUP BY ALL HAVING", "GROUP BY book_id, page, block HAVING"),
)
def furniture_heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.heading_blocks(*_lines(spark))


CAPTIONS = [(1, "Exhibit 6.13. shows that the mill had stopped.", 10.5, False), (2, "Exhibit 6.13 The mill", 9.0, False), (3, "Figure 2 The wheel", 10.5, True), (4, "Figure 3 A heading", 12.5, True), (5, "The figure 3", 9.0, False)]


@query("furniture_captions", "SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, false), (5, false)) t(pos, is_caption)")
def furniture_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are captions, and sentences that cite a figure."""
    return X.frame(spark, CAPTIONS, "pos int, text string, size double, bold boolean").select("pos", U.caption_candidate(F.lit(10.5)).alias("is_caption"))


TABLES = [(1, [["1990", "12"], ["1991", "13"]], False), (2, [["Year", "Units"], ["1990", "12"]], False), (3, [["part", "role"], ["belt", "drives"]], False), (4, [["part", "role"], ["belt", "drives"]], True), (5, [[None, " "], ["1", "2"]], True)]


@query("furniture_headers", "SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, true), (5, false)) t(pos, has_header)")
def furniture_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose first row is a header."""
    return X.frame(spark, TABLES, "pos int, rows array<array<string>>, bold boolean").select("pos", U.has_header(F.col("rows"), F.col("bold")).alias("has_header"))


ROWS = [(1, ["a long note on the looms of the second hall", "", " "]), (2, ["short", ""]), (3, ["a long note on the looms of the second hall", "x"]), (4, ["第二座大厅里的织机是在冬天运来的，一共五台。", None]), (5, [])]


@query("furniture_prose_rows", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false)) t(pos, is_prose)")
def furniture_prose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that are paragraphs."""
    return X.frame(spark, ROWS, "pos int, row array<string>").select("pos", U.is_prose_row(F.col("row")).alias("is_prose"))


FORMS = [(1, "chapter 3: the mill"), (2, "the mill"), (3, "第三章 磨坊之河"), (4, "12 a history of work"), (5, "part ii")]


@query("furniture_heading_forms", "SELECT * FROM (VALUES (1, 'chapter 3: the mill|the mill'), (2, 'the mill'), (3, '第三章 磨坊之河|磨坊之河'), (4, '12 a history of work|a history of work'), (5, 'part ii')) t(pos, forms)")
def furniture_heading_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running head may take from a heading."""
    return X.frame(spark, FORMS, "pos int, text string").select("pos", F.array_join(U.heading_forms(F.col("text")), "|").alias("forms"))


LOST = [("x", "All results were recorded in 1998.", "All were in 1998."), ("y", "Nothing is lost", "nothing IS  lost")]


@query("furniture_lost_words", "SELECT 'x' AS doc, CAST(15 AS BIGINT) AS n_characters, 'recorded results' AS words")
def furniture_lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a draft lost of its source."""
    rows = X.frame(spark, LOST, "doc string, source string, draft string")
    lost = U.lost_words(rows.select("doc", F.col("source").alias("text")), rows.select("doc", F.col("draft").alias("text")), ["doc"])
    return lost.select("doc", "n_characters", F.array_join("words", " ").alias("words"))
