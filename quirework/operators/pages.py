"""More of page layout: roles, scanned pages, margins, heading runs, page breaks, editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.operators.layout import PAGE

# Bands, sizes and lengths the rules go by.
MARGIN, BODY_CHARS, IMAGE_SHARE = 0.08, 20, 0.5
NOTE_TOP, NOTE_SIZE, TITLE_SIZE, TITLE_CHARS, SIDE_WIDTH, SIDE_CHARS, FORMULA_CHARS = 0.82, 0.9, 1.3, 180, 0.38, 40, 300
CAPTION = "(?i)^\\s*(figure|fig\\.|table|chart|exhibit|plate|\\x{56fe}|\\x{8868})\\s*[0-9]"
FORMULA = "[=\\x{2211}\\x{222b}\\x{221a}\\x{b1}\\x{2264}\\x{2265}]"
FOLIO_SAMPLES, FOLIO_TOP = 5, 0.22
PROBE = 40


def roles(blocks: DataFrame) -> DataFrame:
    """What each block of a page is and how much care it needs, by the first rule that fits.

    ``book_id, page, block, is_image, text, size, median, x0, y0, x1, page_width, page_height, layout``.
    """
    several = F.col("layout").isin("multi_column", "mixed")
    rules = [
        (F.col("is_image"), "figure", 1),
        (F.col("text").rlike(FORMULA) & (F.length("text") < FORMULA_CHARS), "formula", 3),
        (F.col("text").rlike(CAPTION), "caption", 1),
        ((F.col("y0") > F.col("page_height") * NOTE_TOP) & (F.col("size") < F.col("median") * NOTE_SIZE), "footnote", 2),
        ((F.col("size") >= F.col("median") * TITLE_SIZE) & (F.length("text") <= TITLE_CHARS), "heading", 0),
        ((F.col("x1") - F.col("x0") < F.col("page_width") * SIDE_WIDTH) & (F.col("layout") == "single_column") & (F.length("text") > SIDE_CHARS), "sidebar", 2),
    ]
    role, risk = F.lit("body"), F.when(several, 2).otherwise(0)
    for test, name, level in reversed(rules):
        role, risk = F.when(test, name).otherwise(role), F.when(test, level).otherwise(risk)
    return blocks.select(*PAGE, "block", role.alias("role"), risk.alias("risk"))


def scanned_pages(blocks: DataFrame) -> DataFrame:
    """Pages that are little but an image: hardly any text between the margins, half the page covered."""
    inside = (F.col("y0") >= F.col("page_height") * MARGIN) & (F.col("y1") <= F.col("page_height") * (1 - MARGIN))
    chars = F.sum(F.when(inside & ~F.col("is_image"), F.length("text")).otherwise(0))
    area = F.sum(F.when(F.col("is_image"), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).otherwise(0.0))
    pages = blocks.groupBy(*PAGE).agg(chars.alias("body_chars"), F.round(F.least(F.lit(1.0), area / F.first(F.col("page_width") * F.col("page_height"))), 6).alias("coverage"))
    return pages.withColumn("scanned", (F.col("body_chars") < BODY_CHARS) & (F.col("coverage") >= IMAGE_SHARE))


def folio_position(folios: DataFrame) -> DataFrame:
    """Whether a book's page numbers stand at the head or the foot, from the median of their places."""
    stats = folios.groupBy("book_id").agg(F.count("*").alias("n"), F.median("y").alias("at"))
    return stats.select("book_id", F.when(F.col("n") < FOLIO_SAMPLES, "unknown").when(F.col("at") < FOLIO_TOP, "header").otherwise("footer").alias("position"))


def heading_runs(lines: DataFrame) -> DataFrame:
    """Heading lines of one level right under each other as one heading."""
    order = Window.partitionBy(*PAGE).orderBy("line")
    follows = (F.col("line") == F.lag("line").over(order) + 1) & (F.col("level") == F.lag("level").over(order))
    runs = lines.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy(*PAGE, "run", "level").agg(F.min("line").alias("line"), F.count("*").alias("n"), text.alias("title")).drop("run")


def page_breaks(pages: DataFrame) -> DataFrame:
    """Ends and beginnings of neighbouring pages that are one sentence, with a stretch of each to find them by.

    Pages are joined on their number plus one.
    """
    later = pages.select("book_id", (F.col("page") - 1).alias("page"), F.col("head").alias("next"))
    both = pages.join(later, ["book_id", "page"])
    open_ = ~F.col("tail").rlike("[.!?:;\\x{3002}\\x{ff01}\\x{ff1f}\\x{2026}\"'\\x{201d}\\x{2019})\\]]$")
    goes_on = open_ & F.col("next").rlike("^[\\p{Ll}0-9]")
    hyphen = F.col("tail").rlike("\\p{L}-$") & F.col("next").rlike("^\\p{Ll}")
    return both.where(goes_on).select("book_id", "page", F.expr(f"right(tail, {PROBE})").alias("tail"), F.expr(f"left(next, {PROBE})").alias("head"), hyphen.alias("divided"))


def lifted_levels(headings: DataFrame) -> DataFrame:
    """Heading levels of a document moved up by one where its only heading of level 1 is its title."""
    counts = headings.groupBy("doc").agg(F.count_if(F.col("level") == 1).alias("n_top"), F.min_by("level", "pos").alias("first"), F.count("*").alias("n"))
    alone = (F.col("n_top") == 1) & (F.col("first") == 1) & (F.col("n") > 1)
    return headings.join(counts, "doc").select("doc", "pos", F.when(alone & (F.col("level") > 1), F.col("level") - 1).otherwise(F.col("level")).alias("level"))


def edition_tables(inventory: DataFrame) -> DataFrame:
    """Tables of each output against what was expected; a lower count that all formats of an edition agree on is a warning."""
    stats = inventory.groupBy("edition").agg(F.countDistinct("actual").alias("kinds"), F.count("*").alias("formats"))
    agreed = (F.col("kinds") == 1) & (F.col("formats") >= 2)
    status = F.when(F.col("actual") == F.col("expected"), "pass").when((F.col("actual") < F.col("expected")) & ~agreed, "fail").otherwise("warn")
    return inventory.join(stats, "edition").select("edition", "format", status.alias("status"))
