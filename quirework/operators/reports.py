"""Roll-ups and gates over findings, pages, exhibits and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.operators.layout import PAGE

# Risks and confidences of a page.
SCAN_RISK, COLUMN_RISK, COLUMN_CONFIDENCE, READ_CONFIDENCE = 3, 2, 0.55, 0.65


def unit_metrics(records: DataFrame, group: list[str]) -> DataFrame:
    """Sums of attempts, seconds and tokens; null counts as nothing."""
    names = {"attempts": "bigint", "duration_seconds": "double", "input_tokens": "bigint", "output_tokens": "bigint"}
    return records.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in names.items()])


def unit_costs(records: DataFrame, group: list[str]) -> DataFrame:
    """Costs by currency, in capitals, dollars where none is named."""
    currency = F.upper(F.coalesce("currency", F.lit("USD"))).alias("currency")
    return records.where(F.col("cost").isNotNull()).groupBy(*group, currency).agg(F.sum("cost").alias("cost"))


def stages(state: DataFrame, units: DataFrame, most_attempts: int) -> DataFrame:
    """``book_id, n_units, n_done, status``: completed once every unit has a result, failed once one was given up, else pending."""
    rows = units.select("book_id", "unit_id").distinct().join(state, ["book_id", "unit_id"], "left")
    given_up = F.coalesce((F.col("last_reason") == "attempt_limit") & (F.col("last_kind") == "requeue") & (F.col("n_dispatched") >= most_attempts), F.lit(False))
    sums = rows.groupBy("book_id").agg(F.count("*").alias("n_units"), F.count("output_sha").alias("n_done"), F.bool_or(given_up).alias("failed"))
    return sums.select("book_id", "n_units", "n_done", F.when(F.col("failed"), "failed_terminal").when(F.col("n_done") == F.col("n_units"), "completed").otherwise("pending").alias("status"))


def exhibits_by_key(items: DataFrame, book: str = "book_id") -> DataFrame:
    """Exhibits of one class and number as one, with their pages and how many images and drawings they have."""
    return items.groupBy(book, "class", "key").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.sum("n_images").alias("n_images"), F.sum("n_drawings").alias("n_drawings"))


def page_conditions(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Risk, confidence of the reading order and kind of each page, from its layout, its scan and its regions.

    ``layout, scanned, ocr_status, n_chars, n_images`` of pages, ``risk`` of regions.
    """
    columns = F.col("layout").isin("multi_column", "mixed")
    unread = F.coalesce(F.col("ocr_status").isin("unavailable", "failed"), F.lit(False))
    own = F.when(F.col("scanned") | unread, SCAN_RISK).when(columns, COLUMN_RISK).otherwise(0)
    worst = regions.groupBy(*PAGE).agg(F.max("risk").alias("_worst"))
    risk = F.greatest(own, F.coalesce("_worst", F.lit(0)))
    confidence = F.when(F.col("scanned"), F.when(F.col("ocr_status") == "completed", READ_CONFIDENCE).otherwise(0.0)).when(columns, COLUMN_CONFIDENCE).otherwise(1.0)
    kind = F.when((F.col("n_chars") == 0) & (F.col("n_images") == 0), "blank").when(F.col("page") == 1, "cover").otherwise("body")
    return pages.join(worst, PAGE, "left").select(*PAGE, risk.alias("risk"), confidence.alias("confidence"), kind.alias("kind"))


def approved(exceptions: DataFrame) -> DataFrame:
    return exceptions.where(F.col("status") == "approved").select("check_id", "scope").distinct()


def unapproved(findings: DataFrame, exceptions: DataFrame, scope: str) -> DataFrame:
    """Warnings that no approved exception covers; one for the scope, the book or the publication does."""
    rules = approved(exceptions)
    whole = rules.where(F.col("scope").isin("book", "publication")).select("check_id").distinct()
    own = rules.select("check_id", F.col("scope").alias(scope))
    warnings = findings.where(F.col("status") == "warn")
    return warnings.join(whole, "check_id", "left_anti").join(own, ["check_id", scope], "left_anti").select(*findings.columns)


def contains_all(whole: Column, part: Column) -> Column:
    """Whether every key of ``part`` stands in ``whole`` with the same value."""
    return F.forall(F.map_keys(part), lambda k: F.element_at(whole, k).eqNullSafe(F.element_at(part, k)))


def best_page(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """The page that a unit without any shares most with, the earliest of equals: ``book_id, unit, page``."""
    lost = scores.where(F.col("score") > 0).join(chosen.select("book_id", "unit").distinct(), ["book_id", "unit"], "left_anti")
    return lost.groupBy("book_id", "unit").agg(F.max_by("page", F.struct("score", (-F.col("page")).alias("first"))).alias("page"))


def median_size(blocks: DataFrame, default: float = 10.0) -> DataFrame:
    """The median type size of each page, of text blocks; a page without any has the default."""
    return blocks.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(~F.col("is_image"), F.col("size"))), F.lit(default)).alias("median"))


def span_gap(direction: Column, before: tuple[Column, Column, Column, Column], after: tuple[Column, Column, Column, Column]) -> Column:
    """Distance between neighbouring spans along the reading direction (right, up or down), null for any other."""
    return F.when(direction == "right", after[0] - before[2]).when(direction == "up", before[1] - after[3]).when(direction == "down", after[1] - before[3])


def inner_box(direction: Column, size: Column, box: tuple[Column, Column, Column, Column]) -> list[Column]:
    """A line's box shrunk across the line, by a quarter of its height but no more than 0.3 of the type size, and by a hair along it."""
    x0, y0, x1, y1 = box
    across = F.least((y1 - y0) * 0.25, F.coalesce(size, y1 - y0) * 0.3)
    sideways = F.least((x1 - x0) * 0.25, F.coalesce(size, x1 - x0) * 0.3)
    dx = F.when(direction.isin("up", "down"), sideways).otherwise(0.5)
    dy = F.when(direction == "right", across).otherwise(0.5)
    return [(x0 + dx).alias("x0"), (y0 + dy).alias("y0"), (x1 - dx).alias("x1"), (y1 - dy).alias("y1")]


def removal_stats(removed: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """``book_id, what, n``: how many lines, tables and figures were taken out of each book."""
    lines = removed.where(F.col("kind").isin("header", "footer", "page_number"))
    count = lambda df, what: df.groupBy("book_id").agg(F.count("*").alias("n")).select("book_id", F.lit(what).alias("what"), "n")
    return count(lines, "furniture_lines").unionByName(count(tables, "tables")).unionByName(count(figures, "figures"))


def first_compact(items: DataFrame, group: list[str], order: str, most: int = 6) -> DataFrame:
    """The first items of each group, in order, as one text."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order, "item"))
    named = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", F.concat("item", F.lit("\u00d7"), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ")
    return items.withColumn("_p", place).where(F.col("_p") <= most).groupBy(*group).agg(named.alias("items"))
