"""Furniture of printed pages: running heads and page numbers, found by two signals and taken out with proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.operators import layout as L
from quirework.operators.conservation import bag_difference
from quirework.operators.layout import PAGE

# The margin's share of a page, lengths of running text, and how many lines a bold heading may have.
MARGIN, PROSE_CHARS, WIDE_CHARS, WIDE_SHARE, BOLD_LINES = 0.08, 60, 40, 0.7, 2
CAPTION = "(?i)^(?:fig(?:ure)?\\.?|exhibit|chart|plate|map|diagram|illustration|\\x{56fe}|\\x{63d2}\\x{56fe})\\s*[0-9]+"
MARKS = "<[^>]+>|[*_`^]"


def normal(text: Column) -> Column:
    """A line as repeats are compared: no marks, single spaces, small letters."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, MARKS, ""), "\\s+", " ")))


def heading_forms(text: Column) -> Column:
    """A heading, and its title alone where a label such as ``chapter 3`` or a number stands before it."""
    bare = F.trim(F.regexp_replace(text, "(?i)^(?:(?:chapter|part|book|section)\\s+[\\w.]+|\\x{7b2c}\\s*[0-9\\x{4e00}\\x{4e8c}\\x{4e09}\\x{56db}\\x{4e94}\\x{516d}\\x{4e03}\\x{516b}\\x{4e5d}\\x{5341}\\x{767e}\\x{96f6}\\x{3007}\\x{4e24}]+\\s*[\\x{7ae0}\\x{90e8}\\x{8282}\\x{7bc7}\\x{5377}]|[0-9]{1,3})[\\s.:\\x{ff1a}\\x{3001}\\x{2013}\\x{2014}-]*", ""))
    return F.when(F.length(bare) >= 3, F.array_distinct(F.array(text, bare))).otherwise(F.array(text))


def is_prose_row(row: Column, least: int = 40) -> Column:
    """A table row with one cell filled, and that a long one: a note or paragraph, no data."""
    filled = F.filter(row, lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return (F.size(filled) == 1) & (T.display_width(F.get(filled, F.lit(0))) >= least)


def bands(lines: DataFrame) -> DataFrame:
    """``band`` of each line: top or bottom if its whole block lies in that margin, else null."""
    own = F.when(F.col("y1") <= F.col("page_height") * MARGIN, "top").when(F.col("y0") >= F.col("page_height") * (1 - MARGIN), "bottom").otherwise("body")
    block = Window.partitionBy(*PAGE, "block")
    rows = lines.withColumn("_own", own)
    return rows.withColumn("band", F.when((F.min("_own").over(block) == F.max("_own").over(block)) & (F.col("_own") != "body"), F.col("_own"))).drop("_own")


def heading_blocks(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Blocks all of whose lines are set as headings, bold ones at body size only if short: ``book_id, page, block, level_size``."""
    rows = lines.join(body, "book_id").withColumn("_head", L.is_heading_line(F.col("body")))
    large = F.max("size") >= F.first("body") * L.HEADING_RATIO
    stats = rows.groupBy(*PAGE, "block").agg(F.bool_and("_head").alias("all"), F.count("*").alias("n"), large.alias("large"), F.max("size").alias("level_size"))
    return stats.where(F.col("all") & (F.col("large") | (F.col("n") <= BOLD_LINES))).select(*PAGE, "block", "level_size")


def kinds(spark: SparkSession, lines: DataFrame, body: DataFrame) -> DataFrame:
    """Furniture lines of each page: ``header``, ``footer`` or ``page_number``.

    Two signals are needed: the whole block lies in a margin, and the line is a
    page number that counts with the pages, repeats on several pages, or repeats
    a heading. Size, place or a number alone are never enough.
    """
    margin = bands(lines).join(body, "book_id").where(F.col("band").isNotNull() & (F.col("size") < F.col("body") * L.HEADING_RATIO))
    margin = margin.select(*PAGE, "block", "line", "band", normal(F.col("text")).alias("text")).where(F.length("text") > 0)
    folios = L.folio_offsets(spark, margin).select("book_id", "system", "offset")
    arabic = F.when(F.col("text").rlike("^[0-9]{1,4}$"), F.col("text").try_cast("int"))
    roman = F.broadcast(N.folio_table(spark).select("text", F.col("value").alias("_roman")))  # 199 numerals
    valued = margin.join(roman, "text", "left").withColumns({"system": F.when(arabic.isNotNull(), "arabic").when(F.col("_roman").isNotNull(), "roman"), "offset": F.coalesce(arabic, F.col("_roman")) - F.col("page")}).drop("_roman")
    numbers = valued.where(F.col("system").isNotNull()).join(folios, ["book_id", "system", "offset"], "left_semi").select(*PAGE, "block", "line", F.lit("page_number").alias("kind"))
    words = valued.where(F.col("system").isNull())
    running = L.running_heads(words).select("book_id", "key", "offset")
    keyed = words.select(*PAGE, "block", "line", "band", F.explode(L.repeat_keys(F.col("text"), F.col("page"))).alias("k")).select(*PAGE, "block", "line", "band", "k.key", "k.offset")
    keyed = keyed.withColumn("offset", F.coalesce("offset", F.lit(1 << 30)))
    repeated = keyed.join(running.withColumn("offset", F.coalesce("offset", F.lit(1 << 30))), ["book_id", "key", "offset"], "left_semi").select(*PAGE, "block", "line", "band")
    titles = lines.join(heading_blocks(lines, body), [*PAGE, "block"], "left_semi").select("book_id", F.explode(heading_forms(normal(F.col("text")))).alias("text")).distinct()
    named = words.join(titles, ["book_id", "text"], "left_semi").select(*PAGE, "block", "line", "band")
    heads = repeated.unionByName(named).distinct().select(*PAGE, "block", "line", F.when(F.col("band") == "top", "header").otherwise("footer").alias("kind"))
    return numbers.unionByName(heads)


def block_roles(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Roles of blocks all of whose lines were removed: figure labels and captions among them make a figure, else heads before feet."""
    rows = lines.where(F.length(F.trim("text")) > 0).join(removed.select(*PAGE, "block", "line", "kind"), [*PAGE, "block", "line"], "left")
    only = lambda k: F.bool_and(F.col("kind") == k)
    has = lambda *k: F.bool_or(F.col("kind").isin(*k))
    role = F.when(only("figure_label"), "figure").when(only("caption"), "caption").when(only("page_number"), "page_number").when(has("figure_label", "caption"), "figure").when(has("header"), "header").otherwise("footer")
    return rows.groupBy(*PAGE, "block").agg(F.bool_and(F.col("kind").isNotNull()).alias("gone"), role.alias("role")).where("gone").drop("gone")


def unproven(original: DataFrame, left: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages whose characters are not exactly those left and those logged as removed: ``book_id, page, missing, unexpected``; they must be put back.

    Bags of characters by page; the partial sums meet before the shuffle.
    """
    characters = lambda df: df.select(*PAGE, F.explode(F.split(F.regexp_replace("text", "\\s", ""), "")).alias("c")).where(F.col("c") != "")
    diff = bag_difference(characters(original), characters(left).unionByName(characters(removed)), PAGE, "c")
    side = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("c")))), "")
    return diff.groupBy(*PAGE).agg(side("source").alias("missing"), side("target").alias("unexpected"))


def caption_candidate(body: Column) -> Column:
    """A caption is set apart: smaller than the body, or bold; a sentence that cites a figure is none."""
    return F.col("text").rlike(CAPTION) & (F.col("size") < body * L.HEADING_RATIO) & ((F.col("size") < body * L.BOLD_RATIO) | F.col("bold"))


def prose_like(width: Column) -> Column:
    """A line that reads like running text: long, or fairly long and wide."""
    return (F.length("text") >= PROSE_CHARS) | ((F.length("text") >= WIDE_CHARS) & (F.col("x1") - F.col("x0") >= width * WIDE_SHARE))


def has_header(rows: Column, bold: Column) -> Column:
    """Whether a table's first row is a header: set bold, or labels over numbers."""
    number = lambda row: F.exists(row, lambda c: F.coalesce(c.rlike("[0-9]"), F.lit(False)))
    first = F.get(rows, F.lit(0))
    filled = F.exists(first, lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    return F.coalesce(filled & (bold | ~number(first) & F.exists(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), number)), F.lit(False))


def lost_words(source: DataFrame, draft: DataFrame, key: list[str], most: int = 20) -> DataFrame:
    """Letters and digits of a source that its draft lacks, and the first words that occur nowhere in it: ``key, n_characters, words``."""
    folded = lambda c: F.lower(F.normalize_nfkc(c)) if hasattr(F, "normalize_nfkc") else F.lower(c)
    characters = lambda df: df.select(*key, F.explode(F.split(F.regexp_replace(folded(F.col("text")), "[^\\p{L}\\p{N}]", ""), "")).alias("c")).where(F.col("c") != "")
    lost = bag_difference(characters(source), characters(draft), key, "c").where(F.col("side") == "source").groupBy(*key).agg(F.sum("n").alias("n_characters"))
    words = source.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))).alias("w")).join(draft.select(*key, folded(F.col("text")).alias("_draft")), key)
    absent = words.where(~F.contains("_draft", "w")).groupBy(*key).agg(F.slice(F.sort_array(F.collect_set("w")), 1, most).alias("words"))
    return lost.join(absent, key, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
