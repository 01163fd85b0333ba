"""Page layout given as rows: columns, roles, reading order, running heads, page numbers, captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import geometry as G
from quirework.functions import numbers as N

# Shares of a page's width, font sizes and repeat counts that the rules go by.
NARROW, WIDE, LEFT_OF, RIGHT_OF, SHARED = 0.7, 0.72, 0.46, 0.54, 0.2
HEADING_RATIO, BOLD_RATIO, HEADING_CHARS, BOLD_CHARS = 1.15, 0.95, 120, 80
LEAST_PAGES = 3
PAGE = ["book_id", "page"]
#: Height of a slice of a page within which blocks are looked for side by side.
SLICE = 100.0


def columns(blocks: DataFrame) -> DataFrame:
    """Layout of each page of each book: single_column, multi_column or mixed.

    Whether a left and a right block overlap is told by an equi-join on the page
    and on slices of its height, so a crowded page makes no pairs of blocks that
    lie far apart.
    """
    middle = G.centre(F.col("x0"), F.col("x1"))
    span = F.col("x1") - F.col("x0")
    narrow = blocks.where((F.length("text") >= 20) & (span <= F.col("page_width") * NARROW))
    slices = F.explode(F.sequence(F.floor(F.col("y0") / SLICE), F.floor(F.greatest("y0", "y1") / SLICE))).alias("slice")
    left = narrow.where(middle < F.col("page_width") * LEFT_OF).select(*PAGE, F.col("y0").alias("a0"), F.col("y1").alias("a1"), slices)
    right = narrow.where(middle > F.col("page_width") * RIGHT_OF).select(*PAGE, F.col("y0").alias("b0"), F.col("y1").alias("b1"), slices)
    paired = left.join(right, [*PAGE, "slice"]).where(G.vertical_overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) >= SHARED).select(*PAGE).distinct().withColumn("paired", F.lit(True))
    pages = blocks.groupBy(*PAGE).agg(F.bool_or(span > F.col("page_width") * WIDE).alias("has_wide"))
    kind = F.when(F.col("paired").isNull(), "single_column").when(F.col("has_wide"), "mixed").otherwise("multi_column")
    return pages.join(paired, PAGE, "left").select(*PAGE, kind.alias("layout"))


def reading_order(blocks: DataFrame, layouts: DataFrame) -> DataFrame:
    """The place of each block: wide ones above the columns, the left column, the right one, wide ones below."""
    rows = blocks.join(layouts, PAGE)
    wide = F.col("x1") - F.col("x0") > F.col("page_width") * WIDE
    top = F.min(F.when(~wide, F.col("y0"))).over(Window.partitionBy(*PAGE))
    left = G.centre(F.col("x0"), F.col("x1")) < F.col("page_width") / 2
    zone = F.when(F.col("layout") == "single_column", 0).when(wide & (F.col("y0") < F.coalesce("top", "page_width")), 0).when(wide, 3).when(left, 1).otherwise(2)
    placed = rows.withColumn("top", top).withColumn("zone", zone)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("zone", "y0", "x0", "block"))
    return placed.select(*PAGE, "block", F.col("zone").cast("int").alias("zone"), order.alias("place"))


def body_size(lines: DataFrame) -> DataFrame:
    """The font size most characters of a book are set in, to half a point."""
    sums = lines.groupBy("book_id", (F.round(F.col("size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return sums.groupBy("book_id").agg(F.max_by("size", F.struct("n", "size")).alias("body"))


def is_heading_line(body: Column) -> Column:
    """Set larger than the body, or bold and short; a sentence is none."""
    letters = F.col("text").rlike("\\p{L}")
    large = (F.col("size") >= body * HEADING_RATIO) & (F.length("text") <= HEADING_CHARS)
    bold = F.col("bold") & (F.col("size") >= body * BOLD_RATIO) & (F.length("text") <= BOLD_CHARS) & ~F.col("text").rlike("[.,;:!?\\x{3002}\\x{ff0c}\\x{ff1b}\\x{ff1a}\\x{ff01}\\x{ff1f}]$")
    return letters & (large | bold)


def repeat_keys(text: Column, page: Column) -> Column:
    """Ways a line may repeat from page to page: word for word, or with a number that counts with the pages."""
    first, last = F.regexp_extract(text, "^(\\d{1,4})\\s+(.+)$", 1), F.regexp_extract(text, "^(.+?)\\s+(\\d{1,4})$", 2)
    offset = lambda n: n.cast("int") - page
    keys = F.array(
        F.struct(text.alias("key"), F.lit(None).cast("int").alias("offset")),
        F.when(first != "", F.struct(F.regexp_extract(text, "^(\\d{1,4})\\s+(.+)$", 2).alias("key"), offset(first).alias("offset"))),
        F.when(last != "", F.struct(F.regexp_extract(text, "^(.+?)\\s+(\\d{1,4})$", 1).alias("key"), offset(last).alias("offset"))),
    )
    return F.array_compact(keys)


def running_heads(lines: DataFrame) -> DataFrame:
    """Margin lines that repeat on several pages."""
    keyed = lines.select("book_id", "page", F.explode(repeat_keys(F.col("text"), F.col("page"))).alias("k")).select("book_id", "page", "k.key", "k.offset")
    pages = keyed.distinct().groupBy("book_id", "key", "offset").agg(F.count("*").alias("n_pages"))
    return pages.where(F.col("n_pages") >= LEAST_PAGES)


def folio_offsets(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Page-number systems of a book: value less page, where it holds on several pages."""
    arabic = lines.where(F.col("text").rlike("^[0-9]{1,4}$")).select("book_id", "page", F.lit("arabic").alias("system"), F.col("text").cast("int").alias("value"))
    roman = lines.withColumn("text", F.lower("text")).join(F.broadcast(N.folio_table(spark)), "text").select("book_id", "page", "system", "value")  # 199 numerals
    both = arabic.unionByName(roman).withColumn("offset", F.col("value") - F.col("page"))
    return both.groupBy("book_id", "system", "offset").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Pages with text whose image is that of an earlier page; the latest such page is named."""
    before = Window.partitionBy("book_id", "image_sha").orderBy("page")
    rows = pages.withColumn("same_as", F.lag("page").over(before))
    return rows.where(F.col("same_as").isNotNull() & (F.col("n_chars") > 0)).select("book_id", "page", "same_as")


def risks(pages: DataFrame) -> DataFrame:
    """How many pages bear each risk from 0 to 3, none left out."""
    scale = pages.sparkSession.range(4).select(F.col("id").cast("int").alias("risk"))
    counts = pages.groupBy("risk").agg(F.count("*").alias("n"))
    return scale.join(counts, "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n_pages"))


def caption_images(captions: DataFrame, images: DataFrame, reach: int = 4) -> DataFrame:
    """Images within a few lines of a caption with no other caption between them.

    The neighbouring captions are known from a window, so each image is tested
    against one interval; lines are bucketed by the reach to keep the join an equi-join.
    """
    order = Window.partitionBy("doc").orderBy("line")
    bounds = captions.withColumn("low", F.coalesce(F.lag("line").over(order), F.lit(-1))).withColumn("high", F.coalesce(F.lead("line").over(order), F.lit(1 << 30)))
    bounds = bounds.withColumn("slot", F.explode(F.array(*[F.floor(F.col("line") / reach) + k for k in (-1, 0, 1)])))
    spots = images.withColumn("slot", F.floor(F.col("line") / reach)).withColumnRenamed("line", "image_line")
    near = bounds.join(spots, ["doc", "slot"]).where((F.abs(F.col("image_line") - F.col("line")) <= reach) & (F.col("image_line") > F.col("low")) & (F.col("image_line") < F.col("high")))
    return near.select("doc", F.col("line").alias("caption_line"), "image_line", "image").distinct()


def exhibits(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each exhibit of a source with its target caption, if any; the class exhibit fits any class."""
    joined = source.alias("s").join(target.alias("t"), (F.col("s.key") == F.col("t.key")) & ((F.col("s.class") == F.col("t.class")) | (F.col("s.class") == "exhibit") | (F.col("t.class") == "exhibit")), "left")
    found = F.when(F.col("t.key").isNull(), "missing_target_caption").when(F.col("t.n_images") > 0, "target_asset").when(F.col("t.n_rows") >= 2, "target_table").otherwise("caption_only")
    status = F.when(F.col("t.key").isNull(), "fail").when(F.col("t.n_images") > 0, "pass").when(F.col("t.n_rows") >= 2, "warn").otherwise("fail")
    return joined.select(F.col("s.class").alias("class"), F.col("s.key").alias("key"), found.alias("finding"), status.alias("status"))


def clusters(boxes: DataFrame, gap: float = 24.0) -> DataFrame:
    """Boxes of a page that touch once each is grown by half the gap, as one box a cluster.

    A page's boxes are few and the closure is transitive, so one page is one group.
    """

    def one(page: pd.DataFrame) -> pd.DataFrame:
        order = page.sort_values(["x0", "y0", "x1", "y1"]).reset_index(drop=True)
        label = list(range(len(order)))

        def top(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        rows = order[["x0", "y0", "x1", "y1"]].to_numpy()
        active: list[int] = []
        for i, (x0, y0, _, y1) in enumerate(rows):
            active = [j for j in active if rows[j][2] + gap >= x0]
            for j in active:
                if rows[j][1] - gap <= y1 and y0 - gap <= rows[j][3]:
                    label[top(i)] = top(j)
            active.append(i)
        order["cluster"] = [top(i) for i in range(len(order))]
        out = order.groupby("cluster").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), n=("x0", "size")).reset_index(drop=True)
        out.insert(0, "page", page["page"].iloc[0])
        out.insert(0, "book_id", page["book_id"].iloc[0])
        return out[["book_id", "page", "x0", "y0", "x1", "y1", "n"]]

    return boxes.select(*PAGE, "x0", "y0", "x1", "y1").groupBy(*PAGE).applyInPandas(one, "book_id string, page int, x0 double, y0 double, x1 double, y1 double, n long")


def ocr_words(rows: DataFrame) -> DataFrame:
    """Words and mean confidence of pages from recognition output, one tab-separated line a row.

    Fields are counted from 1: the eleventh is the confidence, the twelfth the word;
    a negative confidence marks a row without a word.
    """
    cells = F.split("line", "\t")
    words = rows.select(*PAGE, "pos", F.get(cells, F.lit(10)).try_cast("double").alias("conf"), F.trim(F.get(cells, F.lit(11))).alias("word"))
    words = words.where((F.col("conf") >= 0) & (F.length("word") > 0))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return words.groupBy(*PAGE).agg(F.count("*").alias("n_words"), F.round(F.avg("conf"), 6).alias("confidence"), ordered.alias("text"))


def line_wraps(lines: DataFrame, share: float = 0.85, probe: int = 20) -> DataFrame:
    """Pairs of lines that are one sentence: the first is full and open, the second goes on."""
    order = Window.partitionBy(*PAGE, "block").orderBy("line")
    following = F.lead("text").over(order)
    full = F.max(F.length("text")).over(Window.partitionBy(*PAGE, "block")) * share
    rows = lines.withColumn("next", following).withColumn("full", full)
    goes_on = (F.length("text") >= F.col("full")) & ~F.col("text").rlike("[.!?:;\\x{2026}\"'\\x{201d}\\x{2019})\\]]$") & F.col("next").rlike("^[\\p{Ll}0-9]")
    return rows.where(F.col("next").isNotNull() & goes_on).select(*PAGE, "block", "line", F.expr(f"right(text, {probe})").alias("tail"), F.expr(f"left(next, {probe})").alias("head"))


def hyphens(breaks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What to do with a word broken at a line's end: join, keep the hyphen, or leave it open.

    ``vocabulary`` holds the words and compounds of the book's other text.
    """
    joined, compound = F.concat("first", "second"), F.concat_ws("-", "first", "second")
    known = vocabulary.select(F.lower("word").alias("word")).distinct()
    rows = breaks.withColumn("joined", F.lower(joined)).withColumn("compound", F.lower(compound))
    rows = rows.join(known.select(F.col("word").alias("joined"), F.lit(True).alias("has_joined")), "joined", "left")
    rows = rows.join(known.select(F.col("word").alias("compound"), F.lit(True).alias("has_compound")), "compound", "left")
    starts_small = F.col("second").rlike("^\\p{Ll}")
    decision = F.when(F.col("has_compound"), "keep").when(F.col("has_joined"), "join").when(starts_small, "open").otherwise("none")
    return rows.select("first", "second", decision.alias("decision"))
