"""Queries over page layout, on small stated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.functions import numbers as N
from quirework.operators import layout as L
from quirework.plans import fixtures as X
from quirework.plans.registry import query
from quirework.session import ship

BLOCKS = X.values("b", X.BLOCKS, X.BLOCK_SCHEMA)
COLUMNS = f"""{BLOCKS}, c AS (SELECT *, (x0 + x1) / 2 AS m FROM b WHERE length(text) >= 20 AND x1 - x0 <= page_width * 0.7),
paired AS (SELECT DISTINCT l.book_id, l.page FROM c l JOIN c r ON l.book_id = r.book_id AND l.page = r.page WHERE l.m < l.page_width * 0.46 AND r.m > r.page_width * 0.54
  AND greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) / greatest(1, least(l.y1 - l.y0, r.y1 - r.y0)) >= 0.2),
lay AS (SELECT book_id, page, CASE WHEN (book_id, page) NOT IN (SELECT (book_id, page) FROM paired) THEN 'single_column' WHEN bool_or(x1 - x0 > page_width * 0.72) THEN 'mixed' ELSE 'multi_column' END AS layout FROM b GROUP BY book_id, page)"""
LINES = X.values("l", X.LINES, X.LINE_SCHEMA)


@query("layout_columns", f"WITH {COLUMNS} SELECT book_id, page, layout FROM lay")
def layout_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.columns(X.frame(spark, X.BLOCKS, X.BLOCK_SCHEMA))


@query(
    "layout_order",
    f"""WITH {COLUMNS}, t AS (SELECT b.*, lay.layout, x1 - x0 > page_width * 0.72 AS wide, min(CASE WHEN NOT x1 - x0 > page_width * 0.72 THEN y0 END) OVER (PARTITION BY b.book_id, b.page) AS top FROM b JOIN lay USING (book_id, page)),
z AS (SELECT *, CASE WHEN layout = 'single_column' THEN 0 WHEN wide AND y0 < coalesce(top, page_width) THEN 0 WHEN wide THEN 3 WHEN (x0 + x1) / 2 < page_width / 2 THEN 1 ELSE 2 END AS zone FROM t)
SELECT book_id, page, block, zone, CAST(row_number() OVER (PARTITION BY book_id, page ORDER BY zone, y0, x0, block) AS INTEGER) AS place FROM z""",
)
def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = X.frame(spark, X.BLOCKS, X.BLOCK_SCHEMA)
    return L.reading_order(blocks, L.columns(blocks))


@query(
    "layout_boxes",
    f"""WITH {BLOCKS}, n AS (SELECT book_id, page, block, least(1, greatest(0, x0 / page_width)) AS l, least(1, greatest(0, y0 / 800.0)) AS t, least(1, greatest(0, x1 / page_width)) AS r, least(1, greatest(0, y1 / 800.0)) AS u FROM b)
SELECT book_id, page, block, CAST(round(l, 6) AS DOUBLE) AS x, CAST(round(t, 6) AS DOUBLE) AS y, CAST(round(greatest(0.000001, r - l), 6) AS DOUBLE) AS width, CAST(round(greatest(0.000001, u - t), 6) AS DOUBLE) AS height FROM n""",
)
def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as parts of their page."""
    box = G.normal_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("page_width"), F.lit(800.0))
    return X.frame(spark, X.BLOCKS, X.BLOCK_SCHEMA).select("book_id", "page", "block", *box)


BODY = f"""{LINES}, body AS (SELECT book_id, arg_max(size, (n, size)) AS body FROM (SELECT book_id, round(size * 2) / 2 AS size, sum(length(text)) AS n FROM l WHERE NOT in_margin GROUP BY ALL) GROUP BY book_id)"""


@query("layout_body_size", f"WITH {BODY} SELECT book_id, CAST(body AS DOUBLE) AS body FROM body")
def layout_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_size(X.frame(spark, X.LINES, X.LINE_SCHEMA).where(~F.col("in_margin")))


@query(
    "layout_headings",
    f"""WITH {BODY} SELECT book_id, page, line, text FROM l JOIN body USING (book_id) WHERE NOT in_margin AND regexp_matches(text, '\\p{{L}}')
  AND ((size >= body * 1.15 AND length(text) <= 120) OR (bold AND size >= body * 0.95 AND length(text) <= 80 AND NOT regexp_matches(text, '[.,;:!?。，；：！？]$')))""",
)
def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.frame(spark, X.LINES, X.LINE_SCHEMA).where(~F.col("in_margin"))
    return lines.join(L.body_size(lines), "book_id").where(L.is_heading_line(F.col("body"))).select("book_id", "page", "line", "text")


@query(
    "layout_running_heads",
    rf"""WITH {LINES}, k AS (
  SELECT book_id, page, text AS key, NULL AS "offset" FROM l WHERE in_margin
  UNION ALL SELECT book_id, page, regexp_extract(text, '^(\d{{1,4}})\s+(.+)$', 2), CAST(regexp_extract(text, '^(\d{{1,4}})\s+(.+)$', 1) AS INTEGER) - page FROM l WHERE in_margin AND regexp_matches(text, '^(\d{{1,4}})\s+(.+)$')
  UNION ALL SELECT book_id, page, regexp_extract(text, '^(.+?)\s+(\d{{1,4}})$', 1), CAST(regexp_extract(text, '^(.+?)\s+(\d{{1,4}})$', 2) AS INTEGER) - page FROM l WHERE in_margin AND regexp_matches(text, '^(.+?)\s+(\d{{1,4}})$'))
SELECT book_id, key, "offset", CAST(count(DISTINCT page) AS BIGINT) AS n_pages FROM k GROUP BY ALL HAVING count(DISTINCT page) >= 3""",
)
def layout_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_heads(X.frame(spark, X.LINES, X.LINE_SCHEMA).where("in_margin"))


@query(
    "layout_folios",
    rf"""WITH {LINES}, r(text, value) AS (VALUES {", ".join(f"('{N.roman(n)}', {n})" for n in range(1, 200))}),
f AS (SELECT book_id, page, 'arabic' AS system, CAST(text AS INTEGER) - page AS "offset" FROM l WHERE in_margin AND regexp_matches(text, '^[0-9]{{1,4}}$')
  UNION ALL SELECT book_id, page, 'roman', value - page FROM l JOIN r ON lower(l.text) = r.text WHERE in_margin)
SELECT book_id, system, "offset", CAST(count(DISTINCT page) AS BIGINT) AS n_pages FROM f GROUP BY ALL HAVING count(DISTINCT page) >= 3""",
)
def layout_folios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.folio_offsets(spark, X.frame(spark, X.LINES, X.LINE_SCHEMA).where("in_margin"))


PAGES = X.values("p", X.PAGES, X.PAGE_SCHEMA)


@query("layout_duplicate_pages", f"WITH {PAGES}, w AS (SELECT *, lag(page) OVER (PARTITION BY book_id, image_sha ORDER BY page) AS same_as FROM p) SELECT book_id, page, same_as FROM w WHERE same_as IS NOT NULL AND n_chars > 0")
def layout_duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.duplicate_pages(X.frame(spark, X.PAGES, X.PAGE_SCHEMA))


@query("layout_risks", f"WITH {PAGES} SELECT CAST(r AS INTEGER) AS risk, CAST((SELECT count(*) FROM p WHERE p.risk = r) AS BIGINT) AS n_pages FROM range(4) t(r)")
def layout_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.risks(X.frame(spark, X.PAGES, X.PAGE_SCHEMA))


@query(
    "layout_caption_images",
    f"""WITH {X.values("c", X.CAPTIONS, X.CAPTION_SCHEMA)}, {X.values("i", X.IMAGES, X.IMAGE_SCHEMA)}
SELECT c.doc, c.line AS caption_line, i.line AS image_line, i.image FROM c JOIN i ON c.doc = i.doc AND abs(c.line - i.line) <= 4
WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc = c.doc AND o.line <> c.line AND o.line BETWEEN least(c.line, i.line) AND greatest(c.line, i.line))""",
)
def layout_caption_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.caption_images(X.frame(spark, X.CAPTIONS, X.CAPTION_SCHEMA), X.frame(spark, X.IMAGES, X.IMAGE_SCHEMA))


@query(
    "layout_exhibits",
    f"""WITH {X.values("s", X.SOURCE_EXHIBITS, X.EXHIBIT_SCHEMA)}, {X.values("t", X.TARGET_CAPTIONS, X.TARGET_SCHEMA)}
SELECT s.class, s.key, CASE WHEN t.key IS NULL THEN 'missing_target_caption' WHEN t.n_images > 0 THEN 'target_asset' WHEN t.n_rows >= 2 THEN 'target_table' ELSE 'caption_only' END AS finding,
  CASE WHEN t.key IS NULL THEN 'fail' WHEN t.n_images > 0 THEN 'pass' WHEN t.n_rows >= 2 THEN 'warn' ELSE 'fail' END AS status
FROM s LEFT JOIN t ON s.key = t.key AND (s.class = t.class OR s.class = 'exhibit' OR t.class = 'exhibit')""",
)
def layout_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exhibits(X.frame(spark, X.SOURCE_EXHIBITS, X.EXHIBIT_SCHEMA), X.frame(spark, X.TARGET_CAPTIONS, X.TARGET_SCHEMA))


@query("layout_clusters")
def layout_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of touching boxes; a transitive closure of geometry, tested against brute force."""
    ship(spark)
    return L.clusters(X.frame(spark, X.BLOCKS, X.BLOCK_SCHEMA))


@query(
    "layout_ocr",
    f"""WITH {X.values("r", X.TSV, X.TSV_SCHEMA)}, w AS (SELECT book_id, page, pos, TRY_CAST(string_split(line, chr(9))[11] AS DOUBLE) AS conf, trim(string_split(line, chr(9))[12]) AS word FROM r)
SELECT book_id, page, count(*) AS n_words, round(avg(conf), 6) AS confidence, string_agg(word, ' ' ORDER BY pos) AS text FROM w WHERE conf >= 0 AND length(word) > 0 GROUP BY book_id, page""",
)
def layout_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ocr_words(X.frame(spark, X.TSV, X.TSV_SCHEMA))


@query(
    "layout_wraps",
    rf"""WITH {X.values("w", X.WRAPS, X.WRAP_SCHEMA)}, n AS (SELECT *, lead(text) OVER (PARTITION BY book_id, page, block ORDER BY line) AS next, max(length(text)) OVER (PARTITION BY book_id, page, block) * 0.85 AS "full" FROM w)
SELECT book_id, page, block, line, right(text, 20) AS tail, left(next, 20) AS head FROM n WHERE next IS NOT NULL AND length(text) >= "full" AND NOT regexp_matches(text, '[.!?:;…"''”’)\]]$') AND regexp_matches(next, '^[\p{{Ll}}0-9]')""",
)
def layout_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_wraps(X.frame(spark, X.WRAPS, X.WRAP_SCHEMA))


@query(
    "layout_hyphens",
    rf"""WITH {X.values("b", X.BREAKS, X.BREAK_SCHEMA)}, {X.values("v", X.WORDS, X.WORD_SCHEMA)}, k AS (SELECT DISTINCT lower(word) AS word FROM v)
SELECT "first", "second", CASE WHEN lower("first" || '-' || "second") IN (SELECT word FROM k) THEN 'keep' WHEN lower("first" || "second") IN (SELECT word FROM k) THEN 'join' WHEN regexp_matches("second", '^\p{{Ll}}') THEN 'open' ELSE 'none' END AS decision FROM b""",
)
def layout_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hyphens(X.frame(spark, X.BREAKS, X.BREAK_SCHEMA), X.frame(spark, X.WORDS, X.WORD_SCHEMA))
