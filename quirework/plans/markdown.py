"""Queries over the Markdown and HTML of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import markdown as M
from quirework.functions import text as T
from quirework.operators import structure as S
from quirework.plans.registry import query
from quirework.session import ship, table

SEGS = "s AS (SELECT DISTINCT book_id, id, ord, kind, text FROM segments WHERE text IS NOT NULL)"
SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
CELLS = rf"""{SEGS}, l AS (SELECT book_id, id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS n FROM s WHERE kind = 'table' AND contains(text, '|')),
r AS (SELECT * FROM l WHERE contains(line, '|') AND NOT regexp_matches(line, '{SEPARATOR}')),
c AS (SELECT book_id, id, n, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS cells FROM r)"""


def _segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "segments").where(F.col("text").isNotNull())
    return S.once(rows, "book_id", "id", *columns)


@query(
    "markdown_tables",
    rf"""WITH {CELLS}, sep AS (SELECT book_id, id, count(*) AS n_separators FROM l a WHERE regexp_matches(line, '{SEPARATOR}') AND contains(line, '|') AND EXISTS (SELECT 1 FROM l b WHERE b.book_id = a.book_id AND b.id = a.id AND b.n = a.n - 1 AND contains(b.line, '|')) GROUP BY ALL)
SELECT c.book_id, c.id, CAST(count(*) AS INTEGER) AS n_rows, CAST(max(len(cells)) AS INTEGER) AS n_columns, CAST(coalesce(any_value(n_separators), 0) AS INTEGER) AS n_separators,
  CAST(sum(len(list_filter(cells, lambda x: regexp_matches(x, '\p{{L}}')))) AS INTEGER) AS n_word_cells
FROM c LEFT JOIN sep USING (book_id, id) GROUP BY c.book_id, c.id""",
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and cells with words of pipe tables."""
    rows = _segments(spark, sf_dir, "kind", "text").where((F.col("kind") == "table") & F.col("text").contains("|"))
    grid = rows.withColumn("rows", M.table_rows(F.col("text"))).where(F.size("rows") > 0)
    words = F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda x: x.rlike("\\p{L}"))))
    return grid.select("book_id", "id", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_columns"), M.pipe_tables(F.col("text")).alias("n_separators"), words.alias("n_word_cells"))


@query(
    "markdown_table_widths",
    rf"""WITH {CELLS}, x AS (SELECT book_id, id, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col FROM c)
SELECT book_id, id, CAST(col AS INTEGER) AS col, CAST(max(length(trim(cell)) + len(regexp_extract_all(trim(cell), '[\x{{1100}}-\x{{115f}}\x{{2e80}}-\x{{303e}}\x{{3041}}-\x{{a4cf}}\x{{ac00}}-\x{{d7a3}}\x{{f900}}-\x{{faff}}\x{{fe30}}-\x{{fe4f}}\x{{ff00}}-\x{{ff60}}\x{{ffe0}}-\x{{ffe6}}]'))
  - len(regexp_extract_all(trim(cell), '\p{{Mn}}'))) AS INTEGER) AS width FROM x GROUP BY ALL""",
)
def markdown_table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest cell of each column, wide characters counted twice."""
    rows = _segments(spark, sf_dir, "kind", "text").where((F.col("kind") == "table") & F.col("text").contains("|"))
    cells = rows.select("book_id", "id", F.explode(M.table_rows(F.col("text"))).alias("r")).select("book_id", "id", F.posexplode("r").alias("pos", "cell"))
    return cells.groupBy("book_id", "id", (F.col("pos") + 1).alias("col")).agg(F.max(T.display_width(F.col("cell"))).cast("int").alias("width"))


@query(
    "markdown_table_rendered",
    rf"""WITH {CELLS}, w AS (SELECT book_id, id, max(len(cells)) AS k FROM c GROUP BY ALL),
t AS (SELECT c.book_id, c.id, n, '| ' || array_to_string(list_transform(cells, lambda x: replace(trim(x), '|', '\|')), ' | ') || ' |' AS line, row_number() OVER (PARTITION BY c.book_id, c.id ORDER BY n) AS i, k FROM c JOIN w USING (book_id, id))
SELECT book_id, id, string_agg(line || CASE WHEN i = 1 THEN chr(10) || '|' || repeat('---|', CAST(k AS INTEGER)) ELSE '' END, chr(10) ORDER BY n) AS body FROM t GROUP BY ALL""",
)
def markdown_table_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables read into cells and written again."""
    rows = _segments(spark, sf_dir, "kind", "text").where((F.col("kind") == "table") & F.col("text").contains("|"))
    grid = rows.withColumn("rows", M.table_rows(F.col("text"))).where(F.size("rows") > 0)
    return grid.select("book_id", "id", M.pipe_table(F.col("rows"), F.lit(True)).alias("body"))


@query("markdown_lists", rf"WITH {SEGS} SELECT book_id, id, CAST(len(regexp_extract_all(text, '(?m)^\s*(?:[-*+]|\d{{1,3}}[.)])\s+')) AS INTEGER) AS n_items FROM s WHERE kind = 'list'")
def markdown_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir, "kind", "text").where(F.col("kind") == "list")
    return rows.select("book_id", "id", M.list_items(F.col("text")).alias("n_items"))


CAPTION_RE2 = r"(?i)(?:^|[^\p{L}])(exhibit|figure|fig\.|table|chart|plate|illustration|map|图表|插图|图|表)\s*([0-9]+(?:[.–-][0-9]+)*[a-z]?)"
HAN_CAPTION = r"(图表|插图|图|表)\s*([0-9]+(?:[.–-][0-9]+)*[a-z]?)"


@query(
    "markdown_captions",
    rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '([^\p{{L}}])', '\1\1', 'g') AS text FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{{L}}])(exhibit|figure|fig\.\.|table|chart|plate|illustration|map|图表|插图|图|表)\s*([0-9]+(?:(?:\.\.|––|--)[0-9]+)*[a-z]?)')) AS m FROM
   (SELECT doc_id, regexp_replace(text, '([0-9])([0-9])', '\1\2', 'g') AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '([^\p{{L}}0-9])', '\1\1', 'g'), 'zzzz', '') AS text FROM documents WHERE text IS NOT NULL))),
k AS (SELECT DISTINCT doc_id, lower(regexp_extract(m, '(?i)(exhibit|figure|fig\.|table|chart|plate|illustration|map|图表|插图|图|表)', 1)) AS label, upper(replace(replace(replace(regexp_extract(m, '([0-9]+(?:(?:\.\.|––|--)[0-9]+)*[a-z]?)$', 1), '..', '.'), '––', '-'), '--', '-')) AS key FROM x)
SELECT DISTINCT doc_id, CASE WHEN label = 'exhibit' THEN 'exhibit' WHEN label IN ('table', '表') THEN 'table' ELSE 'figure' END || ' ' || key AS caption FROM k""",
)
def markdown_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibits that a document names, by class and number."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", F.explode(M.caption_labels(F.col("text"))).alias("caption")).distinct()


_HEADINGS = "regexp_replace(" * 6 + "t" + "".join(rf", '(?is)<h{n}(?:\s[^>]*)?>\s*(.*?)\s*</h{n}>', '{'#' * n} \1', 'g')" for n in range(1, 7))


@query(
    "markdown_html",
    rf"""WITH {SEGS}, a AS (SELECT book_id, id, text AS t FROM s WHERE regexp_matches(text, '(?i)<(h[1-6]|sup)\b')),
b AS (SELECT book_id, id, {_HEADINGS} AS t FROM a)
SELECT book_id, id, regexp_replace(t, '(?i)<sup[^>]*>\s*\[?(\d{{1,3}})\]?\s*</sup>', '^\1^', 'g') AS body FROM b""",
)
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and note marks in HTML as Markdown."""
    rows = table(spark, sf_dir, "segments").where(F.col("text").rlike("(?i)<(h[1-6]|sup)\\b"))
    return S.once(rows, "book_id", "id", "text").select("book_id", "id", M.superscripts(M.html_headings(F.col("text"))).alias("body"))


@query("markdown_html_tables")
def markdown_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables as pipe tables; a parser's work, tested on fixtures."""
    ship(spark)
    rows = table(spark, sf_dir, "segments").where(F.lower("text").contains("<table"))
    return S.once(rows, "book_id", "id", "text").select("book_id", "id", M.html_tables_as_markdown(F.col("text")).alias("body"))


@query(
    "markdown_images",
    rf"""WITH {SEGS}, i AS (SELECT book_id, unnest(regexp_extract_all(text, '(?i)(?:!\[[^\]]*\]\(|<img\b[^>]*\bsrc\s*=\s*["''])([^)\s"'']+)', 1)) AS image FROM s)
SELECT book_id, image, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL""",
)
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a book refers to."""
    rows = _segments(spark, sf_dir, "text")
    return rows.select("book_id", F.explode(T.images(F.col("text"))).alias("image")).groupBy("book_id", "image").agg(F.count("*").alias("n"))


@query(
    "markdown_anchors",
    rf"""WITH {SEGS}, n AS (SELECT book_id, ord, lower(regexp_replace(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g'))[1:180] AS anchor FROM s WHERE kind = 'paragraph' AND length(text) > 0),
f AS (SELECT book_id, anchor, min(ord) AS ord FROM n WHERE length(anchor) >= 12 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, anchor) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS k FROM f)
SELECT book_id, CAST(i AS INTEGER) AS place, anchor FROM r WHERE i IN (SELECT CAST(round_even(j * (r.k - 1) / 8.0, 0) AS INTEGER) FROM range(9) t(j))""",
)
def markdown_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine evenly spaced stretches of each book's text that stand for it in other formats.

    Distinct stretches of a fixed length are ranked, not texts.
    """
    rows = _segments(spark, sf_dir, "ord", "kind", "text").where((F.col("kind") == "paragraph") & (F.length("text") > 0))
    stretches = rows.select("book_id", "ord", F.substring(T.normal_inventory(F.col("text")), 1, 180).alias("anchor")).where(F.length("anchor") >= 12)
    first = stretches.groupBy("book_id", "anchor").agg(F.min("ord").alias("ord"))
    ranked = S.running_rank(first, ["book_id"], "ord", ["anchor"], "place")
    counts = first.groupBy("book_id").agg(F.count("*").alias("k"))
    wanted = counts.select("book_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("j"), "k").select("book_id", F.bround(F.col("j") * (F.col("k") - 1) / 8).cast("int").alias("place")).distinct()
    return ranked.join(wanted, ["book_id", "place"]).select("book_id", "place", "anchor")


@query(
    "markdown_continues",
    rf"""WITH {SEGS}, n AS (SELECT book_id, id, ord, kind, text FROM s)
SELECT a.book_id, a.id, b.id AS next_id FROM n a JOIN n b ON a.book_id = b.book_id AND b.ord = a.ord + 1
WHERE a.kind = 'paragraph' AND b.kind = 'paragraph' AND NOT regexp_matches(trim(a.text), '[.!?:;。！？：；…"''”’)\]）」』]$') AND regexp_matches(trim(b.text), '^[\p{{Ll}}0-9\x{{4e00}}-\x{{9fff}}]')""",
)
def markdown_continues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that run on into the next: an equi-join on the position."""
    rows = _segments(spark, sf_dir, "ord", "kind", "text").where(F.col("kind") == "paragraph")
    open_ = rows.where(~F.trim("text").rlike("[.!?:;\\x{3002}\\x{ff01}\\x{ff1f}\\x{ff1a}\\x{ff1b}\\x{2026}\"'\\x{201d}\\x{2019})\\]\\x{ff09}\\x{300d}\\x{300f}]$")).select("book_id", "id", (F.col("ord") + 1).alias("ord"))
    starts = rows.where(F.trim("text").rlike("^[\\p{Ll}0-9\\x{4e00}-\\x{9fff}]")).select("book_id", F.col("id").alias("next_id"), "ord")
    return open_.join(starts, ["book_id", "ord"]).select("book_id", "id", "next_id")


@query(
    "markdown_plain",
    rf"""WITH {SEGS} SELECT book_id, id, trim(regexp_replace(regexp_replace(regexp_replace(text, '</?(?:span|div)\b[^>]*>', '', 'g'), '[*_`]', '', 'g'), '\s+', ' ', 'g'), ' #') AS plain FROM s WHERE kind = 'heading'""",
)
def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without marks."""
    rows = _segments(spark, sf_dir, "kind", "text").where(F.col("kind") == "heading")
    return rows.select("book_id", "id", T.plain(F.col("text")).alias("plain"))
