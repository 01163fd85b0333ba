"""Queries over blocks, the heading tree and work units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import text as T
from quirework.operators import structure as S
from quirework.plans.registry import query
from quirework.session import table

SEGS = "segs AS (SELECT DISTINCT book_id, id, ord, kind, text, heading_level, title, lang FROM segments)"


@query(
    "structure_blocks",
    r"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(?:[ \t]*\n)+')) AS piece,
         generate_subscripts(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(?:[ \t]*\n)+'), 1) AS i
  FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, i, trim(piece, chr(10)) AS text FROM pieces WHERE regexp_matches(piece, '\S')),
rows AS (SELECT *, string_split(text, chr(10)) AS l FROM kept),
kinds AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS block_no, text,
    CASE WHEN len(l) = 1 AND regexp_matches(l[1], '^(#{1,6})\s+(\S.*?)\s*$') THEN 'heading'
         WHEN regexp_matches(l[1], '^\s*(```|~~~)') THEN 'code'
         WHEN len(l) <= 3 AND regexp_matches(text, '(?i)(?:!\[[^\]]*\]\(|<img\b[^>]*\bsrc\s*=\s*["''])([^)\s"'']+)') THEN 'image'
         WHEN len(l) >= 2 AND len(list_filter(l, lambda x: contains(x, '|'))) = len(l) THEN 'table'
         WHEN regexp_matches(text, '^\s*<table\b[\s\S]*</table>\s*$') THEN 'table'
         WHEN regexp_matches(l[1], '^\s*([-*+] |\d+[.)]\s)') THEN 'list'
         ELSE 'paragraph' END AS kind
  FROM rows)
SELECT doc_id, block_no, kind, CASE WHEN kind = 'heading' THEN CAST(length(regexp_extract(text, '^(#{1,6})', 1)) AS INTEGER) END AS heading_level,
       CASE WHEN kind = 'heading' THEN regexp_extract(text, '^(#{1,6})\s+(\S.*?)\s*$', 2) END AS title, text
FROM kinds""",
)
def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(table(spark, sf_dir, "documents"))


@query(
    "structure_kinds",
    rf"""
WITH {SEGS}, rows AS (SELECT *, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM segs WHERE length(text) > 0)
SELECT book_id, id,
    CASE WHEN len(l) = 1 AND regexp_matches(l[1], '^(#{{1,6}})\s+(\S.*?)\s*$') THEN 'heading'
         WHEN regexp_matches(l[1], '^\s*(```|~~~)') THEN 'code'
         WHEN len(l) <= 3 AND regexp_matches(text, '(?i)(?:!\[[^\]]*\]\(|<img\b[^>]*\bsrc\s*=\s*["''])([^)\s"'']+)') THEN 'image'
         WHEN len(l) >= 2 AND len(list_filter(l, lambda x: contains(x, '|'))) = len(l) THEN 'table'
         WHEN regexp_matches(text, '^\s*<table\b[\s\S]*</table>\s*$') THEN 'table'
         WHEN regexp_matches(l[1], '^\s*([-*+] |\d+[.)]\s)') THEN 'list'
         ELSE 'paragraph' END AS parsed_kind, kind
FROM rows""",
)
def structure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind a block parser gives a segment beside the kind it carries."""
    rows = table(spark, sf_dir, "segments").where(F.length("text") > 0).select("book_id", "id", "ord", "heading_level", "title", "lang", "kind", S.kind_of(F.col("text")).alias("parsed_kind"), F.xxhash64("text").alias("text"))
    return rows.distinct().select("book_id", "id", "parsed_kind", "kind")


@query(
    "structure_profile",
    rf"""
WITH {SEGS}, l AS (SELECT *, CASE WHEN length(text) = 0 THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS l FROM segs WHERE text IS NOT NULL)
SELECT book_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(l)) AS BIGINT) AS n_lines,
  CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '^(#{{1,6}})\s+(\S.*?)\s*$')))) AS BIGINT) AS n_headings,
  CAST(sum(len(regexp_extract_all(text, '(?i)(?:!\[[^\]]*\]\(|<img\b[^>]*\bsrc\s*=\s*["''])([^)\s"'']+)'))) AS BIGINT) AS n_images,
  CAST(sum(len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2))) AS BIGINT) AS n_table_lines,
  CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '^\s*(```|~~~)')))) AS BIGINT) AS n_fences,
  CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '[=∑∫√±≤≥×→]')))) AS BIGINT) AS n_formula_lines,
  CAST(sum(len(regexp_extract_all(text, '\$[^$]+\$|\\\[[\s\S]*?\\\]'))) AS BIGINT) AS n_formulas
FROM l GROUP BY book_id""",
)
def structure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that describe a book: characters, lines, headings, images, table and formula signals."""
    text = F.col("text")
    counts = {
        "n_chars": F.length(text), "n_lines": F.size(T.lines(text)), "n_headings": T.heading_lines(text), "n_images": F.size(T.images(text)), "n_table_lines": T.table_signals(text),
        "n_fences": T.code_fences(text), "n_formula_lines": T.formula_signals(text), "n_formulas": T.formulas(text),
    }
    # counted where the text is read; only the counts and a hash go on to find rows delivered twice
    rows = table(spark, sf_dir, "segments").where(text.isNotNull()).select("book_id", "id", F.xxhash64("text").alias("h"), *[v.cast("long").alias(k) for k, v in counts.items()])
    return rows.distinct().groupBy("book_id").agg(*[F.sum(k).alias(k) for k in counts])


@query(
    "structure_markup_only",
    rf"""
WITH {SEGS}
SELECT book_id, id, kind FROM segs
WHERE text IS NOT NULL AND NOT regexp_matches(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '<[^>]+>', '', 'g'), '\p{{L}}')""",
)
def structure_markup_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without a letter once tags and images are gone."""
    rows = table(spark, sf_dir, "segments").where(F.col("text").isNotNull() & T.is_markup_only(F.col("text")))
    return S.once(rows, "book_id", "id", "kind")


@query(
    "structure_nodes",
    f"""
WITH {SEGS}
SELECT book_id, id, ord, kind, max(CASE WHEN kind = 'heading' THEN ord END) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node_ord
FROM segs""",
)
def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with the latest heading at or before it."""
    return S.assign_nodes(table(spark, sf_dir, "segments"))


@query(
    "structure_parents",
    f"""
WITH {SEGS}, h AS (SELECT book_id, id, ord, coalesce(heading_level, 1) AS level FROM segs WHERE kind = 'heading')
SELECT h.book_id, h.id, h.ord, h.level, (SELECT max(p.ord) FROM h p WHERE p.book_id = h.book_id AND p.ord < h.ord AND p.level < h.level) AS parent_ord
FROM h""",
)
def structure_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.heading_parents(table(spark, sf_dir, "segments"))


def _after_last(*marks: str) -> str:
    """SQL: where the last of the marks in ``w`` ends, -1 without any."""
    return "greatest(-1, " + ", ".join(f"CASE WHEN contains(w, {m}) THEN length(w) - strpos(reverse(w), reverse({m})) + 1 ELSE -1 END" for m in marks) + ")"


PIECES = f"""long AS (SELECT book_id, id, ord, kind, text FROM segs WHERE length(text) > 9000 AND kind NOT IN ('code', 'table')),
cuts AS (
  SELECT book_id, id, ord, kind, text AS rest, 0 AS part, CAST(NULL AS BIGINT) AS size FROM long
  UNION ALL
  SELECT book_id, id, ord, kind, regexp_replace(rest[cut + 1:], '^[\\s\\p{{Z}}]+', ''), part + 1, length(CASE WHEN cut = length(rest) THEN rest ELSE regexp_replace(rest[:cut], '[\\s\\p{{Z}}]+$', '') END)
  FROM (SELECT *, CASE WHEN length(rest) <= 9000 THEN length(rest) WHEN a >= 4500 THEN a WHEN b >= 4500 THEN b WHEN c >= 4500 THEN c WHEN d >= 4500 THEN d ELSE 9000 END AS cut
    FROM (SELECT *, {_after_last("chr(10)")} AS a, {_after_last("'。'", "'！'", "'？'", "'. '", "'! '", "'? '")} AS b, {_after_last("'；'", "'; '", "'，'", "', '")} AS c, {_after_last("' '")} AS d
      FROM (SELECT *, rest[:9000] AS w FROM cuts WHERE length(rest) > 0)))),
pieces AS (SELECT book_id, id, ord, kind, 0 AS part, length(text) AS n_chars FROM segs WHERE NOT coalesce(length(text) > 9000 AND kind NOT IN ('code', 'table'), false)
  UNION ALL SELECT book_id, id, ord, kind, part, size FROM cuts WHERE part > 0)"""


@query("segments_pieces", f"WITH RECURSIVE {SEGS}, {PIECES} SELECT book_id, id, ord, kind, CAST(part AS INTEGER) AS part, CAST(n_chars AS INTEGER) AS n_chars FROM pieces")
def segments_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut for work units."""
    return S.split_long(table(spark, sf_dir, "segments"))


@query(
    "structure_units",
    f"""
WITH RECURSIVE {SEGS}, {PIECES}, nodes_of AS (
  SELECT book_id, id, ord, max(CASE WHEN kind = 'heading' THEN ord END) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node_ord FROM segs),
sized AS (SELECT book_id, ord, id, part, coalesce(n_chars, 0) + 2 AS size, node_ord FROM pieces JOIN nodes_of USING (book_id, id, ord)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, node_ord ORDER BY ord, id, part) AS r FROM sized),
fold AS (
  SELECT book_id, node_ord, ord, size, r, 1 AS unit_in_node, size AS used FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.book_id, n.node_ord, n.ord, n.size, n.r, CASE WHEN f.used + n.size <= 6000 THEN f.unit_in_node ELSE f.unit_in_node + 1 END, CASE WHEN f.used + n.size <= 6000 THEN f.used + n.size ELSE n.size END
  FROM fold f JOIN ranked n ON n.book_id = f.book_id AND n.node_ord IS NOT DISTINCT FROM f.node_ord AND n.r = f.r + 1)
SELECT book_id, node_ord, CAST(unit_in_node AS INTEGER) AS unit_in_node, min(ord) AS first_ord, max(ord) AS last_ord, CAST(count(*) AS INTEGER) AS n_segments, CAST(sum(size) AS INTEGER) AS n_chars
FROM fold GROUP BY ALL""",
)
def structure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pack_units(table(spark, sf_dir, "segments"))


@query(
    "structure_tree",
    """
WITH RECURSIVE edges AS (SELECT book_id, id AS parent_id, unnest(children) AS id FROM nodes),
parents AS (SELECT book_id, id, min(parent_id) AS parent_id FROM edges GROUP BY ALL),
rows AS (SELECT DISTINCT n.book_id, n.id, p.parent_id FROM nodes n LEFT JOIN parents p USING (book_id, id)),
up AS (
  SELECT book_id, id, parent_id, id AS root_id, 0 AS depth FROM rows WHERE parent_id IS NULL
  UNION ALL SELECT r.book_id, r.id, r.parent_id, u.root_id, u.depth + 1 FROM rows r JOIN up u ON r.book_id = u.book_id AND r.parent_id = u.id)
SELECT * FROM up""",
)
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree(table(spark, sf_dir, "nodes"))


@query(
    "structure_coverage",
    """
WITH mapped AS (SELECT book_id, unnest(segment_ids) AS id FROM nodes), present AS (SELECT DISTINCT book_id, id FROM segments),
d AS (SELECT book_id, id, sum(n) AS n FROM (SELECT *, 1 AS n FROM mapped UNION ALL SELECT *, -1 FROM present) GROUP BY ALL)
SELECT book_id, id, CASE WHEN n > 0 THEN 'only_mapped' ELSE 'unmapped' END AS side, CAST(abs(n) AS INTEGER) AS n FROM d WHERE n <> 0""",
)
def structure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "segments"))


@query(
    "units_hashes",
    """
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments),
x AS (SELECT book_id, unit_id, source_hash, unnest(segment_ids) AS id, generate_subscripts(segment_ids, 1) AS pos FROM units),
j AS (SELECT x.book_id, x.unit_id, any_value(source_hash) AS source_hash, regexp_replace(string_agg(coalesce(t.text, ''), chr(10) || chr(10) ORDER BY pos), '\\s+$', '') || chr(10) AS body,
        CAST(count(*) AS INTEGER) AS n_segments, CAST(count(t.text) AS INTEGER) AS n_found
      FROM x LEFT JOIN t USING (book_id, id) GROUP BY x.book_id, x.unit_id)
SELECT book_id, unit_id, source_hash, sha256(body) AS current_hash, sha256(body) IS NOT DISTINCT FROM source_hash AS fits, n_segments, n_found FROM j""".replace("\\\\", "\\"),
)
def units_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose recorded hash still fits their segments, and those whose source has changed."""
    return S.unit_hashes(table(spark, sf_dir, "units"), table(spark, sf_dir, "segments"))


@query(
    "units_problems",
    """
WITH dup AS (SELECT book_id, unit_id FROM units GROUP BY ALL HAVING count(*) > 1),
dord AS (SELECT book_id, ord FROM units GROUP BY ALL HAVING count(*) > 1),
gaps AS (SELECT book_id FROM units GROUP BY book_id HAVING max(ord) + 1 <> count(DISTINCT ord)),
lost AS (SELECT DISTINCT u.book_id, u.unit_id FROM (SELECT book_id, unit_id, unnest(segment_ids) AS id FROM units) u ANTI JOIN segments s ON s.book_id = u.book_id AND s.id = u.id),
nodeless AS (SELECT u.book_id, u.unit_id FROM units u ANTI JOIN nodes n ON n.book_id = u.book_id AND n.id = u.book_node_id)
SELECT book_id, unit_id, 'duplicate_id' AS problem FROM dup
UNION ALL SELECT book_id, CAST(ord AS VARCHAR), 'duplicate_order' FROM dord
UNION ALL SELECT book_id, NULL, 'order_gap' FROM gaps
UNION ALL SELECT book_id, unit_id, 'missing_segment' FROM lost
UNION ALL SELECT book_id, unit_id, 'missing_node' FROM nodeless""",
)
def units_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unit_problems(*(table(spark, sf_dir, t) for t in ("units", "segments", "nodes")))


UNITS = [("a", "u1", 0, "n1", ["s1", "s2"]), ("a", "u2", 1, "n1", ["s3", "gone"]), ("a", "u2", 3, "n9", ["s4"]), ("a", "u4", 3, "n1", ["s4"])]
UNIT_SCHEMA = "book_id string, unit_id string, ord int, book_node_id string, segment_ids array<string>"
PROBLEMS = "('a', 'u2', 'duplicate_id'), ('a', '3', 'duplicate_order'), ('a', NULL, 'order_gap'), ('a', 'u2', 'missing_segment'), ('a', 'u2', 'missing_node')"


@query("units_problem_cases", f"SELECT * FROM (VALUES {PROBLEMS}) t(book_id, unit_id, problem)")
def units_problem_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated unit table with every fault there is."""
    segments = spark.createDataFrame([("a", f"s{i}") for i in range(1, 5)], "book_id string, id string")
    return S.unit_problems(spark.createDataFrame(UNITS, UNIT_SCHEMA), segments, spark.createDataFrame([("a", "n1")], "book_id string, id string"))


@query("structure_coverage_cases", "SELECT * FROM (VALUES ('a', 's1', 'only_mapped', 1), ('a', 's4', 'unmapped', 1), ('a', 's9', 'only_mapped', 2)) t(book_id, id, side, n)")
def structure_coverage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated map that names a segment twice, one that isn't there, and leaves one out."""
    nodes = spark.createDataFrame([("a", ["s1", "s2", "s9"]), ("a", ["s1", "s3", "s9"])], "book_id string, segment_ids array<string>")
    segments = spark.createDataFrame([("a", f"s{i}") for i in (1, 2, 3, 4, 4)], "book_id string, id string")
    return S.coverage(nodes, segments)


@query(
    "units_samples",
    """
WITH n AS (SELECT book_id, max(ord) + 1 AS n FROM units GROUP BY book_id),
p AS (SELECT DISTINCT book_id, CAST(round_even(i * (n - 1) / 6.0, 0) AS INTEGER) AS ord FROM n, range(7) t(i))
SELECT book_id, unit_id, ord FROM units SEMI JOIN p USING (book_id, ord)""",
)
def units_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.samples(table(spark, sf_dir, "units")).select("book_id", "unit_id", "ord")


@query(
    "units_context",
    """
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments),
size AS (SELECT u.book_id, u.unit_id, CAST(sum(coalesce(length(t.text), 0)) AS BIGINT) AS n FROM (SELECT book_id, unit_id, unnest(segment_ids) AS id FROM units) u LEFT JOIN t USING (book_id, id) GROUP BY ALL),
u AS (SELECT book_id, unit_id, ord, book_node_id, n FROM units JOIN size USING (book_id, unit_id))
SELECT a.book_id, a.unit_id, CAST(count(b.unit_id) AS BIGINT) AS n_earlier, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_chars
FROM u a LEFT JOIN u b ON a.book_id = b.book_id AND a.book_node_id = b.book_node_id AND b.ord < a.ord
  AND (SELECT sum(c.n) FROM u c WHERE c.book_id = a.book_id AND c.book_node_id = a.book_node_id AND c.ord < a.ord AND c.ord >= b.ord) <= 1800
GROUP BY ALL""",
)
def units_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier units of the same node, the newest first, as far as a budget of characters goes.

    Prefix sums tell what lies between two units, so a range of them is the answer and no units are paired.
    """
    units, segments = table(spark, sf_dir, "units"), table(spark, sf_dir, "segments")
    sizes = segments.select("book_id", "id", F.length("text").alias("n")).distinct()
    ids = units.select("book_id", "unit_id", "ord", "book_node_id", F.explode("segment_ids").alias("id"))
    u = ids.join(sizes, ["book_id", "id"], "left").groupBy("book_id", "unit_id", "ord", "book_node_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    node = Window.partitionBy("book_id", "book_node_id")
    u = u.withColumn("before", F.coalesce(F.sum("n").over(node.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = node.orderBy("before").rangeBetween(-1800, 0)
    # empty units share a prefix sum with those behind them, which are not earlier ones
    behind = Window.partitionBy("book_id", "book_node_id", "before").orderBy("ord").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    less = lambda f: f.over(near) - f.over(behind)
    earlier = u.where(F.col("book_node_id").isNotNull()).select("book_id", "unit_id", less(F.count("*")).alias("n_earlier"), less(F.sum("n")).alias("n_chars"))
    alone = u.where(F.col("book_node_id").isNull()).select("book_id", "unit_id", F.lit(0).cast("long").alias("n_earlier"), F.lit(0).cast("long").alias("n_chars"))
    return earlier.unionByName(alone)


@query(
    "headings_identifiers",
    rf"""
WITH {SEGS}, h AS (SELECT book_id, id, ord, title, lower(title) AS t FROM segs WHERE kind = 'heading' AND title IS NOT NULL),
k AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(t, '[^\p{{L}}\p{{N}}_.\s-]', '', 'g')), '\s+', '-', 'g'), '^[^\p{{L}}]+', '') AS raw FROM h),
n AS (SELECT *, CASE WHEN raw = '' THEN 'section' ELSE raw END AS key FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, key ORDER BY ord) - 1 AS i FROM n)
SELECT book_id, id, CASE WHEN i = 0 THEN key ELSE key || '-' || i END AS identifier, coalesce(nullif(regexp_replace(regexp_replace(t, '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')[1:64], ''), 'book-' || sha256(title)[1:8]) AS slug
FROM r""",
)
def headings_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of headings within their book, and file-name keys."""
    rows = table(spark, sf_dir, "segments").where((F.col("kind") == "heading") & F.col("title").isNotNull())
    named = S.with_identifiers(S.once(rows, "book_id", "id", "ord", "title"), "book_id", "ord")
    return named.select("book_id", "id", "identifier", T.slug(F.col("title"), F.sha2("title", 256)).alias("slug"))
