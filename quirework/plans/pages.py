"""More queries over page layout and over whole books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import drafts as D
from quirework.functions import lines as LN
from quirework.functions import markdown as M
from quirework.functions import publication as B
from quirework.functions import text as T
from quirework.functions.hashing import fields_hash
from quirework.operators import pages as P
from quirework.operators import structure as S
from quirework.plans import fixtures as X
from quirework.plans.registry import query
from quirework.session import ship, table

ROLES = X.values("b", X.ROLES, X.ROLE_SCHEMA)


@query(
    "pages_roles",
    rf"""WITH {ROLES}, r AS (SELECT *, CASE WHEN is_image THEN 'figure' WHEN regexp_matches(text, '[=∑∫√±≤≥]') AND length(text) < 300 THEN 'formula'
  WHEN regexp_matches(text, '(?i)^\s*(figure|fig\.|table|chart|exhibit|plate|图|表)\s*[0-9]') THEN 'caption' WHEN y0 > page_height * 0.82 AND size < median * 0.9 THEN 'footnote'
  WHEN size >= median * 1.3 AND length(text) <= 180 THEN 'heading' WHEN x1 - x0 < page_width * 0.38 AND layout = 'single_column' AND length(text) > 40 THEN 'sidebar' ELSE 'body' END AS role FROM b)
SELECT book_id, page, block, role, CASE role WHEN 'figure' THEN 1 WHEN 'formula' THEN 3 WHEN 'caption' THEN 1 WHEN 'footnote' THEN 2 WHEN 'heading' THEN 0 WHEN 'sidebar' THEN 2 ELSE CASE WHEN layout IN ('multi_column', 'mixed') THEN 2 ELSE 0 END END AS risk FROM r""",
)
def pages_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.roles(X.frame(spark, X.ROLES, X.ROLE_SCHEMA))


@query(
    "pages_scanned",
    f"""WITH {ROLES}, p AS (SELECT book_id, page, CAST(sum(CASE WHEN NOT is_image AND y0 >= page_height * 0.08 AND y1 <= page_height * 0.92 THEN length(text) ELSE 0 END) AS BIGINT) AS body_chars,
  round(least(1.0, sum(CASE WHEN is_image THEN (x1 - x0) * (y1 - y0) ELSE 0 END) / any_value(page_width * page_height)), 6) AS coverage FROM b GROUP BY book_id, page)
SELECT book_id, page, body_chars, coverage, body_chars < 20 AND coverage >= 0.5 AS scanned FROM p""",
)
def pages_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scanned_pages(X.frame(spark, X.ROLES, X.ROLE_SCHEMA))


@query("pages_folio_position", f"WITH {X.values('f', X.FOLIOS, X.FOLIO_SCHEMA)} SELECT book_id, CASE WHEN count(*) < 5 THEN 'unknown' WHEN median(y) < 0.22 THEN 'header' ELSE 'footer' END AS position FROM f GROUP BY book_id")
def pages_folio_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.folio_position(X.frame(spark, X.FOLIOS, X.FOLIO_SCHEMA))


@query(
    "pages_heading_runs",
    f"""WITH {X.values("h", X.HEADINGS, X.HEADING_SCHEMA)}, m AS (SELECT *, CASE WHEN line = lag(line) OVER w + 1 AND level = lag(level) OVER w THEN 0 ELSE 1 END AS starts FROM h WINDOW w AS (PARTITION BY book_id, page ORDER BY line)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY book_id, page ORDER BY line) AS run FROM m)
SELECT book_id, page, level, min(line) AS line, count(*) AS n, string_agg(text, ' ' ORDER BY line) AS title FROM r GROUP BY book_id, page, run, level""",
)
def pages_heading_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heading_runs(X.frame(spark, X.HEADINGS, X.HEADING_SCHEMA))


@query(
    "pages_breaks",
    rf"""WITH {X.values("p", X.ENDS, X.END_SCHEMA)}
SELECT a.book_id, a.page, right(a.tail, 40) AS tail, left(b.head, 40) AS head, regexp_matches(a.tail, '\p{{L}}-$') AND regexp_matches(b.head, '^\p{{Ll}}') AS divided
FROM p a JOIN p b ON a.book_id = b.book_id AND b.page = a.page + 1 WHERE NOT regexp_matches(a.tail, '[.!?:;。！？…"''”’)\]]$') AND regexp_matches(b.head, '^[\p{{Ll}}0-9]')""",
)
def pages_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_breaks(X.frame(spark, X.ENDS, X.END_SCHEMA))


@query(
    "pages_lifted",
    f"""WITH {X.values("h", X.LEVELS, X.LEVEL_SCHEMA)}, c AS (SELECT doc, count(*) FILTER (level = 1) AS tops, arg_min(level, pos) AS f, count(*) AS n FROM h GROUP BY doc)
SELECT doc, pos, CASE WHEN tops = 1 AND f = 1 AND n > 1 AND level > 1 THEN level - 1 ELSE level END AS level FROM h JOIN c USING (doc)""",
)
def pages_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lifted_levels(X.frame(spark, X.LEVELS, X.LEVEL_SCHEMA))


@query(
    "pages_editions",
    f"""WITH {X.values("i", X.EDITIONS, X.EDITION_SCHEMA)}, s AS (SELECT edition, count(DISTINCT actual) = 1 AND count(*) >= 2 AS agreed FROM i GROUP BY edition)
SELECT edition, format, CASE WHEN actual = expected THEN 'pass' WHEN actual < expected AND NOT agreed THEN 'fail' ELSE 'warn' END AS status FROM i JOIN s USING (edition)""",
)
def pages_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.edition_tables(X.frame(spark, X.EDITIONS, X.EDITION_SCHEMA))


@query(
    "books_vocabulary",
    r"""WITH s AS (SELECT DISTINCT book_id, id, text FROM segments WHERE kind = 'paragraph' AND text IS NOT NULL),
w AS (SELECT book_id, lower(unnest(regexp_extract_all(text, '[\p{L}]+(?:-[\p{L}]+)+'))) AS compound FROM s)
SELECT compound, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT book_id) AS BIGINT) AS n_books FROM w GROUP BY compound""",
)
def books_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds with a hyphen of their own, and how many books use them."""
    found = F.regexp_extract_all("text", F.lit("\\p{L}+(?:-\\p{L}+)+"), F.lit(0))
    rows = S.once_after(table(spark, sf_dir, "segments").where((F.col("kind") == "paragraph") & F.col("text").contains("-")), "book_id", "id", words=found)
    words = rows.select("book_id", F.explode("words").alias("w"))
    by_book = words.groupBy(F.lower("w").alias("compound"), "book_id").agg(F.count("*").alias("n"))
    return by_book.groupBy("compound").agg(F.sum("n").alias("n"), F.count("*").alias("n_books"))


@query(
    "books_titles",
    """WITH s AS (SELECT DISTINCT book_id, id, ord, kind, title FROM segments WHERE kind = 'heading' AND title IS NOT NULL)
SELECT b.book_id, b.title, arg_min(s.title, s.ord) AS first_heading, coalesce(lower(b.title) = lower(arg_min(s.title, s.ord)), false) AS agrees FROM books b LEFT JOIN s USING (book_id) GROUP BY b.book_id, b.title""",
)
def books_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's title beside its first heading."""
    heads = table(spark, sf_dir, "segments").where((F.col("kind") == "heading") & F.col("title").isNotNull())
    first = heads.groupBy("book_id").agg(F.min_by("title", "ord").alias("first_heading"))
    books = table(spark, sf_dir, "books").select("book_id", "title").distinct()
    return books.join(first, "book_id", "left").withColumn("agrees", F.coalesce(F.lower("title") == F.lower("first_heading"), F.lit(False)))


@query(
    "books_languages",
    """WITH s AS (SELECT DISTINCT book_id, id, lang FROM segments), c AS (SELECT book_id, coalesce(lower(split_part(lang, '-', 1)), 'none') AS lang, count(*) AS n FROM s GROUP BY ALL)
SELECT book_id, lang, CAST(n AS BIGINT) AS n, CAST(rank() OVER (PARTITION BY book_id ORDER BY n DESC, lang) AS INTEGER) AS place, round(n / sum(n) OVER (PARTITION BY book_id), 6) AS share FROM c""",
)
def books_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a book's segments, spellings of one code together."""
    rows = S.once(table(spark, sf_dir, "segments"), "book_id", "id", "lang")
    counts = rows.groupBy("book_id", F.coalesce(F.lower(F.split_part("lang", F.lit("-"), F.lit(1))), F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("book_id"))
    place = F.rank().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "lang"))
    return counts.select("book_id", "lang", "n", place.alias("place"), F.round(F.col("n") / whole, 6).alias("share"))


@query(
    "books_latest",
    """SELECT book_id, id, kind, length(text) AS n_chars, CAST(count(*) OVER (PARTITION BY book_id, id) AS BIGINT) AS n_deliveries FROM segments
QUALIFY row_number() OVER (PARTITION BY book_id, id ORDER BY ingested_at DESC) = 1""",
)
def books_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each segment and how often it was delivered; an aggregate, so copies meet before the shuffle."""
    rows = table(spark, sf_dir, "segments").select("book_id", "id", "kind", F.length("text").cast("long").alias("n_chars"), "ingested_at")
    last = F.max_by(F.struct("kind", "n_chars"), "ingested_at").alias("last")
    return rows.groupBy("book_id", "id").agg(last, F.count("*").alias("n_deliveries")).select("book_id", "id", "last.kind", "last.n_chars", "n_deliveries")


@query(
    "captions_sorted",
    r"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'Figure ([0-9]+\.[0-9]+)', 1)) AS key FROM documents)
SELECT key, CAST(row_number() OVER (ORDER BY CAST(split_part(key, '.', 1) AS INTEGER), CAST(split_part(key, '.', 2) AS INTEGER), key) AS INTEGER) AS place FROM d""",
)
def captions_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure numbers in numeric order, 6.9 before 6.10; the distinct numbers are few whatever the corpus."""
    keys = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("Figure ([0-9]+\\.[0-9]+)"), F.lit(1))).alias("key")).distinct()
    return keys.withColumn("place", F.row_number().over(Window.orderBy(LN.sort_key(F.col("key")), "key")))


@query(
    "documents_weights",
    r"""SELECT doc_id, n_chars = length(text) AS n_chars_fits, CAST(round(len(regexp_extract_all(regexp_replace(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]', ' ', 'g'), '[\p{L}]+(?:[''’][\p{L}]+)*'))
  + len(regexp_extract_all(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]')) * CAST(0.6 AS DOUBLE), 6) AS DOUBLE) AS weight FROM documents WHERE text IS NOT NULL""",
)
def documents_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document in words, and whether its recorded length is right."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", (F.col("n_chars") == F.length("text")).alias("n_chars_fits"), F.round(T.prose_weight(F.col("text")), 6).alias("weight"))


@query(
    "units_chain",
    """SELECT book_id, unit_id, ord, coalesce(lag(source_hash) OVER (PARTITION BY book_id ORDER BY ord, unit_id), 'root') AS previous_hash,
  sha256(coalesce('=' || source_hash, '!') || chr(31) || '=' || coalesce(lag(source_hash) OVER (PARTITION BY book_id ORDER BY ord, unit_id), 'root')) AS dependency_hash FROM units""",
)
def units_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with the hash of the one before it: what changes when a neighbour changes.

    Units are ranked by order and id, so gaps and repeated orders (``units_problems`` names them) do no harm, and the neighbour is found by an equi-join on ranks.
    """
    units = table(spark, sf_dir, "units").select("book_id", "unit_id", "ord", "source_hash")
    keyed = units.withColumns({"book": F.coalesce(F.concat(F.lit("="), "book_id"), F.lit("!")), "place": F.coalesce("ord", F.lit(2147483647))})
    ranked = S.running_rank(keyed, ["book"], "place", ["unit_id", "source_hash"], "rank")
    before = ranked.select("book", (F.col("rank") + 1).alias("rank"), F.col("source_hash").alias("previous_hash"))
    rows = ranked.join(before, ["book", "rank"], "left").withColumn("previous_hash", F.coalesce("previous_hash", F.lit("root")))
    return rows.select("book_id", "unit_id", "ord", "previous_hash", fields_hash(F.col("source_hash"), F.col("previous_hash")).alias("dependency_hash"))


@query(
    "units_nodes",
    """WITH n AS (SELECT book_id, id AS node_id, unnest(segment_ids) AS id FROM nodes), u AS (SELECT book_id, unit_id, book_node_id, unnest(segment_ids) AS id FROM units)
SELECT u.book_id, u.unit_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(count(DISTINCT n.node_id) AS BIGINT) AS n_nodes, coalesce(bool_and(n.node_id = u.book_node_id), false) AS fits FROM u LEFT JOIN n USING (book_id, id) GROUP BY ALL""",
)
def units_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a unit's segments all belong to its node."""
    owners = table(spark, sf_dir, "nodes").select("book_id", F.col("id").alias("node_id"), F.explode("segment_ids").alias("id"))
    parts = table(spark, sf_dir, "units").select("book_id", "unit_id", "book_node_id", F.explode("segment_ids").alias("id"))
    joined = parts.join(owners, ["book_id", "id"], "left")
    return joined.groupBy("book_id", "unit_id").agg(F.count("*").alias("n_segments"), F.countDistinct("node_id").alias("n_nodes"), F.coalesce(F.bool_and(F.col("node_id") == F.col("book_node_id")), F.lit(False)).alias("fits"))


@query(
    "alignment_anchors",
    r"""WITH t AS (SELECT DISTINCT book_id, id, text FROM segments WHERE text IS NOT NULL),
s AS (SELECT a.book_id, a.id, string_agg(t.text, ' ' ORDER BY pos) AS text FROM (SELECT book_id, id, unnest(source_segment_ids) AS sid, generate_subscripts(source_segment_ids, 1) AS pos FROM alignment) a JOIN t ON t.book_id = a.book_id AND t.id = a.sid GROUP BY ALL)
SELECT a.book_id, a.id, coalesce(contains(lower(regexp_replace(s.text, '[^\p{L}\p{N}]', '', 'g')), lower(regexp_replace(a.source_text, '[^\p{L}\p{N}]', '', 'g'))), false) AS present FROM alignment a LEFT JOIN s USING (book_id, id)""",
)
def alignment_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a confirmed paragraph still stands in the segments it was taken from, but for marks and spaces."""
    pairs = table(spark, sf_dir, "alignment")
    texts = S.once(table(spark, sf_dir, "segments").where(F.col("text").isNotNull()), "book_id", "id", "text")
    named = pairs.select("book_id", F.col("id").alias("item"), F.posexplode("source_segment_ids").alias("pos", "id")).join(texts, ["book_id", "id"])
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    bodies = named.groupBy("book_id", F.col("item").alias("id")).agg(whole.alias("body"))
    key = lambda c: F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}]", ""))
    return pairs.select("book_id", "id", "source_text").join(bodies, ["book_id", "id"], "left").select("book_id", "id", F.coalesce(F.contains(key("body"), key("source_text")), F.lit(False)).alias("present"))


@query(
    "publication_links",
    r"""WITH s AS (SELECT DISTINCT book_id, id, text FROM segments WHERE regexp_matches(text, '(?i)<img\b|\]\(')),
a AS (SELECT book_id, id, regexp_replace(text, '(?i)<img\b[^>]*\bsrc\s*=\s*["'']([^"'']+)["''][^>]*\balt\s*=\s*["'']([^"'']*)["''][^>]*>', '![\2](\1)', 'g') AS t FROM s)
SELECT book_id, id, regexp_replace(regexp_replace(t, '(?i)<img\b[^>]*\bsrc\s*=\s*["'']([^"'']+)["''][^>]*>', '![](\1)', 'g'), '\[(!\[[^\]]*\]\([^)]*\))\]\([^)]*\)', '\1', 'g') AS body FROM a""",
)
def publication_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in HTML as Markdown, links around images dropped."""
    rows = table(spark, sf_dir, "segments").where(F.col("text").rlike("(?i)<img\\b|\\]\\("))
    return S.once(rows, "book_id", "id", "text").select("book_id", "id", B.images(F.col("text")).alias("body"))


@query("publication_clean")
def publication_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments made fit for setting, by all steps; each step is tested on fixtures."""
    ship(spark)
    rows = S.once(table(spark, sf_dir, "segments").where(F.col("text").isNotNull()), "book_id", "id", "text")
    tagged = D.column(lambda t: D.note_markers(D.style_spans(t)))
    # Python is sent null for a text without the sign, as it gets all rows whatever stands around it
    drafts = rows.withColumn("text", F.coalesce(tagged(F.when(F.contains("text", F.lit("<")), F.col("text"))), "text"))
    tables = drafts.withColumn("text", F.coalesce(M.html_tables_as_markdown(F.when(F.contains(F.lower("text"), F.lit("<table")), F.col("text"))), "text"))
    return tables.select("book_id", "id", B.clean(F.col("text")).alias("body"))
