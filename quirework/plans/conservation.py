"""Queries that compare sources with their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T
from quirework.operators import conservation as C
from quirework.operators import structure as S
from quirework.plans.registry import query
from quirework.session import ship, table

KEY = ["book_id", "id"]
CORE = r"[0-9]+(?:[.,][0-9]+)*"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
DIFFERENCE = f"""
raw AS (SELECT book_id, id, unnest(regexp_extract_all(source_text, '{CORE}')) AS token, 1 AS n FROM alignment
        UNION ALL SELECT book_id, id, unnest(regexp_extract_all(target_text, '{CORE}')), -1 FROM alignment),
diff AS (SELECT book_id, id, token, CASE WHEN sum(n) > 0 THEN 'source' ELSE 'target' END AS side, CAST(abs(sum(n)) AS BIGINT) AS n FROM raw GROUP BY book_id, id, token HAVING sum(n) <> 0)"""


def _weight(text: str) -> str:
    """SQL: the size of a text in words."""
    return rf"round(len(regexp_extract_all(regexp_replace({text}, '{CJK}', ' ', 'g'), '[\p{{L}}]+(?:[''’][\p{{L}}]+)*')) + len(regexp_extract_all({text}, '{CJK}')) * CAST(0.6 AS DOUBLE), 6)"


WEIGHTS = f"w AS (SELECT book_id, id, CAST({_weight('source_text')} AS DOUBLE) AS source_weight, CAST({_weight('target_text')} AS DOUBLE) AS target_weight FROM alignment)"
STATUS = "CASE WHEN source_weight >= 40 THEN CASE WHEN target_weight / source_weight < 0.5 THEN 'fail' WHEN target_weight / source_weight < 0.7 OR target_weight / source_weight > 2.0 THEN 'warn' END END"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alignment")


@query("conservation_numbers", f"WITH {DIFFERENCE} SELECT * FROM diff")
def conservation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_difference(_pairs(spark, sf_dir), KEY)


@query("conservation_numbers_by_value")
def conservation_numbers_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by value: 10 million and 1,000万 are one number. Arithmetic inside a match has no SQL."""
    ship(spark)
    return C.number_difference(_pairs(spark, sf_dir), KEY, N.canonical_tokens_udf)


@query("conservation_weights", f"WITH {WEIGHTS} SELECT *, {STATUS} AS status FROM w")
def conservation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.weights(_pairs(spark, sf_dir), KEY)


PIECES = rf"""
cut AS (SELECT book_id, id, target_text, string_split(regexp_replace(regexp_replace(source_text, '([.!?…])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)) AS p FROM alignment),
piece AS (SELECT DISTINCT book_id, id, target_text, trim(regexp_replace(x, '\s+', ' ', 'g')) AS piece FROM (SELECT book_id, id, target_text, unnest(p) AS x FROM cut)),
copied AS (SELECT book_id, id, CAST(count(*) AS BIGINT) AS n_copied, round(least(1.0, sum(weight) / any_value(target_weight)), 6) AS share
           FROM (SELECT *, {_weight("piece")} AS weight, {_weight("target_text")} AS target_weight FROM piece)
           WHERE weight >= 6 AND target_weight > 0 AND contains(trim(regexp_replace(target_text, '\s+', ' ', 'g')), piece) GROUP BY book_id, id)"""


@query("conservation_copied", f"WITH {PIECES} SELECT *, CASE WHEN share >= 0.5 THEN 'fail' ELSE 'warn' END AS status FROM copied")
def conservation_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.copied(_pairs(spark, sf_dir), KEY)


@query(
    "conservation_neighbours",
    f"""
WITH {DIFFERENCE}, p AS (SELECT d.*, a.ord FROM diff d JOIN alignment a USING (book_id, id)),
near AS (SELECT a.book_id, a.id, a.token, a.side, sum(b.n) AS surplus FROM p a JOIN p b ON a.book_id = b.book_id AND abs(a.ord - b.ord) = 1 AND a.token = b.token AND a.side <> b.side GROUP BY ALL)
SELECT p.book_id, p.id, p.token, p.side, p.n, coalesce(near.surplus >= p.n, false) AS moved FROM p LEFT JOIN near USING (book_id, id, token, side)""",
)
def conservation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return C.moved_next_door(C.number_difference(pairs, KEY), pairs, "book_id", "ord", "id")


def _spelled_values() -> str:
    return ", ".join(f"({n}, '{form}', {str(form.isascii()).lower()})" for n, forms in N.SPELLINGS.items() for form in forms)


@query(
    "conservation_spelled",
    rf"""
WITH {DIFFERENCE}, f(value, form, latin) AS (VALUES {_spelled_values()}),
s AS (SELECT d.*, lower(CASE WHEN d.side = 'source' THEN a.target_text ELSE a.source_text END) AS text FROM diff d JOIN alignment a USING (book_id, id) WHERE regexp_matches(d.token, '^[0-9]{{1,2}}$'))
SELECT book_id, id, token, side, bool_or(CASE WHEN latin THEN contains(' ' || regexp_replace(text, '[^a-z-]+', ' ', 'g') || ' ', ' ' || form || ' ') ELSE contains(text, form) END) AS spelled
FROM s JOIN f ON f.value = CAST(s.token AS INTEGER) GROUP BY ALL""",
)
def conservation_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return C.spelled_elsewhere(spark, C.number_difference(pairs, KEY), pairs, KEY)


@query(
    "conservation_urls",
    r"""
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments WHERE contains(text, 'http')),
u AS (SELECT book_id, id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+')), '[.,;:!?''"]+$', '') AS url FROM t),
b AS (SELECT book_id, id, CASE WHEN suffix(url, ')') AND length(url) - length(replace(url, ')', '')) > length(url) - length(replace(url, '(', '')) THEN url[:-2] ELSE url END AS url FROM u),
c AS (SELECT book_id, id, CASE WHEN suffix(url, ')') AND length(url) - length(replace(url, ')', '')) > length(url) - length(replace(url, '(', '')) THEN url[:-2] ELSE url END AS url FROM b),
d AS (SELECT book_id, id, CASE WHEN suffix(url, ']') AND length(url) - length(replace(url, ']', '')) > length(url) - length(replace(url, '[', '')) THEN url[:-2] ELSE url END AS url FROM c)
SELECT book_id, id, url, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL""",
)
def conservation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.once_after(table(spark, sf_dir, "segments").where(F.contains("text", F.lit("http"))), "book_id", "id", urls=T.urls(F.col("text")))
    return rows.select("book_id", "id", F.explode("urls").alias("url")).groupBy("book_id", "id", "url").agg(F.count("*").alias("n"))


@query(
    "conservation_measures",
    r"""
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments WHERE text IS NOT NULL),
m AS (SELECT DISTINCT book_id, id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*\s?(?:%|°[CF]|mm|cm|km|kg|mg|MPa|kPa|Pa|Hz|kHz|MHz)\b|[0-9]+(?:[.,][0-9]+)*\s?%')) AS token FROM t)
SELECT book_id, lower(regexp_extract(token, '[^0-9.,\s]+$')) AS unit, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL""",
)
def conservation_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct measurements of a segment by unit, counted by book."""
    pattern = "[0-9]+(?:[.,][0-9]+)*\\s?(?:%|\\x{b0}[CF]|mm|cm|km|kg|mg|MPa|kPa|Pa|Hz|kHz|MHz)\\b|[0-9]+(?:[.,][0-9]+)*\\s?%"
    rows = S.once_after(table(spark, sf_dir, "segments").where(F.col("text").rlike(pattern)), "book_id", "id", tokens=F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    found = rows.select("book_id", "id", F.explode("tokens").alias("token")).distinct()
    return found.select("book_id", F.lower(F.regexp_extract("token", "[^0-9.,\\s]+$", 0)).alias("unit")).groupBy("book_id", "unit").agg(F.count("*").alias("n"))


@query(
    "conservation_score",
    f"""
WITH {DIFFERENCE}, {WEIGHTS}, {PIECES},
checks AS (SELECT DISTINCT book_id, id, 'content.numbers' AS check_id, 'fail' AS status FROM diff
  UNION ALL SELECT book_id, id, 'content.length_ratio', {STATUS} FROM w WHERE {STATUS} IS NOT NULL
  UNION ALL SELECT book_id, id, 'content.untranslated', CASE WHEN share >= 0.5 THEN 'fail' ELSE 'warn' END FROM copied)
SELECT book_id, CAST(count(*) FILTER (status = 'fail') AS BIGINT) AS n_fail, CAST(count(*) FILTER (status = 'warn') AS BIGINT) AS n_warn,
  CAST(greatest(0, 100 - 20 * count(*) FILTER (status = 'fail') - 2 * count(*) FILTER (status = 'warn')) AS BIGINT) AS score
FROM checks GROUP BY book_id""",
)
def conservation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings about a book's aligned paragraphs as one table of checks, and a score."""
    pairs = _pairs(spark, sf_dir)
    numbers = C.number_difference(pairs, KEY).select(*KEY).distinct().select(*KEY, F.lit("content.numbers").alias("check_id"), F.lit("fail").alias("status"))
    lengths = C.weights(pairs, KEY).where(F.col("status").isNotNull()).select(*KEY, F.lit("content.length_ratio").alias("check_id"), "status")
    copies = C.copied(pairs, KEY).select(*KEY, F.lit("content.untranslated").alias("check_id"), "status")
    return C.score(numbers.unionByName(lengths).unionByName(copies), ["book_id"])


@query(
    "conservation_overlap",
    r"""
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments WHERE text IS NOT NULL),
pt AS (SELECT book_id, id AS page, lower(unnest(regexp_extract_all(source_text, '[\p{L}\p{N}]{2,}'))) AS token FROM alignment),
ut AS (SELECT u.book_id, u.unit_id AS unit, u.ord, lower(unnest(regexp_extract_all(t.text, '[\p{L}\p{N}]{2,}'))) AS token
       FROM (SELECT book_id, unit_id, ord, unnest(segment_ids) AS id FROM units WHERE book_id IN (SELECT book_id FROM alignment)) u JOIN t USING (book_id, id)),
a AS (SELECT book_id, page, token, count(*) AS a FROM pt GROUP BY ALL), b AS (SELECT book_id, unit, ord, token, count(*) AS b FROM ut GROUP BY ALL),
s AS (SELECT a.book_id, page, unit, ord, sum(least(a, b)) AS shared FROM a JOIN b USING (book_id, token) GROUP BY ALL),
x AS (SELECT s.*, round(shared / greatest(1, least((SELECT sum(a) FROM a WHERE a.book_id = s.book_id AND a.page = s.page), (SELECT sum(b) FROM b WHERE b.book_id = s.book_id AND b.unit = s.unit))), 6) AS score FROM s),
k AS (SELECT *, max(score) OVER (PARTITION BY book_id, page) AS best FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY ord, unit) AS place FROM k WHERE score >= 0.12 AND score >= best * 0.55)
SELECT book_id, page, unit, CAST(score AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4""",
)
def conservation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work units that an aligned paragraph was taken from, by shared tokens."""
    pairs, units = _pairs(spark, sf_dir), table(spark, sf_dir, "units")
    pages = pairs.select("book_id", F.col("id").alias("page"), F.explode(T.tokens(F.col("source_text"))).alias("token"))
    own = units.join(pairs.select("book_id").distinct(), "book_id", "left_semi").select("book_id", F.col("unit_id").alias("unit"), "ord", F.explode("segment_ids").alias("id"))
    texts = S.once(table(spark, sf_dir, "segments").where(F.col("text").isNotNull()), "book_id", "id", "text")
    words = own.join(texts, ["book_id", "id"]).select("book_id", "unit", "ord", F.explode(T.tokens(F.col("text"))).alias("token"))
    return C.overlap(pages, words, "book_id", "page", "unit", "ord")


@query(
    "conservation_lost_characters",
    r"""
WITH t AS (SELECT DISTINCT book_id, id, text FROM segments WHERE text IS NOT NULL),
src AS (SELECT a.book_id, a.id, string_agg(t.text, ' ') AS text FROM (SELECT book_id, id, unnest(source_segment_ids) AS sid FROM alignment) a JOIN t ON t.book_id = a.book_id AND t.id = a.sid GROUP BY ALL),
c AS (SELECT book_id, id, unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '')) AS character, 1 AS n FROM src
      UNION ALL SELECT book_id, id, unnest(string_split(regexp_replace(lower(source_text), '[^\p{L}\p{N}]', '', 'g'), '')), -1 FROM alignment)
SELECT book_id, id, character, CASE WHEN sum(n) > 0 THEN 'source' ELSE 'target' END AS side, CAST(abs(sum(n)) AS BIGINT) AS n FROM c WHERE character <> '' GROUP BY book_id, id, character HAVING sum(n) <> 0""",
)
def conservation_lost_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of the segments that a confirmed paragraph lacks or adds, as bags of characters."""
    pairs = _pairs(spark, sf_dir)
    texts = S.once(table(spark, sf_dir, "segments").where(F.col("text").isNotNull()), "book_id", "id", "text")
    characters = lambda c: F.explode(F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", ""), ""), lambda x: x != ""))
    named = pairs.select("book_id", F.col("id").alias("item"), F.explode("source_segment_ids").alias("id")).join(texts, ["book_id", "id"])
    left = named.select("book_id", F.col("item").alias("id"), characters("text").alias("character"))
    return C.bag_difference(left, pairs.select("book_id", "id", characters("source_text").alias("character")), KEY, "character")


@query(
    "conservation_editions",
    """
WITH s AS (SELECT DISTINCT book_id, id, kind, text FROM segments), e AS (SELECT source_book_id AS book_a, book_id AS book_b FROM books WHERE source_book_id IS NOT NULL),
n AS (SELECT book_id, kind, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT DISTINCT e.book_a, e.book_b, n.kind FROM e JOIN n ON n.book_id IN (e.book_a, e.book_b))
SELECT k.book_a, k.book_b, k.kind, CAST(coalesce(a.n, 0) AS BIGINT) AS n_a, CAST(coalesce(b.n, 0) AS BIGINT) AS n_b, CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN 'fail' WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'warn' ELSE 'pass' END AS status
FROM k LEFT JOIN n a ON a.book_id = k.book_a AND a.kind = k.kind LEFT JOIN n b ON b.book_id = k.book_b AND b.kind = k.kind""",
)
def conservation_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each kind in a book and its edition."""
    editions = table(spark, sf_dir, "books").where(F.col("source_book_id").isNotNull()).select(F.col("source_book_id").alias("book_a"), F.col("book_id").alias("book_b"))
    counts = S.once(table(spark, sf_dir, "segments"), "book_id", "id", "kind").groupBy("book_id", "kind").agg(F.count("*").alias("n"))
    sides = [editions.join(counts.withColumnRenamed("book_id", side), side).select("book_a", "book_b", "kind", *[F.when(F.lit(side == s), F.col("n")).otherwise(0).alias(f"n_{s[-1]}") for s in ("book_a", "book_b")]) for side in ("book_a", "book_b")]
    both = sides[0].unionByName(sides[1]).groupBy("book_a", "book_b", "kind").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return both.withColumn("status", F.when(F.col("n_b") < F.col("n_a"), "fail").when(F.col("n_b") > F.col("n_a"), "warn").otherwise("pass"))


@query(
    "alignment_blocks",
    r"""
WITH s AS (SELECT book_id, id, string_split_regex(source_text, '\n(?:[ \t]*\n)+') AS a, string_split_regex(target_text, '\n(?:[ \t]*\n)+') AS b FROM alignment)
SELECT book_id, id, CAST(i AS INTEGER) AS part, sha256(trim(a[i])) AS source_sha, sha256(trim(b[i])) AS target_sha FROM s, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i) WHERE len(a) = len(b)
UNION ALL SELECT book_id, id, 0, sha256(trim(source_text)), sha256(trim(target_text)) FROM s JOIN alignment USING (book_id, id) WHERE len(a) <> len(b)""",
)
def alignment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a pair side by side when both have as many, else the pair as a whole, with hashes."""
    pairs = _pairs(spark, sf_dir).select("book_id", "id", F.split("source_text", "\\n(?:[ \\t]*\\n)+").alias("a"), F.split("target_text", "\\n(?:[ \\t]*\\n)+").alias("b"), "source_text", "target_text")
    same = F.size("a") == F.size("b")
    zipped = F.when(same, F.arrays_zip("a", "b")).otherwise(F.array(F.struct(F.col("source_text").alias("a"), F.col("target_text").alias("b"))))
    rows = pairs.select("book_id", "id", same.alias("same"), F.posexplode(zipped).alias("pos", "x"))
    return rows.select("book_id", "id", F.when(F.col("same"), F.col("pos") + 1).otherwise(0).alias("part"), F.sha2(F.trim("x.a"), 256).alias("source_sha"), F.sha2(F.trim("x.b"), 256).alias("target_sha"))


@query(
    "alignment_hashes",
    "SELECT book_id, id, sha256(trim(source_text)) = source_sha256 AS source_fits, sha256(trim(target_text)) = target_sha256 AS target_fits FROM alignment",
)
def alignment_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the recorded hashes of a pair fit its texts."""
    fits = lambda c: (F.sha2(F.trim(f"{c}_text"), 256) == F.col(f"{c}_sha256")).alias(f"{c}_fits")
    return _pairs(spark, sf_dir).select("book_id", "id", fits("source"), fits("target"))


@query(
    "alignment_rendered",
    r"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, id) AS r FROM alignment)
SELECT book_id, CAST(count(*) AS BIGINT) AS n_pairs, sha256(string_agg('::: {.source}' || chr(10) || trim(source_text) || chr(10) || ':::' || chr(10) || chr(10) || '::: {.target}' || chr(10) || trim(target_text) || chr(10) || ':::', chr(10) || chr(10) ORDER BY r)) AS body_sha
FROM p GROUP BY book_id""",
)
def alignment_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both languages in turn as one text a book; its hash stands for it here."""
    block = lambda side: F.concat(F.lit(f"::: {{.{side}}}\n"), F.trim(f"{side}_text"), F.lit("\n:::"))
    item = F.struct("ord", "id", F.concat(block("source"), F.lit("\n\n"), block("target")).alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), "\n\n")
    return _pairs(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n_pairs"), F.sha2(whole, 256).alias("body_sha"))
