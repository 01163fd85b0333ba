"""Queries over the glossary and the texts its terms occur in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import glossary as G
from quirework.plans.registry import query
from quirework.session import table

SURFACES = "s AS (SELECT DISTINCT id, trim(lower(x)) AS surface FROM (SELECT id, unnest(list_concat([source], coalesce(aliases, []))) AS x FROM glossary) WHERE length(trim(lower(x))) > 0)"


def _doubled(text: str) -> str:
    """SQL: characters that end a word doubled, so that neighbouring words each have their own boundary."""
    return f"chr(1) || regexp_replace(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_ ]', chr(1) || chr(1), 'g'), ' ', '  ', 'g') || chr(1)"


def _hits(doubled: str, text: str) -> str:
    """SQL: how often a surface and its regular forms stand between boundaries, by lengths before and after removal."""
    forms = ["stem || 'y'", "stem || 'ies'"], ["needle", "needle || 's'", "needle || 'es'"]
    count = lambda n: f"(length({doubled}) - length(replace({doubled}, {n}, ''))) // length({n})"
    around = lambda f: " + ".join(count(f"{a} || {f} || {b}") for a in ("' '", "chr(1)") for b in ("' '", "chr(1)"))
    y, other = (" + ".join(around(f) for f in x) for x in forms)
    return f"CASE WHEN NOT latin THEN (length({text}) - length(replace({text}, surface, ''))) // length(surface) WHEN ends_y THEN {y} WHEN ends_letter THEN {other} ELSE {around('needle')} END"


NEEDLES = rf"""{SURFACES}, p AS (SELECT id, surface, regexp_matches(surface, '^[\x00-\x7f]*$') AND regexp_matches(surface, '[a-z0-9]') AS latin, regexp_matches(surface, '[^aeiou]y$') AS ends_y, regexp_matches(surface, '[a-z]$') AS ends_letter,
  {_doubled("surface")[len("chr(1) || ") : -len(" || chr(1)")]} AS needle, {_doubled("surface[:-2]")[len("chr(1) || ") : -len(" || chr(1)")]} AS stem FROM s)"""


@query("glossary_surfaces", f"WITH {SURFACES} SELECT id, surface FROM s")
def glossary_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.surfaces(table(spark, sf_dir, "glossary"))


@query("glossary_conflicts", f"WITH {SURFACES} SELECT surface, count(DISTINCT id) AS n_entries, min(id) AS first_id, max(id) AS last_id FROM s GROUP BY surface HAVING count(DISTINCT id) > 1")
def glossary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conflicts(table(spark, sf_dir, "glossary"))


@query(
    "glossary_overlay",
    f"""
WITH {SURFACES}, later AS (SELECT id FROM glossary WHERE coalesce(status, '') = 'pending'), base AS (SELECT id FROM glossary WHERE coalesce(status, '') <> 'pending'),
gone AS (SELECT id FROM s WHERE surface IN (SELECT surface FROM s WHERE id IN (SELECT id FROM later)) UNION SELECT id FROM later)
SELECT id FROM base WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id FROM later""",
)
def glossary_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending entries laid over the confirmed ones: the later library wins by id or shared surface."""
    glossary = table(spark, sf_dir, "glossary")
    pending = F.coalesce("status", F.lit("")) == "pending"
    return G.overlay(glossary.where(~pending), glossary.where(pending)).select("id")


@query(
    "glossary_matches",
    rf"""
WITH {NEEDLES},
t AS (SELECT DISTINCT book_id, id AS segment_id, text FROM segments WHERE text IS NOT NULL),
d AS (SELECT book_id, segment_id, lower(text) AS text, {_doubled("lower(text)")} AS doubled FROM t),
m AS (SELECT d.book_id, d.segment_id, p.id, {_hits("d.doubled", "d.text")} AS n
      FROM d, p WHERE contains(d.text, CASE WHEN suffix(p.surface, 'y') THEN p.surface[:-2] ELSE p.surface END))
SELECT book_id, segment_id, id, CAST(sum(n) AS BIGINT) AS n FROM m WHERE n > 0 GROUP BY ALL""",
)
def glossary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in segments, with the inflected forms of their last word."""
    segments = table(spark, sf_dir, "segments").where(F.col("text").isNotNull())
    return G.matches(segments.select("book_id", F.col("id").alias("segment_id"), "text"), table(spark, sf_dir, "glossary"), ["book_id", "segment_id"])


@query(
    "glossary_frequency",
    rf"""
WITH {NEEDLES},
d AS (SELECT doc_id, lower(text) AS text, {_doubled("lower(text)")} AS doubled FROM documents WHERE text IS NOT NULL),
m AS (SELECT p.id, d.doc_id, {_hits("d.doubled", "d.text")} AS n
      FROM d, p WHERE contains(d.text, CASE WHEN suffix(p.surface, 'y') THEN p.surface[:-2] ELSE p.surface END))
SELECT id, CAST(sum(n) AS BIGINT) AS frequency, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents FROM m WHERE n > 0 GROUP BY id""",
)
def glossary_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term occurs in the documents, and in how many."""
    documents = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    found = G.matches(documents, table(spark, sf_dir, "glossary"), ["doc_id"])
    return found.groupBy("id").agg(F.sum("n").alias("frequency"), F.count("*").alias("n_documents"))


IN_SCOPE = "(coalesce(len(g.scopes), 0) = 0 OR list_contains(g.scopes, 'book') OR coalesce(list_contains(g.scopes, {node}), false))"
ALONE = r"""CASE WHEN regexp_matches(g.target, '^[\x00-\x7f]*$') AND regexp_matches(g.target, '[A-Za-z0-9]') THEN regexp_matches(i.target_text, '(^|[^\p{{L}}\p{{N}}_])' ||
  CASE WHEN regexp_matches(g.target, '[^aeiouAEIOU][yY]$') THEN regexp_escape(g.target[:-2]) || '(y|ies|y[''’]s)' WHEN regexp_matches(g.target, '[A-Za-z]$') THEN regexp_escape(g.target) || '(s|es|[''’]s)?' ELSE regexp_escape(g.target) END
  || '([^\p{{L}}\p{{N}}_]|$)') ELSE contains(i.target_text, g.target) END""".replace("{{", "{").replace("}}", "}")
ITEMS = rf"""{NEEDLES},
d AS (SELECT book_id, id AS item_id, book_node_id, lower(source_text) AS text, {_doubled("lower(source_text)")} AS doubled FROM alignment),
m AS (SELECT DISTINCT d.book_id, d.item_id, p.id FROM d, p JOIN glossary g ON g.id = p.id
      WHERE contains(d.text, CASE WHEN suffix(p.surface, 'y') THEN p.surface[:-2] ELSE p.surface END) AND {_hits("d.doubled", "d.text")} > 0 AND g.status = 'confirmed' AND {IN_SCOPE.format(node="d.book_node_id")})"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alignment").select("book_id", F.col("id").alias("item_id"), "book_node_id", "source_text", "target_text")


@query("glossary_selected", rf"WITH {ITEMS} SELECT book_id, item_id, id FROM m")
def glossary_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed entries in scope that a source paragraph uses."""
    return G.selected(_items(spark, sf_dir), table(spark, sf_dir, "glossary"), ["book_id", "item_id"], "book_node_id", "source_text").drop("n")


@query(
    "glossary_missing_targets",
    rf"""
WITH {ITEMS}
SELECT m.book_id, m.item_id, m.id FROM m JOIN alignment i ON i.book_id = m.book_id AND i.id = m.item_id JOIN glossary g ON g.id = m.id
WHERE g.target IS NOT NULL AND (regexp_matches(i.target_text, '\p{{Han}}') = (lower(g.target_lang) LIKE 'zh%')) AND NOT ({ALONE})""",
)
def glossary_missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed terms of a source paragraph whose target the aligned paragraph lacks; a Latin target must stand as a word of its own, in its own case."""
    items, glossary = _items(spark, sf_dir), table(spark, sf_dir, "glossary")
    found = G.selected(items, glossary, ["book_id", "item_id"], "book_node_id", "source_text")
    found = found.join(glossary.where(F.col("target").isNotNull()).select("id", "target", "target_lang"), "id").join(items.select("book_id", "item_id", "target_text"), ["book_id", "item_id"])
    same = F.col("target_text").rlike("\\p{IsHan}") == F.lower("target_lang").like("zh%")
    return found.where(same & ~G.target_present(F.col("target_text"), F.col("target"))).select("book_id", "item_id", "id")


HASHES = r"""
SELECT id, sha256('{"aliases":' || coalesce(CAST(to_json(aliases) AS VARCHAR), 'null') || ',"category":' || coalesce(CAST(to_json(category) AS VARCHAR), 'null') || ',"domain":' || coalesce(CAST(to_json(domain) AS VARCHAR), 'null')
  || ',"grammatical":null,"scopes":' || coalesce(CAST(to_json(scopes) AS VARCHAR), 'null') || ',"source":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || ',"status":' || coalesce(CAST(to_json(status) AS VARCHAR), 'null')
  || ',"target":' || coalesce(CAST(to_json(target) AS VARCHAR), 'null') || '}') AS entry_hash FROM glossary"""


@query("glossary_hashes", HASHES)
def glossary_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of what an entry means; notes and confidence don't count."""
    glossary = table(spark, sf_dir, "glossary")
    return glossary.select("id", G.entry_hash(glossary).alias("entry_hash"))


@query(
    "glossary_review",
    r"""
SELECT id, '| ' || id || ' | ' || replace(coalesce(source, ''), '|', '\|') || ' | ' || replace(coalesce(target, ''), '|', '\|') || ' | ' || coalesce(category, '') || ' | ' || coalesce(status, '') || ' | ' || coalesce(confidence, '') || ' |' AS line
FROM glossary""",
)
def glossary_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary as lines of a review table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    cells = [F.lit("|"), F.col("id"), *[x for c in ("source", "target", "category", "status", "confidence") for x in (F.lit("|"), cell(c))], F.lit("|")]
    return table(spark, sf_dir, "glossary").select("id", F.concat_ws(" ", *cells).alias("line"))
