"""Queries over what units depend on and what is to be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import planning as P
from quirework.plans import fixtures as X
from quirework.plans import glossary as PG
from quirework.plans.registry import query
from quirework.session import table

NOW = {"source": "s", "book_node": "n", "glossary_selection": "g"}
#: unit, status, attempts, recorded hashes, draft now, draft recorded, edit now, edit recorded, draft it was made from; then queue, reasons, edit.
CASES = [
    (("kept", "completed", 1, NOW, "d", "d", "e", "e", "d"), ("none", "", False)),
    (("never begun", "pending", 0, None, None, None, None, None, None), ("translate", "missing_or_blank_draft", False)),
    (("not recorded", "pending", 0, None, "d", None, None, None, None), ("record", "existing_unrecorded_draft", True)),
    (("term changed", "completed", 1, NOW | {"glossary_selection": "old"}, "d", "d", "e", "e", "d"), ("translate", "dependency_changed:glossary_selection", False)),
    (("all changed", "completed", 1, {"source": "old"}, "d", "d", "e", "e", "d"), ("translate", "dependency_changed:book_node,dependency_changed:glossary_selection,dependency_changed:source", False)),
    (("written anew", "completed", 1, NOW, "new", "d", "e", "e", "d"), ("record", "draft_changed_unrecorded", True)),
    (("given up", "failed_terminal", 3, NOW, None, None, None, None, None), ("blocked", "attempt_limit_reached", False)),
    (("try again", "failed_retryable", 2, NOW, None, None, None, None, None), ("translate", "missing_or_blank_draft", False)),
    (("images only", "skipped_approved", 1, {"source": "s"}, "d", "d", "e", "e", "d"), ("none", "", False)),
    (("images only, changed", "skipped_approved", 1, {"source": "old"}, "d", "d", "e", "e", "d"), ("translate", "dependency_changed:book_node,dependency_changed:glossary_selection,dependency_changed:source", False)),
    (("edited by hand", "completed", 1, NOW, "d", "d", "x", "e", "d"), ("none", "", True)),
]
SCHEMA = "unit_id string, status string, attempts int, recorded map<string,string>, draft_sha string, recorded_draft string, edit_sha string, recorded_edit string, edit_input string"
WANTED = X.values("w", [(c[0][0], *c[1]) for c in CASES], "unit_id string, queue string, reasons string, edit boolean")


@query("planning_cases", f"WITH {WANTED} SELECT * FROM w")
def planning_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit for each decision."""
    now = F.create_map(*[F.lit(x) for pair in NOW.items() for x in pair])
    rows = X.frame(spark, [c[0] for c in CASES], SCHEMA).withColumn("current", now)
    return P.decisions(rows, edited=True).select("unit_id", "queue", F.array_join("reasons", ",").alias("reasons"), "edit")


UNIT_TEXTS = f"""t AS (SELECT book_id, id, min(text) AS text FROM segments WHERE text IS NOT NULL GROUP BY ALL),
x AS (SELECT book_id, unit_id, book_node_id, unnest(segment_ids) AS id, generate_subscripts(segment_ids, 1) AS pos FROM units),
u AS (SELECT x.book_id, x.unit_id, x.book_node_id, string_agg(coalesce(t.text, ''), chr(10) || chr(10) ORDER BY pos) AS body FROM x LEFT JOIN t USING (book_id, id) GROUP BY ALL),
{PG.NEEDLES}, d AS (SELECT book_id, unit_id, book_node_id, lower(body) AS text, {PG._doubled("lower(body)")} AS doubled FROM u),
m AS (SELECT DISTINCT d.book_id, d.unit_id, p.id FROM d, p JOIN glossary g ON g.id = p.id
  WHERE contains(d.text, CASE WHEN suffix(p.surface, 'y') THEN p.surface[:-2] ELSE p.surface END) AND {PG._hits("d.doubled", "d.text")} > 0 AND g.status = 'confirmed' AND {PG.IN_SCOPE.format(node="d.book_node_id")}),
h AS ({PG.HASHES}), c AS (SELECT book_id, unit_id, count(*) AS n, '{{' || string_agg('"' || id || '":"' || entry_hash || '"', ',' ORDER BY id) || '}}' AS json FROM m JOIN h USING (id) GROUP BY ALL)"""


@query("planning_selections", f"WITH {UNIT_TEXTS} SELECT u.book_id, u.unit_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_entries, sha256(coalesce(c.json, '{{}}')) AS selection_hash FROM u LEFT JOIN c USING (book_id, unit_id)")
def planning_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary entries each unit uses, by one hash."""
    return P.selections(P.unit_texts(table(spark, sf_dir, "units"), table(spark, sf_dir, "segments")), table(spark, sf_dir, "glossary"))


@query(
    "planning_alignment",
    r"""WITH t AS (SELECT book_id, id, min(text) AS text FROM segments WHERE text IS NOT NULL GROUP BY ALL),
x AS (SELECT book_id, unit_id, unnest(segment_ids) AS id, generate_subscripts(segment_ids, 1) AS pos FROM units),
s AS (SELECT x.book_id, x.unit_id, string_agg(coalesce(t.text, ''), chr(10) || chr(10) ORDER BY pos) AS text FROM x LEFT JOIN t USING (book_id, id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord, unit_id) - 1 AS rank FROM units),
g AS (SELECT book_id, unit_id, string_agg(target_text, chr(10) || chr(10) ORDER BY ord) AS text FROM alignment GROUP BY ALL)
SELECT r.book_id, 'align-' || lpad(CAST(rank + 1 AS VARCHAR), 4, '0') AS id, unit_id, sha256(regexp_replace(s.text, '^\s+|\s+$', '', 'g')) AS source_sha256, sha256(regexp_replace(g.text, '^\s+|\s+$', '', 'g')) AS target_sha256
FROM r JOIN s USING (book_id, unit_id) JOIN g USING (book_id, unit_id)""",
)
def planning_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with the confirmed paragraphs they have, as an alignment of whole units."""
    units, pairs = table(spark, sf_dir, "units"), table(spark, sf_dir, "alignment")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "target_text"))), lambda x: x["target_text"]), "\n\n")
    targets = pairs.groupBy(*P.UNIT).agg(body.alias("text"))  # the paragraphs of one unit
    found = P.alignment(units, P.unit_texts(units, table(spark, sf_dir, "segments")), targets)
    return found.select("book_id", "id", "unit_id", "source_sha256", "target_sha256")


@query("planning_dependencies")
def planning_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each unit depends on: source, node, glossary, the unit before."""
    found = P.dependencies(*(table(spark, sf_dir, t) for t in ("units", "segments", "nodes", "glossary")))
    return found.select(*P.UNIT, *[F.col("hashes")[k].alias(k) for k in ("source", "book_node", "glossary_selection", "incoming_capsule")])
