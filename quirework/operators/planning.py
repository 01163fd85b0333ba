"""What a unit's result depends on, what of it has changed, and what is to be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators import glossary as G
from quirework.operators import structure as S

UNIT = ["book_id", "unit_id"]
HASHES = "map<string,string>"


def unit_texts(units: DataFrame, segments: DataFrame) -> DataFrame:
    """``book_id, unit_id, book_node_id, text``: the segments of each unit in order."""
    ids = units.select(*UNIT, "book_node_id", F.posexplode("segment_ids").alias("pos", "id"))
    texts = segments.where(F.col("text").isNotNull()).select("book_id", "id", "text")
    first = texts.groupBy("book_id", "id").agg(F.min("text").alias("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    return ids.join(first, ["book_id", "id"], "left").groupBy(*UNIT, "book_node_id").agg(body.alias("text"))


def selections(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``book_id, unit_id, n_entries, selection_hash``: the confirmed entries in scope that a unit uses, by what they mean."""
    used = G.selected(texts, glossary, UNIT, "book_node_id").join(glossary.select("id", G.entry_hash(glossary).alias("hash")), "id")
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("id", "hash"))), lambda x: F.concat(F.lit('"'), x["id"], F.lit('":"'), x["hash"], F.lit('"')))
    found = used.groupBy(*UNIT).agg(F.count("*").alias("n_entries"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("json"))
    rows = texts.select(*UNIT).join(found, UNIT, "left")
    return rows.select(*UNIT, F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), F.sha2(F.coalesce("json", F.lit("{}")), 256).alias("selection_hash"))


def dependencies(units: DataFrame, segments: DataFrame, nodes: DataFrame, glossary: DataFrame, capsules: DataFrame | None = None, stated: dict[str, str] | None = None) -> DataFrame:
    """``book_id, unit_id, hashes``: a hash of everything a unit's result depends on.

    Source, node, chosen glossary entries and what the unit before hands over
    (its capsule, ``book_id, unit_id, sha``; ``missing`` without one, ``root``
    for the first unit), and the ``stated`` hashes of settings that hold for all.
    """
    sources = S.unit_hashes(units, segments).select(*UNIT, F.col("current_hash").alias("source"))
    meaning = F.sha2(F.to_json(F.struct("children", "id", "kind", "ord", "segment_ids", "status", "title"), {"ignoreNullFields": "false"}), 256)
    node = nodes.select("book_id", F.col("id").alias("book_node_id"), meaning.alias("book_node"))
    chosen = selections(unit_texts(units, segments), glossary).select(*UNIT, F.col("selection_hash").alias("glossary_selection"))
    keyed = units.select(*UNIT, "book_node_id", F.coalesce("ord", F.lit(2147483647)).alias("place"))
    ranked = S.running_rank(keyed, ["book_id"], "place", ["unit_id"], "rank")
    handed = ranked.select("book_id", "unit_id", (F.col("rank") + 1).alias("rank"))
    handed = handed.join(capsules.select(*UNIT, "sha"), UNIT, "left").withColumn("sha", F.coalesce("sha", F.lit("missing"))) if capsules is not None else handed.withColumn("sha", F.lit("missing"))
    rows = ranked.join(handed.select("book_id", "rank", "sha"), ["book_id", "rank"], "left").join(sources, UNIT, "left").join(node, ["book_id", "book_node_id"], "left").join(chosen, UNIT, "left")
    pairs = [("source", F.col("source")), ("book_node", F.coalesce("book_node", F.lit("none"))), ("glossary_selection", F.col("glossary_selection")), ("incoming_capsule", F.coalesce("sha", F.lit("root")))]
    pairs += [(k, F.lit(v)) for k, v in sorted((stated or {}).items())]
    return rows.select(*UNIT, F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).cast(HASHES).alias("hashes"))


def alignment(units: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Units with a source and a target text (``book_id, unit_id, text``), numbered in the book's order, with hashes of both."""
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    keyed = units.select(*UNIT, "book_node_id", "segment_ids", F.coalesce("ord", F.lit(2147483647)).alias("place"))
    ranked = S.running_rank(keyed, ["book_id"], "place", ["unit_id"], "rank")
    both = ranked.join(sources.select(*UNIT, bare(F.col("text")).alias("source_text")), UNIT).join(targets.select(*UNIT, bare(F.col("text")).alias("target_text")), UNIT)
    hashes = [F.sha2(f"{s}_text", 256).alias(f"{s}_sha256") for s in ("source", "target")]
    return both.select("book_id", F.format_string("align-%04d", F.col("rank") + 1).alias("id"), F.col("rank").alias("ord"), "unit_id", "book_node_id", F.col("segment_ids").alias("source_segment_ids"), "source_text", "target_text", *hashes)


def changed(current: Column, recorded: Column) -> Column:
    """Keys of the current hashes that the recorded ones lack or have otherwise, in order."""
    return F.sort_array(F.filter(F.map_keys(current), lambda k: ~F.element_at(current, k).eqNullSafe(F.element_at(F.coalesce(recorded, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k))))


def decisions(records: DataFrame, most_attempts: int = 3, edited: bool = False) -> DataFrame:
    """What to do with each unit: ``queue`` (blocked, translate, record or none), its ``reasons``, and whether to ``edit``.

    ``status, attempts, current, recorded`` (maps of hashes), ``draft_sha`` now
    and ``recorded_draft``; of edited results ``edit_sha, recorded_edit,
    edit_input``. The first rule that fits decides.
    """
    differs = changed(F.col("current"), F.col("recorded"))
    failed = (F.col("attempts") >= most_attempts) & F.col("status").isin("failed_retryable", "failed_terminal")
    verbatim = (F.col("status") == "skipped_approved") & (F.col("recorded")["source"] == F.col("current")["source"]) & (F.col("recorded_draft") == F.col("draft_sha"))
    none = F.array().cast("array<string>")
    rules = [
        (failed, "blocked", F.array(F.lit("attempt_limit_reached"))),
        (F.col("draft_sha").isNull(), "translate", F.array(F.lit("missing_or_blank_draft"))),
        (F.col("recorded_draft").isNull(), "record", F.array(F.lit("existing_unrecorded_draft"))),
        (F.coalesce(verbatim, F.lit(False)), "none", none),
        (F.size(differs) > 0, "translate", F.transform(differs, lambda k: F.concat(F.lit("dependency_changed:"), k))),
        (F.col("recorded_draft") != F.col("draft_sha"), "record", F.array(F.lit("draft_changed_unrecorded"))),
    ]
    queue, reasons = F.lit("none"), none
    for test, name, why in reversed(rules):
        queue, reasons = F.when(test, name).otherwise(queue), F.when(test, why).otherwise(reasons)
    stale = F.col("edit_sha").isNull() | ~F.col("recorded_edit").eqNullSafe(F.col("edit_sha")) | ~F.col("edit_input").eqNullSafe(F.col("draft_sha"))
    again = F.col("draft_sha").isNotNull() & stale if edited else F.lit(False)
    return records.withColumns({"queue": queue, "reasons": reasons, "edit": again})
