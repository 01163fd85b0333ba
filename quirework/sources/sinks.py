"""Writers: JSON lines, manifests, reports and merged Markdown. The commit protocol makes each folder appear at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators import structure as S


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as JSON lines, each once; null fields are written."""
    columns = [c for c in segments.columns if c != "ingested_at"]
    segments.select(*columns).distinct().write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def manifest(units: DataFrame, segments: DataFrame) -> DataFrame:
    """One entry a unit with the hash of its source now and the files derived from its key."""
    rows = S.unit_hashes(units, segments).join(units.select("book_id", "unit_id", "ord", "book_node_id"), ["book_id", "unit_id"])
    file = lambda folder: F.format_string(f"{folder}/%s.md", F.col("unit_id"))
    return rows.select("book_id", "unit_id", "ord", "book_node_id", F.col("current_hash").alias("source_hash"), file("source").alias("source_file"), file("draft").alias("draft_file"), file("edit").alias("edit_file"))


def merged(units: DataFrame, segments: DataFrame) -> DataFrame:
    """``book_id, unit_id, text``: the text of each unit."""
    ids = units.select("book_id", "unit_id", F.posexplode("segment_ids").alias("pos", "id"))
    texts = S.once(segments, "book_id", "id", "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return ids.join(texts, ["book_id", "id"], "left").groupBy("book_id", "unit_id").agg(F.concat(F.regexp_replace(F.array_join(ordered, "\n\n"), "\\s+$", ""), F.lit("\n")).alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts as files in a folder for each book."""
    texts.select("book_id", "text").write.mode("overwrite").partitionBy("book_id").text(path)


def report_lines(checks: DataFrame) -> DataFrame:
    """Checks as lines of a Markdown table; pipes in messages become slashes."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    return checks.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in checks.columns]), F.lit(" |")).alias("line"))


#: Comments that mark the notice, so that it is inserted once.
NOTICE_MARK = "<!-- notice -->"


def insert_notice(text: Column, notice: Column) -> Column:
    """``text`` with a notice after its title line, or before everything if it has none; never twice."""
    block = F.concat(F.lit(NOTICE_MARK + "\n"), notice, F.lit("\n"))
    titled = text.rlike("^\\s*# [^\\n]*")
    after = F.regexp_replace(text, "^(\\s*# [^\\n]*\\n?)", "")
    title = F.regexp_extract(text, "^(\\s*# [^\\n]*)", 1)
    placed = F.when(titled, F.concat(title, F.lit("\n\n"), block, F.lit("\n"), F.regexp_replace(after, "^\\n+", ""))).otherwise(F.concat(block, F.lit("\n"), text))
    return F.when(F.contains(text, F.lit(NOTICE_MARK)), text).otherwise(placed)
