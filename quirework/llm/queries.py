"""The queries of the training-data operators, and SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bilingual, encoding, leakage, lookalike, markup, mixing, pii, scanned, splitting
from quirework.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.line_defects(table(spark, sf_dir, "segments"), table(spark, sf_dir, "books"))[0].select("book_id", "id", "line_no", "defect")


@_query
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair_scanned(table(spark, sf_dir, "segments"), table(spark, sf_dir, "books"))


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_segments(table(spark, sf_dir, "segments"), only_affected=True).where("affected").select("book_id", "id").distinct()


@_query
def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_segments(table(spark, sf_dir, "segments"), only_affected=True).distinct()


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "segments"), once=False)
    return pieces.where(F.col("n_pieces") > 1).select("book_id", "id").distinct()


@_query
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "segments"))


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = bilingual.align_books(table(spark, sf_dir, "segments"), table(spark, sf_dir, "books"), table(spark, sf_dir, "alignment"), glossary=table(spark, sf_dir, "glossary"))
    return pairs.where(F.col("book_a") < F.col("book_b")).select("book_a", "id_a", "sent_a", "book_b", "id_b", "sent_b").distinct()


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, sf_dir, "segments")).select("book_id", "id").distinct()


@_query
def p5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalise_segments(table(spark, sf_dir, "segments")).distinct()


@_query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_segments(table(spark, sf_dir, "segments"), only_found=True).select("book_id", "id").distinct()


@_query
def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = markup.clean_segments(table(spark, sf_dir, "segments"))
    return cleaned.withColumn("languages", F.array_join("languages", ",")).distinct()


@_query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


@_query
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("max_share"))


@_query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@_query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@_query
def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps its repeats, its share and its place in the order."""
    return mixing.bounds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@_query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find_mentions(documents, pii.session_key(spark), pii.known_names(documents)).select("doc_id", "start_at", "pii_kind").distinct()


@_query
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.redact_documents(documents, pii.session_key(spark), pii.known_names(documents)).distinct()


ORACLES["p8_bounds"] = "SELECT DISTINCT regexp_replace(trim(lower(source)), '[ _-]+', '_', 'g') AS source, true AS within_repeats, true AS within_share, true AS within_block FROM mix_targets"
ORACLES["p3_found"] = "SELECT DISTINCT book_id, id FROM segments WHERE length(text) > 9000"
