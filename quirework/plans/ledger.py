"""Queries over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import ledger as L
from quirework.operators import structure as S
from quirework.plans.registry import query
from quirework.session import table

ONCE = "l AS (SELECT DISTINCT ON (seq) * FROM ledger)"
STATE = f"""{ONCE}, st AS (SELECT book_id, unit_id, max(seq) AS last_seq, arg_max(kind, seq) AS last_kind, arg_max(output_sha, seq) FILTER (output_sha IS NOT NULL) AS output_sha,
  arg_max(reason, seq) FILTER (reason IS NOT NULL) AS last_reason, count(*) FILTER (kind = 'dispatch') AS n_dispatched, count(*) FILTER (kind = 'record') AS n_recorded,
  count(*) FILTER (kind = 'accept') AS n_accepted, count(*) FILTER (kind = 'requeue') AS n_requeued FROM l GROUP BY book_id, unit_id)"""


@query("ledger_state", f"WITH {STATE} SELECT * FROM st")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.state(table(spark, sf_dir, "ledger"))


@query("ledger_counts", f"WITH {STATE} SELECT last_kind, CAST(count(*) AS BIGINT) AS n_units, CAST(sum(n_dispatched) AS BIGINT) AS n_dispatched FROM st GROUP BY last_kind")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by the kind of their last record."""
    return L.state(table(spark, sf_dir, "ledger")).groupBy("last_kind").agg(F.count("*").alias("n_units"), F.sum("n_dispatched").alias("n_dispatched"))


@query(
    "ledger_out_of_order",
    f"WITH {ONCE}, w AS (SELECT *, max(ts) OVER (PARTITION BY book_id, unit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM l) SELECT seq, book_id, unit_id, kind FROM w WHERE ts < latest",
)
def ledger_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.out_of_order(table(spark, sf_dir, "ledger"))


@query(
    "ledger_cycles",
    f"""WITH {ONCE}, c AS (SELECT *, sum(CASE WHEN kind = 'dispatch' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, unit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cycle FROM l)
SELECT book_id, unit_id, CAST(cycle AS BIGINT) AS cycle, count(*) AS n_records, min(seq) AS first_seq, max(seq) AS last_seq, bool_or(coalesce(kind = 'accept', false)) AS accepted FROM c GROUP BY ALL""",
)
def ledger_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cycles(table(spark, sf_dir, "ledger"))


@query(
    "ledger_orphans",
    """SELECT DISTINCT l.book_id, l.unit_id, 'no_unit' AS side FROM ledger l ANTI JOIN units u ON u.book_id = l.book_id AND u.unit_id = l.unit_id
UNION ALL SELECT u.book_id, u.unit_id, 'no_record' FROM units u ANTI JOIN ledger l ON u.book_id = l.book_id AND u.unit_id = l.unit_id""",
)
def ledger_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.orphans(table(spark, sf_dir, "ledger"), table(spark, sf_dir, "units"))


@query("ledger_orphan_cases", "SELECT * FROM (VALUES ('a', 'x', 'no_unit'), ('a', 'u2', 'no_record')) t(book_id, unit_id, side)")
def ledger_orphan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated ledger with records of no unit, and a unit without any."""
    schema = "book_id string, unit_id string"
    return L.orphans(spark.createDataFrame([("a", "u1"), ("a", "x"), ("a", "x")], schema), spark.createDataFrame([("a", "u1"), ("a", "u2")], schema))


@query(
    "ledger_stale",
    rf"""WITH {STATE}, t AS (SELECT DISTINCT book_id, id, text FROM segments), x AS (SELECT book_id, unit_id, source_hash, unnest(segment_ids) AS id, generate_subscripts(segment_ids, 1) AS pos FROM units),
h AS (SELECT x.book_id, x.unit_id, any_value(source_hash) AS source_hash, sha256(regexp_replace(string_agg(coalesce(t.text, ''), chr(10) || chr(10) ORDER BY pos), '\s+$', '') || chr(10)) AS now FROM x LEFT JOIN t USING (book_id, id) GROUP BY x.book_id, x.unit_id)
SELECT st.book_id, st.unit_id, st.last_kind FROM st JOIN h USING (book_id, unit_id) WHERE h.now IS DISTINCT FROM h.source_hash""",
)
def ledger_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with records whose source has changed since their hash was taken."""
    hashes = S.unit_hashes(table(spark, sf_dir, "units"), table(spark, sf_dir, "segments")).where(~F.col("fits"))
    return L.state(table(spark, sf_dir, "ledger")).join(hashes.select(*L.UNIT), L.UNIT).select(*L.UNIT, "last_kind")


@query(
    "ledger_reasons",
    "SELECT kind, coalesce(split_part(reason, ':', 1), 'none') AS reason, CAST(count(DISTINCT seq) AS BIGINT) AS n, CAST(count(DISTINCT (book_id, unit_id)) AS BIGINT) AS n_units FROM ledger GROUP BY ALL",
)
def ledger_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and units by kind and reason; each record once."""
    rows = table(spark, sf_dir, "ledger").dropDuplicates(["seq"]).withColumn("reason", F.coalesce(F.split_part("reason", F.lit(":"), F.lit(1)), F.lit("none")))
    by_unit = rows.groupBy("kind", "reason", *L.UNIT).agg(F.count("*").alias("n"))
    return by_unit.groupBy("kind", "reason").agg(F.sum("n").alias("n"), F.count("*").alias("n_units"))
