"""The append-only ledger of results: its current state and its faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNIT = ["book_id", "unit_id"]


def state_columns() -> list:
    """Aggregates that fold a unit's records, whatever their order of arrival: the greatest ``seq`` is the last."""
    last = lambda c, test=None: F.max_by(c, F.when(test, F.col("seq")) if test is not None else F.col("seq"))
    return [
        F.max("seq").alias("last_seq"),
        last("kind").alias("last_kind"),
        last("output_sha", F.col("output_sha").isNotNull()).alias("output_sha"),
        last("reason", F.col("reason").isNotNull()).alias("last_reason"),
        F.count_if(F.col("kind") == "dispatch").alias("n_dispatched"),
        F.count_if(F.col("kind") == "record").alias("n_recorded"),
        F.count_if(F.col("kind") == "accept").alias("n_accepted"),
        F.count_if(F.col("kind") == "requeue").alias("n_requeued"),
    ]


def state(ledger: DataFrame) -> DataFrame:
    """The state of each unit. Records delivered twice count once; time stamps are not trusted for order."""
    return ledger.dropDuplicates(["seq"]).groupBy(*UNIT).agg(*state_columns())


def out_of_order(ledger: DataFrame) -> DataFrame:
    """Records older than one before them in sequence."""
    before = Window.partitionBy(*UNIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = ledger.dropDuplicates(["seq"]).withColumn("latest", F.max("ts").over(before))
    return rows.where(F.col("ts") < F.col("latest")).select("seq", *UNIT, "kind")


def cycles(ledger: DataFrame) -> DataFrame:
    """Rounds of work on a unit: each dispatch begins one, and the records up to the next belong to it."""
    order = Window.partitionBy(*UNIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.dropDuplicates(["seq"]).withColumn("cycle", F.sum((F.col("kind") == "dispatch").cast("int")).over(order))
    done = F.count_if(F.col("kind") == "accept") > 0
    return rows.groupBy(*UNIT, "cycle").agg(F.count("*").alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), done.alias("accepted"))


def orphans(ledger: DataFrame, units: DataFrame) -> DataFrame:
    """Records of units that don't exist, and units without a record."""
    extra = ledger.join(units, UNIT, "left_anti").select(*UNIT).distinct().withColumn("side", F.lit("no_unit"))
    return extra.unionByName(units.join(ledger, UNIT, "left_anti").select(*UNIT).withColumn("side", F.lit("no_record")))
