"""The ledger as a stream: the same state as the batch fold, whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.operators.ledger import UNIT, state_columns

SCHEMA = "seq bigint, book_id string, unit_id string, kind string, output_sha string, reason string, ts timestamp"


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder that workers append parquet files to."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def state(records: DataFrame, delay: str | None = None) -> DataFrame:
    """The running state of each unit; a record delivered again changes nothing.

    Order is by sequence number, never by time. Without ``delay`` the keys of
    all records are kept, so a repeat is known however late it comes; with it
    (``"7 days"``) only those of that time, so what is kept is one row a unit
    and the keys of the delay, and a repeat later than that is counted again.
    """
    once = records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"]) if delay else records.dropDuplicates(["seq"])
    return once.groupBy(*UNIT).agg(*state_columns())


def write(current: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add the units that each batch changed to ``path`` as a version of its own, until no files are left.

    A version is written whole or not at all, and once however often its batch
    is tried, so readers (``latest``) never see half a state.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return current.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each unit among all versions."""
    versions = spark.read.parquet(path)
    names = [c for c in versions.columns if c not in (*UNIT, "version")]
    newest = versions.groupBy(*UNIT).agg(F.max_by(F.struct(*names), "version").alias("s"))
    return newest.select(*UNIT, *[F.col("s")[c].alias(c) for c in names])
