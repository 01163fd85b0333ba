"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer. A source's quota is its share of the
largest total that every source with records can serve within its repeats; the
records of a source follow one another in a hashed order, pass after pass, until
the quota is filled. The order of the mixture is a Pfair schedule: block i of a
source of weight w is released at floor(i/w) and due at ceil((i+1)/w), and the
released block that is due first comes next, so at any point a source is less
than one block away from its share.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.arrow import map_batches
from quirework.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blocks the whole mixture is scheduled in, and records in a bucket of the prefix sums.
SLOTS, BUCKET_ROWS = 4096, 50_000
#: A table of targets is a stated parameter; a longer one than this is refused.
MOST_SOURCES = 10_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(column: Column) -> Column:
    """One spelling of a source: small letters, words joined by underscores."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(column.cast("string"))), "[\\s_-]+", "_"), F.lit(""))


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document with a source and a text, sources in one spelling.

    ``path`` is the tokenizer's vocabulary at the driver, which sends it to the executors.
    """

    context = documents.sparkSession.sparkContext
    if path not in context.listFiles and not any(x.endswith("/" + os.path.basename(path)) for x in context.listFiles):
        context.addFile(path)  # the driver serves it to the executors

    def run(batch: pa.RecordBatch) -> dict:
        encode = _encoding(SparkFiles.get(os.path.basename(path))).encode_ordinary
        return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "n_tokens": pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0))
    return map_batches(rows, ["doc_id", "source", "text"], run, "doc_id bigint, source string, n_tokens bigint")


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of all blocks: (source, number) by slot."""
    total = sum(blocks.values())
    waiting, ready, out = [], [], []
    for s, n in sorted(blocks.items()):
        if n > 0:
            heapq.heappush(waiting, (0, -(-total // n), s, 0))
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        n = blocks[s]
        if i + 1 < n:
            heapq.heappush(waiting, ((i + 1) * total // n, -(-(i + 2) * total // n), s, i + 1))
    return out


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = (
        mix_targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("most"))
        .where(F.col("source").isNotNull() & (F.col("share") > 0) & (F.col("most") > 0))
        .distinct()
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.min("most").alias("most"))
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the table of targets")
    return {r.source: (r.share, r.most) for r in rows}


def mix_sources(
    documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, slots: int = SLOTS, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(records, shares): the records of the mixture with their repeats and order, and what each source reached.

    Needs ``doc_id, text, source`` and ``source, target_share, max_repeats``;
    other columns are ignored. Without ``total_tokens`` the total is the largest
    at which every target source that has records gets exactly its share
    (relative to the sources that have any) within its repeats; with it, a
    source that can't serve its share serves what it can and the report says so.
    Null or empty text, a null source and sources without a target are not used;
    a document delivered twice is one record; a target without records reaches
    0; spellings that differ in case, spaces, hyphens or underscores are one
    source; several targets of one source add up and the least ``max_repeats``
    holds. Empty tables give empty records and a report of zeros.

    ``records``: doc_id, source, copy_no (from 1), n_tokens, slot, position.
    Sorting by (slot, source, position) gives the mixture.
    """
    spark = documents.sparkSession
    targets = _targets(mix_targets)
    # one row a document; the texts themselves are never shuffled
    sizes = count_tokens(documents.where(source_name(F.col("source")).isin(list(targets) or [""])), tokenizer).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    sizes = cut(sizes.where(F.col("n_tokens") > 0))
    have = {r.source: (r.tokens, r.records) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records")).collect()}
    present = {s: w for s, (w, _) in targets.items() if s in have}
    whole = sum(Fraction(w) for w in present.values())
    share = {s: Fraction(w) / whole for s, w in present.items()} if whole else {}
    capacity = {s: have[s][0] * targets[s][1] for s in present}
    if total_tokens is None:
        total = min((Fraction(capacity[s]) / share[s] for s in present), default=Fraction(0))
    else:
        total = Fraction(total_tokens)
    quota = {s: min(Fraction(capacity[s]), share[s] * total) for s in present}
    block = max(1, math.ceil(sum(quota.values(), Fraction(0)) / slots))
    plan = [
        (s, float(targets[s][0]), targets[s][1], have[s][0], int(quota[s] // have[s][0]), float(quota[s] % have[s][0]), min(20, math.ceil(math.log2(max(1, have[s][1] / BUCKET_ROWS))))) for s in present
    ]
    plan_schema = "source string, target_share double, max_repeats int, source_tokens bigint, passes int, rest double, bits int"
    plans = F.broadcast(spark.createDataFrame(plan, plan_schema))  # a row a target source, at most MOST_SOURCES

    # Prefix sums in a hashed order: sums of buckets first, then within each bucket.
    keyed = sizes.join(plans, "source").withColumn("hash", F.xxhash64("doc_id", F.lit("mix"))).withColumn("bucket", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned("hash", 44) % F.pow(F.lit(2), F.col("bits")).cast("long")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).select("source", "bucket", "base")
    within = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(sums, ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = cut(placed)
    # The last pass takes what fits before the quota, and one record more: that which fills the remainder best.
    fits = F.col("start") + F.col("n_tokens") <= F.col("rest")
    lacking = placed.groupBy("source").agg((F.max("rest") - F.coalesce(F.sum(F.when(fits, F.col("n_tokens"))), F.lit(0))).alias("lack"))
    error = F.abs(F.col("lack") - F.col("n_tokens"))
    extra = placed.where(~fits & (F.col("passes") < F.col("max_repeats"))).join(F.broadcast(lacking), "source").where(error < F.col("lack"))
    extra = extra.groupBy("source").agg(F.min_by("doc_id", F.struct(error, "hash", "doc_id")).alias("extra_id"))
    placed = placed.join(F.broadcast(extra), "source", "left")
    copies = F.least(F.col("max_repeats"), F.col("passes") + F.when(fits | (F.col("doc_id") == F.col("extra_id")), 1).otherwise(0))
    chosen = placed.withColumn("copies", copies).where(F.col("copies") > 0)
    chosen = chosen.select("doc_id", "source", "n_tokens", "source_tokens", "start", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    chosen = chosen.withColumn("position", (F.col("copy_no") - 1) * F.col("source_tokens") + F.col("start"))

    blocks = {s: max(1, math.ceil(quota[s] / block)) for s in present if quota[s] > 0}
    order = [(s, i, slot) for slot, (s, i) in enumerate(pfair(blocks))]
    schedule = F.broadcast(spark.createDataFrame(order, "source string, block bigint, slot bigint"))  # about `slots` rows
    last = F.broadcast(spark.createDataFrame(list(blocks.items()), "source string, n_blocks bigint"))
    records = (
        chosen.join(last, "source")
        .withColumn("block", F.least(F.floor(F.col("position") / block), F.col("n_blocks") - 1))
        .join(schedule, ["source", "block"])
        .select("doc_id", "source", F.col("copy_no").cast("int").alias("copy_no"), "n_tokens", "slot", "position")
    )
    reached = records.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("records"), F.max("copy_no").alias("most_copies"))
    asked = spark.createDataFrame([(s, float(w), m) for s, (w, m) in targets.items()], "source string, target_share double, max_repeats int")
    shares = (
        asked.join(reached, "source", "left")
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
        .withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0)), F.lit(0.0)))
    )
    return records, shares


def bounds(documents: DataFrame, mix_targets: DataFrame, slots: int = SLOTS, **options) -> DataFrame:
    """``source, within_repeats, within_share, within_block``: whether the mixture keeps what it promises.

    No record is used more often than allowed; a source with records misses its
    share by no more than its largest record for each source of the mixture (any
    may miss its own quota by one); and at no slot is what a source has
    had so far further from its even share than a block and a record on either
    end. Records are whole, so no mixture can promise more.
    """
    records, shares = mix_sources(documents, mix_targets, slots=slots, **options)
    spark = documents.sparkSession
    sums = records.groupBy("source", "slot").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest")).collect()  # a row a slot, at most ``slots`` and one a source
    total, largest = Counter(), Counter()
    for r in sums:
        total[r.source] += r.tokens
        largest[r.source] = max(largest[r.source], r.largest)
    whole, last = sum(total.values()), max((r.slot for r in sums), default=0) + 1
    block = -(-whole // slots)
    seen, even = Counter(), dict.fromkeys(total, True)
    for r in sorted(sums, key=lambda r: r.slot):
        # before and after its own blocks a source is furthest from its share
        for t, had in ((r.slot, seen[r.source]), (r.slot + 1, seen[r.source] + r.tokens)):
            even[r.source] &= abs(Fraction(total[r.source] * t, last) - had) <= 2 * (block + largest[r.source])
        seen[r.source] += r.tokens
    kept = spark.createDataFrame([(s, even[s], largest[s]) for s in total], "source string, within_block boolean, largest bigint")
    present = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / present).otherwise(0.0)
    out = shares.join(kept, "source", "left").withColumn("within_share", F.abs(F.col("reached_share") - wanted) * whole <= F.coalesce("largest", F.lit(0)) * len(total))
    return out.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), "within_share", F.coalesce("within_block", F.lit(True)).alias("within_block"))


def mixture(spark: SparkSession, documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    """The records of the mixture, each with the target share and the share its source reached."""
    records, shares = mix_sources(documents, mix_targets, **options)
    return records.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")


__all__ = ["bounds", "count_tokens", "mix_sources", "mixture", "pfair", "source_name"]
