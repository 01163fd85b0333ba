"""Whether a target text keeps what its source has: numbers, length, sentences, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import numbers as N
from quirework.functions import text as T

# Limits of the length and copy checks, and what a finding costs.
LEAST_WEIGHT, FAIL_BELOW, WARN_BELOW, WARN_ABOVE = 40, 0.5, 0.7, 2.0
LEAST_PIECE, COPIED_FAIL = 6, 0.5
FAIL_COST, WARN_COST = 20, 2


def bag_difference(left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """What either side has more of, with multiplicity: ``key, item, side, n``.

    The same as a bag difference both ways, in one shuffle on the key and item,
    with partial sums before it.
    """
    both = left.select(*key, item, F.lit(1).alias("n")).unionByName(right.select(*key, item, F.lit(-1).alias("n")))
    sums = both.groupBy(*key, item).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    return sums.select(*key, item, F.when(F.col("n") > 0, "source").otherwise("target").alias("side"), F.abs("n").alias("n"))


def number_difference(pairs: DataFrame, key: list[str], tokens=N.core_tokens) -> DataFrame:
    """Numbers of the source that the target lacks, and the other way round."""
    left = pairs.select(*key, F.explode(tokens(F.col("source_text"))).alias("token"))
    right = pairs.select(*key, F.explode(tokens(F.col("target_text"))).alias("token"))
    return bag_difference(left, right, key, "token")


def length_status(source: Column, target: Column) -> Column:
    """Status of a target's length against its source's, null where all is well or the source is short."""
    ratio = target / source
    judged = F.when(ratio < FAIL_BELOW, "fail").when((ratio < WARN_BELOW) | (ratio > WARN_ABOVE), "warn")
    return F.when(source >= LEAST_WEIGHT, judged)


def weights(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Sizes of both texts in words, and the length status."""
    source, target = T.prose_weight(F.col("source_text")), T.prose_weight(F.col("target_text"))
    out = pairs.select(*key, F.round(source, 6).alias("source_weight"), F.round(target, 6).alias("target_weight"))
    return out.withColumn("status", length_status(F.col("source_weight"), F.col("target_weight")))


def copied(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Sentences of the source that stand unchanged in the target, and their share of it."""
    flat = F.trim(F.regexp_replace("target_text", "\\s+", " "))
    rows = pairs.select(*key, F.explode(T.sentence_pieces(F.col("source_text"))).alias("piece"), flat.alias("flat"), F.round(T.prose_weight(F.col("target_text")), 6).alias("target_weight"))
    rows = rows.withColumn("weight", F.round(T.prose_weight(F.col("piece")), 6)).where((F.col("weight") >= LEAST_PIECE) & F.contains("flat", "piece") & (F.col("target_weight") > 0))
    sums = rows.groupBy(*key).agg(F.count("*").alias("n_copied"), F.round(F.least(F.lit(1.0), F.sum("weight") / F.first("target_weight")), 6).alias("share"))
    return sums.withColumn("status", F.when(F.col("share") >= COPIED_FAIL, "fail").otherwise("warn"))


def spelled_elsewhere(spark: SparkSession, difference: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Whether each small number that only one side has is written in words on the other."""
    other = pairs.select(*key, F.lower("source_text").alias("s"), F.lower("target_text").alias("t"))
    small = difference.where(N.is_small(F.col("token"))).join(other, key)
    text = F.when(F.col("side") == "source", F.col("t")).otherwise(F.col("s"))
    forms = N.spelled_table(spark).withColumnRenamed("value", "_value")
    joined = small.withColumn("text", text).withColumn("_value", F.col("token").cast("int")).join(F.broadcast(forms), "_value")  # the words of 100 numbers
    padded = F.concat(F.lit(" "), F.regexp_replace("text", "[^a-z-]+", " "), F.lit(" "))
    found = F.when(F.col("latin"), F.contains(padded, F.concat(F.lit(" "), F.col("form"), F.lit(" ")))).otherwise(F.contains("text", "form"))
    return joined.groupBy(*key, "token", "side").agg(F.bool_or(found).alias("spelled"))


def moved_next_door(difference: DataFrame, pairs: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Numbers missing here that the text before or after has too many of.

    Neighbours are found by an equi-join on the position plus or minus one.
    """
    placed = difference.join(pairs.select(group, key, order), [group, key])
    near = placed.select(group, F.explode(F.array(F.col(order) - 1, F.col(order) + 1)).alias(order), "token", F.when(F.col("side") == "source", "target").otherwise("source").alias("side"), F.col("n").alias("surplus"))
    near = near.groupBy(group, order, "token", "side").agg(F.sum("surplus").alias("surplus"))
    out = placed.join(near, [group, order, "token", "side"], "left")
    return out.select(group, key, "token", "side", "n", F.coalesce(F.col("surplus") >= F.col("n"), F.lit(False)).alias("moved"))


def overlap(pages: DataFrame, units: DataFrame, group: str, page: str, unit: str, order: str, least: float = 0.12, relative: float = 0.55, most: int = 4) -> DataFrame:
    """Units that a page shows, by shared tokens: those near the best score, the first few in unit order.

    Both sides are token rows; scores come from an equi-join on the token within
    a group, the smaller of two counts summed.
    """
    a = pages.groupBy(group, page, "token").agg(F.count("*").alias("a"))
    b = units.groupBy(group, unit, order, "token").agg(F.count("*").alias("b"))
    total_a = a.groupBy(group, page).agg(F.sum("a").alias("total_a"))
    total_b = b.groupBy(group, unit).agg(F.sum("b").alias("total_b"))
    shared = a.join(b, [group, "token"]).groupBy(group, page, unit, order).agg(F.sum(F.least("a", "b")).alias("shared"))
    scored = shared.join(total_a, [group, page]).join(total_b, [group, unit])
    scored = scored.withColumn("score", F.round(F.col("shared") / F.greatest(F.lit(1), F.least("total_a", "total_b")), 6))
    best = F.expr(f"max(score) over (partition by {group}, {page})")
    kept = scored.withColumn("best", best).where((F.col("score") >= least) & (F.col("score") >= F.col("best") * relative))
    place = F.expr(f"row_number() over (partition by {group}, {page} order by {order}, {unit})")
    return kept.withColumn("place", place).where(F.col("place") <= most).select(group, page, unit, "score", F.col("place").cast("int").alias("place"))


def score(checks: DataFrame, key: list[str]) -> DataFrame:
    """100 less what the findings cost, never below 0."""
    fails, warns = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    return checks.groupBy(*key).agg(fails.alias("n_fail"), warns.alias("n_warn"), F.greatest(F.lit(0), 100 - fails * FAIL_COST - warns * WARN_COST).alias("score"))
