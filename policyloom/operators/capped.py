"""Batches under several running caps, published whole or not at all, and one cap that goes over ordered sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered, running_sums


def capped(rows: DataFrame, batch: str, order: list[str], caps: dict[str, int]) -> DataFrame:
    """Rows with `reason`: the first cap, in the order of `caps`, that a row does not fit when all before it ran; null if it runs.

    A cap bounds the running sum of a column; `records` bounds the rows. Amounts are not negative, so the first row that does not fit is where
    a batch stops, and later rows do not fit either: one prefix scan decides all of them.
    """
    amounts = [c for c in caps if c != "records"]
    summed = running_sums(rows, batch, order, amounts)
    reason = F.lit(None).cast("string")
    for name in reversed(caps):
        used = F.col("idx") + 1 if name == "records" else F.col(f"{name}_before") + F.coalesce(F.col(name), F.lit(0))
        reason = F.when(used > caps[name], f"max_{name}").otherwise(reason)
    return summed.withColumn("reason", reason).drop("n", *[f"{a}_before" for a in amounts])


def batch_outcomes(decided: DataFrame, batch: str) -> DataFrame:
    """Of each batch: its rows, how many ran before it stopped, why it stopped (null: complete), and whether it is published."""
    each = decided.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("done"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("idx"))).alias("reason"))
    return each.withColumn("published", F.col("reason").isNull())


def publish(decided: DataFrame, batch: str, path: str) -> DataFrame:
    """Writes the rows of complete batches below path, a folder for each batch, by one rename of a staged folder; returns the outcomes.

    A batch that a cap stops leaves nothing behind; without a complete batch there is no folder at all.
    """
    spark = decided.sparkSession
    outcomes = batch_outcomes(decided, batch)
    whole = decided.join(outcomes.where("published").select(F.col(batch).alias("__b")), F.col(batch).eqNullSafe(F.col("__b")), "left_semi").drop("reason", "idx")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, final = hadoop(f"{path}.staged-{uuid.uuid4().hex}"), hadoop(path)
    files = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(final):
        raise ValueError(f"{path} is there already")
    if not outcomes.where("published").isEmpty():
        whole.write.partitionBy(batch).parquet(staged.toString())
        if not files.rename(staged, final):
            files.delete(staged, True)
            raise RuntimeError(f"{path} was not published")
    return outcomes


def allocate(counts: DataFrame, cap: int, source: str = "source", place: str = "place") -> DataFrame:
    """What a global cap leaves to each source, in order of place: taken and status (whole, truncated or skipped).

    counts: a row for each configured source with n (rows that it has) and most (its own cap). A source is truncated if its own cap exceeds what
    is left, skipped if nothing is left. The table is as long as the configuration, so one window over it is small.
    """
    available = F.least("n", "most")
    before = F.coalesce(F.sum(available).over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(cap) - before, F.lit(0)).cast("long")
    status = F.when(left == 0, "skipped").when(F.col("most") > left, "truncated").otherwise("whole")
    return counts.select(source, place, "n", "most", F.least(available, left).cast("long").alias("taken"), status.alias("status"))


def allocated_rows(rows: DataFrame, allocation: DataFrame, order: list[str], source: str = "source") -> DataFrame:
    """The rows that an allocation takes: the first of each source in `order`, with their position (idx)."""
    given = allocation.where("taken > 0").select(F.col(source).alias("__s"), "taken")
    some = rows.join(given, F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    return numbered(some, source, order).where(F.col("idx") < F.col("taken")).drop("taken", "n")
