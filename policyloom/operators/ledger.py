"""Event logs, attempts, budgets and usage as running sums and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_check(events: DataFrame, sequence: str, kind: str, group: list[str], amount: Column) -> DataFrame:
    """Per event of a log: whether its number is its place, its predecessor's kind, and the running amount. Logs are partitions; a log is ordered by its numbers."""
    w = Window.partitionBy(*group).orderBy(sequence)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(
        "*", F.row_number().over(w).alias("place"), F.lag(kind).over(w).alias("previous"), F.sum(amount).over(running).alias("running"),
    )


def attempt_check(rejections: DataFrame, key: str, attempt: str) -> DataFrame:
    """Keys whose attempts are not exactly 1..n: counted, without ordering rows."""
    seen = rejections.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(attempt).alias("different"), F.min(attempt).alias("low"), F.max(attempt).alias("high"))
    return seen.withColumn("contiguous", (F.col("n") == F.col("different")) & (F.col("low") == 1) & (F.col("high") == F.col("n")))


def reservations(requests: DataFrame, group: list[str], sequence: str, cost: Column, cap: float, most: int) -> DataFrame:
    """Requests of a budget in order: granted while count and reserved cost stay within the caps; the first refusal is final."""
    running = Window.partitionBy(*group).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = requests.withColumn("reserved", F.round(F.sum(cost).over(running), 6)).withColumn("number", F.count(F.lit(1)).over(running))
    fits = (F.col("reserved") <= cap) & (F.col("number") <= most)
    return sums.withColumn("granted", F.min(fits.cast("int")).over(running) == 1)


def usage_rollup(usage: DataFrame, group: list[str], cost: str, tokens: list[str], complete: Column) -> DataFrame:
    """Token sums; the cost is null if any cost is; complete only if all are."""
    return usage.groupBy(*group).agg(
        F.count(F.lit(1)).alias("request_count"), *[F.sum(t).alias(t) for t in tokens],
        F.when(F.count(cost) == F.count(F.lit(1)), F.sum(cost)).alias("estimated_cost"), F.bool_and(complete).alias("accounting_complete"),
    )


def running_cap(rows: DataFrame, group: list[str], order: list[str], size: Column, cap: float) -> DataFrame:
    """Rows read in order under a cap on their total size: what is used before and after, and whether a row is still taken."""
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(running)).withColumn("taken", F.col("used") <= cap)


def worst_case_cost(prompt: Column, image_bytes: Column, max_output: int, price_in: float, price_out: float) -> Column:
    """Upper bound of a request's price, in millionths of a token's price."""
    return ((F.octet_length(prompt) + image_bytes + 4096) * price_in + max_output * price_out) / 1e6


def retry_delay(attempt: Column, first: float, most: float) -> Column:
    """Doubling delays up to a limit."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt - 1))
