"""Places and running sums of rows within groups, without a task that gets a whole group.

Rows are dealt by ranges of (group, order) and written; a range's rows and sums are added up, and what stands before a row is what its range has before it and
what the ranges before hold. A group with a third of all rows is thus numbered by a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallelism, stored


def running_sums(rows: DataFrame, group: str, order: list[str], amounts: list[str]) -> DataFrame:
    """Rows with idx (their place in their group, from 0), n (the group's size), and <amount>_before: the sum over the group's rows before. A null group is one, null amounts add nothing."""
    ranged = stored(rows.repartitionByRange(parallelism(rows.sparkSession), group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    named = {"__rows": F.lit(1).cast("long")} | {f"__{a}": F.coalesce(F.col(a), F.lit(0)) for a in amounts}
    held = ranged.groupBy(group, "__part").agg(*[F.sum(c).alias(name) for name, c in named.items()])
    by = Window.partitionBy(group)
    earlier = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__before{name}") for name in named]
    offsets = stored(held.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.sum("__rows").over(by).alias("n"), *sums), "range-offsets")
    inner = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({f"__in{name}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for name, c in named.items()})
    met = within.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    total = lambda name: F.col(f"__before{name}") + F.col(f"__in{name}")
    out = met.withColumns({"idx": total("__rows")} | {f"{a}_before": total(f"__{a}") for a in amounts})
    return out.drop("__part", "__g", "__p", *[f"__in{name}" for name in named], *[f"__before{name}" for name in named])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with idx and n alone."""
    return running_sums(rows, group, order, [])
