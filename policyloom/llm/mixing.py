"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Every source gets a target share of the mixture. Its mean repetition rate is share * rows / own rows, times
`epochs`. A document's copy count inverts the Poisson distribution of that mean at a uniform number drawn from
a hash of the seed and the id, so it can be recomputed anywhere and does not depend on partitioning. Documents
are exploded by their counts, dealt to partitions by a hash of (seed, id, copy) and sorted by it: a global
shuffle that splits a hot source evenly.

Rates are one row a source. Up to max_local_sources of them, counted first, are broadcast (a name and a number each);
beyond that they are joined as a table, with runtime skew handling. Sources are counted with
map-side combine.

Defined results: a null source is a source of its own; a source without a target gets `default_weight` (None:
the root of its row count, which flattens large sources); weight 0 removes a source; repeated rows of one id
get equal counts; a null id draws like the text 'null'; an empty table gives an empty table. Columns copy_no,
n_copies and order_key are replaced if they exist; all others pass through with the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(rate: Column, u: Column) -> Column:
    """The Poisson distribution of a mean inverted at u: the least k with P(count <= k) > u, summed term by term, beyond any u below 1 - 2 ** -52."""
    top = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.when(F.exp(-rate) <= u, 1).otherwise(0).alias("n"))

    def term(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), (acc["n"] + F.when(total <= u, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, term, lambda acc: acc["n"])).otherwise(0)


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, default_weight: float | None = None, epochs: float = 1.0, max_local_sources: int = 20_000) -> DataFrame:
    """Source and mean repetition rate."""
    counts = docs.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.sqrt("n") if default_weight is None else F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("s").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    rows = weighed.limit(max_local_sources + 1).collect()
    if len(rows) <= max_local_sources:
        weighed = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in rows], weighed.schema))
        total_n, total_w = sum(r.n for r in rows), math.fsum(r.w for r in rows)
    else:
        total_n, total_w = weighed.agg(F.sum("n"), F.sum("w")).first()
    rate = F.when(F.lit(bool(total_w)), F.col("w") * F.lit(float(total_n or 0) * epochs) / F.lit(float(total_w or 1)) / F.col("n")).otherwise(0.0)
    return weighed.select("s", rate.alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", seed: str = "mix-17", weights: dict | None = None, default_weight: float | None = None, epochs: float = 1.0) -> DataFrame:
    """Replicated documents in a global random order, with copy_no (from 1), n_copies and order_key."""
    kept = [c for c in docs.columns if c.lower() not in {"copy_no", "n_copies", "order_key"}]
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    table = rates(docs, source, weights, default_weight, epochs)
    drawn = docs.select(*[F.col(f"`{c}`") for c in kept]).join(table, F.col(f"`{source}`").eqNullSafe(F.col("s")))
    # The uniform number is bound once, as the lambda's own variable.
    counted = drawn.withColumn("n_copies", F.transform(F.array(uniform(seed, name)), lambda u: poisson_count(F.col("rate"), u))[0])
    copies = counted.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("order_key", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("copy_no").cast("string")), 256), 1, 16))
    dealt = keyed.repartition(parallelism(docs.sparkSession), "order_key").sortWithinPartitions("order_key")
    return dealt.select(*[F.col(f"`{c}`") for c in kept], F.col("copy_no").cast("long").alias("copy_no"), F.col("n_copies").cast("long").alias("n_copies"), "order_key")
