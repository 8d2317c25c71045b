"""Connected components of a link table, by alternating large-star and small-star steps, and a join that spreads heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, stored


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, so that no task gets a heavy key's rows.

    A key is heavy if it holds more than a quarter of an even partition's rows, so at most four times as many keys as there
    are partitions are heavy: their rows of the table are broadcast, the others meet by key.
    """
    total, most = rows.count(), 4 * parallelism(rows.sparkSession)
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * most > total).select(key).collect()
    if not heavy:
        return rows.join(table, key, how)
    listed = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in heavy], rows.select(key).schema))
    hot = rows.join(listed, key, "left_semi").join(F.broadcast(table.join(listed, key, "left_semi")), key, how)
    return hot.unionByName(rows.join(listed, key, "left_anti").join(table, key, how))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links of every vertex to its larger neighbours go to its least one; total: how many links there are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    heavy = F.col("n") * (2 * parallelism(edges.sparkSession)) > total
    up = both.where("v > u")
    hubs = F.broadcast(low.where(heavy).drop("n"))  # at most four times as many as there are partitions
    met = up.join(hubs, "u").unionByName(up.join(low.where(~heavy).drop("n"), "u"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every vertex of edges (u, v) of longs; the component is the smallest id reachable.

    Rounds grow with the logarithm of the longest chain and go on until nothing moves. Each round's links are written to the
    shared folder. Hubs combine map-side, and their links meet their least neighbour by a broadcast. After a large-star step
    every vertex points to smaller ones only, so a small-star step sees a vertex's few parents, not a hub's children.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = state(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now, mark[0])), "links")
        before, mark = mark, state(now)
        if before == mark:
            break
    low = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return low.unionByName(low.select(F.col("component_id").alias("id"), "component_id").distinct())
