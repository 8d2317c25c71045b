"""Near-duplicate embeddings by Euclidean p-stable hashing.

Unit vectors x are hashed by floor((a . x + b) / w) with Gaussian a and uniform b; k such numbers make a bucket key of
one table, and vectors of one label that share a bucket of any table are compared exactly, by cosine in doubles. From
the threshold's distance follow p1, the chance that one number agrees for a pair at the threshold, and p2, that for
unrelated unit vectors; k grows with the logarithm of the largest label so that unrelated pairs rarely meet, and the
count of tables is what makes a pair at the threshold meet with probability 1 - miss in one at least.

Equal vectors of a label form a class first, with its count; only classes are hashed. Buckets with several members are
found from their keys alone; vectors travel to those only. A bucket above block members is split in blocks that meet
pairwise in different tasks, so no bucket is collected whole. Tasks form no pair rows: they yield for each vector how
many others it links with, pairs that already met in an earlier table left out, and one link to its block's component.

Defined results: a null vector or label, a zero vector or one with null or non-finite components links with nothing;
vectors of different lengths are not compared. Rows are linked one by one, repeated ids and rows too; a component is
named by the smallest id among its rows; a row without an id has no component and is not kept. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, ship, stored
from .components import components
from .kernels import U64, mix, slices


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def agreement(distance: float, width: float) -> float:
    """The chance that one hash number of two vectors at a distance agrees."""
    r = width / distance
    return 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(largest: int, threshold: float, width: float = 1.0, miss: float = 1e-4) -> tuple[int, int]:
    """Numbers a key and tables for a label of so many vectors."""
    near, far = agreement(math.sqrt(2 - 2 * threshold), width), agreement(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(largest, 8)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


def _signatures(vectors: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys, vectors x tables."""
    random = np.random.default_rng(seed + vectors.shape[1])
    a, b = random.standard_normal((vectors.shape[1], k * tables)), random.uniform(0, width, k * tables)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64).astype(U64).reshape(len(vectors), tables, k)
    total = np.zeros(cells.shape[:2], U64)
    for j in range(k):
        total = mix(total * U64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return total


def link_groups(vectors: np.ndarray, keys: np.ndarray, counts: np.ndarray, sigs: np.ndarray, table: int, sides: np.ndarray, threshold: float, whole: bool):
    """Within a bucket (or between two blocks of it): how many vectors each links with, and its component's least key."""
    n = len(vectors)
    links, label = np.zeros(n, np.int64), keys.copy()
    hits = []
    left = np.arange(n) if whole else np.flatnonzero(sides == 0)
    right = np.arange(n) if whole else np.flatnonzero(sides == 1)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        near = vectors[rows] @ vectors[right].T >= threshold
        x, y = np.nonzero(near)
        x, y = rows[x], right[y]
        fresh = x < y if whole else np.ones(len(x), bool)
        x, y = x[fresh], y[fresh]
        if table and len(x):
            met = np.zeros(len(x), bool)
            for part in range(0, len(x), 65536):
                piece = slice(part, part + 65536)
                met[piece] = (sigs[x[piece], :table] == sigs[y[piece], :table]).any(1)
            x, y = x[~met], y[~met]
        np.add.at(links, x, counts[y])
        np.add.at(links, y, counts[x])
        hits.append((x.astype(np.int32), y.astype(np.int32)))
    x, y = (np.concatenate([h[k] for h in hits]) if hits else np.empty(0, np.int32) for k in (0, 1))
    while len(x):
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        if (before == label).all():
            break
    return links, label


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, width: float = 1.0, miss: float = 1e-4, block: int = 2048, seed: int = 20) -> DataFrame:
    """Per row: the id, n_links, component_id, kept."""
    spark = table.sparkSession
    ship(spark)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & finite
    # The key of a class is a hash; a seed is taken under which no two unlike vectors of a label share one.
    for salt in range(64):
        keyed = rows.withColumn("key", F.when(sound, F.xxhash64(F.lit(salt), "label", F.size("v"), "v")))
        valid = keyed.where("key is not null")
        unlike = valid.groupBy("key").agg(F.min(F.struct("label", "v")).alias("a"), F.max(F.struct("label", "v")).alias("b")).where("a <> b")
        if unlike.isEmpty():
            break
    rows = keyed
    sizes = valid.groupBy("label", F.size("v").alias("d")).count().agg(F.max("count")).first()[0]
    classes = stored(valid.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n")), "vectors")
    k, tables = plan(sizes or 0, threshold, width, miss)

    def unit(column) -> list[np.ndarray]:
        # Scaled by the largest component first, so that no square overflows or vanishes.
        scaled = [x / np.abs(x).max() for x in (np.asarray(v, np.float64) for v in column.to_pylist())]
        return [x / np.linalg.norm(x) for x in scaled]

    def hashed(batches):
        for batch in slices(batches, 1024):
            vectors = unit(batch.column(1))
            for size in {len(v) for v in vectors}:
                own = [i for i, v in enumerate(vectors) if len(v) == size]
                sigs = _signatures(np.array([vectors[i] for i in own]), k, tables, width, seed)
                part = batch.take(pa.array(own))
                salt = mix(np.array(part.column(2).to_pylist()).astype(np.int64).astype(U64) * U64(31) + U64(size))
                buckets = mix(sigs ^ salt[:, None]) + np.arange(tables, dtype=U64)
                # Unsigned sums wrap; a bucket belongs to one table, label and length.
                raw = [x.tobytes() for x in np.array([vectors[i] for i in own])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3), pa.array([x.tobytes() for x in buckets.view(np.int64)], pa.binary()), pa.array(raw, pa.binary()), pa.array(list(buckets.view(np.int64)))],
                    names=["key", "n", "sigs", "unit", "buckets"],
                )

    labelled = classes.select("key", "v", F.xxhash64("label").alias("label"), "n")
    signed = labelled.mapInArrow(hashed, "key long, n long, sigs binary, unit binary, buckets array<long>")
    signed = stored(signed, "vector-buckets")
    members = signed.select("key", F.posexplode("buckets").alias("t", "bucket"))
    crowded = members.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = members.join(crowded, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "t", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    sent = placed.join(signed.select("key", "n", "sigs", "unit"), "key").repartition(parallelism(spark), "bucket", "i", "j")
    sent = sent.sortWithinPartitions("t", "bucket", "i", "j", "side", "key").select("t", "bucket", "i", "j", "side", "key", "n", "sigs", "unit")

    def linked(batches):
        held, at = [], None

        def done():
            if len(held) < 2:
                return None
            t, _, i, j = at
            keys = np.array([r[1] for r in held], np.int64)
            vectors = np.array([np.frombuffer(r[4]) for r in held])
            sigs = np.array([np.frombuffer(r[3], np.int64) for r in held])
            counts = np.array([r[2] for r in held], np.int64)
            links, least = link_groups(vectors, keys, counts, sigs, t, np.array([r[0] for r in held]), threshold, i == j)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(links[some]), pa.array(least[some])], names=["key", "links", "least"]) if len(some) else None

        for batch in slices(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != at:
                    if (out := done()) is not None:
                        yield out
                    held, at = [], row[:4]
                held.append(row[4:])
        if (out := done()) is not None:
            yield out

    links = stored(sent.mapInArrow(linked, "key long, links long, least long"), "vector-links")
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("key").alias("u"), F.col("least").alias("v")))
    least = valid.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = least.join(counted, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component_id", "key"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component"))
    by_key = named.join(smallest, "c").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    result = rows.select("id", "key").join(by_key, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
