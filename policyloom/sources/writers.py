"""Sinks: JSON Lines, split tables and bundles whose manifest comes last, and verification of a bundle before it is resumed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines with sorted fields; the committer makes the folder appear whole or not at all."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Append to an event log."""
    rows.write.mode("append").json(path)


def digest(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of a table: the sum of its rows' hashes."""
    row = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)"))).first()
    return row[0], str(row[1] or 0)


def write_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], extra: dict | None = None) -> dict:
    """Each table as Parquet, then a manifest with counts and digests: a bundle without a manifest is unfinished."""
    manifest = {"tables": {}, **(extra or {})}
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        count, mark = digest(spark.read.parquet(f"{path}/{name}"))
        manifest["tables"][name] = {"rows": count, "digest": mark}
    line = json.dumps(manifest, sort_keys=True, separators=(",", ":"))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_manifest")
    return manifest


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a finished bundle, refused if any has changed since."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    tables = {}
    for name, known in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if digest(tables[name]) != (known["rows"], known["digest"]):
            raise ValueError(f"{name} differs from its manifest")
    return tables


def write_splits(rows: DataFrame, path: str, asset: str, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """train, dev and holdout by asset; returns the counts of each."""
    split = rows.withColumn("split", X.split_of(F.col(asset), seed, ratios))
    split.write.mode("errorifexists").partitionBy("split").json(path)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(asset).alias("assets"))
