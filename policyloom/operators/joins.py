"""Keyed joins with completeness checks, first-wins deduplication and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Incomplete(ValueError):
    """A strict join found rows that it must refuse."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def complete_join(tasks: DataFrame, oracles: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Inner join on a composite key. Strict: refuse repeated keys on either side, missing and unmatched partners."""
    if strict:
        for name, side in (("task", tasks), ("oracle", oracles)):
            if not duplicates(side, *keys).isEmpty():
                raise Incomplete(f"repeated {name} key")
        if not missing(tasks, oracles, keys).isEmpty():
            raise Incomplete("a task has no oracle")
        if not missing(oracles, tasks, keys).isEmpty():
            raise Incomplete("an oracle has no task")
    return tasks.join(oracles, keys)


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(*keys), keys, "left_anti")


def first_wins(df: DataFrame, key: Column | str, ordinal: str) -> DataFrame:
    """One row for each key: that of the smallest ordinal, of equal ordinals the one whose other columns come first as JSON.

    Ordinals and hashes are aggregated first, so that whole rows of a hot key never meet in one task; rows that are equal in
    every column count as one.
    """
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("__k", key).withColumn("__rank", F.struct(F.col(ordinal).alias("o"), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256).alias("h")))
    first = keyed.groupBy("__k").agg(F.min("__rank").alias("__first"))
    kept = keyed.join(first, keyed["__k"].eqNullSafe(first["__k"]) & (F.col("__rank") == F.col("__first")), "left_semi")
    return kept.drop("__k", "__rank").distinct()


def source_lookup(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """Source text by (source, source_id); by the bare id where the source is unknown and the id belongs to one source only."""
    exact = texts.select("source", "source_id", F.col("text").alias("__exact"))
    bare = texts.groupBy("source_id").agg(F.countDistinct("source").alias("__n"), F.min("text").alias("__bare")).where("__n = 1")
    found = refs.join(exact, ["source", "source_id"], "left").join(bare.drop("__n"), "source_id", "left")
    return found.withColumn("source_text", F.coalesce("__exact", "__bare")).drop("__exact", "__bare")


def indicator_index(destinations: DataFrame, normal) -> DataFrame:
    """Normalised indicator to destination, one row each; an indicator of several destinations is an error of the input and is left out."""
    flat = destinations.select("destination_id", "destination_type", F.explode("indicators").alias("raw")).withColumn("indicator", normal(F.col("raw")))
    return flat.where("indicator <> ''").groupBy("indicator").agg(F.min("destination_id").alias("destination_id"), F.min("destination_type").alias("destination_type"), F.countDistinct("destination_id").alias("__n")).where("__n = 1").drop("__n")


def nth_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The nth row of a key on the left meets the nth of the right."""
    number = lambda df, order: df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "__rn"]).drop("__rn")
