"""Streaming forms of the usage ledger and the event counts; additions, as the batch engine has no event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by kind over tumbling windows; state of closed windows is dropped behind the watermark."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def running_usage(usage: DataFrame, key: str, amount: str, cap: float) -> DataFrame:
    """Running total by key and whether it is within a cap, kept as state across batches; a refusal is final."""

    def step(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, count = state.get if state.exists else (0.0, 0)
        for frame in frames:
            total += float(frame[amount].sum())
            count += len(frame)
        state.update((total, count))
        yield pd.DataFrame({key: [name[0]], "requests": [count], "total": [total], "within": [total <= cap]})

    kind = usage.schema[key].dataType.simpleString()
    return usage.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, requests long, total double, within boolean", "total double, count long", "update", "NoTimeout")
