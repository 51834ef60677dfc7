"""Streaming forms of the log aggregates. The batch operators stay the source of truth; these keep them fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window start, key, n: counts by event time; state is dropped once the watermark passes a window."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, time: str, id_: str, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([id_])


def append_pairs(path: str):
    """foreachBatch sink: pair counts of each micro-batch under its own batch folder, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("query", "poi").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
