"""Stateful forms over event streams: latest reading per key with a watermark, and windowed means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Latest value per key, in update or complete mode; state is one struct per key. The first id wins ties."""
    best = F.max(F.struct(F.col(ts), (-F.col("event_id")).alias("__n"), F.col(value)))
    return events.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{ts}").alias(ts), F.col(f"b.{value}").alias(value))


def windowed_means(events: DataFrame, keys: list[str], ts: str, value: str, width: str, late: str) -> DataFrame:
    """Means per key and tumbling window; rows later than the watermark are dropped and old windows' state with them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
