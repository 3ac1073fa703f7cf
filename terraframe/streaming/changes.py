"""Changes as a stream: micro-batches of changed nodes fold into a table with one row per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(id, change): of a stream of (id, ts, change) the last change of each id in each hour of event time. Rows later than
    the delay are dropped by the watermark, so the state stays bounded."""
    hour = changes.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "id")
    return hour.agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts")).select("id", "change", "ts")


def counts(events: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Changes by kind and window of event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
