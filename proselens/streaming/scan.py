"""The stateless rule scan over a stream of documents, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules


def findings(stream: DataFrame) -> DataFrame:
    """Findings of each arriving document; no state."""
    return rules.findings(stream)


def event_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event type and time window, closed once the watermark passes."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a table in memory (tests and demos)."""
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
