"""Streaming forms of the incremental operators: counters, sessions and debounced changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their summed value per window and type; rows later than ``late`` are dropped once streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    return events.where("user_id is not null").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("session_start"), "n_events")


def walk_counts(walks: DataFrame) -> DataFrame:
    """How often each unordered pair (source, target) of a repo was walked."""
    return walks.where("source is not null and target is not null").groupBy("repo", F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.count(F.lit(1)).alias("n_walks"))


def first_changes(changes: DataFrame, quiet: str = "3 seconds") -> DataFrame:
    """The first of each file's changes; repeats are held back for as long as the watermark remembers them."""
    return changes.withWatermark("modified_at", quiet).dropDuplicatesWithinWatermark(["repo", "source_file"])
