"""Structured Streaming forms of the window profile and of gap clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_profile(flow: DataFrame, width_s: int, late_s: int, ts: str = "ts_s") -> DataFrame:
    """Tumbling-window counts of a stream of flow rows; rows later than ``late_s`` are dropped by the watermark."""
    timed = flow.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", f"{late_s} seconds")
    w = F.window("event_time", f"{width_s} seconds")
    out = timed.groupBy(w.alias("w")).agg(F.count("*").alias("row_count"), F.sum("size").alias("size_sum"), F.max("size").alias("size_max"), F.sum("label").alias("positives"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), "row_count", "size_sum", "size_max", "positives")


def streamed_clusters(observations: DataFrame, gap_s: int, late_s: int, ts: str = "ts_s") -> DataFrame:
    """Gap clusters of a stream by tactic, as session windows; a step equal to the gap stays in its cluster."""
    timed = observations.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", f"{late_s} seconds")
    out = timed.groupBy(F.session_window("event_time", f"{gap_s} seconds").alias("w"), "tactic").agg(F.count("*").alias("rows_n"), F.min(ts).alias("start_s"), F.max(ts).alias("end_s"))
    return out.select("tactic", "start_s", "end_s", "rows_n")
