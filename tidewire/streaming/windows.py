"""Watermarked windows over streams of flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_div

#: The longest window of the rule language.
WATERMARK = "5 minutes"


def event_time(flows: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Adds the event time column that windows need; the nanoseconds stay the canonical time."""
    return flows.withColumn("event_time", F.timestamp_micros(floor_div("ts_ns", 1000))).withWatermark("event_time", watermark)


def tumbling_protocols(flows: DataFrame, size: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Packets and bytes by protocol and window; a window is given out once the watermark has passed it."""
    return event_time(flows, watermark).groupBy(F.window("event_time", size), "proto").agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")).select("window.start", "window.end", "proto", "packets", "bytes")


def idle_sessions(flows: DataFrame, idle: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Sessions that end by a pause, the streaming form of idle expiry."""
    from ..functions.scalars import session_key
    from ..operators.sessions import canonical

    own = canonical(event_time(flows, watermark).where("src IS NOT NULL"))
    key = session_key(F.col("proto"), F.col("a_ip"), F.col("a_port"), F.col("b_ip"), F.col("b_port"))
    return own.withColumn("key", key).groupBy("key", F.session_window("event_time", idle)).agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets", "bytes")
