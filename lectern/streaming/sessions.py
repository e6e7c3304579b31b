"""Streams: sessions of users with late data, appended batches without repeated files, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Times without zone as instants; watermarks ask for those."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def user_sessions(events: DataFrame, gap: str = "120 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users that a pause ends, each given out once when no event can reach it any more; a streaming or a static frame."""
    e = event_time(events).withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "events", "value")


def fresh_files(files: DataFrame, time_col: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """Files whose content wasn't seen within the time; state is kept for that long only."""
    return event_time(files, time_col).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["hash"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in fixed windows; late ones count until the watermark passes."""
    e = event_time(events).withWatermark("ts", late)
    c = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return c.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
