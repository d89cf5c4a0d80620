"""Trips of a live stream cut by gaps, and removal of repeated pings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STOP_SPEED_MPH, TRIP_GAP_MINUTES


def stream_trips(
    pings: DataFrame, gap_minutes: float = TRIP_GAP_MINUTES, lateness: str = "10 minutes"
) -> DataFrame:
    """One row per trip, emitted when the watermark has passed its end by the gap.

    Trips are cut by gaps only. Sessions of the same vehicle are merged inside each task before
    the shuffle, so a busy vehicle sends sessions, not pings.
    """
    pings.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    speed = F.coalesce(F.col("Speed"), F.lit(0.0))
    # a session ends at its last ping plus the gap, exclusive; one microsecond more keeps a ping
    # exactly one gap later in the same trip
    gap = f"{int(gap_minutes * 60_000_000) + 1} microseconds"
    return (
        pings.withWatermark("Timestamp", lateness)
        .groupBy("VIN", F.session_window("Timestamp", gap))
        .agg(
            F.count(F.lit(1)).alias("pings"),
            F.min("Timestamp").alias("start_ts"),
            F.max("Timestamp").alias("end_ts"),
            F.max(speed).alias("top_mph"),
            F.count_if(speed < STOP_SPEED_MPH).alias("standing_pings"),
        )
        .drop("session_window")
    )


def drop_repeats(
    pings: DataFrame,
    columns: tuple[str, ...] = ("VIN", "Timestamp", "Latitude", "Longitude"),
    lateness: str = "1 hour",
) -> DataFrame:
    """The first of equal pings; repeats arriving within ``lateness`` are dropped."""
    return pings.withWatermark("Timestamp", lateness).dropDuplicatesWithinWatermark(list(columns))
