"""Movement within trips: path length, pace, stops and trip summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import shorten
from ..schema import STOP_SPEED_MPH
from .features import TRIP_KEY, elapsed_s, trip_scan


def step_km() -> Column:
    """Distance from the previous ping of the trip (null at its first ping)."""
    return haversine_km("_plat", "_plon", "Latitude", "Longitude")


def path_distance(trips: DataFrame, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add step, travelled and total path distance in km."""
    return trip_scan(trips, key).select(
        *trips.columns,
        step_km().alias("step_km"),
        F.col("_km").alias("travelled_km"),
        F.col("_km_total").alias("total_km"),
    )


def pace_eta(trips: DataFrame, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add remaining distance and the arrival estimate from the pace so far.

    The estimate is 0 at the first ping and while nothing has been travelled.
    """
    hours = elapsed_s() / 3600.0
    pace = F.when(hours > 0, F.col("_km") / hours)
    remaining = F.greatest(F.col("_km_total") - F.col("_km"), F.lit(0.0))
    eta = F.when((F.col("_i") > 0) & (pace > 0), remaining / pace * 60.0).otherwise(0.0)
    return trip_scan(trips, key).select(
        *trips.columns, remaining.alias("remaining_km"), eta.alias("pace_eta_min")
    )


def progress_pct(trips: DataFrame, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add the position within the trip in percent of its pings."""
    return trip_scan(trips, key).select(
        *trips.columns, (F.col("_i") / F.col("_n") * 100).alias("progress_pct")
    )


def detect_stops(
    trips: DataFrame,
    stop_mph: float = STOP_SPEED_MPH,
    min_duration_min: float = 60.0,
    emit_open_tail: bool = False,
    key: Sequence[str] = TRIP_KEY,
) -> DataFrame:
    """Standing periods of at least ``min_duration_min`` minutes, one row per stop.

    All standing pings between two moving pings share the number of moving pings before them.
    That number is the stop's key, so a stop is an ordinary aggregation with map-side combining,
    however long it lasts. A stop still open at the end of its trip is left out unless asked for.
    """
    standing = trip_scan(trips, key, stop_mph=stop_mph).where(F.col("_x0") < stop_mph)
    if not emit_open_tail:
        standing = standing.where(F.col("_mv") < F.col("_mv_total"))
    first = F.min(F.struct("_i", "Latitude", "Longitude"))
    return (
        standing.groupBy(*key, "_mv")
        .agg(
            F.max("_i").alias("end_idx"),
            F.min("_us").alias("start_us"),
            F.max("_us").alias("end_us"),
            first.alias("_first"),
        )
        .withColumn("duration_min", (F.col("end_us") - F.col("start_us")) / F.lit(6e7))
        .where(F.col("duration_min") >= min_duration_min)
        .select(
            *key,
            F.col("_first._i").alias("start_idx"),
            "end_idx",
            "start_us",
            "end_us",
            "duration_min",
            F.col("_first.Latitude").alias("lat"),
            F.col("_first.Longitude").alias("lon"),
        )
    )


def seen_until(rows: DataFrame, position: int, column: str = "start_idx") -> DataFrame:
    """The part of a trip's rows (or stops) known when its ping ``position`` arrives."""
    return rows.where(F.col(column) <= position)


def trip_summary(
    trips: DataFrame,
    min_duration_min: float = 60.0,
    key: Sequence[str] = TRIP_KEY,
) -> DataFrame:
    """One row per trip: times, pings, path length, mean speed, stops and mean weight.

    One scan and two aggregations with map-side combining: first per trip and standing period
    (all moving pings of a trip together), then per trip.
    """
    standing = F.when(F.col("_x0") < STOP_SPEED_MPH, F.col("_mv"))
    periods = (
        trip_scan(trips, key)
        .withColumn("_period", standing)
        .withColumn("_km_step", step_km())
        .groupBy(*key, "_period")
        .agg(
            F.min("_us").alias("a"),
            F.max("_us").alias("b"),
            F.count(F.lit(1)).alias("n"),
            F.sum("_km_step").alias("km"),
            F.sum("Weight_lbs").alias("weight"),
            F.count("Weight_lbs").alias("weighed"),
            F.max("_mv_total").alias("moving"),
        )
    )
    minutes = (F.col("b") - F.col("a")) / F.lit(6e7)
    # the period after the last moving ping is still open; moving pings have no period
    is_stop = (F.col("_period") < F.col("moving")) & (minutes >= min_duration_min)
    hours = (F.col("end_us") - F.col("start_us")) / F.lit(3.6e9)
    return (
        periods.groupBy(*key)
        .agg(
            F.min("a").alias("start_us"),
            F.max("b").alias("end_us"),
            F.sum("n").alias("pings"),
            F.coalesce(F.sum("km"), F.lit(0.0)).alias("path_km"),
            F.count_if(is_stop).alias("stops"),
            F.coalesce(F.sum(F.when(is_stop, minutes)), F.lit(0.0)).alias("stop_min"),
            (F.sum("weight") / F.nullif(F.sum("weighed"), F.lit(0))).alias("avg_weight_lbs"),
        )
        .select(
            *key,
            "start_us",
            "end_us",
            hours.alias("hours"),
            "pings",
            "path_km",
            (F.col("path_km") / F.nullif(hours, F.lit(0.0))).alias("km_per_h"),
            "stops",
            "stop_min",
            "avg_weight_lbs",
        )
    )


def trip_card(summary: DataFrame, trip_id: Column) -> DataFrame:
    """Display texts of a trip summary: shortened label and start time."""
    return summary.select(
        *TRIP_KEY,
        shorten(trip_id).alias("label"),
        F.date_format(F.timestamp_micros("start_us"), "HH:mm").alias("start_hhmm"),
    )
