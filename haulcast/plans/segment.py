"""Segmentation job: raw pings in, numbered trip table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.trips import (
    keep_long_trips,
    number_trips_globally,
    segment_trips,
    vehicle_trip_offsets,
)
from ..schema import CHUNK_SECONDS, MIN_TRIP_PINGS
from ..sources.pings import read_pings, write_trips


def numbered_trips(
    pings: DataFrame, min_pings: int = MIN_TRIP_PINGS, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Trips of at least ``min_pings`` pings; the numbering counts the shorter ones too."""
    trips = segment_trips(pings, chunk_seconds=chunk_seconds)
    offsets = vehicle_trip_offsets(pings, chunk_seconds=chunk_seconds)
    return number_trips_globally(keep_long_trips(trips, min_pings), offsets)


def segment_job(spark: SparkSession, source: str, target: str, fmt: str = "csv") -> None:
    write_trips(numbered_trips(read_pings(spark, source, fmt)), target)
