"""Trip segmentation: cutting each vehicle's timeline into trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHUNK_SECONDS, MIN_TRIP_PINGS, STOP_SPEED_MPH, TRIP_GAP_MINUTES
from .scan import NO_TIME, attach, ordered_offsets, with_time_chunk

ORDER = ("_t", "event_seq")


def effective_speed(c: str = "Speed") -> Column:
    """Speed with a missing (null or NaN) reading taken as standing still."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def starts_trip(
    prev_t: Column,
    prev_speed: Column,
    t: Column,
    speed: Column,
    gap_minutes: float,
    stop_mph: float,
    split_on_stop: bool,
) -> Column:
    """True where a ping opens a new trip after a known previous ping of the vehicle."""
    gap = (t != NO_TIME) & ((t - prev_t) > int(gap_minutes * 60_000_000))
    if not split_on_stop:
        return gap
    return gap | ((prev_speed < stop_mph) & (speed >= stop_mph))


def _chunk_cuts(pings: DataFrame, rule: dict, seconds: int) -> DataFrame:
    """Add chunk columns and ``_cut``: trips opened so far inside the chunk."""
    pings = with_time_chunk(pings, seconds).withColumn("_sp", effective_speed())
    w = Window.partitionBy("VIN", "chunk").orderBy(*ORDER)
    opened = starts_trip(
        F.lag("_t").over(w), F.lag("_sp").over(w), F.col("_t"), F.col("_sp"), **rule
    )
    return pings.withColumn("_open", F.coalesce(opened, F.lit(False)).cast("int")).withColumn(
        "_cut", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def _chunk_bases(pings: DataFrame, rule: dict, seconds: int) -> DataFrame:
    """Per (VIN, chunk): the number of the trip that is running at the chunk's first ping."""
    narrow = pings.select("VIN", "Timestamp", "event_seq", "Speed")
    at = F.struct("_t", "event_seq")
    value = F.struct("_t", "_sp")
    chunks = (
        _chunk_cuts(narrow, rule, seconds)
        .groupBy("VIN", "chunk")
        .agg(
            F.min_by(value, at).alias("first"),
            F.max_by(value, at).alias("last"),
            F.sum("_open").alias("opened"),
        )
    )
    w = Window.partitionBy("VIN").orderBy("chunk")
    before = F.lag("last").over(w)
    fresh = before.isNull() | starts_trip(
        before["_t"], before["_sp"], F.col("first._t"), F.col("first._sp"), **rule
    )
    return (
        chunks.withColumn("_fresh", fresh.cast("int"))
        .withColumn(
            "_through",
            F.sum(F.col("_fresh") + F.col("opened")).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select("VIN", "chunk", "opened", "_through", (F.col("_through") - F.col("opened")).alias("_base"))
    )


def segment_trips(
    pings: DataFrame,
    gap_minutes: float = TRIP_GAP_MINUTES,
    stop_mph: float = STOP_SPEED_MPH,
    split_on_stop: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Label every ping with ``trip_local``, the number of its trip within the vehicle (from 1).

    A trip opens at a vehicle's first ping, after a gap longer than ``gap_minutes``, and (unless
    ``split_on_stop`` is off) where a stopped vehicle starts to move. Pings without a vehicle
    belong to no trip. The time bucket ``chunk`` is kept: later operators reuse the partitioning.
    """
    rule = dict(gap_minutes=gap_minutes, stop_mph=stop_mph, split_on_stop=split_on_stop)
    pings = pings.where(F.col("VIN").isNotNull())
    base = _chunk_bases(pings, rule, chunk_seconds).select("VIN", "chunk", "_base")
    return (
        attach(_chunk_cuts(pings, rule, chunk_seconds), base, ["VIN", "chunk"])
        .withColumn("trip_local", F.col("_base") + F.col("_cut"))
        .drop("_t", "_sp", "_open", "_cut", "_base")
    )


def keep_long_trips(trips: DataFrame, min_pings: int = MIN_TRIP_PINGS) -> DataFrame:
    """Keep the pings of trips with at least ``min_pings`` pings.

    Trip sizes are counted per (vehicle, chunk, trip) on the existing partitioning and added up
    over the chunks of a trip, so a trip of any length is counted in parallel.
    """
    pieces = trips.groupBy("VIN", "chunk", "trip_local").agg(F.count(F.lit(1)).alias("_piece"))
    total = F.sum("_piece").over(Window.partitionBy("VIN", "trip_local"))
    kept = (
        pieces.select("VIN", "chunk", "trip_local", total.alias("_size"))
        .where(F.col("_size") >= min_pings)
        .drop("_size")
    )
    return attach(trips, kept, ["VIN", "chunk", "trip_local"])


def trip_label(vin: Column, number: Column) -> Column:
    """Display label of a trip: vehicle and zero-padded number."""
    return F.format_string("%s_%04d", vin, number)


def vehicle_trip_offsets(
    pings: DataFrame,
    gap_minutes: float = TRIP_GAP_MINUTES,
    stop_mph: float = STOP_SPEED_MPH,
    split_on_stop: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Per vehicle, the number of trips of all vehicles before it in VIN order."""
    rule = dict(gap_minutes=gap_minutes, stop_mph=stop_mph, split_on_stop=split_on_stop)
    per_vin = (
        _chunk_bases(pings.where(F.col("VIN").isNotNull()), rule, chunk_seconds)
        .groupBy("VIN")
        .agg(F.max("_through").alias("trips"))
    )
    return ordered_offsets(per_vin, "VIN", "trips", "trip_offset")


def number_trips_globally(trips: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add ``trip_number`` (running on over all vehicles) and the label ``trip_id``.

    The offsets have one row per vehicle. They are spread to one row per (vehicle, chunk) first,
    so the join back runs on the pings' own partitioning and a hot vehicle stays spread out.
    """
    spread = trips.select("VIN", "chunk").distinct().join(offsets.select("VIN", "trip_offset"), "VIN")
    return (
        attach(trips, spread, ["VIN", "chunk"])
        .withColumn("trip_number", F.col("trip_offset") + F.col("trip_local"))
        .withColumn("trip_id", trip_label(F.col("VIN"), F.col("trip_number")))
        .drop("trip_offset")
    )
