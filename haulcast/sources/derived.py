"""Tables derived from the adapted pings for exercising the operators on real volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eta import naive_eta_min
from ..operators.features import add_features, trip_scan
from ..operators.trips import segment_trips
from ..schema import CHUNK_SECONDS, MIN_TRIP_PINGS
from .events import event_pings


def raw_text_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pings as text with defects sprinkled in by event number."""
    p = event_pings(spark, sf_dir)
    seq = F.col("event_seq")

    def broken(column, *cases):
        out = column
        for every, text in reversed(cases):
            out = F.when(seq % every == 0, F.lit(text)).otherwise(out)
        return out

    return p.select(
        broken(F.concat(F.lit(" "), "VIN", F.lit("  ")), (59, "")).alias("VIN"),
        broken(
            F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"), (31, ""), (37, "2024-13-01 00:00:00")
        ).alias("Timestamp"),
        broken(F.col("Latitude").cast("string"), (41, "95.0"), (61, "nan")).alias("Latitude"),
        broken(F.col("Longitude").cast("string"), (43, "abc")).alias("Longitude"),
        broken(F.col("Speed").cast("string"), (47, "-5"), (53, "fast")).alias("Speed"),
        F.col("Weight_lbs").cast("string").alias("Weight_lbs"),
        "Device_Type",
        "Source",
        "event_seq",
    )


def disordered_raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text pings with repeated rows and late arrivals.

    Ping number s arrives at 4s, every 23rd only at 4s + 20002; every 29th comes a second time
    right after itself, one place later.
    """
    raw = raw_text_pings(spark, sf_dir)
    late = F.when(F.col("event_seq") % 23 == 0, 20002).otherwise(0)
    placed = raw.withColumn("_at", F.col("event_seq") * 4 + late)
    repeated = placed.where(F.col("event_seq") % 29 == 0).withColumn("_at", F.col("_at") + 1)
    return placed.unionByName(repeated).withColumn("event_seq", F.col("_at")).drop("_at")


def event_trips(spark: SparkSession, sf_dir: str, **rule) -> DataFrame:
    return segment_trips(event_pings(spark, sf_dir), chunk_seconds=CHUNK_SECONDS, **rule)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with simple stand-in predictions around the naive estimate."""
    rows = add_features(
        event_trips(spark, sf_dir),
        ["dist_remaining_km", "load_state"],
        min_pings=MIN_TRIP_PINGS,
        label=True,
    )
    naive = naive_eta_min(F.col("dist_remaining_km"), F.col("Speed"))
    return rows.withColumn("naive", naive).select(
        "VIN",
        "trip_local",
        "event_seq",
        "load_state",
        F.col("eta_remaining_min").alias("y"),
        F.col("naive").alias("p50"),
        (F.col("naive") * 0.5).alias("p10"),
        (F.col("naive") * 1.5).alias("p90"),
        "naive",
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON request per ping of a kept trip, to its trip's last position; some are broken."""
    rows = trip_scan(event_trips(spark, sf_dir)).where(F.col("_n") >= MIN_TRIP_PINGS)
    seq = F.col("event_seq")
    number = lambda c: F.when(seq % 19 == 0, F.lit("x")).otherwise(c.cast("string"))
    body = F.to_json(
        F.struct(
            F.col("VIN").alias("vin"),
            F.concat_ws("_", "VIN", "trip_local").alias("trip_id"),
            number(F.col("Latitude")).alias("latitude"),
            F.col("Longitude").alias("longitude"),
            F.col("_dest_lat").alias("destination_latitude"),
            F.col("_dest_lon").alias("destination_longitude"),
            F.when(seq % 17 != 0, F.coalesce("Speed", F.lit(0.0))).alias("speed_mph"),
            (seq % 2 == 0).alias("use_google_routes"),
        )
    )
    return rows.select(
        "VIN",
        "trip_local",
        "event_seq",
        "Timestamp",
        F.when(seq % 67 == 0, F.lit("{broken")).otherwise(body).alias("body"),
    )


def route_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route responses: the ``view`` pings, with a duration from their position within a degree."""
    pings = event_pings(spark, sf_dir).where(F.col("Source") == "view")
    k = F.round((F.col("Latitude") - F.floor("Latitude")) * 100).cast("int")
    return pings.select(
        "VIN",
        F.col("Timestamp").alias("route_ts"),
        F.concat((F.lit(300) + k * 10).cast("string"), F.lit("s")).alias("duration"),
    )
