"""Adapter: the generic ``events`` table read as vehicle pings.

The table has one row per event with a user, a value and a small JSON payload. A user becomes a
vehicle, the value a speed, the payload a position. Event gaps average hours, so time is
compressed 48-fold around the origin; the 30-minute and 2-mph trip rules then apply as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN_US = 1704067200000000  # 2024-01-01 00:00:00 UTC in microseconds
COMPRESSION = 48


def event_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ping table (ping columns + event_seq) derived from ``events``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    since_origin = F.expr(f"(unix_micros(cast(ts as timestamp)) - {ORIGIN_US}) div {COMPRESSION}")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.format_string("V%05d", F.col("user_id")).alias("VIN"),
        F.col("event_id").alias("event_seq"),
        F.timestamp_micros(ORIGIN_US + since_origin).alias("Timestamp"),
        (F.lit(35.0) + F.col("user_id") % 10 + k / F.lit(100.0)).alias("Latitude"),
        (F.lit(-100.0) + F.col("user_id") % 15 + k / F.lit(200.0)).alias("Longitude"),
        F.when(F.col("event_id") % 20 != 0, F.col("value") / 4).alias("Speed"),
        F.when(F.col("event_type") == "purchase", 45000.0)
        .when(F.col("event_type") == "signup", 8000.0)
        .alias("Weight_lbs"),
        F.when(F.col("user_id") % 3 == 0, "OEM").otherwise("ELD").alias("Device_Type"),
        F.col("event_type").alias("Source"),
    )
