"""Distinct counts of vehicles and trips kept as mergeable sketches per day.

A day's table is one row per day whatever the number of pings, so any range of days is counted by
reading and merging those rows; a new day is added without reading the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_REGISTERS = 14


def relative_error(log_registers: int = LOG_REGISTERS) -> float:
    """Three standard errors of an estimate, as a share of the true count."""
    return 3 * 1.04 / (1 << log_registers) ** 0.5


def daily_sketches(trips: DataFrame, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """Per day of ``Timestamp``: rows and sketches of the vehicles and of the trips seen on it.

    Sketches are merged map-side, so a day or vehicle of very many pings costs one small row per
    task. Rows without a time belong to no day; null vehicles are counted as rows only.
    """
    trip = F.when(F.col("VIN").isNotNull(), F.concat(F.col("VIN"), F.lit("\x00"), F.col("trip_local").cast("string")))
    return (
        trips.where(F.col("Timestamp").isNotNull())
        .groupBy(F.to_date("Timestamp").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.hll_sketch_agg("VIN", log_registers).alias("vehicles"),
            F.hll_sketch_agg(trip, log_registers).alias("trips"),
        )
    )


def write_daily(sketches: DataFrame, path: str) -> None:
    """Write the days given, replacing those days alone in an existing table."""
    (
        sketches.repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def distinct_between(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Estimated vehicles and trips from day ``first`` to ``last``, both included; one row.

    The bounds are partition filters: files of other days are not opened.
    """
    days = spark.read.parquet(path)
    if first is not None:
        days = days.where(F.col("day") >= F.to_date(F.lit(first)))
    if last is not None:
        days = days.where(F.col("day") <= F.to_date(F.lit(last)))
    merged = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
    return days.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), merged("vehicles"), merged("trips"))
