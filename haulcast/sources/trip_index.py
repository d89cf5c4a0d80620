"""A side index of a written trip table: which files hold which trip.

The trip table is partitioned by day, so a lookup by trip alone would open every day. The index is
a small table of (VIN, trip, file), partitioned by a hash of the VIN: a lookup reads one hash
partition, then only the files named there.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.sources.pings import trip_rows

PARTS = 64


def _part(vin, parts: int):
    return F.pmod(F.xxhash64(vin), F.lit(parts)).cast("int")


def write_trip_index(spark: SparkSession, table: str, path: str, parts: int = PARTS) -> None:
    """Index the trip table at ``table``. One row per trip and file; rows without a VIN are left out."""
    (
        spark.read.parquet(table)
        .where(F.col("VIN").isNotNull())
        .select("VIN", "trip_local", F.col("_metadata.file_path").alias("file"))
        .groupBy("VIN", "trip_local", "file")
        .agg(F.count(F.lit(1)).alias("pings"))
        .withColumn("part", _part(F.col("VIN"), parts))
        .repartition("part")
        .sortWithinPartitions("part", "VIN", "trip_local")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(path)
    )


def trip_files(spark: SparkSession, index: str, vin: str, trip_local: int, parts: int = PARTS) -> list[str]:
    """Files that hold a trip, as many as the trip has days or splits of a day."""
    part = spark.range(1).select(_part(F.lit(vin), parts)).first()[0]
    rows = spark.read.parquet(index).where(
        (F.col("part") == part) & (F.col("VIN") == vin) & (F.col("trip_local") == trip_local)
    )
    return sorted(unquote(r["file"]) for r in rows.select("file").distinct().collect())


def indexed_trip_rows(spark: SparkSession, table: str, index: str, vin: str, trip_local: int, parts: int = PARTS) -> DataFrame:
    """All pings of one trip in time order, read from its own files only; no rows for an unknown trip."""
    files = trip_files(spark, index, vin, trip_local, parts)
    if not files:
        return trip_rows(spark.read.parquet(table).limit(0), vin, trip_local)
    return trip_rows(spark.read.option("basePath", table).parquet(*files), vin, trip_local)
