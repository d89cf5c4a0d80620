"""Reading and writing ping and trip tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PING_SCHEMA
from ..session import checkpoint_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file set as written, from its first line only."""
    return spark.read.option("header", True).csv(path).columns


def _with_arrival_order(df: DataFrame) -> DataFrame:
    """Add ``event_seq``: the position of each row over all files, in path and offset order.

    Rows of one file split are numbered inside their task; only the split sizes (one row per
    split) are accumulated, so there is no sort and no pass over the rows in one place.
    """
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    return (
        rows.join(offsets, ["_file", "_start"])
        .withColumn("event_seq", F.col("_base") + F.col("_id") - F.col("_first"))
        .drop("_file", "_start", "_id", "_first", "_base")
    )


def read_raw_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every cell and name of a CSV as trimmed text, with the arrival order ``event_seq``."""
    names = header_of(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    placed = _with_arrival_order(raw)
    return strip_names(placed.select(*[F.trim(F.col(f"`{n}`")).alias(n) for n in names], "event_seq"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN readings as missing ones, in the declared numeric columns."""
    doubles = [f.name for f in PING_SCHEMA if isinstance(f.dataType, T.DoubleType) and f.name in df.columns]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in doubles})


def read_pings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Typed ping table from CSV (or parquet, orc, json). Undeclared columns stay text.

    Ordering is left to the windows that need it; there is no global sort.
    """
    types = {f.name: f.dataType for f in PING_SCHEMA}
    if fmt != "csv":
        df = strip_names(spark.read.format(fmt).load(path))
        typed = [F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
        df = without_nan(df.select(*typed))
        return df if "event_seq" in df.columns else df.withColumn(
            "event_seq", F.monotonically_increasing_id()
        )
    names = header_of(spark, path)
    schema = T.StructType(
        [T.StructField(n, types.get(n.strip(), T.StringType())) for n in names]
    )
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    if "event_seq" in {n.strip() for n in names}:
        df = without_nan(strip_names(df))
        return df.withColumn("event_seq", F.col("event_seq").cast("long"))
    return without_nan(strip_names(_with_arrival_order(df)))


def write_trips(trips: DataFrame, path: str) -> None:
    """Write a trip table partitioned by the day of the ping.

    The rebalance hint lets the adaptive planner split days that are too big and merge small
    ones, so a day is neither one huge file nor thousands of tiny ones; sorting by trip inside
    the files keeps their min/max statistics selective for trip lookups.
    """
    (
        trips.withColumn("trip_date", F.to_date("Timestamp"))
        .hint("rebalance", "trip_date")
        .sortWithinPartitions("trip_date", "VIN", "trip_local", "Timestamp", "event_seq")
        .write.mode("overwrite")
        .partitionBy("trip_date")
        .parquet(path)
    )


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def trip_rows(trips: DataFrame, vin: str, trip_local: int) -> DataFrame:
    """All pings of one trip in time order; the predicate reaches the parquet scan."""
    return trips.where((F.col("VIN") == vin) & (F.col("trip_local") == trip_local)).orderBy(
        "Timestamp", "event_seq"
    )


def trip_list(trips: DataFrame) -> DataFrame:
    """Distinct trips in order."""
    return trips.select("VIN", "trip_local").distinct().orderBy("VIN", "trip_local")
