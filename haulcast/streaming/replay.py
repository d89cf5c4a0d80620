"""Replaying stored pings as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(rows: DataFrame, path: str, run: Callable[[DataFrame], object], slices: int = 4, order: str = "Timestamp") -> None:
    """Replay ``rows`` as ``slices`` steps in time order, equally wide in time.

    ``run`` gets the stream and works off what is there; it is called once per slice, with the same
    checkpoint. A slice is one micro-batch however many files it has, so none of its files is late
    against another. Rows without a time come with the first slice.
    """
    spark = rows.sparkSession
    at = F.unix_micros(order)
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    place = F.least(F.floor((at - F.lit(lo)) / F.lit((hi - lo) // slices + 1)), F.lit(slices - 1))
    held = f"{path}-held"
    rows.withColumn("_slice", F.coalesce(place, F.lit(0)).cast("int")).write.partitionBy("_slice").parquet(held)
    held = spark.read.parquet(held)
    for i in range(slices):
        held.where(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into parquet files and read them back."""
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
