"""Chunked scans: ordered per-vehicle work that never needs a whole vehicle in one task.

An ordered computation over a vehicle (previous ping, running total, trip number) is normally a
window partitioned by the vehicle. One vehicle may hold a large share of all pings, so here the
timeline is cut into time chunks first and the work is done on two levels:

1. windows partitioned by (vehicle, chunk) over the pings, in parallel for all chunks;
2. windows partitioned by vehicle over one summary row per chunk, which are few however many
   pings a chunk holds;

and the carried values of level 2 are joined back on (vehicle, chunk). The pings are shuffled
once, on (vehicle, chunk); every join back reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHUNK_SECONDS

# A ping without a timestamp sorts after all others of its vehicle.
NO_TIME = 2**62
CHUNK_LADDER = (7 * 86400, 86400, 6 * 3600, 3600, 600, 60, 1)


def micros(c: str = "Timestamp") -> Column:
    return F.unix_micros(F.col(c))


def with_time_chunk(df: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Add ``_t`` (sortable time in microseconds) and ``chunk`` (time bucket)."""
    return df.withColumn("_t", F.coalesce(micros(), F.lit(NO_TIME))).withColumn(
        "chunk", F.expr(f"_t div {int(seconds) * 1_000_000}L")
    )


def measured_chunk_seconds(df: DataFrame, max_rows: int = 5_000_000, key: str = "VIN") -> int:
    """The longest chunk length for which no (vehicle, chunk) exceeds ``max_rows`` pings.

    One pass counts pings per vehicle and second with map-side combining; the coarser lengths
    are rolled up from those counts. Only the maxima reach the driver.
    """
    finest = CHUNK_LADDER[-1]
    counts = (
        with_time_chunk(df.select(key, "Timestamp"), finest)
        .groupBy(key, "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = F.array(
        *[
            F.struct(
                F.lit(length).alias("length"),
                F.expr(f"chunk div {length // finest}L").alias("bucket"),
            )
            for length in CHUNK_LADDER
        ]
    )
    worst = (
        counts.select(key, "n", F.explode(levels).alias("level"))
        .groupBy(key, "level.length", "level.bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("length")
        .agg(F.max("n").alias("n"))
        .collect()
    )
    fitting = [row["length"] for row in worst if row["n"] <= max_rows]
    return max(fitting, default=finest)


def attach(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join per-chunk summaries back to the rows they came from.

    The rows are already partitioned and sorted by the leading join columns, so a merge join moves
    only the summary. Left free, the planner may broadcast whichever side looks small, which gives
    up the rows' partitioning.
    """
    return rows.join(summary.hint("merge"), list(on))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    amounts: dict[str, Column],
) -> DataFrame:
    """Running sums of ``amounts`` in ``order`` within ``keys``, computed chunk by chunk.

    ``chunk`` must not decrease along ``order``.
    """
    local = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        df.groupBy(*keys, chunk)
        .agg(*[F.sum(amount).alias(f"_sum_{name}") for name, amount in amounts.items()])
        .select(
            *keys,
            chunk,
            *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in amounts],
        )
    )
    summed = df.select(
        "*", *[F.sum(amount).over(local).alias(f"_local_{name}") for name, amount in amounts.items()]
    )
    out = attach(summed, carry, [*keys, chunk])
    for name in amounts:
        total = F.coalesce(F.col(f"_local_{name}"), F.lit(0)) + F.coalesce(
            F.col(f"_carry_{name}"), F.lit(0)
        )
        out = out.withColumn(name, total).drop(f"_local_{name}", f"_carry_{name}")
    return out


def ordered_offsets(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` over all rows in ``order`` (a unique column).

    The rows are range-partitioned on ``order`` and written once to the checkpoint folder, which
    fixes the partition numbers; the sums per partition (as many rows as partitions) are then
    accumulated and added to the running sum inside each partition.
    """
    from ..session import cut_lineage

    placed = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum(amount).alias("_part_sum"))
    # one row per partition: bounded by spark.sql.shuffle.partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_part_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(parts), "_part")
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_part", "_base", "_inside")
    )
