"""Read-only data-quality audit of the raw ping text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, outside, parse_number, parse_time, round_half_up
from ..schema import REQUIRED_COLUMNS, SEQUENCE_BLOCK
from .scan import attach


def missing_columns(df: DataFrame) -> DataFrame:
    """One row per required column the table lacks."""
    present = {c.strip() for c in df.columns}
    rows = [(c,) for c in REQUIRED_COLUMNS if c not in present]
    return df.sparkSession.createDataFrame(rows, "column_name string")


def _text(raw: DataFrame, name: str):
    return clean(name) if name in raw.columns else F.lit("")


def validity_columns(raw: DataFrame) -> DataFrame:
    """Per row, the audit's verdicts on timestamp, coordinates and speed."""
    speed_text = _text(raw, "Speed")
    speed = parse_number(speed_text)
    return raw.withColumns(
        {
            "bad_timestamp": parse_time(_text(raw, "Timestamp")).isNull(),
            "bad_latitude": outside(parse_number(_text(raw, "Latitude")), -90, 90),
            "bad_longitude": outside(parse_number(_text(raw, "Longitude")), -180, 180),
            "missing_speed": speed_text == "",
            "negative_speed": F.coalesce(speed < 0, F.lit(False)),
            "invalid_speed": (speed_text != "") & speed.isNull(),
        }
    )


def audit_totals(raw: DataFrame) -> DataFrame:
    """Row, vehicle and defect counts in one pass."""
    vin = F.nullif(_text(raw, "VIN"), F.lit(""))
    checked = validity_columns(raw)
    return checked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(vin).alias("vin_count"),
        *[
            F.count_if(c).alias(c)
            for c in (
                "bad_timestamp",
                "bad_latitude",
                "bad_longitude",
                "missing_speed",
                "negative_speed",
                "invalid_speed",
            )
        ],
    )


def missingness(raw: DataFrame, flag_above: float = 5.0) -> DataFrame:
    """Per required column: empty cells, their share in percent, and whether to take note."""
    counts = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_text(raw, c) == "").alias(c) for c in REQUIRED_COLUMNS],
    )
    pct = round_half_up(F.col("missing") / F.nullif(F.col("rows"), F.lit(0)) * 100, 3)
    return (
        counts.unpivot(["rows"], REQUIRED_COLUMNS, "column_name", "missing")
        .select("column_name", "missing", F.coalesce(pct, F.lit(0.0)).alias("missing_pct"))
        .withColumn("flagged", F.col("missing_pct") > flag_above)
    )


def rows_per_vin(raw: DataFrame) -> DataFrame:
    vin = _text(raw, "VIN")
    return raw.where(vin != "").groupBy(vin.alias("VIN")).agg(F.count(F.lit(1)).alias("n"))


def extreme_vins(raw: DataFrame, k: int = 10, most: bool = True) -> DataFrame:
    """The ``k`` vehicles with most (or fewest) rows; equal counts in VIN order."""
    order = F.desc("n") if most else F.asc("n")
    return rows_per_vin(raw).orderBy(order, "VIN").limit(k)


def weight_coverage(raw: DataFrame) -> DataFrame:
    """Per vehicle: rows, rows with a weight, and their share in percent."""
    vin = _text(raw, "VIN")
    return (
        raw.where(vin != "")
        .groupBy(vin.alias("VIN"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(_text(raw, "Weight_lbs") != "").alias("with_weight"),
        )
        .withColumn("coverage_pct", round_half_up(F.col("with_weight") / F.col("n") * 100, 3))
    )


def coverage_rollup(raw: DataFrame) -> DataFrame:
    """Rows, vehicles, weight coverage and missing speeds per (source, vehicle), per source and overall.

    ``level`` tells a total from an empty value: 0 one vehicle of a source, 1 a source, 3 the whole
    table (an empty table has no rows at any level). The raw rows are aggregated once, inside the tasks first; the grouping
    sets expand only the rows per (source, vehicle).
    """
    per_vin = raw.groupBy(_text(raw, "Source").alias("Source"), _text(raw, "VIN").alias("VIN")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_text(raw, "Weight_lbs") != "").alias("with_weight"),
        F.count_if(_text(raw, "Speed") == "").alias("missing_speed"),
    )
    named = per_vin.withColumn("_vehicle", F.nullif(F.col("VIN"), F.lit("")))
    return (
        named.rollup("Source", "VIN")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("n"),
            F.count_distinct("_vehicle").alias("vehicles"),
            F.sum("with_weight").alias("with_weight"),
            F.sum("missing_speed").alias("missing_speed"),
        )
        .where(F.col("n").isNotNull())
        .withColumn("coverage_pct", round_half_up(F.col("with_weight") / F.col("n") * 100, 3))
    )


def coverage_extremes(raw: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` vehicles of lowest and of highest weight coverage."""
    per_vin = weight_coverage(raw)
    low = per_vin.orderBy("coverage_pct", "VIN").limit(k).withColumn("side", F.lit("lowest"))
    high = per_vin.orderBy(F.desc("coverage_pct"), "VIN").limit(k).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def weight_verdict(raw: DataFrame, missing_above: float = 10.0, spread_above: float = 30.0) -> DataFrame:
    """Overall weight coverage, its spread over vehicles, and whether weights look event-driven.

    One aggregation per vehicle; the overall figures are rolled up from it together with the
    rows that carry no vehicle. An empty table gives nulls.
    """
    vin, weight = _text(raw, "VIN"), _text(raw, "Weight_lbs")
    per_vin = raw.groupBy(vin.alias("VIN")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(weight != "").alias("with_weight")
    )
    pct = F.when(F.col("VIN") != "", round_half_up(F.col("with_weight") / F.col("n") * 100, 3))
    rows, present = F.sum("n"), F.sum("with_weight")
    return (
        per_vin.agg(
            round_half_up(present / F.nullif(rows, F.lit(0)) * 100, 3).alias("overall_pct"),
            round_half_up((rows - present) / F.nullif(rows, F.lit(0)) * 100, 3).alias("missing_pct"),
            F.min(pct).alias("lowest_pct"),
            F.max(pct).alias("highest_pct"),
        )
        .withColumn("spread_pct", F.col("highest_pct") - F.col("lowest_pct"))
        .withColumn(
            "event_driven",
            (F.col("missing_pct") > missing_above) & (F.col("spread_pct") > spread_above),
        )
    )


def _block_before(ends: DataFrame, group_blocks: int) -> DataFrame:
    """``_carried``: the end of the block before each, wherever numbers were left out.

    Blocks are worked in groups; across groups only one row per group is ordered, that is one for
    ``group_blocks`` times the rows of a block.
    """
    grouped = ends.withColumn("_group", F.expr(f"_block div {int(group_blocks)}L"))
    tails = grouped.groupBy("_group").agg(F.max_by("_end", "_block").alias("_tail"))
    earlier = tails.select("_group", F.lag("_tail").over(Window.orderBy("_group")).alias("_earlier"))
    inside = F.lag("_end").over(Window.partitionBy("_group").orderBy("_block"))
    return grouped.withColumn("_inside", inside).join(earlier, "_group").select(
        "_block", F.coalesce("_inside", "_earlier").alias("_carried")
    )


def adjacent_duplicates(raw: DataFrame, block_rows: int = 1_000_000, group_blocks: int = 4096) -> DataFrame:
    """Rows whose vehicle, time and position text equal the row just before them in file order.

    File order ignores vehicles, so the rows are cut into blocks of consecutive sequence numbers;
    only each block's last row is looked at from outside (one row per block, in groups of blocks).
    """
    rows = raw.select(
        "event_seq", *[_text(raw, c).alias(c) for c in ("VIN", "Timestamp", "Latitude", "Longitude")]
    ).withColumn("_block", F.expr(f"event_seq div {int(block_rows)}L"))
    content = F.struct("VIN", "Timestamp", "Latitude", "Longitude")
    ends = rows.groupBy("_block").agg(F.max_by(content, "event_seq").alias("_end"))
    carried = _block_before(ends, group_blocks)
    before = F.lag(content).over(Window.partitionBy("_block").orderBy("event_seq"))
    return (
        attach(rows.withColumn("_before", before), carried, ["_block"])
        .where(F.coalesce(F.col("_before"), F.col("_carried")) == content)
        .select("event_seq", "VIN", "Timestamp", "Latitude", "Longitude")
    )


def out_of_order(raw: DataFrame, block_rows: int = SEQUENCE_BLOCK) -> DataFrame:
    """Rows earlier than the vehicle's previous readable row in arrival order.

    Blocks of sequence numbers split a hot vehicle; the last time of each (vehicle, block) is
    carried into the vehicle's next block.
    """
    rows = (
        raw.select(
            "event_seq",
            _text(raw, "VIN").alias("VIN"),
            F.unix_micros(parse_time(_text(raw, "Timestamp"))).alias("_us"),
        )
        .where((F.col("VIN") != "") & F.col("_us").isNotNull())
        .withColumn("_block", F.expr(f"event_seq div {int(block_rows)}L"))
    )
    ends = rows.groupBy("VIN", "_block").agg(F.max_by("_us", "event_seq").alias("_end"))
    carried = ends.select(
        "VIN", "_block", F.lag("_end").over(Window.partitionBy("VIN").orderBy("_block")).alias("_carried")
    )
    before = F.lag("_us").over(Window.partitionBy("VIN", "_block").orderBy("event_seq"))
    return (
        attach(rows.withColumn("_before", before), carried, ["VIN", "_block"])
        .withColumn("previous_us", F.coalesce("_before", "_carried"))
        .where(F.col("_us") < F.col("previous_us"))
        .select("VIN", "event_seq", F.col("_us").alias("ts_us"), "previous_us")
    )


def out_of_order_vins(raw: DataFrame, block_rows: int = SEQUENCE_BLOCK) -> DataFrame:
    """Per vehicle, how many rows arrived out of time order."""
    return out_of_order(raw, block_rows).groupBy("VIN").agg(F.count(F.lit(1)).alias("n"))


def fleet_counts(trips: DataFrame) -> DataFrame:
    """Rows, vehicles and trips of a segmented table.

    Both distinct counts come from one pass: trips are made distinct first, with map-side
    combining, and the rest is counted on the trip list.
    """
    per_trip = trips.groupBy("VIN", "trip_local").agg(F.count(F.lit(1)).alias("n"))
    return per_trip.groupBy("VIN").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("vehicles"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("trips"),
    )
