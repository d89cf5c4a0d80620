"""Load state from speed: per segment between change points, and its check against weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHUNK_SECONDS, LOAD_SPEED_MPH, LOADED_WEIGHT_LBS
from ..session import cut_lineage
from .changepoint import METHODS, change_points
from .features import add_features, trip_scan
from .scan import running_totals

TRIP = ["VIN", "trip_local"]


def with_segments(scanned: DataFrame, points: DataFrame) -> DataFrame:
    """Number the segments of each trip (from 0), given the positions of its change points.

    Positions are unique per trip, so the join key spreads a long trip over all partitions; the
    segment number is a running sum carried from chunk to chunk.
    """
    marks = points.select(*TRIP, F.col("position").alias("_i")).distinct().withColumn("_mark", F.lit(1))
    marked = scanned.join(marks, [*TRIP, "_i"], "left")
    mark = F.coalesce(F.col("_mark"), F.lit(0)).cast("long")
    return running_totals(marked, TRIP, "chunk", ["_i"], {"segment": mark}).drop("_mark")


def segment_states(
    segmented: DataFrame, speed: str = "_x0", threshold: float = LOAD_SPEED_MPH
) -> DataFrame:
    """Per segment, its mean speed and state: 0 (unloaded) at or above the threshold, else 1."""
    return (
        segmented.groupBy(*TRIP, "segment")
        .agg(F.count(F.lit(1)).alias("pings"), F.avg(speed).alias("mean_speed"))
        .withColumn("load_state", (F.round("mean_speed", 9) < threshold).cast("int"))
    )


def state_changes(states: DataFrame, by: Sequence[str] = TRIP, state: str = "load_state", order: str = "_i",
                  chunk: str = "chunk") -> DataFrame:
    """Changes between consecutive known states per group; unknown (-1) states are passed over.

    Each (group, chunk) is summarised by its first and last known state and its own changes; the
    changes across chunks are added from those summaries.
    """
    known = F.when(F.col(state) != -1, F.col(state))
    local = Window.partitionBy(*by, chunk).orderBy(order)
    before = F.last(known, True).over(local.rowsBetween(Window.unboundedPreceding, -1))
    at = F.when(known.isNotNull(), F.col(order))
    pieces = (
        states.withColumn("_known", known)
        .withColumn("_turn", F.coalesce((known != before).cast("long"), F.lit(0)))
        .groupBy(*by, chunk)
        .agg(
            F.sum("_turn").alias("_turns"),
            F.min_by("_known", at).alias("_first"),
            F.max_by("_known", at).alias("_last"),
        )
    )
    w = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    across = F.coalesce((F.last("_last", True).over(w) != F.col("_first")).cast("long"), F.lit(0))
    return (
        pieces.withColumn("_across", across)
        .groupBy(*by)
        .agg(F.sum(F.col("_turns") + F.col("_across")).alias("load_change_count"))
    )


def segment_changes(states: DataFrame) -> DataFrame:
    """Load changes per trip from its segment states.

    Neighbouring segments are matched by number, as a join on a key that is unique per segment.
    """
    following = states.select(
        *TRIP, (F.col("segment") + 1).alias("segment"), F.col("load_state").alias("_prev")
    )
    turned = F.coalesce((F.col("_prev") != F.col("load_state")).cast("long"), F.lit(0))
    return (
        states.join(following, [*TRIP, "segment"], "left")
        .groupBy(*TRIP)
        .agg(
            F.sum(turned).alias("load_change_count"),
            F.count(F.lit(1)).alias("segments"),
        )
    )


def add_load_state(
    trips: DataFrame, method: str = "heuristic", chunk_seconds: int = CHUNK_SECONDS, **search
) -> DataFrame:
    """Add ``load_state`` and ``load_change_count`` by the named method.

    ``heuristic`` smooths the speed over three pings; ``pelt`` and ``binseg`` average it between
    change points.
    """
    if method == "heuristic":
        return add_features(trips, ["load_state", "load_change_count"], chunk_seconds=chunk_seconds)
    if method not in METHODS:
        raise ValueError("method must be one of: 'heuristic', 'pelt', 'binseg'")
    scanned = trip_scan(trips, chunk_seconds=chunk_seconds).select(
        *dict.fromkeys([*trips.columns, "chunk"]), "_i", "_x0"
    )
    # written once: the means, the changes and the result all read the segmented rows
    segmented = cut_lineage(with_segments(scanned, change_points(trips, method, **search)))
    states = segment_states(segmented)
    # trip totals are attached to the segments, so the pings are joined once
    described = states.join(segment_changes(states).select(*TRIP, "load_change_count"), TRIP)
    return segmented.join(
        described.select(*TRIP, "segment", "load_state", "load_change_count"), [*TRIP, "segment"]
    ).select(*trips.columns, "load_state", "load_change_count")


def load_confusion(
    rows: DataFrame,
    by: Sequence[str] = (),
    state: str = "load_state",
    weight: str = "Weight_lbs",
    threshold: float = LOADED_WEIGHT_LBS,
) -> DataFrame:
    """Precision, recall and F1 of a load state against reported weights, per group or overall.

    Rows without a weight or with an unknown state are not compared. Groups with fewer than five
    weights or two comparisons give no row.
    """
    weighed = F.col(weight).isNotNull() & ~F.isnan(weight)
    compared = weighed & (F.col(state) != -1)
    truth = F.col(weight) > threshold
    loaded = F.col(state) == 1

    def cell(predicted: Column, actual: Column) -> Column:
        return F.count_if(compared & predicted & actual)

    counts = rows.groupBy(*by).agg(
        F.count_if(weighed).alias("_weights"),
        F.count_if(compared).alias("n_compared"),
        cell(loaded, truth).alias("tp"),
        cell(loaded, ~truth).alias("fp"),
        cell(~loaded, truth).alias("fn"),
        cell(~loaded, ~truth).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    both = F.col("precision") + F.col("recall")
    return (
        counts.where((F.col("_weights") >= 5) & (F.col("n_compared") >= 2))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1", F.when(both > 0, F.col("precision") * F.col("recall") * 2 / both).otherwise(0.0)
        )
        .select(*by, "n_compared", "tp", "fp", "fn", "tn", "precision", "recall", "f1")
    )


def compare_methods(trips: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Per trip and change-point method: change points, load changes and agreement with weights."""
    out = None
    scanned = cut_lineage(
        trip_scan(trips, chunk_seconds=chunk_seconds).select(
            *TRIP, "chunk", "_i", "_x0", "Weight_lbs", "Timestamp", "event_seq", "Speed"
        )
    )
    for method in METHODS:
        segmented = cut_lineage(with_segments(scanned, change_points(scanned, method)))
        states = segment_states(segmented)
        rows = segmented.join(states.select(*TRIP, "segment", "load_state"), [*TRIP, "segment"])
        report = segment_changes(states).select(
            *TRIP, F.lit(method).alias("method"), (F.col("segments") - 1).alias("n_changepoints"),
            "load_change_count",
        ).join(load_confusion(rows, TRIP), TRIP, "left")
        out = report if out is None else out.unionByName(report)
    return out
