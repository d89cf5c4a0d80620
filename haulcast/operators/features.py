"""Per-trip features, the arrival label and the trip scan they are built on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..schema import (
    CHUNK_SECONDS,
    FEATURE_COLS,
    LOAD_SPEED_MPH,
    LOAD_WINDOW_PINGS,
    ROLLING_PINGS,
    STOP_SPEED_MPH,
)
from .scan import NO_TIME, attach, with_time_chunk
from .trips import ORDER, effective_speed

TRIP_KEY = ("VIN", "trip_local")
_BACK = ROLLING_PINGS - 1  # earlier pings a rolling statistic looks at


def is_low(mean: str) -> str:
    """SQL: 1 where a mean speed is below the load threshold, else 0."""
    return f"cast(round({mean}, 9) < {LOAD_SPEED_MPH} AS int)"


def mean_of(middle: str, *neighbours: str) -> str:
    """SQL: mean of a speed and those of its neighbours that exist."""
    total = " + ".join([middle, *[f"coalesce({c}, 0D)" for c in neighbours]])
    count = " + ".join(["1", *[f"int({c} IS NOT NULL)" for c in neighbours]])
    return f"(({total}) / ({count}))"


def _local_columns(trips: DataFrame, group: list[str], stop_mph: float) -> DataFrame:
    """Ordered columns that need only the pings of one (trip, chunk)."""
    w = Window.partitionBy(*group).orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = haversine_km("_llat", "_llon", "Latitude", "Longitude")
    return (
        trips.withColumn("_sp", effective_speed())
        .withColumns(
            {
                "_idx": F.row_number().over(w) - 1,
                **{f"_l{k}": F.lag("_sp", k).over(w) for k in range(1, _BACK + 1)},
                "_n1": F.lead("_sp").over(w),
                "_tail": F.lead(F.lit(1)).over(w).isNull(),
                "_llat": F.lag("Latitude").over(w),
                "_llon": F.lag("Longitude").over(w),
                "_lmax": F.max("_sp").over(upto),
                "_lmv": F.sum((F.col("_sp") >= stop_mph).cast("long")).over(upto),
                "_lat_seen": F.last("Latitude", True).over(upto),
                "_lon_seen": F.last("Longitude", True).over(upto),
            }
        )
        .withColumn("_step", step)
        .withColumn("_lkm", F.sum("_step").over(upto))
    )


def _pieces(local: DataFrame, group: list[str]) -> DataFrame:
    """One summary row per (trip, chunk), by aggregation on the existing partitioning."""
    head, tail, inner = "_idx = 0", "_tail", "_n1 IS NOT NULL"
    here = is_low("(_l1 + _sp + _n1) / 3")
    before = is_low("(_l2 + _l1 + _sp) / 3")

    def at(where: str, value: str) -> Column:
        return F.expr(f"max(CASE WHEN {where} THEN {value} END)")

    return local.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.max("_sp").alias("max_sp"),
        F.max("_lmv").alias("moving"),
        F.sum("_step").alias("km"),
        at(head, "_sp").alias("sp_first"),
        at(head, "_n1").alias("sp_second"),
        at(head, "Latitude").alias("lat_first"),
        at(head, "Longitude").alias("lon_first"),
        at(tail, "Latitude").alias("lat_last"),
        at(tail, "Longitude").alias("lon_last"),
        at(tail, "_lat_seen").alias("lat_seen"),
        at(tail, "_lon_seen").alias("lon_seen"),
        at(tail, "_sp").alias("tail1"),
        *[at(tail, f"_l{k}").alias(f"tail{k + 1}") for k in range(1, _BACK)],
        # load states whose three pings all lie inside the piece
        at(f"_idx = 1 AND {inner}", here).alias("state_second"),
        at(f"{tail} AND _idx >= 2", before).alias("state_penult"),
        F.expr(f"count_if(_idx >= 2 AND {inner} AND {here} <> {before})").alias("inner_changes"),
    )


def _carries(pieces: DataFrame, key: Sequence[str], group: list[str]) -> DataFrame:
    """Values carried into each piece from the other pieces of its trip, and trip totals."""
    w = Window.partitionBy(*key).orderBy("chunk")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = F.array_compact(F.array(*[F.col(f"tail{k}") for k in range(1, _BACK + 1)]))
    zero = F.lit(0)
    df = pieces.withColumns(
        {
            "c_n": F.coalesce(F.sum("n").over(earlier), zero),
            "t_n": F.sum("n").over(whole),
            "t_start": F.min("first_us").over(whole),
            "t_end": F.max("last_us").over(whole),
            "c_max": F.max("max_sp").over(earlier),
            "c_mv": F.coalesce(F.sum("moving").over(earlier), zero),
            "t_mv": F.sum("moving").over(whole),
            "dest_lat": F.last("lat_seen", True).over(whole),
            "dest_lon": F.last("lon_seen", True).over(whole),
            "p_lat": F.lag("lat_last").over(w),
            "p_lon": F.lag("lon_last").over(w),
            "p_sp": F.lag("tail1").over(w),
            "n_sp": F.lead("sp_first").over(w),
            # newest first: at most _BACK earlier pieces of at most _BACK speeds each
            "halo": F.flatten(
                F.reverse(F.collect_list(tails).over(w.rowsBetween(-_BACK, -1)))
            ),
            "link_km": haversine_km(
                F.lag("lat_last").over(w), F.lag("lon_last").over(w), "lat_first", "lon_first"
            ),
        }
    ).withColumns(
        {
            "c_km": F.coalesce(F.sum("km").over(earlier), F.lit(0.0))
            + F.coalesce(
                F.sum("link_km").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)
            ),
            "t_km": F.coalesce(F.sum("km").over(whole), F.lit(0.0))
            + F.coalesce(F.sum("link_km").over(whole), F.lit(0.0)),
        }
    )
    # load changes: states at the two ends of a piece depend on the neighbouring pieces
    def end_state(speed: str, *neighbours: str) -> Column:
        low = f"cast({speed} < {LOAD_SPEED_MPH} AS int)"
        smoothed = is_low(mean_of(speed, *neighbours))
        return F.expr(f"CASE WHEN t_n < {LOAD_WINDOW_PINGS} THEN {low} ELSE {smoothed} END")

    df = df.withColumns(
        {
            "_next": F.expr("CASE WHEN n = 1 THEN n_sp ELSE sp_second END"),
            "_prev": F.expr("CASE WHEN n = 1 THEN p_sp ELSE tail2 END"),
        }
    ).withColumns(
        {
            "s_first": end_state("sp_first", "p_sp", "_next"),
            "s_last": end_state("tail1", "_prev", "n_sp"),
        }
    )
    inside = F.expr(
        """CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN int(s_first <> s_last)
        ELSE inner_changes + int(s_first <> state_second) + int(state_penult <> s_last) END"""
    )
    across = F.coalesce((F.lag("s_last").over(w) != F.col("s_first")).cast("long"), zero)
    df = df.withColumn("_piece_changes", inside + across)
    return df.select(
        *group,
        "c_n", "t_n", "t_start", "t_end", "c_max", "c_mv", "t_mv", "dest_lat", "dest_lon",
        "p_lat", "p_lon", "n_sp", "halo", "c_km", "t_km",
        F.sum("_piece_changes").over(whole).alias("changes"),
    )


def trip_scan(
    trips: DataFrame,
    key: Sequence[str] = TRIP_KEY,
    chunk_seconds: int = CHUNK_SECONDS,
    stop_mph: float = STOP_SPEED_MPH,
) -> DataFrame:
    """Add the ordered per-trip values every feature is made of, as ``_`` columns.

    ``_i`` position from 0, ``_n`` pings of the trip, ``_x0.._x4`` this and the four earlier
    speeds, ``_nx`` next speed, ``_us`` / ``_start`` / ``_end`` times in microseconds, ``_max``
    running top speed, ``_mv`` / ``_mv_total`` moving pings so far / in all, ``_plat, _plon``
    previous position, ``_km`` / ``_km_total`` path so far / in all, ``_dest_lat, _dest_lon`` last
    known position, ``_changes`` load changes of the trip. Unused ones are pruned by Catalyst,
    together with the windows behind them.
    """
    if "event_seq" not in trips.columns:
        trips = trips.withColumn("event_seq", F.lit(0))
    if "chunk" in trips.columns:
        rows = trips.withColumn("_t", F.coalesce(F.unix_micros("Timestamp"), F.lit(NO_TIME)))
    else:
        rows = with_time_chunk(trips, chunk_seconds)
    rows = rows.withColumn("_us", F.unix_micros("Timestamp"))
    # vehicle and chunk first: the order segmentation already shuffled by
    group = [key[0], "chunk", *key[1:]]
    local = _local_columns(rows, group, stop_mph)
    carries = _carries(_pieces(local, group), key, group)
    df = attach(local, carries, group)

    earlier = [
        f"CASE WHEN _idx >= {k} THEN _l{k} ELSE get(halo, {k - 1} - _idx) END AS _x{k}"
        for k in range(1, _BACK + 1)
    ]
    return df.selectExpr(
        *[f"`{c}`" for c in trips.columns],
        *([] if "chunk" in trips.columns else ["chunk"]),
        "_us",
        "c_n + _idx AS _i",
        "t_n AS _n",
        "_sp AS _x0",
        *earlier,
        "CASE WHEN _tail THEN n_sp ELSE _n1 END AS _nx",
        "t_start AS _start",
        "t_end AS _end",
        "greatest(_lmax, c_max) AS _max",
        "_lmv + c_mv AS _mv",
        "t_mv AS _mv_total",
        "CASE WHEN _idx = 0 THEN p_lat ELSE _llat END AS _plat",
        "CASE WHEN _idx = 0 THEN p_lon ELSE _llon END AS _plon",
        "coalesce(_lkm, 0D) + c_km AS _km",
        "t_km AS _km_total",
        "dest_lat AS _dest_lat",
        "dest_lon AS _dest_lon",
        "changes AS _changes",
    )


# --- feature expressions over a trip scan -------------------------------------------------


def elapsed_s() -> Column:
    return F.expr("(_us - _start) / 1e6D")


def eta_remaining_s() -> Column:
    return F.expr("(_end - _us) / 1e6D")


# the speeds looked back at are contiguous, so their number follows from the position
_SPEEDS = [f"_x{k}" for k in range(ROLLING_PINGS)]
_SPEED_COUNT = f"least(_i + 1, {ROLLING_PINGS})"
_SPEED_MEAN = "((" + " + ".join(f"coalesce({x}, 0D)" for x in _SPEEDS) + f") / {_SPEED_COUNT})"


def rolling_mean() -> Column:
    return F.expr(_SPEED_MEAN)


def rolling_std() -> Column:
    """Sample standard deviation of the recent speeds; 0 for a single ping."""
    squares = " + ".join(f"coalesce(pow({x} - {_SPEED_MEAN}, 2), 0D)" for x in _SPEEDS)
    return F.expr(f"CASE WHEN _i > 0 THEN sqrt(({squares}) / ({_SPEED_COUNT} - 1)) ELSE 0D END")


def hour_of_day() -> Column:
    """Hours with minutes as a fraction; seconds are ignored."""
    return F.expr("hour(Timestamp) + minute(Timestamp) / 60D")


def day_turn() -> Column:
    """Time of day as an angle."""
    return F.lit(2 * pi) * hour_of_day() / F.lit(24.0)


def load_state() -> Column:
    """1 (loaded, slow) or 0 from the centred three-ping mean; raw speed in very short trips."""
    smoothed = is_low(mean_of("_x0", "_x1", "_nx"))
    raw = f"cast(_x0 < {LOAD_SPEED_MPH} AS int)"
    return F.expr(f"CASE WHEN _n < {LOAD_WINDOW_PINGS} THEN {raw} ELSE {smoothed} END")


def weight_flag(df: DataFrame) -> Column:
    """1 where a weight was reported; 0 for all rows when the column is absent."""
    if "Weight_lbs" not in df.columns:
        return F.lit(0)
    return F.nanvl(F.col("Weight_lbs").cast("double"), F.lit(None)).isNotNull().cast("int")


FEATURE_EXPRESSIONS: dict[str, Callable[[DataFrame], Column]] = {
    "elapsed_s": lambda df: elapsed_s(),
    "speed_rolling_mean": lambda df: rolling_mean(),
    "speed_rolling_std": lambda df: rolling_std(),
    "speed_cummax": lambda df: F.col("_max"),
    "dist_remaining_km": lambda df: haversine_km("Latitude", "Longitude", "_dest_lat", "_dest_lon"),
    "hour_sin": lambda df: F.sin(day_turn()),
    "hour_cos": lambda df: F.cos(day_turn()),
    "dow": lambda df: F.weekday("Timestamp"),
    "has_weight": weight_flag,
    "trip_progress": lambda df: F.expr("_i / greatest(_n - 1, 1)"),
    "load_state": lambda df: load_state(),
    "load_change_count": lambda df: F.col("_changes"),
}


def add_features(
    trips: DataFrame,
    names: Sequence[str] = tuple(FEATURE_COLS),
    key: Sequence[str] = TRIP_KEY,
    min_pings: int | None = None,
    label: bool = False,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add the named features (default: all) and, on request, the arrival label.

    ``min_pings`` drops trips shorter than that in the same scan; features look only at pings of
    the same trip, so filtering first or afterwards gives the same rows.
    """
    scanned = trip_scan(trips, key, chunk_seconds)
    if min_pings is not None:
        scanned = scanned.where(F.col("_n") >= min_pings)
    chosen = {name: FEATURE_EXPRESSIONS[name](scanned) for name in names}
    if label:
        chosen["eta_remaining_s"] = eta_remaining_s()
        chosen["eta_remaining_min"] = eta_remaining_s() / 60.0
    return scanned.select(*trips.columns, *[c.alias(name) for name, c in chosen.items()])


def build_features(trips: DataFrame, **options) -> DataFrame:
    """Original columns plus every column of ``FEATURE_COLS``."""
    return add_features(trips, FEATURE_COLS, **options)


def drop_incomplete(features: DataFrame) -> DataFrame:
    """Drop rows with a missing feature or label.

    Only the times and the position can make a feature missing: speeds, weights and counts have
    values for every ping. Testing those three columns instead of all thirteen keeps the other
    feature expressions out of the filter.
    """
    distance = F.col("dist_remaining_km")
    known = F.col("elapsed_s").isNotNull() & F.col("eta_remaining_s").isNotNull()
    return features.where(known & distance.isNotNull() & ~F.isnan(distance))
