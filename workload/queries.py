"""The registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions import eta, text
from haulcast.functions.geo import haversine_km
from haulcast.operators import (
    audit,
    backoff,
    calibrate,
    cells,
    changepoint,
    clusters,
    extras,
    features,
    loadstate,
    metrics,
    models,
    motion,
    quantiles,
    sketches,
)
from haulcast.operators.models import trip_split
from haulcast.operators.routes import join_destinations, route_asof, route_refreshes
from haulcast.operators.trips import keep_long_trips, segment_trips, trip_label
from haulcast.plans import ledger, scoring, training
from haulcast.plans.segment import numbered_trips
from haulcast.schema import MIN_TRIP_PINGS
from haulcast.session import configure, cut_lineage
from haulcast.sources import derived, trip_index
from haulcast.sources import pings as ping_source
from haulcast.sources.events import event_pings
from haulcast.sources.requests import parse_requests
from haulcast.streaming import replay
from haulcast.streaming.closing import archive, stream_closed_trips
from haulcast.streaming.features import split_late, stream_features
from haulcast.streaming.trips import drop_repeats, stream_trips

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["VIN", "trip_local", "event_seq"]


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def r6(value: Column | str, digits: int = 6) -> Column:
    return text.round_half_up(F.col(value) if isinstance(value, str) else value, digits)


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """All double columns rounded, except those to keep."""
    return df.select(
        *[
            r6(c, digits).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


def ping_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "VIN",
        "event_seq",
        F.unix_micros("Timestamp").alias("ts_us"),
        r6("Latitude").alias("lat"),
        r6("Longitude").alias("lon"),
        r6("Speed").alias("speed"),
        F.col("Weight_lbs").alias("weight_lbs"),
        F.col("Device_Type").alias("device_type"),
        F.col("Source").alias("source"),
        *more,
    )


def trips(spark: SparkSession, sf_dir: str, **rule) -> DataFrame:
    return derived.event_trips(spark, sf_dir, **rule)


def kept_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_long_trips(trips(spark, sf_dir))


def trip_ends(rows: DataFrame) -> DataFrame:
    """Last known position of each trip."""
    at = F.struct("Timestamp", "event_seq")
    return rows.groupBy("VIN", "trip_local").agg(
        F.max_by("Latitude", F.when(F.col("Latitude").isNotNull(), at)).alias("destination_latitude"),
        F.max_by("Longitude", F.when(F.col("Longitude").isNotNull(), at)).alias("destination_longitude"),
    )


def with_features(spark: SparkSession, sf_dir: str, *names: str, label: bool = False) -> DataFrame:
    return features.add_features(
        trips(spark, sf_dir), names, min_pings=MIN_TRIP_PINGS, label=label
    )


# --- sources ------------------------------------------------------------------------------


@query("read_pings")
def _(spark, sf_dir):
    """Ping CSV round trip: written with padded names, read typed with stripped names."""
    path = ping_source.scratch_path(spark, "pings-csv")
    p = event_pings(spark, sf_dir)
    out = p.withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    out.toDF(*[f" {c}" for c in out.columns]).write.option("header", True).csv(path)
    return ping_columns(ping_source.read_pings(spark, path))


@query("read_raw_strings")
def _(spark, sf_dir):
    """Text CSV with padded cells; the arrival order is the position over all files."""
    path = ping_source.scratch_path(spark, "raw-csv")
    p = event_pings(spark, sf_dir)
    (
        p.select(
            F.concat(F.lit("  "), "VIN").alias(" VIN"),
            F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts "),
            F.concat("Source", F.lit("  ")).alias("source"),
            "event_seq",
        )
        .repartitionByRange(4, "event_seq")
        .sortWithinPartitions("event_seq")
        .drop("event_seq")
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return ping_source.read_raw_strings(spark, path)


@query("write_trips")
def _(spark, sf_dir):
    """Trips written by day and counted per day from the files."""
    path = ping_source.scratch_path(spark, "trips")
    ping_source.write_trips(kept_trips(spark, sf_dir), path)
    return ping_source.read_trips(spark, path).groupBy("trip_date").agg(F.count(F.lit(1)).alias("n"))


@query("read_trips")
def _(spark, sf_dir):
    path = ping_source.scratch_path(spark, "trips")
    ping_source.write_trips(kept_trips(spark, sf_dir), path)
    return ping_columns(ping_source.read_trips(spark, path), "trip_local")


@query("required_columns")
def _(spark, sf_dir):
    """The events table seen as raw pings lacks most of the required columns."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("Source")
    )
    return audit.missing_columns(raw)


@query("trip_point_lookup")
def _(spark, sf_dir):
    """All pings of the first trip, looked up in the written trip table."""
    path = ping_source.scratch_path(spark, "trips")
    ping_source.write_trips(kept_trips(spark, sf_dir), path)
    table = ping_source.read_trips(spark, path)
    first = ping_source.trip_list(table).first()
    return ping_columns(ping_source.trip_rows(table, first["VIN"], first["trip_local"]), "trip_local")


@query("trip_point_lookup_indexed")
def _(spark, sf_dir):
    """The same pings, read from the files that the side index names for the trip."""
    path, index = ping_source.scratch_path(spark, "trips"), ping_source.scratch_path(spark, "trip-index")
    ping_source.write_trips(kept_trips(spark, sf_dir), path)
    trip_index.write_trip_index(spark, path, index)
    first = ping_source.trip_list(ping_source.read_trips(spark, path)).first()
    found = trip_index.indexed_trip_rows(spark, path, index, first["VIN"], first["trip_local"])
    return ping_columns(found, "trip_local")


@query("trip_list")
def _(spark, sf_dir):
    return ping_source.trip_list(kept_trips(spark, sf_dir))


# --- scalar functions ---------------------------------------------------------------------


@query("haversine")
def _(spark, sf_dir):
    p = event_pings(spark, sf_dir)
    km = haversine_km("Latitude", "Longitude", F.lit(40.7128), F.lit(-74.0060))
    return p.select("event_seq", r6(km).alias("km"))


@query("naive_eta")
def _(spark, sf_dir):
    df = with_features(spark, sf_dir, "dist_remaining_km")
    value = eta.naive_eta_min(F.col("dist_remaining_km"), F.col("Speed"))
    return df.select(*KEY, r6(value).alias("naive_eta_min"))


@query("time_encoding")
def _(spark, sf_dir):
    df = event_pings(spark, sf_dir)
    turn = features.day_turn()
    return df.select(
        "event_seq",
        r6(F.sin(turn)).alias("hour_sin"),
        r6(F.cos(turn)).alias("hour_cos"),
        F.weekday("Timestamp").alias("dow"),
    )


@query("weight_flag")
def _(spark, sf_dir):
    df = event_pings(spark, sf_dir)
    return df.select("event_seq", features.weight_flag(df).alias("has_weight"))


@query("label_minutes")
def _(spark, sf_dir):
    df = with_features(spark, sf_dir, label=True)
    return df.select(*KEY, r6(eta.to_minutes(F.col("eta_remaining_s"))).alias("eta_remaining_min"))


@query("format_hhmm")
def _(spark, sf_dir):
    df = derived.predictions(spark, sf_dir)
    return df.select(*KEY, text.format_hhmm(F.col("p50") - 30).alias("hhmm"))


@query("eta_status")
def _(spark, sf_dir):
    df = derived.predictions(spark, sf_dir)
    half = eta.band_half_width(F.col("p10"), F.col("p50"), F.col("p90"))
    return df.select(*KEY, eta.eta_status(F.col("p50")).alias("status"), r6(half).alias("half_width"))


@query("interval_scale_apply")
def _(spark, sf_dir):
    low, high = eta.scaled_interval(F.col("p10"), F.col("p90"), 1.25)
    return derived.predictions(spark, sf_dir).select(*KEY, r6(low).alias("low"), r6(high).alias("high"))


@query("near_weights")
def _(spark, sf_dir):
    return derived.predictions(spark, sf_dir).select(
        *KEY, eta.near_arrival_weight(F.col("y")).alias("weight")
    )


@query("near_blend_apply")
def _(spark, sf_dir):
    value = eta.near_blend(F.col("p50"), F.col("p10"), F.col("naive"), 120.0, 0.75)
    return derived.predictions(spark, sf_dir).select(*KEY, r6(value).alias("blended"))


@query("digitize")
def _(spark, sf_dir):
    value = eta.bucket_index(F.col("p50"), [0, 10, 30, 60, 240, 1000])
    return derived.predictions(spark, sf_dir).select(*KEY, value.alias("bucket"))


@query("route_duration_parse")
def _(spark, sf_dir):
    """Stored route responses, some without the unit or a number."""
    p = event_pings(spark, sf_dir).where(F.col("Source") == "view")
    k = F.round((F.col("Latitude") - F.floor("Latitude")) * 100).cast("int")
    seconds = (F.lit(300) + k * 10).cast("string")
    duration = (
        F.when(F.col("event_seq") % 7 == 0, seconds)
        .when(F.col("event_seq") % 11 == 0, F.lit("soons"))
        .otherwise(F.concat(seconds, F.lit("s")))
    )
    response = F.to_json(F.struct(F.array(F.struct(duration.alias("duration"))).alias("routes")))
    return p.select("event_seq", r6(eta.route_duration_min(response)).alias("minutes"))


@query("trip_label")
def _(spark, sf_dir):
    return (
        trips(spark, sf_dir)
        .select("VIN", "trip_local", trip_label(F.col("VIN"), F.col("trip_local")).alias("label"))
        .distinct()
    )


@query("api_budget")
def _(spark, sf_dir):
    """Budget of each observed day at several ping intervals and refresh ratios."""
    daily = (
        event_pings(spark, sf_dir)
        .groupBy(F.to_date("Timestamp").alias("day"))
        .agg(
            F.count_distinct("VIN").alias("trucks"),
            F.count_distinct(F.hour("Timestamp")).cast("double").alias("hours"),
        )
    )
    scenarios = daily.select(
        "*", F.explode(F.array(*[F.lit(v) for v in (10.0, 30.0, 60.0)])).alias("interval_s")
    ).select("*", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.1, 0.15, 1.0)])).alias("ratio"))
    columns = eta.budget_columns(
        F.col("trucks"), F.col("interval_s"), F.col("hours"), F.col("ratio"), F.lit(5.0), F.lit(2000.0)
    )
    return scenarios.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "trucks",
        "interval_s",
        "ratio",
        *[c.alias(n) if n.endswith("_ok") else r6(c).alias(n) for n, c in columns.items()],
    )


@query("quota_ceiling")
def _(spark, sf_dir):
    """Fleet ceiling at each vehicle's observed mean ping interval."""
    per_vin = event_pings(spark, sf_dir).groupBy("VIN").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.unix_micros("Timestamp")) - F.min(F.unix_micros("Timestamp"))).alias("span"),
    )
    interval = F.col("span") / F.lit(1e6) / F.nullif(F.col("n") - 1, F.lit(0))
    return per_vin.select("VIN", r6(eta.max_trucks(interval)).alias("max_trucks"))


# --- filters ------------------------------------------------------------------------------


@query("drop_incomplete")
def _(spark, sf_dir):
    p = event_pings(spark, sf_dir).withColumn(
        "Latitude", F.when(F.col("event_seq") % 13 != 0, F.col("Latitude"))
    )
    built = features.build_features(segment_trips(p), min_pings=MIN_TRIP_PINGS, label=True)
    return features.drop_incomplete(built).select(*KEY, r6("dist_remaining_km").alias("dist_remaining_km"))


@query("short_trip_filter")
def _(spark, sf_dir):
    return kept_trips(spark, sf_dir).select(*KEY)


@query("valid_timestamp")
def _(spark, sf_dir):
    return audit.validity_columns(derived.raw_text_pings(spark, sf_dir)).select(
        "event_seq", "bad_timestamp"
    )


@query("valid_coordinates")
def _(spark, sf_dir):
    return audit.validity_columns(derived.raw_text_pings(spark, sf_dir)).select(
        "event_seq", "bad_latitude", "bad_longitude"
    )


@query("valid_speed")
def _(spark, sf_dir):
    return audit.validity_columns(derived.raw_text_pings(spark, sf_dir)).select(
        "event_seq", "missing_speed", "negative_speed", "invalid_speed"
    )


@query("near_arrival_filter")
def _(spark, sf_dir):
    return derived.predictions(spark, sf_dir).where(F.col("y") <= 60).select(*KEY, r6("y").alias("y"))


@query("prefix_asof")
def _(spark, sf_dir):
    """What is known of each trip when its fourth ping arrives."""
    scanned = features.trip_scan(trips(spark, sf_dir)).where(F.col("_n") >= MIN_TRIP_PINGS)
    return motion.seen_until(scanned, 3, "_i").select(*KEY)


# --- joins --------------------------------------------------------------------------------


@query("route_asof")
def _(spark, sf_dir):
    return route_asof(event_pings(spark, sf_dir), derived.route_offers(spark, sf_dir)).select(
        "event_seq", "VIN", r6("route_eta_min").alias("route_eta_min")
    )


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route calls of all trips; places to whole degrees, as the adapted positions jump inside one."""
    rows = kept_trips(spark, sf_dir)
    return route_refreshes(join_destinations(rows, trip_ends(rows)), digits=0)


@query("route_refresh")
def _(spark, sf_dir):
    return refreshed(spark, sf_dir).select(*KEY, "refresh", "served_by")


@query("route_call_budget")
def _(spark, sf_dir):
    """Budget of each day at the share of pings that asked the route service."""
    daily = (
        refreshed(spark, sf_dir)
        .groupBy(F.to_date("Timestamp").alias("day"))
        .agg(
            F.count_distinct("VIN").alias("trucks"),
            F.count_distinct(F.hour("Timestamp")).cast("double").alias("hours"),
            F.count_if("refresh").alias("calls"),
            F.count(F.lit(1)).alias("pings"),
        )
    )
    columns = eta.budget_columns(
        F.col("trucks"), F.lit(30.0), F.col("hours"), F.col("calls") / F.col("pings"), F.lit(5.0), F.lit(2000.0)
    )
    return daily.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "calls",
        "pings",
        *[c.alias(n) if n.endswith("_ok") else r6(c).alias(n) for n, c in columns.items()],
    )


@query("trip_backjoin")
def _(spark, sf_dir):
    """Trip aggregates attached to the trip's rows."""
    return (
        features.trip_scan(trips(spark, sf_dir))
        .where(F.col("_n") >= MIN_TRIP_PINGS)
        .select(*KEY, F.col("_n").alias("trip_pings"), F.col("_start").alias("start_us"))
    )


@query("destination_join")
def _(spark, sf_dir):
    """Last known position of each trip as a destination table, joined to the trip's pings."""
    rows = kept_trips(spark, sf_dir)
    return join_destinations(rows.select(*KEY), trip_ends(rows)).select(
        *KEY,
        r6("destination_latitude").alias("destination_latitude"),
        r6("destination_longitude").alias("destination_longitude"),
    )


# --- audit --------------------------------------------------------------------------------


@query("audit_totals")
def _(spark, sf_dir):
    return audit.audit_totals(derived.raw_text_pings(spark, sf_dir))


@query("audit_missingness")
def _(spark, sf_dir):
    return audit.missingness(derived.raw_text_pings(spark, sf_dir))


@query("rows_per_vin")
def _(spark, sf_dir):
    return audit.rows_per_vin(derived.raw_text_pings(spark, sf_dir))


@query("coverage_rollup")
def _(spark, sf_dir):
    return audit.coverage_rollup(derived.raw_text_pings(spark, sf_dir))


@query("weight_coverage")
def _(spark, sf_dir):
    return audit.weight_coverage(derived.raw_text_pings(spark, sf_dir))


@query("weight_verdict")
def _(spark, sf_dir):
    return rounded(audit.weight_verdict(derived.raw_text_pings(spark, sf_dir)))


@query("out_of_order")
def _(spark, sf_dir):
    return audit.out_of_order(derived.disordered_raw_pings(spark, sf_dir), block_rows=5000)


@query("out_of_order_vins")
def _(spark, sf_dir):
    return audit.out_of_order_vins(derived.disordered_raw_pings(spark, sf_dir), block_rows=5000)


@query("adjacent_duplicates")
def _(spark, sf_dir):
    found = audit.adjacent_duplicates(derived.disordered_raw_pings(spark, sf_dir))
    return found.select("event_seq", "VIN")


@query("fleet_counts")
def _(spark, sf_dir):
    return audit.fleet_counts(kept_trips(spark, sf_dir))


@query("top_vins")
def _(spark, sf_dir):
    return audit.extreme_vins(derived.raw_text_pings(spark, sf_dir), most=True)


@query("bottom_vins")
def _(spark, sf_dir):
    return audit.extreme_vins(derived.raw_text_pings(spark, sf_dir), most=False)


@query("coverage_extremes")
def _(spark, sf_dir):
    return audit.coverage_extremes(derived.raw_text_pings(spark, sf_dir))


# --- trips and features -------------------------------------------------------------------


@query("trip_segment")
def _(spark, sf_dir):
    return trips(spark, sf_dir).select(*KEY)


@query("ping_order")
def _(spark, sf_dir):
    """Position of every ping in the time order of its trip; no global sort."""
    scanned = features.trip_scan(trips(spark, sf_dir))
    return scanned.select(*KEY, F.col("_i").alias("position"))


@query("trip_segment_gap")
def _(spark, sf_dir):
    return trips(spark, sf_dir, split_on_stop=False).select(*KEY)


@query("trip_number_global")
def _(spark, sf_dir):
    return numbered_trips(event_pings(spark, sf_dir)).select("VIN", "event_seq", "trip_number", "trip_id")


def _feature_query(name: str, *columns: str) -> None:
    @query(name)
    def _(spark, sf_dir):
        return rounded(with_features(spark, sf_dir, *columns).select(*KEY, *columns))


_feature_query("elapsed", "elapsed_s")
_feature_query("speed_rolling", "speed_rolling_mean", "speed_rolling_std", "speed_cummax")
_feature_query("distance_remaining", "dist_remaining_km")
_feature_query("trip_progress", "trip_progress")
_feature_query("load_state", "load_state")
_feature_query("load_change_count", "load_change_count")


@query("load_state_all_trips")
def _(spark, sf_dir):
    """Load state including trips of one or two pings, which use the raw speed."""
    names = ["load_state", "load_change_count"]
    return features.add_features(trips(spark, sf_dir), names).select(*KEY, *names)


@query("eta_label")
def _(spark, sf_dir):
    return with_features(spark, sf_dir, label=True).select(*KEY, r6("eta_remaining_s").alias("eta_remaining_s"))


@query("build_features")
def _(spark, sf_dir):
    """All twelve features and the label."""
    built = features.build_features(trips(spark, sf_dir), min_pings=MIN_TRIP_PINGS, label=True)
    return rounded(built.select(*KEY, *features.FEATURE_COLS, "eta_remaining_min"))


@query("path_distance")
def _(spark, sf_dir):
    df = motion.path_distance(kept_trips(spark, sf_dir))
    return rounded(df.select(*KEY, "step_km", "travelled_km", "total_km"))


@query("pace_eta")
def _(spark, sf_dir):
    return rounded(motion.pace_eta(kept_trips(spark, sf_dir)).select(*KEY, "remaining_km", "pace_eta_min"))


@query("progress_pct")
def _(spark, sf_dir):
    return rounded(motion.progress_pct(kept_trips(spark, sf_dir)).select(*KEY, "progress_pct"))


@query("detect_stops")
def _(spark, sf_dir):
    """Stops of at least a minute on trips cut by gaps only."""
    return rounded(motion.detect_stops(trips(spark, sf_dir, split_on_stop=False), min_duration_min=1.0))


@query("trip_summary")
def _(spark, sf_dir):
    return rounded(motion.trip_summary(trips(spark, sf_dir, split_on_stop=False), min_duration_min=1.0))


@query("trip_card")
def _(spark, sf_dir):
    summary = motion.trip_summary(kept_trips(spark, sf_dir))
    label = F.concat(trip_label(F.col("VIN"), F.col("trip_local")), F.lit(" trip of "), "VIN")
    return motion.trip_card(summary, label)


# --- metrics ------------------------------------------------------------------------------


def _metric_query(name: str, column: str, make: Callable[[], Column]) -> None:
    @query(name)
    def _(spark, sf_dir):
        return derived.predictions(spark, sf_dir).agg(r6(make()).alias(column))


_metric_query("mae", "mae", lambda: metrics.mae("y", "p50"))
_metric_query("rmse", "rmse", lambda: metrics.rmse("y", "p50"))
_metric_query("mape", "mape", lambda: metrics.mape("y", "p50"))
_metric_query("pinball", "pinball_p10", lambda: metrics.pinball("y", "p10", 0.1))
_metric_query("coverage", "coverage_p10_p90", lambda: metrics.coverage("y", "p10", "p90"))


@query("evaluate")
def _(spark, sf_dir):
    return rounded(metrics.evaluate(derived.predictions(spark, sf_dir), p10="p10", p90="p90"))


@query("evaluate_by_load_state")
def _(spark, sf_dir):
    return rounded(
        metrics.evaluate(derived.predictions(spark, sf_dir), p10="p10", p90="p90", by=["load_state"])
    )


@query("model_comparison")
def _(spark, sf_dir):
    """Three stand-in models against each other."""
    models = {"naive": "p50", "baseline": "p90", "quantile_p50": "p10"}
    return rounded(metrics.model_comparison(derived.predictions(spark, sf_dir), models))


# --- calibration --------------------------------------------------------------------------


def split_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, validation, test) stand-in predictions, written once for the passes of the fits."""
    df = cut_lineage(trip_split(derived.predictions(spark, sf_dir)))
    return df, df.where(F.col("split") == "validation"), df.where(F.col("split") == "test")


@query("trip_split")
def _(spark, sf_dir):
    return trip_split(kept_trips(spark, sf_dir)).select(*KEY, "split")


@query("quantile_higher")
def _(spark, sf_dir):
    """An exact order statistic found through narrowing brackets (small sort limit)."""
    df = cut_lineage(derived.predictions(spark, sf_dir).select("p50"))
    value = quantiles.quantile_higher(df, "p50", 0.8, sort_limit=200)
    return spark.range(1).select(r6(F.lit(value)).alias("value"))


@query("quantile_edges")
def _(spark, sf_dir):
    _, validation, _ = split_predictions(spark, sf_dir)
    edges = calibrate.quantile_edges(validation)
    return rounded(spark.createDataFrame(list(enumerate(edges)), "position int, edge double"))


@query("conformal_qhat")
def _(spark, sf_dir):
    _, validation, _ = split_predictions(spark, sf_dir)
    return spark.range(1).select(r6(F.lit(calibrate.conformal_qhat(validation))).alias("qhat"))


@query("conformal_apply")
def _(spark, sf_dir):
    _, validation, test = split_predictions(spark, sf_dir)
    q = calibrate.conformal_qhat(validation)
    return rounded(
        test.select(*KEY, (F.col("p10") - q).alias("low"), (F.col("p90") + q).alias("high"))
    )


@query("interval_scale_fit")
def _(spark, sf_dir):
    _, validation, test = split_predictions(spark, sf_dir)
    s = calibrate.interval_scales(validation, [0.8, 0.9])
    posthoc = calibrate.interval_scale(test, 0.805)
    row = [(float(s[0.8]), float(s[0.9]), float(posthoc))]
    return rounded(spark.createDataFrame(row, "scale_80 double, scale_90 double, scale_posthoc double"))


@query("bucketed_scales_fit")
def _(spark, sf_dir):
    _, validation, _ = split_predictions(spark, sf_dir)
    return rounded(calibrate.fit_bucket_scales(validation).to_df(spark))


@query("bucket_scale_join")
def _(spark, sf_dir):
    _, validation, test = split_predictions(spark, sf_dir)
    fitted = calibrate.fit_bucket_scales(validation)
    return rounded(calibrate.join_bucket_scale(test, fitted).select(*KEY, "bucket", "scale"))


@query("bucketed_scales_apply")
def _(spark, sf_dir):
    _, validation, test = split_predictions(spark, sf_dir)
    fitted = calibrate.fit_bucket_scales(validation)
    return rounded(calibrate.apply_bucket_scales(test, fitted).select(*KEY, "bucket", "low", "high"))


@query("calibration_report")
def _(spark, sf_dir):
    _, validation, test = split_predictions(spark, sf_dir)
    fitted = calibrate.fit_calibration(validation, test)
    return rounded(calibrate.calibration_report(test, fitted))




# --- load state ---------------------------------------------------------------------------


@query("load_confusion")
def _(spark, sf_dir):
    """Heuristic load state against reported weights, over all rows."""
    rows = with_features(spark, sf_dir, "load_state")
    return rounded(loadstate.load_confusion(rows))


@query("load_confusion_by_trip")
def _(spark, sf_dir):
    rows = with_features(spark, sf_dir, "load_state")
    return rounded(loadstate.load_confusion(rows, by=["VIN", "trip_local"]))


def fixed_points(scanned: DataFrame) -> DataFrame:
    """Change points at every fourth ping."""
    return scanned.where((F.col("_i") % 4 == 0) & (F.col("_i") > 0)).select(
        "VIN", "trip_local", F.col("_i").alias("position")
    )


def kept_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trip_scan(trips(spark, sf_dir)).where(F.col("_n") >= MIN_TRIP_PINGS)


@query("segment_state")
def _(spark, sf_dir):
    """Segment means and states for change points at every fourth ping."""
    scanned = kept_scan(spark, sf_dir)
    return rounded(loadstate.segment_states(loadstate.with_segments(scanned, fixed_points(scanned))))


@query("segment_changes")
def _(spark, sf_dir):
    scanned = kept_scan(spark, sf_dir)
    states = loadstate.segment_states(loadstate.with_segments(scanned, fixed_points(scanned)))
    return loadstate.segment_changes(states)


@query("state_changes")
def _(spark, sf_dir):
    """Changes between known weight states per trip; rows without a weight are unknown."""
    state = F.when(F.col("Weight_lbs") > 10000, 1).when(F.col("Weight_lbs").isNotNull(), 0).otherwise(-1)
    return loadstate.state_changes(kept_scan(spark, sf_dir).withColumn("load_state", state))


@query("changepoints_pelt")
def _(spark, sf_dir):
    return changepoint.change_points(kept_trips(spark, sf_dir), "pelt")


@query("changepoints_binseg")
def _(spark, sf_dir):
    return changepoint.change_points(kept_trips(spark, sf_dir), "binseg")


@query("binseg_first_split")
def _(spark, sf_dir):
    """Best first split of every trip from running sums."""
    return rounded(changepoint.best_first_split(kept_scan(spark, sf_dir)), digits=3)


@query("load_state_cpd")
def _(spark, sf_dir):
    return loadstate.add_load_state(kept_trips(spark, sf_dir), "pelt").select(
        *KEY, "load_state", "load_change_count"
    )


@query("compare_cpd")
def _(spark, sf_dir):
    return rounded(loadstate.compare_methods(kept_trips(spark, sf_dir)))


# --- requests -----------------------------------------------------------------------------


@query("parse_requests")
def _(spark, sf_dir):
    parsed = parse_requests(derived.request_bodies(spark, sf_dir))
    return rounded(parsed.select("event_seq", "vin", "trip_id", "latitude", "speed_mph", "use_route", "error"))


def scored_requests(spark: SparkSession, sf_dir: str, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Request bodies with the route estimate known at their time, scored.

    With ``both`` the placed bodies are written once, for a caller that reads both results.
    """
    bodies = derived.request_bodies(spark, sf_dir)
    placed = route_asof(bodies, derived.route_offers(spark, sf_dir))
    if both:
        placed = cut_lineage(placed.select("body", "route_eta_min", "Timestamp"))
    return scoring.batch_predict(placed, F.col("route_eta_min"), F.unix_micros("Timestamp"))


@query("route_blend")
def _(spark, sf_dir):
    responses, _ = scored_requests(spark, sf_dir)
    return responses.select("vin", "as_of", "blended_eta_min", "method")


@query("eta_response")
def _(spark, sf_dir):
    """Full responses; the JSON text is read back to prove it well-formed."""
    responses, _ = scored_requests(spark, sf_dir)
    body = scoring.response_json(responses)
    read = F.from_json(body, responses.schema)
    return responses.select(body.alias("b"), read.alias("r")).select("r.*")


@query("batch_predict")
def _(spark, sf_dir):
    """Usable and rejected requests per outcome."""
    responses, rejected = scored_requests(spark, sf_dir, both=True)
    usable = responses.groupBy(F.col("method").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return usable.unionByName(
        rejected.groupBy(F.col("error").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    )


# --- models -------------------------------------------------------------------------------

def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(training.training_rows(trips(spark, sf_dir), MIN_TRIP_PINGS))


def model_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = models.assemble(model_rows(spark, sf_dir))
    return tuple(rows.where(F.col("split") == s) for s in ("train", "validation", "test"))


@query("gbt_baseline")
def _(spark, sf_dir):
    train, _, test = model_parts(spark, sf_dir)
    model = models.train_baseline(train)
    return rounded(metrics.evaluate(models.predict_with(model, test, "p50")))


@query("near_specialist")
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    columns = [*features.FEATURE_COLS, "naive"]
    model = models.train_near_specialist(rows.where("split = 'train'"), columns)
    test = rows.where("split = 'test'")
    return rounded(metrics.evaluate(models.predict_with(model, test, "p50")))


@query("quantile_gbt")
def _(spark, sf_dir):
    """The 0.9 quantile."""
    train, validation, test = model_parts(spark, sf_dir)
    model = models.train_quantiles(train, validation, (0.9,))["p90"]
    scored = model.predict(test, "p90")
    return rounded(
        scored.agg(
            metrics.pinball("y", "p90", 0.9).alias("pinball_p90"),
            F.avg((F.col("y") <= F.col("p90")).cast("double")).alias("share_below"),
        )
    )


@query("predict_quantiles")
def _(spark, sf_dir):
    train, validation, test = model_parts(spark, sf_dir)
    fitted = models.train_quantiles(train, validation)
    return rounded(models.predict_quantiles(fitted, test).select(*KEY, *fitted))


@query("near_opt_candidates")
def _(spark, sf_dir):
    """All 63 near-arrival candidates on stand-in predictions (p10 as the specialist)."""
    _, validation, _ = split_predictions(spark, sf_dir)
    rows = validation.withColumn("p50", F.col("naive") * 1.2)
    found = models.near_candidates(rows, specialist="p10")
    return rounded(models.choices_df(spark, found))


@query("near_opt_select")
def _(spark, sf_dir):
    _, validation, _ = split_predictions(spark, sf_dir)
    rows = validation.withColumn("p50", F.col("naive") * 1.2)
    best = models.choose_near(models.near_candidates(rows, specialist="p10"))
    return rounded(models.choices_df(spark, [best]).drop("trial"))


@query("train_pipeline")
def _(spark, sf_dir):
    """Train everything, then compare the models on the test rows."""
    trained, test = training.fit(training.training_rows(trips(spark, sf_dir), MIN_TRIP_PINGS))
    return rounded(training.reports(trained, test)["comparison"])


@query("model_save_load")
def _(spark, sf_dir):
    """Predictions of a saved and reloaded training run equal those of the original."""
    trained, test = training.fit(training.training_rows(trips(spark, sf_dir), MIN_TRIP_PINGS))
    path = ping_source.scratch_path(spark, "models")
    trained.save(path)
    names = ["baseline", "specialist", "p10", "p50", "p90", "near_opt"]
    again = training.Trained.load(path).predict(test.drop(*names))
    both = test.select(*KEY, *[F.col(n).alias(f"{n}_a") for n in names]).join(again.select(*KEY, *names), KEY)
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.max(F.abs(F.col(n) - F.col(f"{n}_a"))).alias(f"{n}_diff") for n in names],
    )


@query("feature_importance")
def _(spark, sf_dir):
    train, _, _ = model_parts(spark, sf_dir)
    return rounded(models.feature_importance(models.train_baseline(train)))


@query("ablation")
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return rounded(
        extras.ablation(rows.where("split = 'train'"), rows.where("split = 'test'"), features.FEATURE_COLS)
    )


@query("model_variants")
def _(spark, sf_dir):
    """Linear model, forest, and a tuned tree depth, on the test rows."""
    train, _, test = model_parts(spark, sf_dir)
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", seed=models.SEED)
    grid = extras.parameter_grid(depth=(tree.maxDepth, [2, 4, 6, 8]))
    fitted = {
        "linear": extras.train_linear(train),
        "forest": extras.train_forest(train),
        "tuned_tree": extras.tune_by_trip(tree, grid, train).bestModel,
    }
    out = None
    for name, model in fitted.items():
        scored = models.predict_with(model, test, "p50")
        report = metrics.evaluate(scored).select(F.lit(name).alias("model"), "*")
        out = report if out is None else out.unionByName(report)
    return rounded(out)


# --- further features and reports ---------------------------------------------------------


@query("acceleration")
def _(spark, sf_dir):
    df = extras.motion_features(kept_trips(spark, sf_dir))
    return rounded(df.select(*KEY, "acceleration_mphps"))


@query("stop_go_ratio")
def _(spark, sf_dir):
    df = extras.motion_features(kept_trips(spark, sf_dir))
    return rounded(df.select(*KEY, "stop_go_ratio"))


@query("bearing_change_rate")
def _(spark, sf_dir):
    df = extras.motion_features(kept_trips(spark, sf_dir))
    return rounded(df.select(*KEY, "bearing_change_rate"), digits=4)


@query("trip_duration_estimate")
def _(spark, sf_dir):
    df = extras.duration_estimate(kept_trips(spark, sf_dir))
    return rounded(df.select(*KEY, "trip_duration_estimate_min"), digits=4)


@query("eta_smoothing")
def _(spark, sf_dir):
    """Moving average of the naive estimate over each trip."""
    scanned = kept_scan(spark, sf_dir).withColumn(
        "naive",
        eta.naive_eta_min(haversine_km("Latitude", "Longitude", "_dest_lat", "_dest_lon"), F.col("Speed")),
    )
    return rounded(extras.smooth_eta(scanned, "naive").select(*KEY, "eta_smoothed"))


@query("eta_drift")
def _(spark, sf_dir):
    scanned = kept_scan(spark, sf_dir).withColumn(
        "naive",
        eta.naive_eta_min(haversine_km("Latitude", "Longitude", "_dest_lat", "_dest_lon"), F.col("Speed")),
    )
    return rounded(extras.eta_drift(scanned, "naive").select(*KEY, "drift_min"), digits=4)


@query("trip_category")
def _(spark, sf_dir):
    """Distance and duration category of every trip."""
    summary = motion.trip_summary(kept_trips(spark, sf_dir))
    return summary.select(
        "VIN",
        "trip_local",
        extras.distance_category(F.col("path_km")).alias("by_distance"),
        extras.duration_category(F.col("hours")).alias("by_duration"),
    )


@query("live_category")
def _(spark, sf_dir):
    return extras.live_category(kept_trips(spark, sf_dir)).select(*KEY, "trip_category")


@query("metrics_by_category")
def _(spark, sf_dir):
    """Error report per live trip category."""
    rows = features.add_features(
        extras.live_category(trips(spark, sf_dir)), ["dist_remaining_km"], min_pings=MIN_TRIP_PINGS, label=True
    )
    naive = eta.naive_eta_min(F.col("dist_remaining_km"), F.col("Speed"))
    rows = rows.select("trip_category", F.col("eta_remaining_min").alias("y"), naive.alias("p50"))
    return rounded(extras.metrics_by_category(rows))


@query("one_hot")
def _(spark, sf_dir):
    """Rows per one-hot position of device and source."""
    p = event_pings(spark, sf_dir)
    coded = extras.one_hot_pipeline().fit(p).transform(p)
    hot = lambda c: F.array_position(vector_to_array(c), 1.0).cast("int")
    return coded.groupBy(
        "Device_Type", "Source", hot("Device_Type_vec").alias("device_slot"), hot("Source_vec").alias("source_slot")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("frequency_encoding")
def _(spark, sf_dir):
    return rounded(extras.frequency_encoding(event_pings(spark, sf_dir), "Source").select("event_seq", "Source_freq"))


@query("target_encoding")
def _(spark, sf_dir):
    """Mean remaining minutes per source, by the encoder."""
    rows = with_features(spark, sf_dir, label=True).select("Source", "Device_Type", F.col("eta_remaining_min").alias("y"))
    indexed = extras.one_hot_pipeline().fit(rows).transform(rows)
    encoded = extras.target_encoder(["Source"], "y").fit(indexed).transform(indexed)
    return rounded(encoded.groupBy("Source").agg(F.max("Source_target").alias("mean_y")))


@query("detection_lag")
def _(spark, sf_dir):
    """Pings from each load event to the next fixed change point."""
    scanned = kept_scan(spark, sf_dir)
    return extras.detection_lag(scanned, fixed_points(scanned))


@query("median_detection_lag")
def _(spark, sf_dir):
    scanned = kept_scan(spark, sf_dir)
    median = extras.median_lag(extras.detection_lag(scanned, fixed_points(scanned)))
    return spark.range(1).select(F.lit(median).alias("median_lag"))


@query("grid_density")
def _(spark, sf_dir):
    return rounded(extras.grid_density(event_pings(spark, sf_dir), 0.25))


@query("cell_density")
def _(spark, sf_dir):
    """Densities per geohash of one to five characters; speeds as sums, which have no rounding ties."""
    found = cells.cell_density(event_pings(spark, sf_dir))
    return rounded(found.withColumn("speed_sum", F.col("mean_speed") * F.col("pings")).drop("mean_speed"))


@query("density_clusters")
def _(spark, sf_dir):
    """Density clusters of all pings, in degrees."""
    p = event_pings(spark, sf_dir)
    points = p.select(F.col("event_seq").alias("id"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"))
    return clusters.density_clusters(points, 0.015, 10).withColumnRenamed("id", "event_seq")


# --- histories ----------------------------------------------------------------------------


@query("speed_backoff")
def _(spark, sf_dir):
    """Mean speed of each vehicle, drawn towards its device type's and the fleet's."""
    return rounded(backoff.backoff_table(event_pings(spark, sf_dir), "Speed"))


@query("silent_spells")
def _(spark, sf_dir):
    """Spells of more than five minutes without a ping."""
    return rounded(backoff.silent_spells(event_pings(spark, sf_dir)))


@query("fleet_counts_sketched")
def _(spark, sf_dir):
    """Distinct counts from the daily sketches, beside the exact ones."""
    path = ping_source.scratch_path(spark, "fleet-days")
    rows = kept_trips(spark, sf_dir)
    sketches.write_daily(sketches.daily_sketches(rows), path)
    exact = audit.fleet_counts(rows).withColumnsRenamed({"vehicles": "exact_vehicles", "trips": "exact_trips"})
    both = sketches.distinct_between(spark, path).join(exact.withColumnRenamed("rows", "exact_rows"), F.lit(True))
    near = lambda c: F.abs(F.col(c) - F.col(f"exact_{c}")) <= F.col(f"exact_{c}") * sketches.relative_error()
    return both.select("rows", "exact_rows", "exact_vehicles", "exact_trips", *[near(c).alias(f"{c}_near") for c in ("vehicles", "trips")])


@query("run_ledger")
def _(spark, sf_dir):
    """Two milestones' reports recorded, the first one twice, and compared."""
    path = ping_source.scratch_path(spark, "runs")
    rows = derived.predictions(spark, sf_dir).select("load_state", "y", "p50", "p90")
    before, after = (metrics.evaluate(rows, p50=c, by=["load_state"]) for c in ("p50", "p90"))
    for report, run in ((before, "m1"), (after, "m2"), (before, "m1")):
        ledger.record_run(report, path, run, f"milestone {run}", ["load_state"])
    return rounded(ledger.compare_runs(ledger.read_runs(spark, path), "m1", "m2"))


# --- streams ------------------------------------------------------------------------------


def streamed(spark: SparkSession, rows: DataFrame, build) -> DataFrame:
    """Result of the stream that ``build`` makes of the replayed rows."""
    path, target, state = (ping_source.scratch_path(spark, n) for n in ("replay", "stream", "stream-state"))
    replay.replay(rows, path, lambda stream: replay.run_to_table(build(stream), target, state))
    return spark.read.parquet(target)


@query("stream_features")
def _(spark, sf_dir):
    """State per vehicle over replayed pings."""
    out = streamed(spark, event_pings(spark, sf_dir), stream_features)
    return rounded(out.drop("eta_min", "eta_smoothed_min"))


@query("stream_eta")
def _(spark, sf_dir):
    """Estimate to the destination at every ping, smoothed in the vehicle's state."""
    rows = features.trip_scan(trips(spark, sf_dir)).withColumnsRenamed(
        {"_dest_lat": "dest_lat", "_dest_lon": "dest_lon"}
    )
    rows = rows.select("VIN", "event_seq", "Timestamp", "Speed", "Latitude", "Longitude", "dest_lat", "dest_lon")
    out = streamed(spark, cut_lineage(rows), stream_features)
    return rounded(out.select("VIN", "event_seq", "eta_min", "eta_smoothed_min"))


def with_closing_ping(pings: DataFrame) -> DataFrame:
    """The pings and one of another vehicle a day later, which lets the watermark pass all of them."""
    end = pings.agg(F.max("Timestamp").alias("t")).select(
        F.lit("closing").alias("VIN"),
        F.lit(-1).cast("long").alias("event_seq"),
        (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("Timestamp"),
    )
    return pings.unionByName(end, allowMissingColumns=True)


@query("stream_trips")
def _(spark, sf_dir):
    """Gap trips from session windows; a later ping of another vehicle closes the last ones."""
    out = streamed(spark, with_closing_ping(event_pings(spark, sf_dir)), stream_trips)
    return out.where(F.col("VIN") != "closing").select(
        "VIN",
        "pings",
        F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"),
        r6("top_mph").alias("top_mph"),
        "standing_pings",
    )


@query("stream_closed_trips")
def _(spark, sf_dir):
    """Live trips by gap and by stop and move, archived per day once they are closed."""
    path, target, state = (ping_source.scratch_path(spark, n) for n in ("replay", "archive", "archive-state"))
    rows = with_closing_ping(event_pings(spark, sf_dir))
    replay.replay(rows, path, lambda stream: archive(stream_closed_trips(stream), target, state))
    out = spark.read.parquet(target).where(F.col("VIN") != "closing")
    return out.withColumn("top_mph", r6("top_mph")).drop("day", "batch")


@query("stream_dedupe")
def _(spark, sf_dir):
    """Every third ping sent twice; repeats are dropped within the watermark."""
    pings = event_pings(spark, sf_dir)
    sent = pings.unionByName(pings.where(F.col("event_seq") % 3 == 0))
    return streamed(spark, sent, drop_repeats).select("VIN", "event_seq")


@query("stream_late")
def _(spark, sf_dir):
    """Every 23rd ping sent a quarter of the replay too late; late rows go to their own table."""
    pings = event_pings(spark, sf_dir)
    late = F.col("event_seq") % 23 == 0
    sent = pings.withColumn(
        "_sent", F.when(late, F.col("Timestamp") + F.expr("INTERVAL 5 HOURS")).otherwise(F.col("Timestamp"))
    )
    path, on_time, late_rows, state = (ping_source.scratch_path(spark, n) for n in ("replay", "on-time", "late", "late-state"))
    replay.replay(sent, path, lambda stream: split_late(stream_features(stream), on_time, late_rows, state), order="_sent")
    taken, passed = spark.read.parquet(on_time), spark.read.parquet(late_rows)
    return (
        taken.select("event_seq", F.lit(False).alias("late"))
        .unionByName(passed.select("event_seq", F.lit(True).alias("late")))
        .groupBy("late")
        .agg(F.count(F.lit(1)).alias("n"))
    )
