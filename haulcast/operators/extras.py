"""Further trip features and reports: motion, stability, categories, encodings, detection lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, TargetEncoder
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, wrap_180
from ..schema import LOADED_WEIGHT_LBS, STOP_SPEED_MPH
from . import metrics, models
from .features import TRIP_KEY, elapsed_s, trip_scan
from .histboost import train_boosts
from .quantiles import linear_quantiles
from .scan import attach

# --- fixed values: trip categories --------------------------------------------------------
SHORT_KM, MEDIUM_KM = 150.0, 500.0
SHORT_HOURS, MEDIUM_HOURS = 2.0, 8.0
CATEGORY_EVERY = 5

FEATURE_GROUPS = {
    "temporal": ["elapsed_s", "hour_sin", "hour_cos", "dow"],
    "speed": ["speed_rolling_mean", "speed_rolling_std", "speed_cummax"],
    "spatial": ["dist_remaining_km"],
    "load": ["has_weight", "load_state", "load_change_count"],
    "progress": ["trip_progress"],
}


# --- causal movement features -------------------------------------------------------------


def _previous(trips: DataFrame, key: Sequence[str]) -> DataFrame:
    """Trip scan plus the previous ping's time ``_pus`` and the heading before last.

    The previous row of a chunk's first ping comes from the trip's earlier chunks, one summary
    row per (trip, chunk).
    """
    scanned = trip_scan(trips, key)
    group = [key[0], "chunk", *key[1:]]
    w = Window.partitionBy(*group).orderBy("_i")
    last = F.struct("_us", "_plat", "_plon")
    ends = scanned.groupBy(*group).agg(F.max_by(last, "_i").alias("_end"))
    before = Window.partitionBy(*key).orderBy("chunk")
    carried = ends.select(*group, F.lag("_end").over(before).alias("_carried"))
    local = scanned.withColumn("_before", F.lag(last).over(w))
    joined = attach(local, carried, group).withColumn("_b", F.coalesce("_before", "_carried"))
    return joined.select(
        *scanned.columns,
        F.col("_b._us").alias("_pus"),
        F.col("_b._plat").alias("_pplat"),
        F.col("_b._plon").alias("_pplon"),
    )


def motion_features(trips: DataFrame, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Acceleration, share of low-speed pings so far and heading change per second."""
    seconds = F.nullif((F.col("_us") - F.col("_pus")) / F.lit(1e6), F.lit(0.0))
    heading = bearing_deg("_plat", "_plon", "Latitude", "Longitude")
    before = bearing_deg("_pplat", "_pplon", "_plat", "_plon")
    return _previous(trips, key).select(
        *trips.columns,
        ((F.col("_x0") - F.col("_x1")) / seconds).alias("acceleration_mphps"),
        ((F.col("_i") + 1 - F.col("_mv")) / (F.col("_i") + 1)).alias("stop_go_ratio"),
        (wrap_180(heading - before) / seconds).alias("bearing_change_rate"),
    )


def duration_estimate(trips: DataFrame, pings: int = 5, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add ``trip_duration_estimate_min``: remaining path at the pace of the last steps.

    Each row sees its window through the running path and time of ``pings - 1`` rows earlier.
    Those sit in the same chunk or are carried as a short tail of the earlier chunks.
    """
    back = pings - 1
    scanned = trip_scan(trips, key)
    group = [key[0], "chunk", *key[1:]]
    w = Window.partitionBy(*group).orderBy("_i")
    point = F.struct("_us", "_km")
    local = scanned.withColumns(
        {"_ago": F.lag(point, back).over(w), "_at": F.row_number().over(w) - 1}
    )
    # the last `back` points of a piece, newest first
    tail = F.reverse(F.collect_list(point).over(w.rowsBetween(-(back - 1), 0)))
    tails = (
        scanned.withColumn("_tail", tail)
        .groupBy(*group)
        .agg(F.max_by("_tail", "_i").alias("_tail"))
    )
    chain = Window.partitionBy(*key).orderBy("chunk").rowsBetween(-back, -1)
    carried = tails.select(
        *group, F.flatten(F.reverse(F.collect_list("_tail").over(chain))).alias("_halo")
    )
    df = attach(local, carried, group)
    ago = F.coalesce(F.col("_ago"), F.get("_halo", F.lit(back - 1) - F.col("_at")))
    minutes = (F.col("_us") - ago["_us"]) / F.lit(6e7)
    km = F.col("_km") - ago["_km"]
    left = F.greatest(F.col("_km_total") - F.col("_km"), F.lit(0.0))
    estimate = F.when((km > 0) & (minutes > 0), left / (km / F.nullif(minutes, F.lit(0.0))))
    return df.select(*trips.columns, estimate.alias("trip_duration_estimate_min"))


# --- stability of successive estimates ----------------------------------------------------


def smooth_eta(
    rows: DataFrame, value: str, alpha: float = 0.3, key: Sequence[str] = TRIP_KEY, order: str = "_i"
) -> DataFrame:
    """Add ``eta_smoothed``: the exponential moving average of successive estimates of a trip.

    ``order`` counts all pings of the trip from 0. The first known estimate starts the average and a
    missing one holds it, so known estimates are numbered first. The average is linear in the estimates, so
    blocks of 128 pings are averaged on their own, with a running sum scaled by powers of
    1 - alpha, and joined up exactly: the end of a block adds to the blocks after it with a weight
    falling by (1 - alpha) ** 128 per block, until that is below double precision.
    """
    if not 0.01 <= alpha <= 0.99:
        raise ValueError("alpha must be between 0.01 and 0.99")
    block, keep = 128, 1.0 - alpha
    reach = 1
    while keep ** (block * reach) > 1e-18:
        reach += 1
    group = [*key, "_block"]
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_known", F.count(value).over(upto))
    sums = blocked.groupBy(*group).agg(F.count(value).alias("_n_known"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, F.coalesce(F.sum("_n_known").over(earlier), F.lit(0)).alias("_base"))
    numbered = blocked.join(sums.hint("merge"), group).withColumn("_pos", F.col("_base") + F.col("_known") - 1)
    numbered = numbered.drop("_block", "_known", "_base")
    known = _smooth_known(numbered.where(F.col(value).isNotNull()), value, alpha, key, "_pos", block, reach)
    missing = numbered.where(F.col(value).isNull()).join(known.select(*key, "_pos", "eta_smoothed"), [*key, "_pos"], "left")
    return known.unionByName(missing).drop("_pos")


def _smooth_known(rows, value: str, alpha: float, key: Sequence[str], order: str, block: int, reach: int) -> DataFrame:
    """The moving average over estimates numbered without gaps."""
    keep, group = 1.0 - alpha, [*key, "_block"]
    decay = F.pow(F.lit(keep), F.col("_p"))
    # the first estimate starts the average, later ones enter with weight alpha
    share = F.when(F.col(order) == 0, F.col(value)).otherwise(F.col(value) * alpha)
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        rows.withColumn("_block", F.floor(F.col(order) / block))
        .withColumn("_p", (F.col(order) % block).cast("double"))
        .withColumn("_part", F.sum(share / decay).over(w) * decay)
    )
    ends = local.groupBy(*group).agg(F.max_by("_part", order).alias("_end"))
    carry = (
        ends.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(reach))))
        .groupBy(*key, (F.col("_block") + F.col("_back")).alias("_block"))
        .agg(F.sum(F.col("_end") * F.pow(F.lit(keep), block * (F.col("_back") - 1))).alias("_carry"))
    )
    return (
        local.join(carry.hint("merge"), group, "left")
        .withColumn("eta_smoothed", F.col("_part") + F.coalesce("_carry", F.lit(0.0)) * decay * keep)
        .drop("_block", "_p", "_part", "_carry")
    )


def eta_drift(rows: DataFrame, value: str, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add the predicted arrival and its change since the trip's previous ping, in minutes.

    ``rows`` is a trip scan with an estimate in minutes. The previous row has position one less,
    so it is matched by an equi-join on (trip, position), which spreads a long trip.
    """
    arrival = F.col("_us") / F.lit(6e7) + F.col(value)
    df = rows.withColumn("arrival_min", arrival)
    before = df.select(*key, (F.col("_i") + 1).alias("_i"), F.col("arrival_min").alias("_prev"))
    return df.join(before, [*key, "_i"], "left").withColumn("drift_min", F.col("arrival_min") - F.col("_prev")).drop("_prev")


# --- categories ---------------------------------------------------------------------------


def distance_category(km: Column) -> Column:
    return (
        F.when(km.isNull(), "unknown").when(km <= SHORT_KM, "short").when(km <= MEDIUM_KM, "medium").otherwise("long")
    )


def duration_category(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), "unknown").when(hours < SHORT_HOURS, "short").when(hours <= MEDIUM_HOURS, "medium")
        .otherwise("long")
    )


def live_category(trips: DataFrame, every: int = CATEGORY_EVERY, margin: float = 0.1, key: Sequence[str] = TRIP_KEY) -> DataFrame:
    """Add ``trip_category`` as known at each ping: from the path so far plus the straight rest.

    It is ``unknown`` until the first update, is renewed every ``every`` pings and changes only
    where the estimate is clear of the boundaries by ``margin``; in between the last clear
    category holds. That last clear category is carried from chunk to chunk.
    """
    from ..functions.geo import haversine_km

    scanned = trip_scan(trips, key)
    estimate = F.col("_km") + F.coalesce(
        haversine_km("Latitude", "Longitude", "_dest_lat", "_dest_lon"), F.lit(0.0)
    )
    low, high = 1 - margin, 1 + margin
    clear = (
        F.when(estimate <= SHORT_KM * low, "short")
        .when((estimate > SHORT_KM * high) & (estimate <= MEDIUM_KM * low), "medium")
        .when(estimate > MEDIUM_KM * high, "long")
    )
    update = F.when((F.col("_i") + 1) % every == 0, clear)
    group = [key[0], "chunk", *key[1:]]
    w = Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    local = scanned.withColumn("_seen", F.last(update, True).over(w))
    ends = local.groupBy(*group).agg(F.max_by("_seen", "_i").alias("_end"))
    chain = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, F.last("_end", True).over(chain).alias("_carried"))
    return attach(local, carried, group).select(
        *trips.columns,
        F.coalesce("_seen", "_carried", F.lit("unknown")).alias("trip_category"),
    )


def metrics_by_category(rows: DataFrame, category: str = "trip_category", **columns) -> DataFrame:
    return metrics.evaluate(rows, by=[category], **columns)


# --- encodings ----------------------------------------------------------------------------


def one_hot_pipeline(columns: Sequence[str] = ("Device_Type", "Source")) -> Pipeline:
    """Indexing and one-hot encoding with a bucket for unseen values, to be fitted and saved."""
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vec" for c in columns], handleInvalid="keep", dropLast=False),
        ]
    )


def frequency_encoding(rows: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_freq``: the share of rows with the same value.

    The join is left to the adaptive planner, which broadcasts the counts or splits a frequent
    value by the sizes it measures.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    shares = counts.select(
        F.col(column).alias("_value"), (F.col("_n") / F.lit(float(total))).alias(f"{column}_freq")
    )
    return rows.join(shares, rows[column].eqNullSafe(F.col("_value"))).drop("_value")


def target_encoder(columns: Sequence[str], label: str) -> TargetEncoder:
    """Mean label per value, for indexed columns of many values."""
    return TargetEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_target" for c in columns],
        labelCol=label, targetType="continuous", handleInvalid="keep",
    )


# --- load detection lag -------------------------------------------------------------------


def detection_lag(scanned: DataFrame, points: DataFrame) -> DataFrame:
    """Per load event of a trip, the pings until the next detected change point.

    A load event is a reported weight on the other side of the threshold than the last reported
    one. Events and change points are rows of their trips' positions; both are rare, so the
    search for the next point runs on those rows only: they are stacked and the next point is
    carried backwards, block by block of positions.
    """
    block = 100_000
    key = list(TRIP_KEY)
    weighed = scanned.where(F.col("Weight_lbs").isNotNull()).select(
        *key, "chunk", "_i", (F.col("Weight_lbs") > LOADED_WEIGHT_LBS).alias("_loaded")
    )
    group = [key[0], "chunk", key[1]]
    w = Window.partitionBy(*group).orderBy("_i")
    ends = weighed.groupBy(*group).agg(F.max_by("_loaded", "_i").alias("_end"))
    chain = Window.partitionBy(*key).orderBy("chunk")
    carried = ends.select(*group, F.lag("_end").over(chain).alias("_carried"))
    events = (
        attach(weighed.withColumn("_before", F.lag("_loaded").over(w)), carried, group)
        .where(F.coalesce("_before", "_carried") != F.col("_loaded"))
        .select(*key, "_i", F.lit(True).alias("_event"))
    )
    marks = points.select(*key, F.col("position").alias("_i"), F.lit(False).alias("_event"))
    stacked = events.unionByName(marks).withColumn("_block", F.floor(F.col("_i") / block))
    ahead = (
        Window.partitionBy(*key, "_block").orderBy("_i").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    )
    point = F.when(~F.col("_event"), F.col("_i"))
    starts = stacked.groupBy(*key, "_block").agg(F.min(point).alias("_first"))
    later = Window.partitionBy(*key).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    following = starts.select(*key, "_block", F.first("_first", True).over(later).alias("_later"))
    return (
        attach(stacked.withColumn("_next", F.min(point).over(ahead)), following, [*key, "_block"])
        .where("_event")
        .select(
            *key,
            F.col("_i").alias("event_position"),
            (F.coalesce("_next", "_later") - F.col("_i")).alias("lag_pings"),
        )
    )


def median_lag(lags: DataFrame) -> float | None:
    """Median number of pings from load event to detection; undetected events do not count."""
    found = linear_quantiles(lags, "lag_pings", [0.5])
    return found[0] if found else None


# --- model studies ------------------------------------------------------------------------


def ablation(
    train: DataFrame, test: DataFrame, columns: Sequence[str], groups: dict[str, list[str]] = FEATURE_GROUPS, **model
) -> DataFrame:
    """Error report of the baseline without each feature group, and with all features; all are trained side by side."""
    kept = {name: [c for c in columns if c not in dropped] for name, dropped in {"none": [], **groups}.items()}
    fitted = train_boosts(train, None, [models.baseline_spec(name, own, **model) for name, own in kept.items()])
    out = None
    for name, own in kept.items():
        scored = fitted[name].predict(test.dropna(subset=own), "p50")
        report = metrics.evaluate(scored).select(F.lit(name).alias("dropped"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def train_linear(train: DataFrame, label: str = "y"):
    return LinearRegression(featuresCol="features", labelCol=label).fit(train)


def train_forest(train: DataFrame, label: str = "y", trees: int = 20, depth: int = 6):
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=models.SEED
    ).fit(train)


def tune_by_trip(estimator, grid: list, train: DataFrame, label: str = "y", folds: int = 3):
    """Cross-validated choice from a parameter grid; all rows of a trip share a fold."""
    rows = train.withColumn("_fold", (models.trip_hash() % folds).cast("int"))
    evaluator = RegressionEvaluator(labelCol=label, metricName="mae")
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="_fold"
    ).fit(rows)


def parameter_grid(**choices) -> list:
    """Grid over ``param object -> values`` pairs given as (param, values)."""
    builder = ParamGridBuilder()
    for param, values in choices.values():
        builder = builder.addGrid(param, values)
    return builder.build()


# --- spatial density ----------------------------------------------------------------------


def grid_density(pings: DataFrame, cell_deg: float = 0.1) -> DataFrame:
    """Pings, mean speed and standing share per square grid cell.

    A cell is an aggregation key, so a crowded cell is combined map-side. Vehicles are not counted
    distinct here: that would gather a crowded cell's vehicle list.
    """
    located = pings.where(F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull())
    speed = F.coalesce(F.col("Speed"), F.lit(0.0))
    return located.groupBy(
        F.floor(F.col("Latitude") / cell_deg).alias("cell_lat"),
        F.floor(F.col("Longitude") / cell_deg).alias("cell_lon"),
    ).agg(
        F.count(F.lit(1)).alias("pings"),
        F.avg(speed).alias("mean_speed"),
        F.avg((speed < STOP_SPEED_MPH).cast("double")).alias("standing_share"),
    )


