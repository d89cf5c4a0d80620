"""Column sets, thresholds and other fixed values of the telematics model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: ping table -------------------------------------------------------------
REQUIRED_COLUMNS = [
    "VIN",
    "Timestamp",
    "Latitude",
    "Longitude",
    "Speed",
    "Weight_lbs",
    "Device_Type",
    "Source",
]

PING_SCHEMA = T.StructType(
    [
        T.StructField("VIN", T.StringType()),
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Speed", T.DoubleType()),
        T.StructField("Weight_lbs", T.DoubleType()),
        T.StructField("Device_Type", T.StringType()),
        T.StructField("Source", T.StringType()),
    ]
)

# --- fixed values: trips ------------------------------------------------------------------
TRIP_GAP_MINUTES = 30.0
STOP_SPEED_MPH = 2.0
MIN_TRIP_PINGS = 5

# --- fixed values: geometry and units -----------------------------------------------------
EARTH_RADIUS_KM = 6371.0
KM_PER_MILE = 1.60934

# --- fixed values: features ---------------------------------------------------------------
ROLLING_PINGS = 5
LOAD_SPEED_MPH = 10.0
LOAD_WINDOW_PINGS = 3
LOADED_WEIGHT_LBS = 10000.0
FEATURE_COLS = [
    "elapsed_s",
    "speed_rolling_mean",
    "speed_rolling_std",
    "speed_cummax",
    "dist_remaining_km",
    "hour_sin",
    "hour_cos",
    "dow",
    "has_weight",
    "trip_progress",
    "load_state",
    "load_change_count",
]

# --- fixed values: change points ----------------------------------------------------------
CHANGE_MIN_PINGS = 5
CHANGE_PENALTY = 1.0
CHANGE_MIN_SIZE = 2
FLAT_STD = 1e-6

# --- fixed values: models and calibration -------------------------------------------------
QUANTILES = (0.1, 0.5, 0.9)
NEAR_ARRIVAL_MIN = 60.0
TOLERANCE_MIN = 10.0
BLEND_THRESHOLDS = (60.0, 90.0, 120.0, 150.0, 180.0, 240.0)
BLEND_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
TARGET_COVERAGE = 0.8
WIDE_COVERAGE = 0.9
POSTHOC_COVERAGE = 0.805
BUCKET_COVERAGE = 0.85
CALIBRATION_BUCKETS = 8
MIN_HALF_WIDTH = 1e-6

# --- fixed values: scoring service --------------------------------------------------------
LOCAL_ETA_WEIGHT = 0.7
ROUTE_ETA_WEIGHT = 0.3
METHOD_LOCAL = "physics_speed_haversine"
METHOD_BLEND = "local_plus_google_blend"
REQUEST_FIELDS = [
    "vin",
    "trip_id",
    "latitude",
    "longitude",
    "destination_latitude",
    "destination_longitude",
    "speed_mph",
]
REQUEST_NUMBERS = REQUEST_FIELDS[2:]
ROUTE_CALLS_PER_MINUTE = 3000.0
DAYS_PER_MONTH = 30.0

# --- sizing -------------------------------------------------------------------------------
# A vehicle's timeline is processed in time chunks, so that no vehicle, however long its
# history, has to fit in one task. See operators/scan.py.
CHUNK_SECONDS = 3600
# The same for data in arrival order: rows per block of consecutive sequence numbers.
SEQUENCE_BLOCK = 50_000_000
# Largest number of values an exact order statistic sorts in one place.
SORT_LIMIT = 100_000
