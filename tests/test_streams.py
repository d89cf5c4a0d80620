"""Replayed streams lose no rows, however many files a slice has; missing readings are not values."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from haulcast.operators.extras import smooth_eta
from haulcast.operators.features import weight_flag
from haulcast.operators.trips import effective_speed
from haulcast.schema import PING_SCHEMA
from haulcast.streaming import replay
from haulcast.streaming.features import stream_features
from haulcast.streaming.trips import drop_repeats

START = dt.datetime(2026, 4, 1, 8)


def pings(spark, n=48):
    names = [f.name for f in PING_SCHEMA]
    rows = []
    for k in range(n):
        at = START + dt.timedelta(minutes=20 * k)
        values = {"VIN": f"V{k % 3}", "Timestamp": at, "Latitude": 40.0 + k / 100, "Longitude": -74.0, "Speed": float(k % 40) if k % 7 else None}
        rows.append(tuple(values.get(c) for c in names))
    numbered = spark.createDataFrame(rows, PING_SCHEMA)
    return numbered.withColumn("event_seq", (F.unix_micros("Timestamp") / 1_000_000).cast("long")) if "event_seq" not in names else numbered


@pytest.mark.parametrize("build", [stream_features, drop_repeats])
def test_a_slice_of_many_files_is_one_step(spark, build):
    rows = pings(spark).withColumn("event_seq", (F.unix_micros("Timestamp") / 1_000_000).cast("long"))
    results = []
    for files in (1, 5):
        folder = tempfile.mkdtemp(prefix="haulcast-test-")
        target = f"{folder}/out"
        replay.replay(rows.repartition(files), f"{folder}/in", lambda s: replay.run_to_table(build(s), target, f"{folder}/state"), slices=3)
        got = spark.read.parquet(target)
        results.append(sorted(map(str, got.select(*sorted(got.columns)).collect())))
    assert len(results[0]) == 48 and results[0] == results[1]


def test_a_missing_estimate_holds_the_average(spark):
    values = [None, 100.0, None, 100.0, 200.0, None] * 60
    rows = spark.createDataFrame([("v", 1, k, v) for k, v in enumerate(values)], "VIN string, trip_local long, _i long, eta double").repartition(3)
    got = {r["_i"]: r["eta_smoothed"] for r in smooth_eta(rows, "eta").collect()}
    average = None
    for k, v in enumerate(values):
        if v is not None:
            average = v if average is None else 0.7 * average + 0.3 * v
        assert got[k] == average or abs(got[k] - average) < 1e-9


def test_nan_is_a_missing_reading(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (None, None), (3.0, 8000.0)], "Speed double, Weight_lbs double")
    got = df.select(effective_speed().alias("s"), weight_flag(df).alias("w")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0), (0.0, 0), (3.0, 1)]
