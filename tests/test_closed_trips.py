"""Trips closed on a stream equal the trips of the whole table, however the input is split."""

import datetime as dt
import random
import tempfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulcast.operators.trips import segment_trips
from haulcast.streaming import closing, features, replay

START = dt.datetime(2026, 4, 1, 8)
SCHEMA = "VIN string, event_seq long, Timestamp timestamp, Speed double"


def drive(spark, n=240, seed=5):
    """Four vehicles with stops, gaps, equal times and missing speeds; one ping is a trip of its own."""
    draw = random.Random(seed)
    rows, at = [], dict.fromkeys(("V0", "V1", "V2", "V3"), START)
    for k in range(n):
        vin = draw.choice(list(at))
        at[vin] += dt.timedelta(seconds=draw.choice([0, 20, 60, 300, 1800, 1801, 4000]))
        rows.append((vin, k, at[vin], draw.choice([None, float("nan"), 0.0, 1.9, 2.0, 30.0, 55.5])))
    return spark.createDataFrame(rows, SCHEMA)


def with_end(rows):
    """A ping of another vehicle a day later lets the watermark pass all trips."""
    late = rows.agg(F.max("Timestamp").alias("t")).select(
        F.lit("closing").alias("VIN"), F.lit(-1).cast("long").alias("event_seq"),
        (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("Timestamp"), F.lit(0.0).alias("Speed"),
    )
    return rows.unionByName(late)


def whole(rows):
    speed = F.coalesce(F.nanvl("Speed", F.lit(0.0)), F.lit(0.0))
    trips = segment_trips(rows).groupBy("VIN", "trip_local").agg(
        F.count("*").alias("pings"), F.min(F.unix_micros("Timestamp")).alias("start_us"),
        F.max(F.unix_micros("Timestamp")).alias("end_us"), F.max(speed).alias("top_mph"),
        F.count_if(speed < 2).alias("standing_pings"),
    )
    return sorted(tuple(r) for r in trips.collect())


def closed(got):
    rows = got.where("VIN <> 'closing'").select(*closing.CLOSED[:-1]).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("slices,files", [(1, 1), (4, 1), (2, 16)])
def test_closed_trips_equal_batch_trips(spark, slices, files):
    rows = drive(spark)
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    replay.replay(
        with_end(rows).repartition(files), f"{folder}/in",
        lambda s: closing.archive(closing.stream_closed_trips(s), f"{folder}/out", f"{folder}/state"), slices=slices,
    )
    assert closed(spark.read.parquet(f"{folder}/out")) == whole(rows)


def test_rows_out_of_order_within_the_lateness(spark):
    rows = drive(spark, 120, seed=9)
    shift = F.expr("make_interval(0, 0, 0, 0, 0, cast(greatest(event_seq, 0) % 9 as int), 0)")
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    sent = with_end(rows).withColumn("_sent", F.col("Timestamp") + shift)
    replay.replay(
        sent, f"{folder}/in",
        lambda s: closing.archive(closing.stream_closed_trips(s, lateness="20 minutes"), f"{folder}/out", f"{folder}/state"),
        slices=6, order="_sent",
    )
    assert closed(spark.read.parquet(f"{folder}/out")) == whole(rows)


def test_a_batch_whose_commit_is_lost_is_not_doubled(spark):
    rows = with_end(drive(spark, 80, seed=3))
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    rows.coalesce(1).write.parquet(f"{folder}/in")
    stream = lambda: closing.stream_closed_trips(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    closing.archive(stream(), f"{folder}/out", f"{folder}/state")
    first = closed(spark.read.parquet(f"{folder}/out"))
    # without its commit the last batch is worked off again
    commits = sorted(Path(f"{folder}/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last = commits[-1]
    last.rename(f"{folder}/lost-commit")
    Path(f"{folder}/state/commits/.{last.name}.crc").unlink(missing_ok=True)
    closing.archive(stream(), f"{folder}/out", f"{folder}/state")
    assert closed(spark.read.parquet(f"{folder}/out")) == first == whole(drive(spark, 80, seed=3))


def test_the_rule_that_closed_a_trip(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = spark.createDataFrame(
        [("a", 1, at(0), 0.0), ("a", 2, at(1), 9.0), ("a", 3, at(40), 9.0), ("a", 4, at(41), 1.0), ("a", 5, at(80), 7.0),
         (None, 6, at(2), 9.0), ("a", 7, None, 9.0)], SCHEMA)
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    replay.replay(
        with_end(rows), f"{folder}/in",
        lambda s: replay.run_to_table(closing.stream_closed_trips(s), f"{folder}/out", f"{folder}/state"), slices=2,
    )
    got = spark.read.parquet(f"{folder}/out").where("VIN = 'a'").orderBy("trip_local")
    assert [(r["trip_local"], r["pings"], r["closed_by"]) for r in got.collect()] == [
        (1, 1, "move"), (2, 1, "gap"), (3, 2, "gap"), (4, 1, "gap")]


class State:
    """Value and list state of one vehicle, held here."""

    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def appendList(self, values):
        self.held = [*(self.held or []), *values]

    def clear(self):
        self.held = None

    def getValueState(self, *_, **__):
        return State()

    getListState = getValueState

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 7_200_000


@pytest.mark.parametrize("kind", ["closing", "features"])
def test_a_vehicle_of_a_step_builds_one_table_at_most(kind, monkeypatch):
    """Steps have many vehicles of few pings, so tables built per vehicle are most of their time."""
    minutes = [0, 1, 2, 50, 51, 52, 119, 130]
    batch = pd.DataFrame({"at_us": [m * 60_000_000 for m in minutes], "event_seq": range(8), "mph": [5.0, 0.0, 9.0, 9.0, 1.0, 0.0, 7.0, 8.0]})
    batch = batch.assign(Latitude=40.0, Longitude=[-70.0, None, *[-70.5] * 6], dest_lat=41.0, dest_lon=-71.0).sample(frac=1, random_state=2)
    built, real = [], pd.DataFrame.__init__
    processor = closing.ClosingTrips(30 * 60_000_000, 2.0) if kind == "closing" else features.TripState()
    processor.init(State())
    parts = [batch.iloc[:5], batch.iloc[5:]]

    def counted(self, *args, **kwargs):
        built.append(1)
        real(self, *args, **kwargs)

    monkeypatch.setattr(pd.DataFrame, "__init__", counted)
    if kind == "closing":
        assert list(processor.handleInputRows(("v",), iter(parts), None)) == []
        read, built[:] = len(built), []
        (out,) = processor.handleExpiredTimer(("v",), State(), None)
    else:
        (out,) = processor.handleInputRows(("v",), iter(parts), None)
        read = 0
    made = len(built)
    monkeypatch.undo()
    if kind == "closing":
        assert out["pings"].tolist() == [2, 1, 3] and out["closed_by"].tolist() == ["move", "gap", "gap"]
        assert processor.waiting.get() == [(130 * 60_000_000, 7, 8.0)] and processor.running.get()[:2] == (4, 1)
    else:
        assert out["event_seq"].tolist() == list(range(8)) and out["trip_local"].tolist() == [1, 1, 2, 3, 3, 3, 4, 4]
        assert out["eta_min"].isna().tolist() == [k == 1 for k in range(8)] and not out["late"].any()
    assert read == 0 and made <= 1
