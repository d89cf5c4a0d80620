"""Back-off estimates, silent spells, daily sketches, the run ledger and the trip index on fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulcast.operators.audit import adjacent_duplicates
from haulcast.operators.backoff import backoff_table, silent_spells, with_backoff
from haulcast.operators.sketches import daily_sketches, distinct_between, relative_error, write_daily
from haulcast.plans.ledger import compare_runs, history, read_runs, record_run
from haulcast.sources.pings import scratch_path, write_trips
from haulcast.sources.trip_index import indexed_trip_rows, trip_files, write_trip_index

T0 = dt.datetime(2024, 1, 1)


def test_backoff_levels_and_cold_start(spark):
    rows = spark.createDataFrame(
        [("A", "v1", 10.0), ("A", "v1", 20.0), ("A", "v2", 60.0), ("B", "v3", 5.0), ("A", "v2", None), (None, "v4", 5.0), ("A", None, float("nan"))],
        "Device_Type string, VIN string, s double",
    )
    table = backoff_table(rows, "s", strength=2.0)
    got = {(r["level"], r["Device_Type"], r["VIN"]): (r["n"], r["estimate"]) for r in table.collect()}
    fleet = 100 / 5
    a, b = (90 + 2 * fleet) / 5, (5 + 2 * fleet) / 3
    want = {
        (0, "A", "v1"): (2, (30 + 2 * a) / 4), (0, "A", "v2"): (1, (60 + 2 * a) / 3), (0, "B", "v3"): (1, (5 + 2 * b) / 3),
        (1, "A", None): (3, a), (1, "B", None): (1, b), (2, None, None): (5, fleet),
    }
    assert got == {k: (n, pytest.approx(e)) for k, (n, e) in want.items()}
    asked = spark.createDataFrame([("A", "v1"), ("A", "new"), ("C", "new"), (None, None)], "Device_Type string, VIN string")
    known = {(r[0], r[1]): (r["estimate"], r["estimate_level"]) for r in with_backoff(asked, table).collect()}
    assert known[("A", "v1")] == (pytest.approx((30 + 2 * a) / 4), 0)
    assert known[("A", "new")] == (pytest.approx(a), 1)
    assert known[("C", "new")] == known[(None, None)] == (pytest.approx(fleet), 2)
    empty = backoff_table(rows.limit(0), "s")
    assert empty.count() == 0
    assert with_backoff(asked, empty).where("estimate is null and estimate_level is null").count() == 4


def test_silent_spells_across_days(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("v", 1, at(0)), ("v", 2, at(300)), ("v", 3, at(601)), ("v", 4, at(86400 * 3)), ("w", 5, at(10)), ("v", 6, None), (None, 7, at(5))]
    pings = spark.createDataFrame(rows, "VIN string, event_seq long, Timestamp timestamp")
    got = sorted(tuple(r) for r in silent_spells(pings).collect())
    assert got == [("v", 2, 3, 301.0), ("v", 3, 4, 86400.0 * 3 - 601)]
    assert silent_spells(pings.limit(0)).count() == 0


def day_trips(spark, day, vehicles):
    return spark.range(vehicles * 3).select(
        F.concat(F.lit("v"), (F.col("id") % vehicles).cast("string")).alias("VIN"),
        F.lit(day).cast("long").alias("trip_local"),
        F.lit(T0 + dt.timedelta(days=day)).cast("timestamp").alias("Timestamp"),
    )


def test_sketches_merge_over_days_and_one_day_is_replaced(spark):
    path = scratch_path(spark, "days")
    write_daily(daily_sketches(day_trips(spark, 0, 3000).unionByName(day_trips(spark, 1, 5000))), path)
    before = {f for f in spark.read.parquet(path).inputFiles() if "2024-01-01" in f}
    for _ in range(2):  # a day written again counts once
        write_daily(daily_sketches(day_trips(spark, 2, 4000)), path)
    assert before == {f for f in spark.read.parquet(path).inputFiles() if "2024-01-01" in f}
    whole = distinct_between(spark, path).first()
    assert whole["rows"] == 36000
    assert abs(whole["vehicles"] - 5000) <= 5000 * relative_error()
    assert abs(whole["trips"] - 12000) <= 12000 * relative_error()
    part = distinct_between(spark, path, "2024-01-02", "2024-01-02")
    assert abs(part.first()["vehicles"] - 5000) <= 5000 * relative_error()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1][:40]
    none = distinct_between(spark, path, "2030-01-01").first()
    assert tuple(none) == (0, 0, 0)


def test_a_run_written_twice_is_there_once(spark):
    path = scratch_path(spark, "runs")
    report = spark.createDataFrame([("x", 2.0, 5), (None, 0.0, 7)], "g string, mae double, n int")
    later = spark.createDataFrame([("x", 3.0, 5), ("y", 1.0, 1)], "g string, mae double, n int")
    for _ in range(2):
        record_run(report, path, "007", "first", ["g"])
    record_run(later, path, "m2", "second", ["g"])
    runs = read_runs(spark, path)
    assert {(r["run_id"], r["count"]) for r in runs.groupBy("run_id").count().collect()} == {("007", 4), ("m2", 4)}
    got = {(r["slice"], r["metric"]): tuple(r)[2:] for r in compare_runs(runs, "007", "m2").collect()}
    assert got[("g=x", "mae")] == (2.0, 3.0, 1.0, 50.0)
    assert got[("g=null", "mae")] == (0.0, None, None, None)
    assert got[("g=y", "n")] == (None, 1.0, None, None)
    assert history(runs, "mae").count() == 4
    with pytest.raises(ValueError):
        record_run(report, path, "a/b", "bad")
    with pytest.raises(ValueError):
        record_run(report.select("g"), path, "m3", "bad", ["g"])


def test_lookup_opens_only_the_trips_files(spark):
    path, index = scratch_path(spark, "trips"), scratch_path(spark, "index")
    rows = [(f"v{v}", 1, T0 + dt.timedelta(days=v), v * 10 + k) for v in range(6) for k in range(4)]
    rows += [("v0", 1, T0 + dt.timedelta(days=1), 99), (None, 1, T0, 100)]
    write_trips(spark.createDataFrame(rows, "VIN string, trip_local long, Timestamp timestamp, event_seq long"), path)
    write_trip_index(spark, path, index)
    assert len(trip_files(spark, index, "v0", 1)) == 2  # the trip crosses midnight
    found = indexed_trip_rows(spark, path, index, "v0", 1)
    assert [r["event_seq"] for r in found.collect()] == [0, 1, 2, 3, 99]
    assert all("2024-01-01" in f or "2024-01-02" in f for f in found.inputFiles()) and len(found.inputFiles()) == 2
    assert "trip_date" in found.columns
    assert indexed_trip_rows(spark, path, index, "v0", 2).count() == 0
    assert indexed_trip_rows(spark, path, index, "absent", 1).count() == 0


def test_adjacent_duplicates_over_blocks_and_groups(spark):
    """Repeats at the borders of blocks, of groups of blocks and over missing numbers."""
    numbers = [n for n in range(200) if not 61 <= n < 117]
    rows = [(n, f"v{n // 3}", "t", "1", "2") for n in numbers]
    raw = spark.createDataFrame(rows, "event_seq long, VIN string, Timestamp string, Latitude string, Longitude string")
    want = {b for a, b in zip(numbers, numbers[1:]) if a // 3 == b // 3}
    for block, group in ((4, 3), (7, 1), (1000, 4096)):
        got = {r["event_seq"] for r in adjacent_duplicates(raw, block, group).collect()}
        assert got == want
