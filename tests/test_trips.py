from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from haulcast.operators.features import FEATURE_COLS, build_features, trip_scan
from haulcast.operators.motion import detect_stops
from haulcast.operators.scan import measured_chunk_seconds, ordered_offsets
from haulcast.operators.trips import keep_long_trips, segment_trips
from haulcast.plans.segment import numbered_trips

START = datetime(2026, 4, 1, 8)
SCHEMA = "VIN string, event_seq long, Timestamp timestamp, Latitude double, Longitude double, Speed double, Weight_lbs double"


def pings(spark, rows):
    """rows: (vin, minutes after start, speed)"""
    return spark.createDataFrame(
        [(v, i, START + timedelta(minutes=m), 40.0 + i / 1000, -74.0, s, None) for i, (v, m, s) in enumerate(rows)],
        SCHEMA,
    )


def counts(df):
    return sorted(r["n"] for r in df.groupBy("VIN", "trip_local").agg(F.count(F.lit(1)).alias("n")).collect())


def test_continuous_is_one_trip(spark):
    df = keep_long_trips(segment_trips(pings(spark, [("A", m, 50.0) for m in range(10)])))
    assert counts(df) == [10]


def test_gap_splits(spark):
    rows = [("A", m, 60.0) for m in range(6)] + [("A", 60 + m, 60.0) for m in range(6)]
    assert counts(segment_trips(pings(spark, rows))) == [6, 6]


def test_gap_of_exactly_thirty_minutes_does_not_split(spark):
    assert counts(segment_trips(pings(spark, [("A", 0, 60.0), ("A", 30, 60.0), ("A", 61, 60.0)]))) == [1, 2]


def test_start_after_stop_splits(spark):
    rows = [("A", m, s) for m, s in enumerate([30, 30, 0, None, 30, 30])]
    rows = [(v, m, None if s is None else float(s)) for v, m, s in rows]
    assert counts(segment_trips(pings(spark, rows))) == [2, 4]
    assert counts(segment_trips(pings(spark, rows), split_on_stop=False)) == [6]


def test_short_trips_dropped_but_numbered(spark):
    rows = [("A", m, 50.0) for m in range(4)] + [("A", 100 + m, 50.0) for m in range(10)]
    rows += [("B", m, 50.0) for m in range(6)]
    ids = {r["trip_id"] for r in numbered_trips(pings(spark, rows)).select("trip_id").distinct().collect()}
    assert ids == {"A_0002", "B_0003"}


def random_pings(seed=3, vins=3, n=400):
    """One hot vehicle with long trips over many chunks, and a few small ones."""
    rng = np.random.default_rng(seed)
    frames = []
    for v in range(vins):
        size = n if v == 0 else 40
        gap = rng.choice([20, 60, 300, 2400], size=size, p=[0.5, 0.3, 0.17, 0.03])
        speed = rng.choice([0.0, 1.0, 5.0, 12.0, 30.0], size=size, p=[0.05, 0.05, 0.3, 0.3, 0.3])
        frames.append(
            pd.DataFrame(
                {
                    "VIN": f"V{v}",
                    "Timestamp": pd.Timestamp("2026-04-01") + pd.to_timedelta(np.cumsum(gap), unit="s"),
                    "Latitude": 40 + rng.normal(0, 0.05, size).cumsum(),
                    "Longitude": -74 + rng.normal(0, 0.05, size).cumsum(),
                    "Speed": np.where(rng.random(size) < 0.05, np.nan, speed),
                    "Weight_lbs": np.where(rng.random(size) < 0.2, 45000.0, np.nan),
                }
            )
        )
    df = pd.concat(frames, ignore_index=True)
    df.insert(1, "event_seq", range(len(df)))
    df.loc[rng.random(len(df)) < 0.05, "Latitude"] = np.nan
    return df


def table_rows(df):
    def value(v):
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if v != v else v

    names = ["VIN", "event_seq", "Timestamp", "Latitude", "Longitude", "Speed", "Weight_lbs"]
    return [tuple(value(v) for v in row) for row in df[names].itertuples(index=False, name=None)]


def brute(df):
    """Row-at-a-time statement of segmentation and features."""
    out = []
    for vin, g in df.sort_values(["VIN", "Timestamp", "event_seq"]).groupby("VIN"):
        trip, prev = 0, None
        for row in g.to_dict("records"):
            sp = 0.0 if np.isnan(row["Speed"]) else row["Speed"]
            if prev is None or (row["Timestamp"] - prev[0]).total_seconds() > 1800 or (prev[1] < 2 <= sp):
                trip += 1
            prev = (row["Timestamp"], sp)
            out.append({**row, "trip_local": trip, "sp": sp})
    rows = pd.DataFrame(out)
    results = []
    for _, t in rows.groupby(["VIN", "trip_local"]):
        sp, n = t["sp"].to_numpy(), len(t)
        low = (
            (sp < 10).astype(int)
            if n < 3
            else np.array([int(round(sp[max(0, i - 1) : i + 2].mean(), 9) < 10) for i in range(n)])
        )
        dest = (t["Latitude"].dropna().iloc[-1:].tolist() or [np.nan])[0]
        for i, row in enumerate(t.to_dict("records")):
            last = sp[max(0, i - 4) : i + 1]
            results.append(
                {
                    "event_seq": row["event_seq"],
                    "trip_local": row["trip_local"],
                    "elapsed_s": (row["Timestamp"] - t["Timestamp"].iloc[0]).total_seconds(),
                    "speed_rolling_mean": last.mean(),
                    "speed_rolling_std": last.std(ddof=1) if len(last) > 1 else 0.0,
                    "speed_cummax": sp[: i + 1].max(),
                    "dest": dest,
                    "trip_progress": i / max(n - 1, 1),
                    "load_state": low[i],
                    "load_change_count": int((np.diff(low) != 0).sum()),
                    "eta_remaining_s": (t["Timestamp"].iloc[-1] - row["Timestamp"]).total_seconds(),
                }
            )
    return pd.DataFrame(results).sort_values("event_seq").reset_index(drop=True)


@pytest.mark.parametrize("chunk", [45, 600, 3600, 10**7])
def test_any_chunk_length_gives_the_row_by_row_result(spark, chunk):
    df = random_pings()
    want = brute(df)
    source = spark.createDataFrame(table_rows(df), SCHEMA)
    got = (
        build_features(segment_trips(source, chunk_seconds=chunk), label=True, chunk_seconds=chunk)
        .orderBy("event_seq")
        .toPandas()
    )
    assert len(got) == len(df)
    for c in want.columns.drop("dest"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, err_msg=c)
    dest = trip_scan(segment_trips(source, chunk_seconds=chunk)).orderBy("event_seq").toPandas()["_dest_lat"]
    np.testing.assert_allclose(dest.to_numpy(float), want["dest"].to_numpy(float), atol=1e-12)


def test_row_windows_never_span_a_whole_vehicle(spark):
    """The pings are exchanged on (VIN, chunk) only; summaries are what moves by VIN."""
    source = pings(spark, [("A", m, 50.0) for m in range(10)])
    plan = segment_trips(source)._jdf.queryExecution().executedPlan().toString()
    over_pings = [line for line in plan.splitlines() if "Window [" in line and ("lag(_t#" in line or "sum(_open#" in line)]
    assert over_pings
    for line in over_pings:
        spec = line.split("windowspecdefinition(")[1]
        assert spec.split(",")[1].strip().startswith("chunk#")
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_one_trip_features(spark):
    n = 10
    rows = [
        ("T", i, START + timedelta(minutes=i), 40 + 0.1 * i / 9, -74 + 0.1 * i / 9, 60.0 * i / 9, None if i < 5 else 45000.0)
        for i in range(n)
    ]
    df = build_features(segment_trips(spark.createDataFrame(rows, SCHEMA), split_on_stop=False), label=True)
    got = df.orderBy("event_seq").toPandas()
    assert got["elapsed_s"].iloc[0] == 0 and got["elapsed_s"].iloc[-1] == 540
    assert got["speed_cummax"].is_monotonic_increasing
    assert got["dist_remaining_km"].iloc[-1] == pytest.approx(0)
    assert got["trip_progress"].tolist() == pytest.approx([i / 9 for i in range(n)])
    assert got["has_weight"].tolist() == [0] * 5 + [1] * 5
    assert got["eta_remaining_s"].iloc[-1] == 0
    assert not got[FEATURE_COLS].isna().any().any()


def test_stops(spark):
    speeds = [30, 0, 0, 0, 30, 0, 30, 0, 0]
    df = segment_trips(pings(spark, [("A", 10 * i, float(s)) for i, s in enumerate(speeds)]), split_on_stop=False)
    found = sorted((r["start_idx"], r["end_idx"], r["duration_min"]) for r in detect_stops(df, min_duration_min=0).collect())
    assert found == [(1, 3, 20.0), (5, 5, 0.0)]
    assert [r["start_idx"] for r in detect_stops(df, min_duration_min=15).collect()] == [1]
    assert detect_stops(df).count() == 0
    assert detect_stops(df, min_duration_min=0, emit_open_tail=True).count() == 3


def test_chunk_length_follows_density(spark):
    sparse = pings(spark, [("A", m, 1.0) for m in range(20)])
    assert measured_chunk_seconds(sparse, max_rows=100) == 7 * 86400
    assert measured_chunk_seconds(sparse, max_rows=10) == 600


def test_offsets_run_over_all_partitions(spark):
    df = spark.range(1000).select(F.format_string("K%05d", "id").alias("k"), (F.col("id") % 7).alias("v"))
    got = ordered_offsets(df, "k", "v", "before").orderBy("k").toPandas()
    assert got["before"].tolist() == (got["v"].cumsum() - got["v"]).tolist()
