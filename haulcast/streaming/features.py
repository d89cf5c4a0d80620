"""Continuously updated trip features: one state per vehicle, one output row per ping."""

from __future__ import annotations

from collections.abc import Iterator
from math import asin, cos, radians, sin, sqrt
from statistics import fmean, stdev

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import (
    EARTH_RADIUS_KM,
    KM_PER_MILE,
    LOAD_SPEED_MPH,
    LOAD_WINDOW_PINGS,
    ROLLING_PINGS,
    STOP_SPEED_MPH,
    TRIP_GAP_MINUTES,
)

OUTPUT_SCHEMA = (
    "VIN string, event_seq long, ts_us long, late boolean, trip_local long, pings_so_far long, "
    "elapsed_s double, speed_rolling_mean double, speed_rolling_std double, speed_cummax double, "
    "load_state_trailing int, load_changes_so_far long, eta_min double, eta_smoothed_min double"
)
STATE_SCHEMA = (
    "last_us long, last_seq long, trip long, pings long, start_us long, recent array<double>, "
    "top double, load int, changes long, smoothed double"
)
OUTPUT = [tuple(f.split()) for f in OUTPUT_SCHEMA.split(", ")]
TAKEN = ("at_us", "event_seq", "mph", "Latitude", "Longitude", "dest_lat", "dest_lon")
DTYPES = {"long": np.int64, "int": np.int32, "boolean": np.bool_, "double": np.float64, "string": object}
DAY_MS = 86_400_000


def _column(kind: str, values: tuple) -> np.ndarray:
    """An output column of its own type; whole numbers that a late row lacks become floats with NaN."""
    dtype = DTYPES[kind]
    if kind in ("long", "int") and None in values:
        dtype = np.float64
    return np.array(values, dtype=dtype)


def distance_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle distance of two points, for the row-wise stream state."""
    lat1, lon1, lat2, lon2 = map(radians, (lat1, lon1, lat2, lon2))
    a = sin((lat2 - lat1) / 2) ** 2 + cos(lat1) * cos(lat2) * sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * asin(sqrt(min(a, 1.0)))


class TripState(StatefulProcessor):
    """Keeps the running trip of a vehicle and the last pings the features look at.

    Only earlier pings count: the load state is the mean of the last three pings instead of a
    centred one. Rows of a step are taken in time order; a row older than the last one already
    taken is passed on marked ``late`` and changes nothing.
    """

    def __init__(self, smoothing: float = 0.3, ttl_days: int | None = None):
        self.smoothing, self.ttl_days = smoothing, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl_days is None else self.ttl_days * DAY_MS
        self.state = handle.getValueState("trip", STATE_SCHEMA, ttlDurationMs=ttl)

    def _step(self, s: dict | None, us: int, seq: int, speed: float, eta: float | None) -> dict:
        gap = s is not None and us - s["last_us"] > TRIP_GAP_MINUTES * 60_000_000
        moves = s is not None and s["recent"][-1] < STOP_SPEED_MPH <= speed
        if s is None or gap or moves:
            s = {
                "trip": 1 if s is None else s["trip"] + 1,
                "pings": 0, "start_us": us, "recent": [], "top": speed, "load": -1, "changes": 0,
                "smoothed": None,
            }
        recent = [*s["recent"], speed][-ROLLING_PINGS:]
        load = int(round(fmean(recent[-LOAD_WINDOW_PINGS:]), 9) < LOAD_SPEED_MPH)
        smoothed = s["smoothed"]
        if eta is not None:
            smoothed = eta if smoothed is None else self.smoothing * eta + (1 - self.smoothing) * smoothed
        return {
            "last_us": us, "last_seq": seq, "trip": s["trip"], "pings": s["pings"] + 1,
            "start_us": s["start_us"], "recent": recent, "top": max(s["top"], speed), "load": load,
            "changes": s["changes"] + (s["load"] not in (-1, load)), "smoothed": smoothed,
        }

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        s = self.state.get()  # a call is a round trip to the JVM
        s = None if s is None else dict(zip(names, s))
        if s is not None:
            s["recent"] = list(s["recent"])
        taken = [c for batch in rows for c in zip(*(batch[n].tolist() for n in TAKEN))]
        taken.sort(key=lambda row: row[:2])
        out = []
        for us, seq, speed, *places in taken:
            if s is not None and (us, seq) < (s["last_us"], s["last_seq"]):
                out.append((key[0], seq, us, True, *[None] * 10))
                continue
            eta = None
            if all(x is not None and x == x for x in places):
                eta = distance_km(*places) / (max(speed, 1.0) * KM_PER_MILE) * 60.0
            s = self._step(s, int(us), int(seq), float(speed), eta)
            recent = s["recent"]
            out.append((
                key[0], seq, us, False, s["trip"], s["pings"], (us - s["start_us"]) / 1e6,
                fmean(recent), stdev(recent) if len(recent) > 1 else 0.0, s["top"], s["load"],
                s["changes"], eta, s["smoothed"],
            ))
        self.state.update(tuple(s[n] for n in names))
        yield pd.DataFrame({name: _column(kind, values) for (name, kind), values in zip(OUTPUT, zip(*out))})

    def close(self) -> None:
        pass


def stream_features(pings: DataFrame, smoothing: float = 0.3, ttl_days: int | None = None) -> DataFrame:
    """Features and arrival estimate at every ping of a stream of pings.

    The stream may carry the destination as ``dest_lat, dest_lon``; without one the estimates
    stay null. With ``ttl_days``, vehicles silent for that long are forgotten; expiry follows
    the clock, so such a stream must run on a processing-time trigger. The state lives in RocksDB, so the
    number of vehicles is not bound by memory, and how much of a busy vehicle one step takes is
    set by the source's rate limit.
    """
    spark = pings.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    for c in ("dest_lat", "dest_lon"):
        if c not in pings.columns:
            pings = pings.withColumn(c, F.lit(None).cast("double"))
    rows = pings.where(F.col("VIN").isNotNull() & F.col("Timestamp").isNotNull()).select(
        "VIN",
        "event_seq",
        F.unix_micros("Timestamp").alias("at_us"),
        F.coalesce("Speed", F.lit(0.0)).alias("mph"),
        "Latitude",
        "Longitude",
        "dest_lat",
        "dest_lon",
    )
    return rows.groupBy("VIN").transformWithStateInPandas(
        statefulProcessor=TripState(smoothing, ttl_days),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="None" if ttl_days is None else "ProcessingTime",
    )


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str) -> None:
    """Run a feature stream into two tables: rows taken in order, and late rows.

    Each micro-batch is written under its number, so a batch repeated after a failure replaces
    its own files instead of adding to them.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where(~F.col("late")).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        kept.where("late").select("VIN", "event_seq", "ts_us").write.mode("overwrite").parquet(
            f"{late}/batch={number}"
        )
        kept.unpersist()

    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
