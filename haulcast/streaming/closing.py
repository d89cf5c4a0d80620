"""Live trips by both rules (gap, stopped vehicle that starts to move), emitted once they are closed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.trips import effective_speed
from ..schema import STOP_SPEED_MPH, TRIP_GAP_MINUTES

CLOSED_SCHEMA = (
    "VIN string, trip_local long, pings long, start_us long, end_us long, top_mph double, "
    "standing_pings long, closed_by string"
)
OPEN_SCHEMA = (
    "trip long, pings long, start_us long, end_us long, last_mph double, top_mph double, "
    "standing long, is_open boolean"
)
WAITING_SCHEMA = "at_us long, event_seq long, mph double"
OPEN = [f.split()[0] for f in OPEN_SCHEMA.split(", ")]
WAITING = [f.split()[0] for f in WAITING_SCHEMA.split(", ")]
CLOSED = [f.split()[0] for f in CLOSED_SCHEMA.split(", ")]


def fold(t: np.ndarray, mph: np.ndarray, running: dict | None, gap_us: int, stop_mph: float) -> list[dict]:
    """Trips of sorted pings as rows of the open-trip state, the running one continued.

    ``starts`` tells what opened each trip: ``gap``, ``move`` or, for the running one and a vehicle's
    first, nothing. A vehicle has few pings in a step, so this works on arrays, not on tables.
    """
    before_t, before_mph = np.empty_like(t), np.empty_like(mph)
    before_t[1:], before_mph[1:] = t[:-1], mph[:-1]
    before_t[0] = t[0] if running is None else running["end_us"]
    before_mph[0] = mph[0] if running is None else running["last_mph"]
    gap = t - before_t > gap_us
    opens = gap | ((before_mph < stop_mph) & (mph >= stop_mph))
    number = np.cumsum(opens) + (1 if running is None else running["trip"])
    first = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
    last = np.append(first[1:], len(t)) - 1
    columns = {
        "trip": number[first], "pings": last - first + 1, "start_us": t[first], "end_us": t[last], "last_mph": mph[last],
        "top_mph": np.maximum.reduceat(mph, first), "standing": np.add.reduceat((mph < stop_mph).astype(np.int64), first),
        "starts": np.where(gap[first], "gap", np.where(opens[first], "move", "")),
    }
    trips = [dict(zip(columns, values)) for values in zip(*(c.tolist() for c in columns.values()))]
    if running is None or not running["is_open"]:
        return trips
    if trips[0]["trip"] != running["trip"]:
        return [{**running, "starts": ""}, *trips]
    trips[0]["start_us"] = running["start_us"]
    trips[0]["top_mph"] = max(trips[0]["top_mph"], running["top_mph"])
    for name in ("pings", "standing"):
        trips[0][name] += running[name]
    return trips


class ClosingTrips(StatefulProcessor):
    """Holds a vehicle's pings until the watermark has passed them, and its running trip.

    Pings are taken in time order when no earlier one can come any more, so the trips do not depend
    on how the input was split into steps. A trip is given out when the next one opens or the
    watermark is a whole gap past its end. Waiting pings span the allowed lateness only; the rest
    of a vehicle's past is one row of state.
    """

    def __init__(self, gap_us: int, stop_mph: float):
        self.gap_us, self.stop_mph = gap_us, stop_mph

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", OPEN_SCHEMA)
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(int(-(-at_us // 1000)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            at = batch["at_us"].tolist()
            self.waiting.appendList(list(zip(at, batch["event_seq"].tolist(), batch["mph"].tolist())))
            self._wake(min(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # every call to the state is a round trip to the JVM, so what is missing is read, not asked for first
        running, waiting = self.running.get(), list(self.waiting.get())
        running = None if running is None else dict(zip(OPEN, running))
        ready = sorted((p for p in waiting if p[0] <= passed), key=lambda p: (p[0], p[1]))
        closed = []
        if ready:
            at, mph = np.array([p[0] for p in ready], dtype=np.int64), np.array([p[2] for p in ready], dtype=np.float64)
            trips = fold(at, mph, running, self.gap_us, self.stop_mph)
            closed += [{**trip, "closed_by": after["starts"]} for trip, after in zip(trips, trips[1:])]
            running = {**trips[-1], "is_open": True}
            later = [tuple(p) for p in waiting if p[0] > passed]
            if later:
                self.waiting.put(later)
                self._wake(min(p[0] for p in later))
            else:
                self.waiting.clear()
        if running is not None and running["is_open"]:
            if passed >= running["end_us"] + self.gap_us:
                closed.append({**running, "closed_by": "gap"})
                running["is_open"] = False
            else:
                self._wake(running["end_us"] + self.gap_us)
        if running is not None:
            self.running.update(tuple(running[n] for n in OPEN))
        if closed:
            named = {"trip_local": "trip", "standing_pings": "standing"}
            out = {n: [trip[named.get(n, n)] for trip in closed] for n in CLOSED if n != "VIN"}
            yield pd.DataFrame({"VIN": [key[0]] * len(closed), **out})

    def close(self) -> None:
        pass


def stream_closed_trips(
    pings: DataFrame,
    gap_minutes: float = TRIP_GAP_MINUTES,
    stop_mph: float = STOP_SPEED_MPH,
    lateness: str = "10 minutes",
) -> DataFrame:
    """One row per closed trip of a stream of pings, numbered as ``segment_trips`` numbers them.

    A trip ends by a gap or where a stopped vehicle starts to move (``closed_by``: ``gap`` or
    ``move``; a gap goes first). Pings that come later than ``lateness`` behind the newest ones are
    dropped by the watermark; pings without vehicle or time belong to no live trip. Null and NaN
    speeds count as standing. A trip that is still running when the input ends is given out by a
    later step.
    """
    spark = pings.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = pings.where(F.col("VIN").isNotNull() & F.col("Timestamp").isNotNull()).select(
        "VIN",
        "Timestamp",
        F.unix_micros("Timestamp").alias("at_us"),
        "event_seq",
        effective_speed().alias("mph"),
    )
    return (
        rows.withWatermark("Timestamp", lateness)
        .groupBy("VIN")
        .transformWithStateInPandas(
            statefulProcessor=ClosingTrips(int(gap_minutes * 60_000_000), stop_mph),
            outputStructType=CLOSED_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def archive(trips: DataFrame, target: str, checkpoint: str) -> None:
    """Add the closed trips of a stream to a table with one folder per day of the trips' ends.

    A micro-batch replaces what an earlier attempt at the same batch has written, so a trip stands
    in the archive once, also after a failure between the write and the commit of its batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        day = F.to_date(F.timestamp_micros("end_us")).alias("day")
        (
            batch.select("*", day, F.lit(number).alias("batch"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(target)
        )

    (
        trips.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
