"""Change points of a trip's speed: optimal partitioning with pruning, and binary segmentation.

Spark hash-partitions the trips and sorts each partition by trip and time; the sorted batches are
then streamed through a small per-trip state. The pruned optimal search keeps only its live
candidates and emits change points as soon as every live candidate agrees on them, so a trip is
never held as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHANGE_MIN_PINGS, CHANGE_MIN_SIZE, CHANGE_PENALTY, FLAT_STD
from .scan import NO_TIME, attach, running_totals
from .trips import effective_speed

METHODS = ("pelt", "binseg")
POSITION_SCHEMA = "VIN string, trip_local long, position long"


class PrunedSearch:
    """Pruned exact search (squared error to the segment mean, fixed price per segment).

    Values arrive in pieces through ``push``; ``settled`` and ``finish`` give the start positions
    of the segments after the first.
    """

    def __init__(self, penalty: float = CHANGE_PENALTY, min_size: int = CHANGE_MIN_SIZE):
        self.penalty, self.min_size = penalty, min_size
        self.n = 0
        self.sum = self.squares = 0.0
        # positions not old enough to end a segment before: (position, best cost, sum, squares)
        self.waiting: list[tuple[float, float, float, float]] = [(0, 0.0, 0.0, 0.0)]
        # live candidates, one column each, same four values
        self.table = np.empty((4, 64))
        self.live = 0
        self.parent: dict[int, int] = {}
        self.root = 0

    def _admit(self) -> None:
        while self.waiting and self.waiting[0][0] <= self.n - self.min_size:
            if self.live == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
            self.table[:, self.live] = self.waiting.pop(0)
            self.live += 1

    def push(self, values: np.ndarray) -> None:
        for x in values.tolist():
            self.n += 1
            self.sum += x
            self.squares += x * x
            if self.n < self.min_size:
                continue
            self._admit()
            at, best, s1, s2 = self.table[:, : self.live]
            diff = self.sum - s1
            total = best + np.maximum(self.squares - s2 - diff * diff / (self.n - at), 0.0)
            k = int(total.argmin())
            optimum = float(total[k]) + self.penalty
            self.parent[self.n] = int(at[k])
            self.waiting.append((self.n, optimum, self.sum, self.squares))
            keep = total <= optimum
            kept = int(np.count_nonzero(keep))
            if kept < self.live:
                self.table[:, :kept] = self.table[:, : self.live][:, keep]
                self.live = kept

    def _path(self, position: int) -> list[int]:
        path = []
        while position != self.root:
            path.append(position)
            position = self.parent[position]
        return path[::-1]

    def settled(self) -> list[int]:
        """Change points shared by all live candidates; forgets everything before them."""
        live = [int(t) for t in self.table[0, : self.live]] + [int(w[0]) for w in self.waiting]
        if self.root in live:
            return []
        paths = [self._path(t) for t in live]
        shared = []
        for step in zip(*paths):
            if any(p != step[0] for p in step):
                break
            shared.append(step[0])
        if not shared:
            return []
        self.root = shared[-1]
        reachable = {p for path in paths for p in path if p > self.root}
        self.parent = {p: self.parent[p] for p in reachable}
        return shared

    def finish(self) -> list[int]:
        """The remaining change points; the end of the signal is not one."""
        if self.n not in self.parent:
            return []
        return self._path(self.n)[:-1]


def pelt_positions(
    speeds: np.ndarray, penalty: float = CHANGE_PENALTY, min_size: int = CHANGE_MIN_SIZE
) -> list[int]:
    """Change points of one complete signal; none for short or flat signals."""
    speeds = np.nan_to_num(np.asarray(speeds, dtype=float), nan=0.0)
    if len(speeds) < CHANGE_MIN_PINGS or speeds.std() < FLAT_STD:
        return []
    search = PrunedSearch(penalty, min_size)
    search.push(speeds)
    return search.finish()


def _best_split(s1: np.ndarray, s2: np.ndarray, lo: int, hi: int, min_size: int):
    """(gain, position) of the best split of [lo, hi); the later one of equal gains."""
    cuts = np.arange(lo + min_size, hi - min_size + 1)
    if len(cuts) == 0:
        return 0.0, None

    def cost(a, b):
        d = s1[b] - s1[a]
        return s2[b] - s2[a] - d * d / (b - a)

    gains = cost(lo, hi) - cost(lo, cuts) - cost(cuts, hi)
    k = len(gains) - 1 - int(gains[::-1].argmax())
    return float(gains[k]), int(cuts[k])


def binseg_positions(
    speeds: np.ndarray, splits: int | None = None, min_size: int = CHANGE_MIN_SIZE
) -> list[int]:
    """Greedy splits by largest gain; by default as many as the optimal search finds (at least 1)."""
    speeds = np.nan_to_num(np.asarray(speeds, dtype=float), nan=0.0)
    if len(speeds) < CHANGE_MIN_PINGS or speeds.std() < FLAT_STD:
        return []
    if splits is None:
        splits = max(1, len(pelt_positions(speeds)))
    s1 = np.concatenate([[0.0], np.cumsum(speeds)])
    s2 = np.concatenate([[0.0], np.cumsum(speeds * speeds)])
    queue: list[tuple[float, int, int, int | None]] = []

    def offer(lo: int, hi: int) -> None:
        gain, cut = _best_split(s1, s2, lo, hi, min_size)
        heapq.heappush(queue, (-gain, lo, hi, -1 if cut is None else cut))

    offer(0, len(speeds))
    found: list[int] = []
    while len(found) < splits:
        _, lo, hi, cut = heapq.heappop(queue)
        if cut < 0:
            break
        found.append(cut)
        offer(lo, cut)
        offer(cut, hi)
    return sorted(found)


def _stream(method: str, penalty: float, min_size: int, splits: int | None):
    """Batch function: sorted (VIN, trip_local, _sp) rows to change-point rows."""

    def table(found: list[tuple]) -> pd.DataFrame:
        """Change points of several trips [(vehicle, trip, positions)] as one table: trips are many and short."""
        size = [len(positions) for _, _, positions in found]
        return pd.DataFrame(
            {
                "VIN": np.repeat(np.array([vin for vin, _, _ in found], dtype=object), size),
                "trip_local": np.repeat(np.array([trip for _, trip, _ in found]), size),
                "position": np.concatenate([np.asarray(positions, dtype=np.int64) for _, _, positions in found]),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, search, held = None, None, []

        def close() -> list[int]:
            if key is None:
                return []
            if method == "pelt":
                return search.finish() if search.n >= CHANGE_MIN_PINGS else []
            if sum(map(len, held)) < CHANGE_MIN_PINGS:
                return []
            speeds = np.concatenate(held)
            wanted = len(pelt_positions(speeds)) if splits is None else splits
            return binseg_positions(speeds, wanted, min_size)

        for batch in batches:
            vin, trip, sp = (batch[c].to_numpy() for c in ("VIN", "trip_local", "_sp"))
            change = np.flatnonzero((vin[1:] != vin[:-1]) | (trip[1:] != trip[:-1])) + 1
            bounds = [0, *change.tolist(), len(batch)]
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo == hi:
                    continue
                here = (vin[lo], trip[lo])
                if here != key:
                    out.append((*(key or here), close()))
                    key, search, held = here, PrunedSearch(penalty, min_size) if method == "pelt" else None, []
                if method == "pelt":
                    search.push(sp[lo:hi])
                else:
                    held.append(sp[lo:hi])
            if method == "pelt" and key is not None and search.n >= CHANGE_MIN_PINGS:
                out.append((*key, search.settled()))
            out = [o for o in out if o[2]]
            if out:
                yield table(out)
        last = close()
        if last:
            yield table([(*key, last)])

    return run


def change_points(
    trips: DataFrame,
    method: str = "pelt",
    penalty: float = CHANGE_PENALTY,
    min_size: int = CHANGE_MIN_SIZE,
    splits: int | None = None,
) -> DataFrame:
    """One row per change point: the trip and the position (from 0) of its segment's first ping.

    ``binseg`` makes ``splits`` splits per trip, by default as many as ``pelt`` finds there.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    # a fixed number of partitions: the search costs time, not bytes, so small ones stay apart
    partitions = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        trips.select(
            "VIN",
            "trip_local",
            F.coalesce(F.unix_micros("Timestamp"), F.lit(NO_TIME)).alias("_t"),
            "event_seq",
            effective_speed().alias("_sp"),
        )
        .repartition(partitions, "VIN", "trip_local")
        .sortWithinPartitions("VIN", "trip_local", "_t", "event_seq")
        .select("VIN", "trip_local", "_sp")
    )
    return ordered.mapInPandas(_stream(method, penalty, min_size, splits), POSITION_SCHEMA)


def best_first_split(scanned: DataFrame, min_size: int = CHANGE_MIN_SIZE) -> DataFrame:
    """Per trip, the first split of the binary segmentation, as aggregations and running sums.

    ``scanned`` is a trip scan. The gain of every position follows from the trip's running sums,
    so trips of any length are split without being gathered anywhere.
    """
    rows = scanned.select(
        "VIN", "trip_local", "chunk", "_i", "_n", F.col("_x0").alias("sp")
    )
    summed = running_totals(
        rows,
        ["VIN", "trip_local"],
        "chunk",
        ["_i"],
        {"a1": F.col("sp"), "a2": F.col("sp") * F.col("sp")},
    )
    totals = rows.groupBy("VIN", "trip_local", "chunk").agg(
        F.sum("sp").alias("b1"), F.sum(F.col("sp") * F.col("sp")).alias("b2")
    )
    whole = Window.partitionBy("VIN", "trip_local")
    totals = totals.select(
        "VIN",
        "trip_local",
        "chunk",
        F.sum("b1").over(whole).alias("t1"),
        F.sum("b2").over(whole).alias("t2"),
    )
    cut = F.col("_i") + 1
    rest = F.col("_n") - cut
    left = F.col("a2") - F.col("a1") * F.col("a1") / cut
    right = (F.col("t2") - F.col("a2")) - (F.col("t1") - F.col("a1")) * (
        F.col("t1") - F.col("a1")
    ) / rest
    whole_cost = F.col("t2") - F.col("t1") * F.col("t1") / F.col("_n")
    gain = F.round(whole_cost - left - right, 6)
    flat = whole_cost / F.col("_n") < FLAT_STD * FLAT_STD
    return (
        attach(summed, totals, ["VIN", "trip_local", "chunk"])
        .where((F.col("_n") >= CHANGE_MIN_PINGS) & (cut >= min_size) & (rest >= min_size) & ~flat)
        .groupBy("VIN", "trip_local")
        .agg(F.max(F.struct(gain.alias("gain"), cut.alias("position"))).alias("s"))
        .select("VIN", "trip_local", "s.position", "s.gain")
    )
