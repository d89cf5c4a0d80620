from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from haulcast.operators import changepoint, loadstate
from haulcast.operators.changepoint import PrunedSearch, binseg_positions, pelt_positions
from haulcast.operators.extras import smooth_eta

TWO = [5.0] * 10 + [30.0] * 10
FOUR = [5.0] * 8 + [35.0] * 8 + [8.0] * 8 + [25.0] * 8


def test_hand_signals():
    assert pelt_positions([20.0] * 20) == [] and binseg_positions([20.0] * 20) == []
    assert pelt_positions([20.0, 21.0, 22.0]) == [] and pelt_positions([]) == []
    assert pelt_positions(TWO, 0.5) == [10] and pelt_positions(FOUR) == [8, 16, 24]
    assert binseg_positions(TWO, 1) == [10] and len(binseg_positions(FOUR, 2)) == 2
    assert binseg_positions(FOUR, 0) == [] and pelt_positions([np.nan] * 10) == []


def segmentation_cost(x, cuts, penalty):
    bounds = [0, *cuts, len(x)]
    return sum(np.var(x[a:b]) * (b - a) for a, b in zip(bounds, bounds[1:])) + penalty * len(cuts)


def optimum(x, penalty, min_size):
    best = {0: -penalty}
    for t in range(min_size, len(x) + 1):
        options = [
            best[s] + np.var(x[s:t]) * (t - s) + penalty for s in range(0, t - min_size + 1) if s in best
        ]
        best[t] = min(options)
    return best[len(x)]


@pytest.mark.parametrize("seed", range(6))
def test_pruned_search_against_all_segmentations(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.uniform(0, 60, 12), rng.integers(2, 9, 12)) + rng.normal(0, 0.3, 1)
    x = x + rng.normal(0, 0.2, len(x))
    found = pelt_positions(x, 2.0)
    # pruning looks back at once, so with a minimum size the cost may exceed the optimum by little
    assert segmentation_cost(x, found, 2.0) <= optimum(x, 2.0, 2) + 2.0
    assert all(b - a >= 2 for a, b in zip([0, *found], [*found, len(x)]))


def test_streamed_pieces_give_the_same_points():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.uniform(0, 60, 200), rng.integers(2, 20, 200)) + 0.0
    whole = pelt_positions(x)
    search, got = PrunedSearch(), []
    for part in np.array_split(x, 37):
        search.push(part)
        got += search.settled()
    assert got + search.finish() == whole
    assert len(search.parent) < 200  # settled history is forgotten


def trip_table(spark, trips):
    start = datetime(2026, 4, 1, 8)
    rows = []
    for vin, speeds, weights in trips:
        for i, (s, w) in enumerate(zip(speeds, weights)):
            rows.append((vin, 1, len(rows), start + timedelta(minutes=i), 40.0, -74.0, s, w))
    return spark.createDataFrame(
        rows,
        "VIN string, trip_local long, event_seq long, Timestamp timestamp, Latitude double, Longitude double, "
        "Speed double, Weight_lbs double",
    )


def test_change_points_per_trip(spark):
    df = trip_table(spark, [("A", TWO, [None] * 20), ("B", FOUR, [None] * 32), ("C", [20.0] * 9, [None] * 9)])
    got = sorted((r["VIN"], r["position"]) for r in changepoint.change_points(df, "pelt").collect())
    assert got == [("A", 10), ("B", 8), ("B", 16), ("B", 24)]
    greedy = sorted((r["VIN"], r["position"]) for r in changepoint.change_points(df, "binseg", splits=1).collect())
    assert [v for v, _ in greedy] == ["A", "B"]
    with pytest.raises(ValueError):
        changepoint.change_points(df, "other")


@pytest.mark.parametrize("method", ["pelt", "binseg", "heuristic"])
def test_add_load_state(spark, method):
    df = trip_table(spark, [("A", TWO, [45000.0] * 10 + [None] * 10), ("C", [20.0] * 10, [None] * 10)])
    got = loadstate.add_load_state(df, method, chunk_seconds=300).orderBy("VIN", "event_seq").toPandas()
    a, c = got[got["VIN"] == "A"], got[got["VIN"] == "C"]
    assert len(got) == 30 and a["load_state"].tolist()[:9] == [1] * 9 and a["load_state"].tolist()[11:] == [0] * 9
    assert set(a["load_change_count"]) == {1} and set(c["load_change_count"]) == {0}


def test_state_changes_pass_over_unknown(spark):
    cases = {"A": [1, 1, -1, 0, 0], "B": [1, 1, 0, 0, 1, 1], "C": [-1, -1, -1], "D": [1], "E": [1, -1, 1, -1, 0]}
    rows = [(v, 1, i, i // 2, s) for v, states in cases.items() for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "VIN string, trip_local long, _i long, chunk long, load_state int")
    got = {r["VIN"]: r["load_change_count"] for r in loadstate.state_changes(df).collect()}
    assert got == {"A": 1, "B": 2, "C": 0, "D": 0, "E": 1}


def test_confusion(spark):
    def report(states, weights):
        df = spark.createDataFrame(list(zip(states, weights)), "load_state int, Weight_lbs double")
        return loadstate.load_confusion(df).collect()

    row = report([1, 1, 0, 0, 0, 1], [45000.0, 45000.0, 5000.0, 50000.0, 3000.0, 48000.0])[0]
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (3, 0, 1, 2)
    assert report([1, 1, 1, 0, 0, 0], [45000.0] * 3 + [5000.0] * 3)[0]["f1"] == 1.0
    assert report([1, 1, -1, 0, 0], [45000.0] * 3 + [5000.0] * 2)[0]["n_compared"] == 4
    assert report([1] * 6, [45000.0] + [None] * 5) == []


@pytest.mark.parametrize("alpha", [0.05, 0.3, 0.9])
def test_smoothing_over_many_blocks(spark, alpha):
    n = 700
    values = np.random.default_rng(2).uniform(0, 100, n)
    df = spark.createDataFrame([("A", 1, i, float(v)) for i, v in enumerate(values)], "VIN string, trip_local long, _i long, v double")
    got = smooth_eta(df.repartition(4), "v", alpha).orderBy("_i").toPandas()["eta_smoothed"].to_numpy()
    want, s = [], values[0]
    for v in values:
        s = alpha * v + (1 - alpha) * s if want else v
        want.append(s)
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("method", changepoint.METHODS)
def test_a_batch_of_many_trips_gives_one_table(method):
    """Trips are short, so a table for each of them would be most of the time."""
    signals = [FOUR, [5.0, 6.0], TWO, FOUR]
    rows = pd.DataFrame([("v", k, x) for k, signal in enumerate(signals) for x in signal], columns=["VIN", "trip_local", "_sp"])
    run = changepoint._stream(method, changepoint.CHANGE_PENALTY, changepoint.CHANGE_MIN_SIZE, None)
    positions = pelt_positions if method == "pelt" else binseg_positions
    want = [("v", k, p) for k, signal in enumerate(signals) for p in positions(np.array(signal))]
    for cut in (len(rows), 11):
        tables = list(run(iter([rows.iloc[:cut], rows.iloc[cut:]])))
        assert sorted(map(tuple, pd.concat(tables).to_numpy().tolist())) == want
        assert len(tables) <= 3
    built = []

    class Counted(pd.DataFrame):
        def __init__(self, *args, **kwargs):
            built.append(1)
            super().__init__(*args, **kwargs)

    frames = changepoint.pd.DataFrame
    try:
        changepoint.pd.DataFrame = Counted
        list(run(iter([rows])))
    finally:
        changepoint.pd.DataFrame = frames
    assert len(built) <= 2  # the batch's and the last trip's
