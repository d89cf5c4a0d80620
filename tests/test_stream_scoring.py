"""A stream scored by saved models gives what a batch job gives; versions change between batches."""

import tempfile
from pathlib import Path

import numpy as np
import pytest

from haulcast.operators.calibrate import BucketScales, Calibration
from haulcast.operators.histboost import HistBoost
from haulcast.operators.models import NearChoice
from haulcast.plans.training import Trained
from haulcast.schema import FEATURE_COLS
from haulcast.streaming import scoring

COLUMNS = tuple(FEATURE_COLS)
QUANTILES = ("p10", "p50", "p90")


def stumps(name, shift, seed):
    """A model of ten trees of one split each."""
    draw = np.random.default_rng(seed)
    trees = [
        (np.array([draw.integers(len(COLUMNS)), -1, -1]), np.array([draw.normal(), 0.0, 0.0]), np.array([1, 0, 0]),
         np.array([2, 0, 0]), 1, np.array([0.0, *draw.normal(size=2)])) for _ in range(10)
    ]
    return HistBoost(name, shift, 0.5, COLUMNS, trees, dict.fromkeys(COLUMNS, 1.0))


def trained(seed):
    return Trained(
        quantiles={q: stumps(q, 10.0 * k, seed + k) for k, q in enumerate(QUANTILES)},
        baseline=stumps("baseline", 9.0, seed + 7),
        specialist=stumps("specialist", 8.0, seed + 8),
        near=NearChoice("blend", 10.0, 0.5, 1.0, 0.5),
        calibration=Calibration(1.1, 1.2, 1.0, BucketScales([0.0, 10.0, 20.0], [1.0, 1.5]), 2.0),
    )


def feature_rows(spark, start, n):
    draw = np.random.default_rng(start)
    rows = []
    for k in range(start, start + n):
        values = [float(x) for x in draw.normal(size=len(COLUMNS))]
        if k % 10 == 3:
            values[k % len(COLUMNS)] = None
        if k % 10 == 7:
            values[k % len(COLUMNS)] = float("nan")
        rows.append((f"V{k % 3}", k, float(k % 60), *values))
    schema = "VIN string, event_seq long, Speed double, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return {r["event_seq"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_streamed_predictions_equal_batch_predictions(spark):
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    first, second = trained(1), trained(100)
    parts = [feature_rows(spark, 0, 60), feature_rows(spark, 60, 60)]

    def run():
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in")
        scoring.score_stream(stream, f"{folder}/models", f"{folder}/out", f"{folder}/state")

    parts[0].write.parquet(f"{folder}/in")
    with pytest.raises(Exception, match="no saved models"):
        run()
    assert scoring.publish(spark, first, f"{folder}/models") == 1
    run()
    # a version that is only half written is not taken up
    Path(f"{folder}/models/version=2/p10").mkdir(parents=True)
    assert scoring.versions(spark, f"{folder}/models") == [1]
    assert scoring.publish(spark, second, f"{folder}/models") == 2
    parts[1].write.mode("append").parquet(f"{folder}/in")
    run()

    out = spark.read.parquet(f"{folder}/out")
    wanted = (*QUANTILES, "naive", "baseline", "specialist", "near_opt")
    got = values(out, *wanted)
    assert out.count() == 120 and set(got) == set(range(120))
    for model, part, number in ((first, parts[0], 1), (second, parts[1], 2)):
        expected = values(model.predict(part), *wanted)
        assert 0 < len(expected) < 60
        seen = values(out.where(f"model_version = {number}"), *wanted)
        assert set(seen) == set(values(part, "event_seq"))
        for k, row in seen.items():
            if k in expected:
                assert row == pytest.approx(expected[k], abs=1e-12)
            else:
                assert row[:3] == (None, None, None) and row[4:] == (None, None, None)


def test_a_repeated_batch_replaces_its_rows(spark):
    folder = tempfile.mkdtemp(prefix="haulcast-test-")
    rows = feature_rows(spark, 0, 40)
    rows.coalesce(1).write.parquet(f"{folder}/in")
    scoring.publish(spark, trained(5), f"{folder}/models")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        scoring.score_stream(stream, f"{folder}/models", f"{folder}/out", f"{folder}/state")
        for commit in Path(f"{folder}/state/commits").iterdir():
            commit.rename(f"{folder}/lost-{commit.name.strip('.')}-{_}")
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r["event_seq"] for r in out.collect()) == list(range(40))
