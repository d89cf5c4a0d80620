import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.functions import eta, text
from haulcast.functions.geo import haversine_km
from haulcast.operators import calibrate, metrics
from haulcast.operators.quantiles import linear_quantiles, order_statistics, quantile_higher


def one(spark, rows, schema, column):
    return spark.createDataFrame(rows, schema).agg(column.alias("v")).first()["v"]


def test_hand_values(spark):
    yp = "y double, p double"
    assert one(spark, [(0.0, 3.0), (0.0, 4.0)], yp, metrics.mae("y", "p")) == 3.5
    assert one(spark, [(0.0, 3.0), (0.0, 4.0)], yp, metrics.rmse("y", "p")) == pytest.approx(12.5**0.5)
    assert one(spark, [(0.0, 5.0), (10.0, 12.0)], yp, metrics.mape("y", "p")) == pytest.approx(20.0)
    assert one(spark, [(0.0, 5.0)], yp, metrics.mape("y", "p")) is None
    assert one(spark, [(5.0, 10.0)], yp, metrics.pinball("y", "p", 0.9)) == pytest.approx(0.5)
    assert one(spark, [(10.0, 5.0)], yp, metrics.pinball("y", "p", 0.1)) == pytest.approx(0.5)


def test_near_arrival(spark):
    df = spark.createDataFrame([(5.0, 7.0), (20.0, 35.0), (80.0, 100.0)], "y double, p50 double")
    row = metrics.evaluate(df).first()
    assert (row["near_arrival_n"], row["near_arrival_mae"], row["within_tolerance_rate"]) == (2.0, 8.5, 0.5)
    far = metrics.evaluate(df.where("y > 60")).first()
    assert far["near_arrival_n"] == 0 and far["near_arrival_mae"] is None


def test_coverage_is_inclusive(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, 1.0, 2.0)], "y double, a double, b double")
    assert df.agg(metrics.coverage("y", "a", "b")).first()[0] == pytest.approx(2 / 3)


def test_haversine(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437)).alias("far"),
        haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("same"),
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
        haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("unknown"),
    ).first()
    assert 3900 < row["far"] < 4000 and row["same"] == 0
    assert row["half"] == pytest.approx(np.pi * 6371) and row["unknown"] is None


@pytest.mark.parametrize("limit", [10, 10_000])
@pytest.mark.parametrize("ties", [False, True])
def test_order_statistics_are_exact(spark, limit, ties):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 6, 3000).astype(float) if ties else rng.lognormal(0, 3, 3000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    ranks = [0, 1, 700, 1500, 2998, 2999]
    got = order_statistics(df, [(F.col("v"), ranks)], sort_limit=limit)[0]
    ordered = np.sort(values)
    assert got == {r: ordered[r] for r in ranks}
    for q in (0.0, 0.1, 0.8, 0.805, 1.0):
        assert quantile_higher(df, "v", q, sort_limit=limit) == np.quantile(values, q, method="higher")
    qs = [i / 8 for i in range(9)]
    np.testing.assert_allclose(linear_quantiles(df, "v", qs, limit), np.quantile(values, qs), rtol=1e-12)


def test_higher_is_not_percentile_disc(spark):
    assert quantile_higher(spark.range(10).select(F.col("id").cast("double").alias("v")), "v", 0.8) == 8.0


def test_degenerate_buckets(spark):
    rows = [(1.0, 0.5, 2.0, 1.5)] * 20
    df = spark.createDataFrame(rows, "y double, p10 double, p50 double, p90 double")
    fitted = calibrate.fit_bucket_scales(df)
    assert len(fitted.scales) == 1 and fitted.edges == [2.0, 2.0 + 1e-6]
    assert calibrate.interval_scale(df) == 1.0


def test_display_texts(spark):
    rows = [(0.0,), (59.9,), (60.0,), (125.5,), (-1.0,), (None,)]
    df = spark.createDataFrame(rows, "m double").select(text.format_hhmm(F.col("m")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["00:00", "00:59", "01:00", "02:05", "N/A", "N/A"]


def test_route_durations(spark):
    rows = [('{"routes":[{"duration":"123.4s"}]}',), ('{"routes":[{"duration":"90"}]}',), ('{"routes":[]}',), ("x",)]
    df = spark.createDataFrame(rows, "r string").select(eta.route_duration_min(F.col("r")).alias("m"))
    assert [r["m"] for r in df.collect()] == [pytest.approx(123.4 / 60), None, None, None]


def test_numbers_and_times_from_text(spark):
    cases = {"1": 1.0, "-2.5e1": -25.0, " 3 ": 3.0, "1_0": 10.0, "1d": None, "0x1": None, "": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r["v"] for r in df.select(text.parse_number(F.col("t")).alias("v")).collect()] == list(cases.values())
    times = {"2024-01-02 03:04:05": True, "2024-1-2 3:4:5": True, "2024-13-01 00:00:00": False, "2024-01-02": False, "": False}
    df = spark.createDataFrame([(k,) for k in times], "t string")
    assert [r["v"] for r in df.select(text.parse_time(F.col("t")).isNotNull().alias("v")).collect()] == list(times.values())


def test_budget(spark):
    columns = eta.budget_columns(*[F.lit(v) for v in (250, 30.0, 12.0, 0.15, 5.0, 2000.0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    assert row["pings_per_month"] == pytest.approx(10_800_000)
    assert row["calls_per_month"] == pytest.approx(1_620_000)
    assert row["calls_per_minute"] == pytest.approx(75.0)
    assert row["monthly_cost"] == pytest.approx(8100.0) and row["quota_ok"] and not row["budget_ok"]
