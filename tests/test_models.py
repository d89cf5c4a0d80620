import pytest
from pyspark.sql import functions as F

from haulcast.operators import models
from haulcast.operators.models import NearChoice, choose_near
from haulcast.operators.routes import route_asof, route_refreshes
from haulcast.plans import training
from haulcast.plans.scoring import batch_predict, response_json
from haulcast.sources.requests import parse_requests

BODY = (
    '{"vin": "A", "trip_id": 7, "latitude": 41.8781, "longitude": "-87.6298", "destination_latitude": 39.7392,'
    ' "destination_longitude": -104.9903, "speed_mph": 55.0, "use_google_routes": %s}'
)


def test_split_keeps_trips_together(spark):
    rows = spark.range(4000).select(F.format_string("V%03d", F.col("id") % 200).alias("VIN"), (F.col("id") % 5).alias("trip_local"))
    for exact in (False, True):
        df = models.trip_split(rows, exact=exact)
        per_trip = df.groupBy("VIN", "trip_local").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"))
        assert per_trip.where("n > 1").count() == 0
        sizes = {r["s"]: r["count"] for r in per_trip.groupBy("s").count().collect()}
        if exact:
            assert sizes == {"test": 40, "validation": 20, "train": 140}


def test_choice_walks_in_order():
    a = NearChoice("global", 60, 0, 10.0, 0.5)
    b = NearChoice("naive", 60, 0, 10.00001, 0.6)  # about the same error, better rate
    c = NearChoice("specialist", 60, 0, 10.00005, 0.7)
    d = NearChoice("blend_naive", 60, 0.25, 11.0, 0.9)
    assert choose_near([a, b, c, d]) == c
    assert choose_near([a, d]) == a
    assert choose_near([NearChoice("global", 60, 0, None, None), b]).mode == "global"


def test_quantile_boost_learns_and_survives_saving(spark, tmp_path):
    rows = spark.range(2000).select(
        ((F.col("id") * 7919) % 100).cast("double").alias("x"),
        (((F.col("id") * 7919) % 100) + (F.col("id") * 104729) % 50).cast("double").alias("y"),
    )
    data = models.assemble(rows, ["x"]).select("features", "y")
    model = models.train_quantile_boost(data, data, 0.9, rounds=6, depth=3, step=0.5, cut_every=2)
    chain = data.withColumn("p", F.lit(model.start))
    for i in range(len(model.trees)):
        chain = model._add(chain, "p", i)
    assert [r["p"] for r in chain.collect()] == [r["p"] for r in model.predict(data, "p").collect()]
    scored = model.predict(data, "p90")
    share = scored.agg(F.avg((F.col("y") <= F.col("p90")).cast("double"))).first()[0]
    assert share == pytest.approx(0.9, abs=0.06)
    model.save(str(tmp_path / "m"))
    again = models.QuantileBoost.load(str(tmp_path / "m")).predict(data, "p90")
    assert again.agg(F.sum("p90")).first()[0] == pytest.approx(scored.agg(F.sum("p90")).first()[0])


def test_requests(spark):
    rows = [(BODY % "true",), (BODY % "false",), ("{nope",), ("",), ('{"vin": "A"}',), ((BODY % "false").replace("55.0", '"fast"'),)]
    bodies = spark.createDataFrame(rows, "body string")
    errors = [r["error"] for r in parse_requests(bodies).collect()]
    assert errors[:4] == [None, None, "Invalid JSON", "Request body is required"]
    assert errors[4].startswith("Missing fields: trip_id, latitude, longitude") and "numeric" in errors[5]
    responses, rejected = batch_predict(bodies, F.lit(1000.0), F.lit("now"))
    asked, plain = responses.orderBy(F.desc("method")).collect()[::-1]
    assert plain["method"] == "physics_speed_haversine" and plain["google_route_eta_min"] is None
    assert plain["eta_remaining_min"] == plain["blended_eta_min"]
    assert asked["blended_eta_min"] == pytest.approx(0.7 * asked["eta_remaining_min"] + 300, abs=2e-3)
    assert rejected.count() == 4
    assert '"google_route_eta_min":null' in [r[0] for r in responses.where("method like 'physics%'").select(response_json(responses)).collect()][0]


def chain_rows(seed, n=400):
    import random

    rng = random.Random(seed)
    rows, at = [], 0
    for k in range(n):
        at += rng.choice([0, 5, 60, 200, 600, 2000])
        rows.append((rng.choice("AAAB"), rng.randrange(2), k, at, rng.choice([41.001, 41.004, 41.2, None]), 9.0, 40.0, 8.0))
    rows.append(("A", 0, n, None, 41.0, 9.0, 40.0, 8.0))
    return rows


@pytest.mark.parametrize("chunk", [100, 3600, 10**6])
def test_route_refreshes(spark, chunk):
    rows = chain_rows(chunk)
    pings = spark.createDataFrame(rows, "VIN string, trip_local long, event_seq long, s long, Latitude double, Longitude double, destination_latitude double, destination_longitude double")
    pings = pings.withColumn("Timestamp", F.timestamp_seconds("s")).drop("s")
    last, want = {}, {}
    for vin, trip, seq, s, lat, *_ in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[2])):
        if s is None or lat is None:
            want[seq] = (False, None)
            continue
        key = (vin, trip, round(lat, 2))
        if key not in last or s >= last[key][0] + 900:
            last[key] = (s, seq)
        want[seq] = (last[key][1] == seq, last[key][1])
    got = route_refreshes(pings, ttl_minutes=15, chunk_seconds=chunk)
    assert got.columns == [*pings.columns, "refresh", "served_by"]
    assert {r["event_seq"]: (r["refresh"], r["served_by"]) for r in got.collect()} == want
    assert route_refreshes(pings.limit(0)).count() == 0


def test_route_refreshes_of_one_long_key(spark):
    pings = spark.range(3000).select(F.lit("A").alias("VIN"), F.lit(1).cast("long").alias("trip_local"), F.col("id").alias("event_seq"), F.timestamp_seconds(F.col("id") * 7).alias("Timestamp"))
    for c in ("Latitude", "Longitude", "destination_latitude", "destination_longitude"):
        pings = pings.withColumn(c, F.lit(1.0))
    got = route_refreshes(pings, ttl_minutes=1, chunk_seconds=1000).where("refresh").select("event_seq").collect()
    assert sorted(r[0] for r in got) == list(range(0, 3000, 9))  # the first ping at least 60 s later is the ninth


@pytest.mark.parametrize("chunk", [300, 3600, 10**6])
def test_route_lifetime(spark, chunk):
    pings = spark.createDataFrame([("A", 0), ("A", 600), ("A", 1500), ("A", 1501), ("B", 600)], "VIN string, s long")
    pings = pings.withColumn("Timestamp", F.timestamp_seconds("s"))
    routes = spark.createDataFrame([("A", 600, "120s"), ("A", 590, "60s"), ("A", 610, "bad")], "VIN string, s long, duration string")
    routes = routes.select("VIN", F.timestamp_seconds("s").alias("route_ts"), "duration")
    got = {(r["VIN"], r["s"]): r["route_eta_min"] for r in route_asof(pings, routes, chunk_seconds=chunk).collect()}
    assert got == {("A", 0): None, ("A", 600): 2.0, ("A", 1500): 2.0, ("A", 1501): None, ("B", 600): None}


class _Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name, where, sizes",
    [
        ("gbt_baseline", "haulcast.operators.models.train_baseline", {"rounds": 200, "depth": 6}),
        ("near_specialist", "haulcast.operators.models.train_near_specialist", {"rounds": 300, "depth": 6}),
        ("quantile_gbt", "haulcast.operators.models.train_quantiles", {"rounds": 300, "depth": 6, "patience": 20}),
        ("predict_quantiles", "haulcast.operators.models.train_quantiles", {"rounds": 300, "depth": 6, "patience": 20}),
        ("train_pipeline", "haulcast.plans.training.fit", {"options": training.TrainingOptions()}),
        ("model_save_load", "haulcast.plans.training.fit", {"options": training.TrainingOptions()}),
        ("feature_importance", "haulcast.operators.models.train_baseline", {"rounds": 200, "depth": 6}),
        ("ablation", "haulcast.operators.models.baseline_spec", {"rounds": 200, "depth": 6}),
        ("model_variants", "haulcast.operators.extras.train_forest", {"trees": 20, "depth": 6}),
        ("model_variants", "haulcast.operators.extras.tune_by_trip", {"folds": 3}),
    ],
)
def test_registered_queries_train_full_sizes(spark, monkeypatch, name, where, sizes):
    import inspect
    from importlib import import_module
    from unittest.mock import MagicMock

    from workload import queries

    module, function = where.rsplit(".", 1)
    signature = inspect.signature(getattr(import_module(module), function))

    def asked(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        assert {k: call.arguments[k] for k in sizes} == sizes
        raise _Asked

    for target in ("trips", "model_rows"):
        monkeypatch.setattr(queries, target, MagicMock())
    monkeypatch.setattr(queries, "model_parts", lambda *_: (MagicMock(), MagicMock(), MagicMock()))
    for other in ("train_linear", "train_forest", "tune_by_trip"):
        monkeypatch.setattr(queries.extras, other, MagicMock())
    monkeypatch.setattr(queries.training, "training_rows", MagicMock())
    monkeypatch.setattr(queries.models, "assemble", MagicMock())
    monkeypatch.setattr(where, asked)
    with pytest.raises(_Asked):
        queries.QUERIES[name](spark, "")
