"""Geohash cells and density clusters against known values and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haulcast.operators.cells import cell_density, geohash, neighbours, parent
from haulcast.operators.clusters import components, density_clusters

POINTS = "id long, x double, y double"


def test_geohash_known_values_and_borders(spark):
    rows = spark.createDataFrame(
        [(57.64911, 10.40744), (42.6, -5.6), (90.0, 180.0), (-90.0, -180.0), (None, 1.0), (91.0, 0.0), (float("nan"), 0.0)],
        "lat double, lon double",
    )
    got = [r[0] for r in rows.select(geohash(F.col("lat"), F.col("lon"), 5)).collect()]
    assert got == ["u4pru", "ezs42", "zzzzz", "00000", None, None, None]
    cell = F.lit("u4pru")
    assert spark.range(1).select(parent(cell, 3), parent(cell, 6)).first()[:] == ("u4p", None)
    with pytest.raises(ValueError):
        geohash(F.col("lat"), F.col("lon"), 13)


def test_neighbours_touch_and_wrap(spark):
    one = lambda c: spark.range(1).select(neighbours(F.lit(c), len(c))).first()[0]
    assert one("ezs42") == sorted(["ezefr", "ezs43", "ezefx", "ezs48", "ezs49", "ezefp", "ezs40", "ezs41"])
    assert set(one("z")) == {"b", "8", "x", "w", "y"}  # across the date line
    for cell in one("9q8"):
        assert "9q8" in one(cell)
    assert len(one("zz")) < 8  # nothing beyond the pole


def test_levels_add_up(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(30, 50), rnd.uniform(-120, -60), rnd.choice([None, 0.0, 30.0])) for _ in range(300)] + [(None, 1.0, 1.0)]
    pings = spark.createDataFrame(rows, "Latitude double, Longitude double, Speed double")
    found = cell_density(pings, 4, 2).collect()
    for level in (2, 3, 4):
        assert sum(r["pings"] for r in found if r["level"] == level) == 300
    by = {r["cell"]: r["pings"] for r in found}
    assert all(by[c] == sum(n for d, n in by.items() if len(d) == len(c) + 1 and d.startswith(c)) for c in by if len(c) < 4)
    assert cell_density(pings.limit(0)).count() == 0


def brute(points, eps, least):
    finite = [p for p in points if all(v is not None and math.isfinite(v) for v in p[1:])]
    near = {
        i: [j for j, q in enumerate(finite) if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= eps * eps]
        for i, p in enumerate(finite)
    }
    core = {i for i in near if len(near[i]) >= least}
    name, seen = {}, set()
    for start in core:
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            i = todo.pop()
            group.append(i)
            for j in near[i]:
                if j in core and j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min(finite[i][0] for i in group)
        name |= dict.fromkeys(group, first)
    out = {p[0]: (None, False) for p in points}
    for i, p in enumerate(finite):
        if i in core:
            out[p[0]] = (name[i], True)
        elif any(j in core for j in near[i]):
            out[p[0]] = (min(name[j] for j in near[i] if j in core), False)
    return out


def labels(spark, points, eps, least, block=4096):
    found = density_clusters(spark.createDataFrame(points, POINTS), eps, least, block).collect()
    assert len(found) == len(points)
    return {r["id"]: (r["cluster_id"], r["is_core"]) for r in found}


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(7)
    blobs = [(rnd.gauss(cx, 0.4), rnd.gauss(cy, 0.4)) for cx, cy in ((0, 0), (2.2, 0.1), (-3, 4)) for _ in range(90)]
    chain = [(6 + 0.9 * k, -2.0) for k in range(25)]
    strewn = [(rnd.uniform(-8, 8), rnd.uniform(-8, 8)) for _ in range(120)]
    hot = [(5.0, 5.0)] * 150  # one place holds a quarter of the rows
    grid = [(0.5 * i - 8, 0.5 * j + 9) for i in range(8) for j in range(8)]  # distances of exactly eps
    places = blobs + chain + strewn + hot + grid
    points = [(i, x, y) for i, (x, y) in enumerate(places)]
    points += [(9001, None, 1.0), (9002, float("nan"), 1.0), (9003, 1.0, float("inf")), (9004, -0.0, 0.0), (9005, 0.0, -0.0)]
    rnd.shuffle(points)
    for eps, least in ((0.5, 5), (1.0, 3)):
        assert labels(spark, points, eps, least, block=7) == brute(points, eps, least)


def test_close_full_cells_that_do_and_do_not_touch(spark):
    """Two full columns of locations, just within and just beyond eps of each other."""
    for apart, one in ((0.9999, True), (1.0001, False)):
        points = [(i, 0.0, 0.001 * i) for i in range(60)] + [(100 + i, apart, 0.001 * i + 0.0005 * (not one)) for i in range(60)]
        got = labels(spark, points, 1.0, 4)
        assert got == brute(points, 1.0, 4)
        assert len({c for c, _ in got.values()}) == (1 if one else 2)


def test_clusters_of_empty_tables_and_bad_parameters(spark):
    assert labels(spark, [], 1.0, 3) == {}
    assert labels(spark, [(1, 0.0, 0.0), (2, 9.0, 9.0)], 1.0, 1) == {1: (1, True), 2: (2, True)}
    assert labels(spark, [(1, 0.0, 0.0), (2, 9.0, 9.0)], 1.0, 2) == {1: (None, False), 2: (None, False)}
    with pytest.raises(ValueError):
        density_clusters(spark.createDataFrame([], POINTS), 0.0, 1)


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(150)], "a long, b long")
    got = {r["n"]: r["root"] for r in components(spark.range(200).withColumnRenamed("id", "n"), links).collect()}
    chain = order[:151]
    assert got == {n: min(chain) if n in chain else n for n in range(200)}
