"""Histogram boosting against plain numpy, the tree-by-tree booster, and its own invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.operators import histboost, models
from haulcast.operators.histboost import BoostSpec, HistBoost, best_split, compressed, train_boosts, weighted_quantile


def table(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.uniform(size=n) * 10, rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    y = 5 * (a > 4) + b * b + 0.5 * a + rng.normal(size=n) * (1 + (b > 2))
    rows = [(float(p), float(q), float(r), float(s), 4.0 if s > 10 else 1.0) for p, q, r, s in zip(a, b, c, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double").repartition(3), np.array(rows)


def numpy_split(x, g, h, least=20):
    """The best plain split of one node: (gain, feature, threshold)."""
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            if h[low].sum() >= least and h[~low].sum() >= least:
                gain = g[low].sum() ** 2 / h[low].sum() + g[~low].sum() ** 2 / h[~low].sum() - g.sum() ** 2 / h.sum()
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, j, t)
    return best


def test_root_split_equals_the_plain_one(spark):
    df, _ = table(spark, n=400)
    df = df.withColumn("a", F.round("a", 0))  # fewer values than bins, so binning loses nothing
    data = np.array([tuple(r) for r in df.select("a", "b", "y", "w").collect()])
    for weight in (None, "w"):
        model = train_boosts(df, None, [BoostSpec("m", columns=("a", "b"), rounds=1, step=1.0, weight=weight, depth=1)])["m"]
        w = data[:, 3] if weight else np.ones(len(data))
        start = (w * data[:, 2]).sum() / w.sum()
        _, j, t = numpy_split(data[:, :2], w * (data[:, 2] - start), w)
        feature, threshold, *_, value = model.trees[0]
        assert model.start == pytest.approx(start) and (feature[0], threshold[0]) == (j, t)
        low = data[:, j] <= t
        assert value[1] == pytest.approx((w * (data[:, 2] - start))[low].sum() / w[low].sum())


def test_all_models_together_as_alone(spark):
    df, data = table(spark)
    specs = [
        BoostSpec("mean", columns=("a", "b", "c"), rounds=12, step=0.3),
        BoostSpec("weighted", columns=("a", "b"), rounds=9, step=0.3, weight="w"),
        BoostSpec("p90", 0.9, columns=("a", "b", "c"), rounds=12, step=0.3, patience=5),
        BoostSpec("masked", columns=("c",), rounds=4, step=0.3),
    ]
    together = train_boosts(df, df, specs, block_rows=400)
    assert {k: m.columns for k, m in together.items()} == {s.name: s.columns for s in specs}
    scored = df
    for name, model in together.items():
        scored = model.predict(scored, f"f_{name}")
        for tree in model.trees:
            leaves = (tree[0] < 0).sum()
            assert leaves <= 31 and tree[4] <= 6
        assert sum(v for _, v in model.importances()) == pytest.approx(1.0)
    rows = scored.toPandas()
    for s in specs:
        alone = train_boosts(df, df, [s])[s.name]  # one block instead of four
        other = alone.predict(df, "f").toPandas()
        merged = rows.merge(other[["a", "c", "f"]], on=["a", "c"])
        assert np.allclose(merged["f"], merged[f"f_{s.name}"], rtol=1e-6, atol=1e-6)
    spread = ((rows["y"] - rows["y"].mean()) ** 2).mean()
    assert ((rows["y"] - rows["f_mean"]) ** 2).mean() < 0.15 * spread
    assert (rows["y"] <= rows["f_p90"]).mean() == pytest.approx(0.9, abs=0.04)


def test_quantiles_no_worse_than_tree_by_tree(spark):
    df, _ = table(spark, n=900)
    data = models.assemble(df, ["a", "b", "c"])
    old = models.train_quantile_boost(data, data, 0.9, rounds=6, depth=5, step=0.4).predict(data, "f")
    spec = BoostSpec("p90", 0.9, columns=("a", "b", "c"), rounds=6, step=0.4, depth=5, patience=20)
    new = train_boosts(df, df, [spec])["p90"].predict(df, "f")
    loss = [x.agg(models.pinball("y", "f", 0.9)).first()[0] for x in (old, new)]
    assert loss[1] <= 1.05 * loss[0]


def test_saved_and_loaded_models_predict_the_same(spark, tmp_path):
    df, _ = table(spark, n=300)
    model = train_boosts(df, None, [BoostSpec("m", columns=("b", "a"), rounds=3, step=0.5)])["m"]
    model.save(str(tmp_path / "m"))
    again = HistBoost.load(str(tmp_path / "m"))
    both = again.predict(model.predict(df, "f"), "g")
    assert both.where("f <> g").count() == 0 and again.importances() == model.importances()


def test_odd_rows(spark):
    df, _ = table(spark, n=200)
    odd = df.limit(3).withColumn("a", F.lit(None).cast("double")).union(df.limit(2).withColumn("y", F.lit(None).cast("double")))
    spec = BoostSpec("m", columns=("a", "b"), rounds=2, step=0.5)
    with_odd, without = (train_boosts(x, None, [spec])["m"].predict(df, "f").agg(F.sum("f")).first()[0] for x in (df.union(odd), df))
    assert with_odd == pytest.approx(without)
    none = train_boosts(df.limit(0), None, [spec])["m"]
    assert none.trees == [] and none.predict(odd, "f").where("f = 0").count() == 5
    flat = train_boosts(df.withColumn("y", F.lit(2.0)), df, [spec, BoostSpec("q", 0.5, columns=("a",), rounds=5, patience=2)])
    assert flat["m"].predict(odd, "f").where("f = 2").count() == 5


def test_sketches_keep_ranks():
    rng = np.random.default_rng(1)
    x = rng.exponential(size=50_000)
    value, weight = np.zeros(0), np.zeros(0)
    for part in np.split(x, 20):
        value, weight = compressed(np.concatenate([value, part]), np.concatenate([weight, np.ones(len(part))]))
    assert len(value) <= 1024 and weight.sum() == pytest.approx(len(x))
    for q in (0.1, 0.5, 0.9):
        assert abs((x <= weighted_quantile(value, weight, q)).mean() - q) < 0.01
    assert weighted_quantile(*compressed(np.array([3.0, 1.0, 2.0]), np.ones(3)), 0.5) == 2.0


def test_leaf_quantiles_of_many_tasks():
    """Ranked residuals of all tasks are put together once; the driver keeps every point, also of tasks of unlike size."""
    rng = np.random.default_rng(4)
    block = lambda x: (np.zeros((1, len(x)), np.uint8), x, np.zeros(len(x), bool), np.zeros((0, len(x))), np.zeros((1, len(x))))
    leaf = {0: histboost.Tree().packed()}
    for sizes in ((3000, 700, 40_000, 1, 90), (5, 1, 30)):
        parts = [rng.exponential(size=n) + (n > 10_000) for n in sizes]
        sketches = [next(histboost._residuals(leaf, [0])([block(x)]))[0, 0] for x in parts]
        assert [n for _, n in sketches] == list(sizes) and max(len(value) for value, _ in sketches) <= 1024
        for x, (value, _) in zip(parts, sketches):
            assert np.array_equal(value, compressed(x, np.ones(len(x)))[0])
        every = np.sort(np.concatenate(parts))
        two = histboost._merged({(0, 0): sketches[0]}, {(0, 0): sketches[1]})[0, 0]
        assert two[1] == sizes[0] + sizes[1]
        for q in (0.1, 0.5, 0.9):
            got = histboost.leaf_quantile(sketches, q)
            assert abs((every <= got).mean() - q) <= 0.001 or got == weighted_quantile(every, np.ones(len(every)), q)
            assert histboost.leaf_quantile([two, *sketches[2:]], q) == pytest.approx(got, rel=0.02)
    whole = next(histboost._residuals(leaf, [0])([block(x) for x in parts]))[0, 0]  # blocks of one task
    assert np.array_equal(whole[0], every) and whole[1] == len(every)


def test_a_round_adds_one_stage_for_the_leaf_values(spark):
    """Few tasks: the sketches reach the driver in one job of one stage, as the sums do."""
    df, _ = table(spark)
    tracker, group = spark.sparkContext.statusTracker(), "leaf-values"
    spark.sparkContext.setJobGroup(group, group)
    try:
        train_boosts(df.repartition(8), None, [BoostSpec("p90", 0.9, columns=("a", "b", "c"), rounds=3, step=0.3)], block_rows=200)
        stages = [len(tracker.getJobInfo(j).stageIds) for j in sorted(tracker.getJobIdsForGroup(group))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(stages[-5:]) == {1}


def test_a_node_without_a_fine_split():
    g, h = np.zeros((2, 64)), np.zeros((2, 64))
    h[:, 3] = 100
    assert best_split(g, h, np.array([True, True])) is None


def test_a_job_follows_its_own_nodes_only():
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 64, (3, 500)).astype(np.uint8), rng.normal(size=500)
    tree = histboost.Tree()
    low, high = tree.split(0, 1, 30, 1.0)
    left, right = tree.split(high, 2, 10, 1.0)
    rows = np.flatnonzero(y > -1)
    reached = {node: own.tolist() for node, own in histboost.node_rows(tree.packed(), bins, rows)}
    at_high = bins[1, rows] > 30
    expected = {low: ~at_high, left: at_high & (bins[2, rows] <= 10), right: at_high & (bins[2, rows] > 10)}
    assert reached == {node: rows[mask].tolist() for node, mask in expected.items()}
    assert [node for node, _ in histboost.node_rows(tree.packed(), bins, rows, [left])] == [left]
    missing = np.array([[1.0], [np.nan], [np.nan]])
    assert [n for n, own in histboost.node_rows(tree.packed(), missing, np.arange(1)) if len(own)] == [right]  # nothing known: right


def test_rows_are_dealt_to_the_cluster_not_to_tasks_of_a_block():
    assert [histboost.task_count(n, 12) for n in (0, 5000, 20_000, 350_000, 20_000_000)] == [1, 1, 3, 12, 12]
    assert histboost.task_count(100_000_000, 12) == 48


def test_a_job_does_not_repeat_the_trees_of_earlier_rounds(spark, monkeypatch):
    """However many rounds lie between two writes, a task gets one round's trees to advance by."""
    sizes = []
    real = histboost.RDD.map

    def seen(self, f, preservesPartitioning=False):
        sizes.extend(len(d) for d in (f.__defaults__ or ()) if isinstance(d, list))
        return real(self, f, preservesPartitioning)

    monkeypatch.setattr(histboost.RDD, "map", seen)
    df, _ = table(spark, n=300)
    specs = [BoostSpec("a", columns=("a", "b"), rounds=13, step=0.5), BoostSpec("b", columns=("b",), rounds=13, step=0.5)]
    train_boosts(df, None, specs)
    assert sizes == [2] * 13
