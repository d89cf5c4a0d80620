"""The quantile booster's steps as named: leaf-wise trees, 255 bins, exact quantiles of the residuals in every leaf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulcast.operators import histboost, models
from haulcast.operators.histboost import BoostSpec, train_boosts


def numpy_best(x, g, least=20):
    """(gain, feature, threshold) of the best plain split of one node's rows."""
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            if low.sum() >= least and (~low).sum() >= least:
                gain = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - g.sum() ** 2 / len(g)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, t)
    return best


def numpy_leaf_wise(x, g, leaves, depth):
    """{(path of (feature, threshold, low)): rows} of the leaves: always the leaf that gains most is split."""
    done = {(): np.arange(len(g))}
    while len(done) < leaves:
        found = [(numpy_best(x[rows], g[rows]), path) for path, rows in done.items() if len(path) < depth]
        found = [(best, path) for best, path in found if best]
        if not found:
            break
        (_, j, t), path = max(found, key=lambda f: f[0][0])
        rows = done.pop(path)
        low = x[rows, j] <= t
        done[(*path, (j, t, True))], done[(*path, (j, t, False))] = rows[low], rows[~low]
    return done


def model_leaves(tree):
    feature, threshold, left, right, _, value = tree
    out, todo = {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if feature[node] < 0:
            out[path] = value[node]
        else:
            j, t = int(feature[node]), float(threshold[node])
            todo += [(left[node], (*path, (j, t, True))), (right[node], (*path, (j, t, False)))]
    return out


def exact(values, alpha):
    """The smallest value up to which the share ``alpha`` lies."""
    values = np.sort(values)
    return values[max(0, int(np.ceil(alpha * len(values))) - 1)]


def deep(n=6000, seed=2):
    """All that matters happens below a = 4, deeper and deeper; above it little does."""
    rng = np.random.default_rng(seed)
    a, b, c = (rng.integers(0, 12, n).astype(float) for _ in range(3))
    y = 40.0 * (a > 3) + (a <= 3) * (25 * (b > 5) + (b <= 5) * (16 * (c > 7) + (c <= 7) * 9 * (a > 1))) + 0.4 * (c > 3)
    return np.column_stack([a, b, c, y + rng.normal(size=n)])


@pytest.mark.parametrize("alpha, leaves", [(None, 5), (0.9, 4), (0.5, 12)])
def test_the_leaf_that_gains_most_is_split_next(spark, alpha, leaves):
    data = deep()
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, y double").repartition(3)
    model = train_boosts(df, None, [BoostSpec("m", alpha, columns=("a", "b", "c"), rounds=1, step=1.0, leaves=leaves)], block_rows=900)["m"]
    x, y = data[:, :3], data[:, 3]
    g = y - model.start if alpha is None else np.where(y >= model.start, alpha, alpha - 1.0)
    expected = numpy_leaf_wise(x, g, leaves, 6)
    found = model_leaves(model.trees[0])
    assert {frozenset(k) for k in found} == {frozenset(k) for k in expected} and len(found) == leaves
    assert max(len(path) for path in found) > np.ceil(np.log2(leaves))  # deeper than a tree filled level by level
    for path, rows in expected.items():
        miss = y[rows] - model.start
        assert found[path] == pytest.approx(miss.mean() if alpha is None else exact(miss, alpha), abs=1e-9)


def test_a_node_is_followed_only_if_it_may_be_split():
    spec, usable = BoostSpec("m", columns=("a",), leaves=3, depth=6), np.array([True])
    growing = histboost._Growing(spec, usable)
    g, h = np.zeros((1, 4)), np.full((1, 4), 100.0)
    growing.take(0, g + [9.0, 8.0, -8.0, -9.0], h)
    assert len(growing.split_level()) == 1
    left, right = growing.tree.left[0], growing.tree.right[0]
    growing.sums = {left: (g + [50.0, -50.0, 0, 0], h * [1, 1, 0, 0]), right: (g + [0, 0, 1.0, -1.0], h * [0, 0, 1, 1])}
    assert growing.split_level() == []  # the second and last split is the left child's
    growing.finish()
    assert growing.tree.feature == [0, 0, -1, -1, -1] and growing.tree.left[0] == 1 and growing.tree.left[1] == 3


def test_train_quantiles_fits_exact_leaf_quantiles_on_fine_bins(spark):
    n = 30_000
    rng = np.random.default_rng(6)
    x = rng.permutation(n) % 250
    y = np.round(x + rng.exponential(size=n) * (5 + x / 10), 4)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double")
    for name in models.FEATURE_COLS:
        df = df.withColumn(name, F.col("x") if name == "elapsed_s" else F.lit(0.0))
    for alpha, model in ((0.1, None), (0.9, None)):
        model = models.train_quantiles(df, df, (alpha,), rounds=2, step=1.0, patience=5)[models.quantile_name(alpha)]
        f = np.full(n, model.start)
        for tree in model.trees:
            leaf = np.zeros(n, dtype=int)
            column = np.zeros((len(models.FEATURE_COLS), n))
            column[models.FEATURE_COLS.index("elapsed_s")] = x
            for _ in range(tree[4]):
                low = column[np.maximum(tree[0][leaf], 0), np.arange(n)] <= tree[1][leaf]
                leaf = np.where(tree[0][leaf] < 0, leaf, np.where(low, tree[2][leaf], tree[3][leaf]))
            for k in np.unique(leaf):
                assert tree[5][k] == exact((y - f)[leaf == k], alpha)
            f += tree[5][leaf]
        cuts = {t for tree in model.trees for j, t in zip(tree[0], tree[1]) if j >= 0}
        assert len(cuts) > 20
    model = train_boosts(df, None, [BoostSpec("m", columns=("x",), rounds=1, step=1.0, depth=8, leaves=250)])["m"]
    assert (model.trees[0][0] < 0).sum() > 64  # one bin per value: more leaves than the 64 bins there were before


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9])
def test_exact_quantiles_of_unlike_tasks(spark, alpha):
    """Also where the tasks' rows differ so much that their windows miss the quantile, and with equal values."""
    rng = np.random.default_rng(7)
    for parts in ([rng.normal(size=9000), rng.normal(size=20_000) + 50, rng.normal(size=7)], [np.round(rng.exponential(size=8000), 1)] * 3, [np.zeros(5000), np.ones(3)]):
        block = lambda x: (np.zeros((1, len(x)), np.uint8), x, np.zeros(len(x), bool), np.zeros((0, len(x))), np.zeros((1, len(x))))
        blocks = spark.sparkContext.parallelize([block(x) for x in parts], len(parts))
        got = histboost.leaf_quantiles(blocks, {0: histboost.Tree().packed()}, {0: alpha})
        every = np.concatenate(parts)
        assert got == {(0, 0): exact(every, alpha)}
        windows = [histboost.window(x, alpha) for x in parts]
        stepwise = windows[0]
        for w in windows[1:]:
            stepwise = histboost.joined([stepwise, w], alpha)
        assert stepwise.below + len(stepwise.values) + stepwise.above == len(every)
        assert stepwise.quantile(alpha) in (None, exact(every, alpha))


def test_no_core_waits_for_the_last_tasks():
    assert [histboost.task_count(n, 6) for n in (12_000_000, 17_000_000, 30_000_000)] == [6, 12, 18]


def test_masks_find_the_rows_of_a_node():
    rng = np.random.default_rng(8)
    bins, tree = rng.integers(0, 255, (2, 700)).astype(np.uint8), histboost.Tree()
    low, high = tree.split(0, 0, 100, 1.0)
    tree.split(high, 1, 30, 1.0)
    tree.split(low, 1, 200, 1.0)
    packed, fit = tree.packed(), rng.random(700) < 0.7
    for wanted in (None, [high], [low, 4]):
        rows = {node: own.tolist() for node, own in histboost.node_rows(packed, bins, np.flatnonzero(fit), wanted)}
        assert {node: np.flatnonzero(own).tolist() for node, own in histboost.node_masks(packed, bins, fit, wanted)} == rows
    numbers = histboost.leaf_numbers(packed, bins)
    assert all(set(numbers[own]) == {node} for node, own in histboost.node_rows(packed, bins, np.arange(700)))


@pytest.mark.parametrize("alpha", [None, 0.1, 0.9])
def test_root_sums_of_a_later_round_need_no_counts(alpha):
    """The counts are those of the first round; of a quantile model only the rarer side is counted."""
    rng = np.random.default_rng(9)
    bins, y, held = rng.integers(0, 9, (2, 900)).astype(np.uint8), rng.normal(size=900), rng.random(900) < 0.2
    blocks = [(bins, y, held, np.zeros((0, 900)), np.full((1, 900), 0.3))]
    run = lambda known: next(histboost._summer([BoostSpec("m", alpha)], [], [[0, 1]], 9, {0: histboost.Tree().packed()}, {0: [0]}, known, [])(blocks))
    first, second = run([]), run([0])
    kind = int(alpha is None)
    above, every = first[kind].reshape(2, 2, 9)
    assert every.sum() == 2 * (~held).sum()
    assert np.allclose(second[kind].reshape(2, 9), every - above if alpha == 0.1 else above)
