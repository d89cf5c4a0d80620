"""Histogram gradient boosting: squared error and quantiles, all models grown side by side.

Features are binned once, into at most 255 bins, at sketched quantiles. A tree grows leaf-wise: of all its
leaves, at any depth, the one whose split gains most is split next, until the tree has its number of leaves.
The sums this needs are taken a depth at a time: one job sums gradients by (model, node, feature, bin) over
all rows, the sums are added up a tree of tasks, and the driver, which sees sums only, replays the splits in
the order of their gain; nodes that cannot be among the splits whatever lies below the others are not followed.
Of two children only the smaller is summed; its sibling is the parent less it. Leaves of squared-error models
take the mean residual from the same sums, those of quantile models the exact quantile of their residuals
(see ``window``). Models that are trained together (quantiles, baseline, a weighted specialist, ablations
with features left out) share every job.

Rows are blocks of binned features and running predictions, one array per column. Every round's first job
advances the predictions by the trees of the round before and keeps the blocks; they are written to the
shared checkpoint folder every few rounds, so a lost executor costs at most the rounds since. A job follows
the open nodes only, by masks over a block's rows: comparing and combining bytes costs a fraction of moving row
numbers. The sums of a quantile model are counts, above and below its predictions; the counts behind a tree's root
are the same every round and are taken once. Blocks are an RDD because a round has up to seven
jobs on the same arrays, each of which returns one array of sums; what reaches the driver does not grow with
the rows. There are as many tasks as the cluster runs at once, and more only beyond ``TASK_ROWS`` rows each.

Rows without a label, or with a missing feature, are left out of the fit; a missing feature goes to the
right when a model predicts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush
from math import ceil, floor, inf, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURE_COLS
from ..session import checkpoint_root, cut_lineage

BINS = 255
BLOCK_ROWS = 1 << 16  # rows of a block
FEW_ROWS = 1 << 13  # rows that are not spread over more tasks
TASK_ROWS = 1 << 21  # rows of a task, at most; its blocks are read one after the other
FLAT_REDUCE = 32  # tasks up to which the driver adds up the sums alone
LEAST_ROWS = 20.0  # weight of the rows on either side of a split, at least
LEAST_GAIN = 1e-9
SKETCH = 1024  # points that stand for a leaf's residuals; fewer residuals are kept as they are
SPREADS = 6.0  # standard deviations of a task's share below a leaf's quantile that its window reaches to either side
CUT_EVERY = 10  # rounds after which running predictions are written
ACCURACY = 10_000  # of the sketches behind the bins and the start values


@dataclass(frozen=True)
class BoostSpec:
    """What one model learns: a quantile, or (``alpha`` None) the mean, weighted by ``weight`` where given."""

    name: str
    alpha: float | None = None
    rounds: int = 300
    step: float = 0.05
    columns: tuple[str, ...] = tuple(FEATURE_COLS)
    weight: str | None = None
    patience: int | None = None  # rounds without a lower validation loss after which growing ends
    depth: int = 6
    leaves: int = 31


class Tree:
    """A tree as arrays over its nodes; node 0 is the root, a leaf has feature -1."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.gain, self.depth = [-1], [0], [0], [0], [0.0], [0]
        self.value = None

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = kids
        for kid in kids:
            for column, value in ((self.feature, -1), (self.cut, 0), (self.left, kid), (self.right, kid), (self.gain, 0.0), (self.depth, self.depth[node] + 1)):
                column.append(value)
        return kids

    def packed(self) -> tuple:
        value = None if self.value is None else np.asarray(self.value)
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right), max(self.depth), value


def node_rows(tree: tuple, columns: Sequence[np.ndarray], rows: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, row numbers that reach it, in the order of ``rows``) of every leaf or, if given, of the ``wanted`` nodes.

    ``columns`` are binned (or, with thresholds for cuts, plain) features, one array each.
    """
    feature, cut, left, right = (x.tolist() for x in tree[:4])
    if wanted is None:
        ends = follow = {k for k, j in enumerate(feature) if j < 0}
    else:
        ends = set(wanted)
        follow = set(ends)
    if follow is ends:
        follow = set(range(len(feature)))
    else:
        for node in range(len(feature) - 1, -1, -1):  # children have higher numbers than their parent
            if feature[node] >= 0 and (left[node] in follow or right[node] in follow):
                follow.add(node)
    open_nodes = [(0, rows)] if 0 in follow else []
    while open_nodes:
        node, own = open_nodes.pop()
        if node in ends:
            yield node, own
            continue
        low = columns[feature[node]].take(own) <= cut[node]
        if right[node] in follow:
            open_nodes.append((right[node], own[~low]))
        if left[node] in follow:
            open_nodes.append((left[node], own[low]))


def node_masks(tree: tuple, columns: Sequence[np.ndarray], top: np.ndarray | None = None, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, flags of the rows that reach it) of every leaf or of the ``wanted`` nodes; ``top`` flags the rows to look at."""
    feature, cut, left, right = (x.tolist() for x in tree[:4])
    ends = {k for k, j in enumerate(feature) if j < 0} if wanted is None else set(wanted)
    follow = set(ends)
    for node in range(len(feature) - 1, -1, -1):  # children have higher numbers than their parent
        if feature[node] >= 0 and (left[node] in follow or right[node] in follow):
            follow.add(node)
    top = np.ones(len(columns[0]), dtype=bool) if top is None else top
    open_nodes = [(0, top)] if 0 in follow else []
    while open_nodes:
        node, own = open_nodes.pop()
        if node in ends:
            yield node, own
            continue
        low = columns[feature[node]] <= cut[node]
        if right[node] in follow:
            open_nodes.append((right[node], own > low))
        if left[node] in follow:
            open_nodes.append((left[node], own & low))


def leaf_numbers(tree: tuple, columns: Sequence[np.ndarray]) -> np.ndarray:
    """The node number of every row's leaf."""
    kind = np.uint8 if len(tree[0]) <= 256 else np.uint32
    numbers = np.zeros(len(columns[0]), dtype=kind)
    for node, own in node_masks(tree, columns):
        numbers |= own * kind(node)
    return numbers


# --- tasks ----------------------------------------------------------------------------------


def _advanced(block, grown):
    """The block with running predictions after the trees ``grown`` since: [(model, step, tree)]."""
    bins, y, held, w, f = block
    f = f.copy()
    for model, step, tree in grown:
        f[model] += (step * tree[-1]).take(leaf_numbers(tree, bins))
    return bins, y, held, w, f


def _summer(specs, weights, used, width, partial, wanted, known, losses):
    """Two arrays per task, counts and sums.

    For every wanted node of a squared-error model the sums of the negative gradient and of the weight by (node,
    feature, bin); of a quantile model the rows at or above its prediction and all rows. ``used`` names the features to
    sum for each model. Of a model in ``known`` the second ones are not asked for, and only the rarer side of a
    quantile model is counted. Then (loss, rows) of the held rows per model.
    """

    def sums(spec, weight, bins, y, f, features, own, slot, nodes, known):
        """(two or one, node, feature, bin)"""
        every = len(own) == len(y)
        part = (lambda x: x) if every else (lambda x: x.take(own))
        cells = nodes * width
        out = np.empty((1 if known else 2, nodes, len(features), width), np.uint32 if spec.alpha is not None else np.float64)
        base = 0 if nodes == 1 else slot * width
        if spec.alpha is not None and not known:
            base = base + part(y >= f) * np.intp(cells)
        elif spec.alpha is None:
            g, h = part(y - f), None if weight is None else part(weight)
            g = g if h is None else g * h
        for k, j in enumerate(features):
            at = part(bins[j]) if isinstance(base, int) else base + part(bins[j])
            if spec.alpha is None:
                out[0, :, k] = np.bincount(at, g, cells).reshape(nodes, width)
                if not known:
                    out[1, :, k] = np.bincount(at, h, cells).reshape(nodes, width)
            elif known:
                out[0, :, k] = np.bincount(at, minlength=cells).reshape(nodes, width)
            else:
                below, above = np.bincount(at, minlength=2 * cells).reshape(2, nodes, width)
                out[0, :, k], out[1, :, k] = above, below + above
        return out.ravel()

    def run(blocks):
        total = None
        for bins, y, held, w, f in blocks:
            counts, parts, fit = [np.zeros(0, np.uint32)], [], ~held
            for model, nodes in wanted.items():
                spec = specs[model]
                top = fit
                if model in known and spec.alpha is not None:
                    top = fit & (y >= f[model] if spec.alpha >= 0.5 else y < f[model])
                masks = dict(node_masks(partial[model], bins, top, nodes))
                own = [np.flatnonzero(masks[node]) for node in nodes]
                slot = np.repeat(np.arange(len(nodes)), [len(x) for x in own])
                weight = None if spec.weight is None else w[weights.index(spec.weight)]
                found = sums(spec, weight, bins, y, f[model], used[model], np.concatenate(own), slot, len(nodes), model in known)
                (parts if spec.alpha is None else counts).append(found)
            aside = np.flatnonzero(held) if losses else None
            for model in losses:
                spec = specs[model]
                miss = y.take(aside) - f[model].take(aside)
                loss = miss * miss if spec.alpha is None else np.maximum(spec.alpha * miss, (spec.alpha - 1.0) * miss)
                parts.append(np.array([loss.sum(), len(aside)], dtype=np.float64))
            found = np.concatenate(counts), np.concatenate([np.zeros(0), *parts])
            total = found if total is None else (total[0] + found[0], total[1] + found[1])
        if total is not None:
            yield total

    return run


def _added(a: tuple, b: tuple) -> tuple:
    """The arrays of two tasks put together; counts of one task fit 32 bits, those of all need not."""
    return a[0].astype(np.int64) + b[0], a[1] + b[1]


def compressed(value: np.ndarray, weight: np.ndarray, points: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """Weighted values by rank; more than ``points`` are stood for by as many, evenly spaced in weight."""
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    if len(value) > points:
        total = weight.sum()
        at = np.searchsorted(np.cumsum(weight), (np.arange(points) + 0.5) * total / points)
        value, weight = value[np.minimum(at, len(value) - 1)], np.full(points, total / points)
    return value, weight


def ranked(value: np.ndarray, points: int = SKETCH) -> np.ndarray:
    """The values that ``compressed`` keeps of values that all weigh one."""
    value = np.sort(value)
    if len(value) > points:
        value = value[np.ceil((np.arange(points) + 0.5) * len(value) / points).astype(np.intp) - 1]
    return value


def _residuals(partial, quantiles):
    """One sketch per (model, leaf) of a task: ranked residuals of equal weight and the number of rows behind them."""

    def run(blocks):
        found = {}
        for bins, y, held, _, f in blocks:
            fit, own_sketches = np.flatnonzero(~held), {}
            for model in quantiles:
                miss = y - f[model]
                for leaf, own in node_rows(partial[model], bins, fit):
                    if len(own):
                        own_sketches[model, leaf] = ranked(miss.take(own)), len(own)
            found = _merged(found, own_sketches)
        yield found

    return run


def _weighted(sketches: Sequence[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(value, weight) of the points of several sketches of a leaf."""
    value = np.concatenate([value for value, _ in sketches])
    return value, np.concatenate([np.full(len(value), n / len(value)) for value, n in sketches])


def _merged(a: dict, b: dict) -> dict:
    """Points of a merged sketch weigh the same again: it is either compressed or holds every residual."""
    out = dict(a)
    for key, sketch in b.items():
        out[key] = (compressed(*_weighted([out[key], sketch]))[0], out[key][1] + sketch[1]) if key in out else sketch
    return out


def leaf_quantile(sketches: Sequence[tuple[np.ndarray, int]], alpha: float) -> float:
    """A leaf's quantile from the sketches of all tasks; their points are ranked together once and none is dropped."""
    value, weight = _weighted(sketches)
    order = np.argsort(value, kind="stable")  # runs that are ranked already
    return weighted_quantile(value[order], weight[order], alpha)


def rank_of(alpha: float, n: int) -> int:
    """Place, from 0, of the smallest of ``n`` ranked values up to which the share ``alpha`` of them lies."""
    return min(n - 1, max(0, ceil(alpha * n) - 1))


class Window(NamedTuple):
    """The ranked values of a leaf around its quantile, and how many lie outside: none above ``lo``, none below ``hi``."""

    below: int
    lo: float
    values: np.ndarray
    hi: float
    above: int

    def quantile(self, alpha: float) -> float | None:
        """The leaf's exact quantile; None if it may lie outside."""
        k = rank_of(alpha, self.below + len(self.values) + self.above) - self.below
        found = float(self.values[k]) if 0 <= k < len(self.values) else None
        return found if found is not None and self.lo <= found <= self.hi else None


def window(values: np.ndarray, alpha: float) -> Window:
    """The part of a task's residuals of a leaf that its quantile over all tasks is looked for in.

    Rows are dealt to the tasks evenly, so the rank of that quantile among a task's own values strays by the square
    root of their number. Whether it was met is checked when all windows are there, so the result does not depend on it.
    """
    n = len(values)
    reach = SPREADS * sqrt(n * alpha * (1 - alpha)) + 32
    first, end = max(0, floor(alpha * n - reach)), min(n, ceil(alpha * n + reach))
    if first or end < n:
        values = np.partition(values, sorted({first, end - 1}))[first:end]
    values = np.sort(values)
    return Window(first, values[0] if first else -inf, values, values[-1] if end < n else inf, n - end)


def between(values: np.ndarray, lo: float, hi: float) -> Window:
    """The values from ``lo`` to ``hi``."""
    own = np.sort(values[(values >= lo) & (values <= hi)])
    return Window(int((values < lo).sum()), lo, own, hi, int((values > hi).sum()))


def joined(windows: Sequence[Window], alpha: float) -> Window:
    """The window of all tasks' values together, as far as every task's window reaches."""
    lo, hi = max(w.lo for w in windows), min(w.hi for w in windows)
    below, above = sum(w.below for w in windows), sum(w.above for w in windows)
    values = np.sort(np.concatenate([w.values for w in windows]), kind="stable")
    first, end = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
    if first >= end:
        return Window(below + int(first), inf, values[:0], -inf, above + len(values) - int(first))
    below, values, above = below + int(first), values[first:end], above + len(values) - int(end)
    if below or above:  # no more than one task with as many rows would send
        n = below + len(values) + above
        reach = SPREADS * sqrt(n * alpha * (1 - alpha)) + 32
        first, end = max(0, floor(alpha * n - reach) - below), min(len(values), ceil(alpha * n + reach) - below)
        if first < end:
            lo, hi = (values[first] if first else lo), (values[end - 1] if end < len(values) else hi)
            below, values, above = below + first, values[first:end], above + len(values) - end
    return Window(below, lo, values, hi, above)


def _windows(partial, alphas, brackets=None):
    """One window per (model, leaf) of a task; with ``brackets`` only of their leaves, between their two values."""

    def run(blocks):
        found = {}
        for bins, y, held, _, f in blocks:
            fit = ~held
            for model in alphas:
                miss = y - f[model]
                leaves = None if brackets is None else [leaf for m, leaf in brackets if m == model]
                for leaf, mask in node_masks(partial[model], bins, fit, leaves):
                    own = np.flatnonzero(mask)
                    if len(own):
                        found.setdefault((model, leaf), []).append(miss.take(own))
        out = {}
        for (model, leaf), parts in found.items():
            values = np.concatenate(parts)
            parts.clear()
            out[model, leaf] = tuple(window(values, alphas[model]) if brackets is None else between(values, *brackets[model, leaf]))
        yield out

    return run


def _gathered(alphas, reduce_tasks: bool, found: RDD) -> dict:
    """The windows of all tasks by (model, leaf)."""

    def merge(*tasks):
        keys = dict.fromkeys(k for t in tasks for k in t)
        return {k: tuple(joined([Window(*t[k]) for t in tasks if k in t], alphas[k[0]])) for k in keys}

    found = found.treeReduce(merge, 2) if reduce_tasks else merge(*found.collect())
    return {k: Window(*w) for k, w in found.items()}


def leaf_quantiles(blocks: RDD, partial: dict, alphas: dict[int, float]) -> dict[tuple[int, int], float]:
    """The exact quantile of the residuals in every (model, leaf) that has rows; one job, as a rule.

    Leaves whose quantile is missed by the windows of some task are bracketed by sketches, ever wider, until it is met.
    """
    many = blocks.getNumPartitions() > FLAT_REDUCE
    windows = _gathered(alphas, many, blocks.mapPartitions(_windows(partial, alphas)))
    out = {k: w.quantile(alphas[k[0]]) for k, w in windows.items()}
    missed = [k for k, value in out.items() if value is None]
    if not missed:
        return out
    own = {m: alphas[m] for m in sorted({m for m, _ in missed})}
    found = blocks.mapPartitions(_residuals(partial, list(own)))
    sketches = [found.treeReduce(_merged, 2)] if many else found.collect()
    slack = 4 / SKETCH
    while missed:
        brackets = {}
        for m, leaf in missed:
            parts, alpha = [t[m, leaf] for t in sketches if (m, leaf) in t], alphas[m]
            brackets[m, leaf] = (
                leaf_quantile(parts, alpha - slack) if alpha > slack else -inf,
                leaf_quantile(parts, alpha + slack) if alpha + slack < 1 else inf,
            )
        own = {m: alphas[m] for m in sorted({m for m, _ in missed})}
        met = blocks.mapPartitions(_windows(partial, own, brackets))
        met = _gathered(own, many, met)
        out |= {k: met[k].quantile(alphas[k[0]]) for k in missed}
        missed = [k for k in missed if out[k] is None]
        slack *= 4
    return out


def weighted_quantile(value: np.ndarray, weight: np.ndarray, alpha: float) -> float:
    """The smallest of the ranked values up to which the share ``alpha`` of the weight lies."""
    total = np.cumsum(weight)
    return float(value[min(len(value) - 1, int(np.searchsorted(total, alpha * total[-1])))])


# --- splits ---------------------------------------------------------------------------------


def best_splits(g: np.ndarray, h: np.ndarray, usable: np.ndarray) -> list[tuple[float, int, int] | None]:
    """(gain, feature, bin) of the best split of every node; ``g`` and ``h`` are sums by (node, feature, bin)."""
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    left_g, left_h = left_g[:, :, :-1], left_h[:, :, :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    fine = (left_h >= LEAST_ROWS) & (right_h >= LEAST_ROWS) & usable[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_h + right_g**2 / right_h - all_g**2 / all_h
    gain = np.where(fine, gain, -np.inf).reshape(len(g), -1)
    if not gain.shape[1]:
        return [None] * len(g)
    at = np.argmax(gain, axis=1)
    return [
        (float(best), *(int(x) for x in divmod(k, h.shape[2] - 1))) if best > LEAST_GAIN else None
        for k, best in zip(at, gain[np.arange(len(g)), at])
    ]


def best_split(g: np.ndarray, h: np.ndarray, usable: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of one node's best split; ``g`` and ``h`` are sums by (feature, bin)."""
    return best_splits(g[None], h[None], usable)[0]


class _Growing:
    """A tree of one round with the sums of its open nodes.

    ``tree`` holds every split whose children may be needed; ``finish`` keeps those that leaf-wise growth makes.
    """

    def __init__(self, spec: BoostSpec, usable: np.ndarray):
        self.spec, self.usable, self.tree = spec, usable, Tree()
        self.sums, self.totals, self.best, self.pairs = {}, {}, {}, {}

    def take(self, node: int, g: np.ndarray, h: np.ndarray) -> None:
        """Sums of a node; with those of its parent they give its sibling's."""
        self.sums[node] = (g, h)
        if not node:
            self.totals[0] = (g[0].sum(), h[0].sum())
        elif node in self.pairs:
            sibling, (all_g, all_h) = self.pairs.pop(node)
            self.sums[sibling] = (all_g - g, all_h - h)

    def order(self) -> list[int]:
        """Nodes in the order in which they are split: always the leaf whose split gains most.

        Leaves whose sums are not there yet are left out. Their splits could only come in between, so a node that is
        not in this list is not split, whatever they gain.
        """
        found, heap = [], [(-self.best[0][0], 0)] if 0 in self.best else []
        while heap and len(found) < self.spec.leaves - 1:
            _, node = heappop(heap)
            found.append(node)
            if self.tree.feature[node] >= 0:
                for kid in (self.tree.left[node], self.tree.right[node]):
                    if kid in self.best:
                        heappush(heap, (-self.best[kid][0], kid))
        return found

    def split_level(self) -> list[int]:
        """Looks for the best splits of the nodes just summed; returns the nodes to sum next."""
        nodes = sorted(self.sums)
        if nodes:
            g, h = (np.stack([self.sums[node][k] for node in nodes]) for k in (0, 1))
            self.best |= {node: best for node, best in zip(nodes, best_splits(g, h, self.usable)) if best and self.tree.depth[node] < self.spec.depth}
        wanted = []
        for place, node in enumerate(self.order(), 1):
            if self.tree.feature[node] >= 0:
                continue
            gain, feature, cut = self.best[node]
            left, right = self.tree.split(node, feature, cut, gain)
            g, h = self.sums[node]
            self.totals[left] = (g[feature, : cut + 1].sum(), h[feature, : cut + 1].sum())
            self.totals[right] = tuple(a - b for a, b in zip(self.totals[node], self.totals[left]))
            if self.tree.depth[left] < self.spec.depth and place < self.spec.leaves - 1:
                small, large = (left, right) if self.totals[left][1] <= self.totals[right][1] else (right, left)
                self.pairs[small] = (large, (g, h))
                wanted.append(small)
        self.sums = {}
        return wanted

    def finish(self) -> None:
        """Keeps the splits of the leaf-wise tree, numbered as they are made."""
        tree, place, totals = Tree(), {0: 0}, {0: self.totals.get(0)}
        for node in self.order():
            kids = tree.split(place[node], self.tree.feature[node], self.tree.cut[node], self.tree.gain[node])
            for old, new in zip((self.tree.left[node], self.tree.right[node]), kids):
                place[old], totals[new] = new, self.totals[old]
        self.tree, self.totals = tree, totals


# --- training -------------------------------------------------------------------------------


@dataclass
class HistBoost:
    """An additive model: a start value plus ``step`` times the leaf value of each tree."""

    name: str
    start: float
    step: float
    columns: tuple[str, ...]
    trees: list[tuple] = field(default_factory=list)  # (feature, threshold, left, right, depth, value)
    gains: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add the prediction from the model's columns, all trees in one pass over Arrow batches."""
        start, step, trees = self.start, self.step, self.trees

        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            total = np.full(len(features), start)
            if len(features):
                columns = np.ascontiguousarray(np.stack(features.to_numpy()).astype(np.float64).T)
                for tree in trees:
                    total += (step * tree[-1]).take(leaf_numbers(tree, columns))
            return pd.Series(total)

        return df.withColumn(out, score(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def importances(self) -> list[tuple[str, float]]:
        """Each column's share of the gain of all splits."""
        total = sum(self.gains.values())
        return [(c, self.gains.get(c, 0.0) / total if total else 0.0) for c in self.columns]

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        trees = [(k, *(x.tolist() for x in tree[:4]), int(tree[4]), tree[5].tolist()) for k, tree in enumerate(self.trees)]
        spark.createDataFrame(trees, _TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = [(self.name, self.start, self.step, list(self.columns), [self.gains.get(c, 0.0) for c in self.columns])]
        spark.createDataFrame(meta, _META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> HistBoost:
        spark = SparkSession.getActiveSession()
        meta = spark.read.schema(_META_SCHEMA).parquet(f"{path}/meta").first()
        rows = sorted(spark.read.schema(_TREE_SCHEMA).parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
        trees = [(np.array(r["feature"]), np.array(r["threshold"]), np.array(r["left"]), np.array(r["right"]), r["depth"], np.array(r["value"])) for r in rows]
        return cls(meta["name"], meta["start"], meta["step"], tuple(meta["columns"]), trees, dict(zip(meta["columns"], meta["gains"])))


_TREE_SCHEMA = "tree int, feature array<long>, threshold array<double>, left array<long>, right array<long>, depth int, value array<double>"
_META_SCHEMA = "name string, start double, step double, columns array<string>, gains array<double>"


def _packer(columns, cuts, starts, weights, block_rows):
    """Rows to blocks: bins, labels, held flags, weights and running predictions as bytes, column by column."""

    def packed(parts):
        table = pa.Table.from_batches(parts)
        n = table.num_rows
        bins = np.stack([np.searchsorted(c, table[name].to_numpy(), side="left") for name, c in zip(columns, cuts)]).astype(np.uint8)
        w = np.stack([table[name].to_numpy() for name in weights]) if weights else np.zeros((0, n))
        f = np.repeat(np.array(starts, dtype=np.float64)[:, None], n, axis=1)
        held = table["_held"].to_numpy(zero_copy_only=False).astype(bool)
        data = (bins, table["_y"].to_numpy().astype(np.float64), held, w.astype(np.float64), f)
        return pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data)], ["n", "bins", "y", "held", "w", "f"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - n)
                batch = batch.slice(part.num_rows)
                parts.append(part)
                n += part.num_rows
                if n == block_rows:
                    yield packed(parts)
                    parts, n = [], 0
        if parts:
            yield packed(parts)

    return run


def _unpacker(features, weights, models):
    def run(row):
        n = row["n"]
        shapes = ((np.uint8, (features, n)), (np.float64, (n,)), (np.bool_, (n,)), (np.float64, (weights, n)), (np.float64, (models, n)))
        return tuple(np.frombuffer(bytes(row[name]), dtype).reshape(shape) for name, (dtype, shape) in zip(("bins", "y", "held", "w", "f"), shapes))

    return run


def task_count(rows: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Tasks that ``rows`` are dealt to: one for few rows, all the cluster's cores for more, the same number to each, none with too many."""
    few, most = min(FEW_ROWS, block_rows), -(-rows // TASK_ROWS)
    if most > parallelism:
        return -(-most // parallelism) * parallelism  # no core waits for the last ones
    return max(1, min(parallelism, -(-rows // few)))


def _kept(blocks: RDD, before: RDD | None) -> RDD:
    """``blocks`` written to the shared checkpoint folder; those they replace are dropped."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks.count()
    if before is not None:
        _drop(before)
    return blocks


def _drop(blocks: RDD) -> None:
    blocks.unpersist()
    path = blocks.ctx._jvm.org.apache.hadoop.fs.Path(blocks.getCheckpointFile())
    path.getFileSystem(blocks.ctx._jsc.hadoopConfiguration()).delete(path, True)


def train_boosts(
    train: DataFrame, validation: DataFrame | None, specs: Sequence[BoostSpec], label: str = "y", bins: int = BINS, block_rows: int = BLOCK_ROWS
) -> dict[str, HistBoost]:
    """Train all ``specs`` together; early stopping looks at the rows of ``validation``."""
    spark = train.sparkSession
    columns = list(dict.fromkeys(c for s in specs for c in s.columns))
    weights = list(dict.fromkeys(s.weight for s in specs if s.weight))
    shape = [*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, *weights])], F.col(label).cast("double").alias("_y")]
    rows = train.select(*shape, F.lit(False).alias("_held"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*shape, F.lit(True).alias("_held")))
    rows = cut_lineage(rows.dropna(subset=[*columns, "_y"]).fillna(1.0, subset=weights))
    fitted = rows.where(~F.col("_held"))
    marks = [k / bins for k in range(1, bins)]
    measures = [F.percentile_approx(c, marks, ACCURACY) for c in columns]
    for s in specs:
        w = F.col(s.weight) if s.weight else F.lit(1.0)
        measures.append(F.percentile_approx("_y", s.alpha, ACCURACY) if s.alpha is not None else F.sum(w * F.col("_y")) / F.sum(w))
    found = fitted.agg(F.count("*").alias("n"), *[m.alias(f"m{k}") for k, m in enumerate(measures)]).first()
    if not found["n"]:
        return {s.name: HistBoost(s.name, 0.0, s.step, s.columns) for s in specs}
    cuts = [np.unique(np.array(found[f"m{k}"], dtype=np.float64)) for k in range(len(columns))]
    starts = [float(found[f"m{len(columns) + k}"]) for k in range(len(specs))]
    checkpoint_root(spark)
    parts = task_count(rows.count(), spark.sparkContext.defaultParallelism, block_rows)
    packer = _packer(columns, cuts, starts, weights, block_rows)
    packed = rows.repartition(parts).mapInArrow(packer, "n long, bins binary, y binary, held binary, w binary, f binary")
    written = blocks = _kept(packed.rdd.map(_unpacker(len(columns), len(weights), len(specs))), None)

    usable = [np.array([c in s.columns for c in columns]) for s in specs]
    # features of a single bin have no split; the first one also gives the totals
    used = [[j for j, own in enumerate(mask) if not j or own and len(cuts[j])] for mask in usable]
    width = max(len(c) for c in cuts) + 1
    roots: dict[int, np.ndarray] = {}  # weights, or numbers of rows, by (feature, bin)
    trees = [[] for _ in specs]
    best = [(np.inf, 0) for _ in specs]
    live, grown, number = set(range(len(specs))), [], 0

    def sums(growing: dict[int, _Growing], wanted: dict[int, list[int]], losses: list[int]) -> list[tuple[float, float]]:
        if not wanted and not losses:
            return []
        partial = {m: growing[m].tree.packed() for m in wanted}
        known = [m for m in wanted if m in roots and wanted[m] == [0]]
        found = blocks.mapPartitions(_summer(specs, weights, used, width, partial, wanted, known, losses))
        flat, at = found.reduce(_added) if parts <= FLAT_REDUCE else found.treeReduce(_added, 2), [0, 0]
        for m, nodes in wanted.items():
            alpha = specs[m].alpha
            kind, shape = int(alpha is None), (1 if m in known else 2, len(nodes), len(used[m]), width)
            size = int(np.prod(shape))
            whole = np.zeros((shape[0], len(nodes), len(columns), width))
            whole[:, :, used[m]] = flat[kind][at[kind] : at[kind] + size].reshape(shape)
            at[kind] += size
            if m in known:
                g, h = whole[0], roots[m][None]
                g = h - g if alpha is not None and alpha < 0.5 else g
            else:
                g, h = whole
                if nodes == [0]:
                    roots[m] = h[0]
            g = g if alpha is None else g - (1.0 - alpha) * h  # those above gain alpha, the others lose the rest
            for k, node in enumerate(nodes):
                growing[m].take(node, g[k], h[k])
        return [tuple(x) for x in flat[1][at[1] :].reshape(-1, 2)]

    while live:
        before = blocks
        if grown:
            if number % CUT_EVERY:
                blocks = blocks.map(lambda block, grown=grown: _advanced(block, grown)).persist(StorageLevel.MEMORY_AND_DISK)
            else:
                written = blocks = _kept(blocks.map(lambda block, grown=grown: _advanced(block, grown)), written)
            grown = []
        growing = {m: _Growing(specs[m], usable[m]) for m in sorted(live) if number < specs[m].rounds}
        watched = [m for m in sorted(live) if specs[m].patience is not None and validation is not None]
        wanted = {m: [0] for m in growing}
        for m, (loss, n) in zip(watched, sums(growing, wanted, watched)):
            if n and loss / n < best[m][0]:
                best[m] = (loss / n, number)
            if number - best[m][1] >= specs[m].patience:
                live.discard(m)
        if before is not blocks:
            before.unpersist()  # the job above has filled the advanced blocks
        live = {m for m in live if m in growing}
        growing = {m: g for m, g in growing.items() if m in live}
        wanted = {m: g.split_level() for m, g in growing.items()}
        wanted = {m: nodes for m, nodes in wanted.items() if nodes}
        while wanted:
            sums(growing, wanted, [])
            wanted = {m: growing[m].split_level() for m in wanted}
            wanted = {m: nodes for m, nodes in wanted.items() if nodes}
        for g in growing.values():
            g.finish()
        alphas = {m: specs[m].alpha for m in growing if specs[m].alpha is not None}
        quantiles = leaf_quantiles(blocks, {m: growing[m].tree.packed() for m in alphas}, alphas) if alphas else {}
        for m, g in growing.items():
            tree, spec = g.tree, specs[m]
            value = np.zeros(len(tree.feature))
            for node in (k for k, j in enumerate(tree.feature) if j < 0):
                if spec.alpha is None:
                    value[node] = g.totals[node][0] / g.totals[node][1] if g.totals[node][1] else 0.0
                else:
                    value[node] = quantiles.get((m, node), 0.0)
            tree.value = value
            trees[m].append(tree)
            grown.append((m, spec.step, tree.packed()))
        number += 1
    blocks.unpersist()
    _drop(written)

    out = {}
    for m, s in enumerate(specs):
        own = trees[m][: best[m][1]] if s.patience is not None and validation is not None and best[m][0] < np.inf else trees[m]
        out[s.name] = _finished(s, starts[m], own, columns, cuts)
    return out


def _finished(spec: BoostSpec, start: float, trees: list[Tree], columns: list[str], cuts: list[np.ndarray]) -> HistBoost:
    """Bins to thresholds, features to the model's own columns."""
    place = {columns.index(c): k for k, c in enumerate(spec.columns)}
    plain, gains = [], {}
    for tree in trees:
        feature = np.array([place.get(j, -1) if j >= 0 else -1 for j in tree.feature])
        threshold = np.array([cuts[j][b] if j >= 0 else 0.0 for j, b in zip(tree.feature, tree.cut)], dtype=np.float64)
        plain.append((feature, threshold, np.array(tree.left), np.array(tree.right), max(tree.depth), np.asarray(tree.value)))
        for j, gain in zip(tree.feature, tree.gain):
            if j >= 0:
                gains[columns[j]] = gains.get(columns[j], 0.0) + gain
    return HistBoost(spec.name, start, spec.step, tuple(spec.columns), plain, gains)
