"""Arrival-time models: trip split, boosted trees, quantile boosting, near-arrival choice."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, isnan

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eta import near_arrival_weight, near_blend
from ..schema import (
    BLEND_THRESHOLDS,
    BLEND_WEIGHTS,
    FEATURE_COLS,
    NEAR_ARRIVAL_MIN,
    QUANTILES,
    TOLERANCE_MIN,
)
from ..session import cut_lineage
from .histboost import BoostSpec, HistBoost, train_boosts
from .metrics import pinball
from .quantiles import order_statistics

SEED = 42
HASH_BUCKETS = 1000
TRIP = ("VIN", "trip_local")


# --- trip-level split ---------------------------------------------------------------------


def trip_hash(key: Sequence[str] = TRIP) -> Column:
    """A uniform 32-bit number per trip, the same in any run."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *key)), 1, 8), 16, 10).cast("long")


def trip_split(
    df: DataFrame,
    test_size: float = 0.2,
    validation_size: float = 0.1,
    key: Sequence[str] = TRIP,
    exact: bool = False,
) -> DataFrame:
    """Add ``split``: all rows of a trip fall into train, validation or test together.

    Membership follows from a hash of the trip, so it needs no shuffle. With ``exact`` the cuts
    are order statistics of the trips' hashes and the trip counts come out as asked for.
    """
    value = trip_hash(key)
    if not exact:
        bucket = value % HASH_BUCKETS
        cuts = [round(test_size * HASH_BUCKETS), round((test_size + validation_size) * HASH_BUCKETS)]
    else:
        bucket = value
        trips = df.select(value.alias("h")).distinct()
        n = trips.count()
        n_test = ceil(test_size * n)
        n_validation = ceil(validation_size / (1 - test_size) * (n - n_test))
        ranks = [n_test, min(n_test + n_validation, n - 1)]
        found = order_statistics(trips, [(F.col("h"), ranks)])[0]
        cuts = [found[r] for r in ranks]
    return df.withColumn(
        "split",
        F.when(bucket < cuts[0], "test").when(bucket < cuts[1], "validation").otherwise("train"),
    )


# --- boosted trees ------------------------------------------------------------------------


def assemble(df: DataFrame, columns: Sequence[str] = tuple(FEATURE_COLS)) -> DataFrame:
    """Add the vector column ``features``; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def baseline_spec(name: str = "baseline", columns: Sequence[str] = tuple(FEATURE_COLS), rounds: int = 200, depth: int = 6, step: float = 0.1) -> BoostSpec:
    return BoostSpec(name, None, rounds, step, tuple(columns), depth=depth)


def specialist_spec(columns: Sequence[str], rounds: int = 300, depth: int = 6, step: float = 0.05) -> BoostSpec:
    """Rows close to arrival weigh up to sixteenfold (column ``near_weight``)."""
    return BoostSpec("specialist", None, rounds, step, tuple(columns), weight="near_weight", depth=depth)


def quantile_spec(alpha: float, columns: Sequence[str] = tuple(FEATURE_COLS), rounds: int = 300, depth: int = 6, step: float = 0.05, patience: int = 20) -> BoostSpec:
    return BoostSpec(quantile_name(alpha), alpha, rounds, step, tuple(columns), patience=patience, depth=depth)


def with_near_weight(df: DataFrame, label: str = "y") -> DataFrame:
    return df.withColumn("near_weight", near_arrival_weight(F.col(label)))


def train_baseline(train: DataFrame, label: str = "y", rounds: int = 200, depth: int = 6, step: float = 0.1) -> HistBoost:
    """Boosted trees on squared error. ``train`` carries the feature columns and the label."""
    spec = baseline_spec(rounds=rounds, depth=depth, step=step)
    return train_boosts(train, None, [spec], label)[spec.name]


def train_near_specialist(
    train: DataFrame, columns: Sequence[str], label: str = "y", rounds: int = 300, depth: int = 6, step: float = 0.05
) -> HistBoost:
    """Boosted trees that weigh rows close to arrival up to sixteenfold.

    ``columns`` are the model features and the naive estimate.
    """
    spec = specialist_spec(columns, rounds, depth, step)
    return train_boosts(with_near_weight(train, label), None, [spec], label)[spec.name]


def train_quantiles(
    train: DataFrame,
    validation: DataFrame,
    alphas: Sequence[float] = QUANTILES,
    label: str = "y",
    rounds: int = 300,
    depth: int = 6,
    step: float = 0.05,
    patience: int = 20,
) -> dict[str, HistBoost]:
    """One model per quantile, grown side by side, with early stopping on the validation rows."""
    specs = [quantile_spec(a, rounds=rounds, depth=depth, step=step, patience=patience) for a in alphas]
    return train_boosts(train, validation, specs, label)


def predict_with(model, df: DataFrame, out: str) -> DataFrame:
    """Add a model's prediction as ``out``."""
    if isinstance(model, HistBoost):
        return model.predict(df, out)
    return model.transform(df).withColumnRenamed(model.getPredictionCol(), out)


def feature_importance(model: HistBoost) -> DataFrame:
    """One row per feature with its share of the model's gain."""
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(model.importances(), "feature string, importance double")


# --- quantile boosting --------------------------------------------------------------------

_NODE = re.compile(r"\s*(?:If \(feature (\d+) <= ([^)]+)\)|(Else) |(Predict): )")


def _tree_nodes(tree: DecisionTreeRegressionModel) -> np.ndarray:
    """A tree as rows (feature, threshold, left, right, leaf) of its nodes, from its description.

    Nodes and leaves are numbered as the description lists them, left before right; a leaf's
    children are the leaf itself.
    """
    nodes, open_nodes, leaves, parent = [], [], 0, None
    for line in tree.toDebugString.splitlines()[1:]:
        found = _NODE.match(line)
        if not found:
            raise ValueError(f"not a split of a continuous feature: {line.strip()}")
        feature, threshold, other, leaf = found.groups()
        if other:
            parent = (open_nodes.pop(), 3)
            continue
        at = len(nodes)
        if parent:
            nodes[parent[0]][parent[1]] = at
        if leaf:
            nodes.append([0, 0.0, at, at, leaves])
            leaves, parent = leaves + 1, None
        else:
            nodes.append([int(feature), float(threshold), None, None, -1])
            open_nodes.append(at)
            parent = (at, 2)
    return np.array(nodes, dtype=np.float64)


@dataclass
class QuantileBoost:
    """An additive model of one quantile: a start value plus scaled leaf values of each tree."""

    alpha: float
    start: float
    step: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)

    def _add(self, df: DataFrame, out: str, i: int) -> DataFrame:
        # leaf ids count from 0, so the leaf values are an array looked up by position
        value = F.get(F.lit(self.leaves[i]), F.col("_leaf").cast("int"))
        return (
            self.trees[i]
            .transform(df)
            .withColumn(out, F.col(out) + F.lit(self.step) * value)
            .drop("_leaf", "_tree")
        )

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add the prediction. ``df`` carries the vector column ``features``."""
        return df.withColumn(out, self._score()(vector_to_array("features")))

    def _score(self):
        """All trees in one pass over Arrow batches, so the plan does not grow with their number."""
        start, step = float(self.start), self.step
        parts = []
        for tree, leaves in zip(self.trees, self.leaves):
            nodes = _tree_nodes(tree)
            left, right, leaf = nodes[:, 2].astype(int), nodes[:, 3].astype(int), nodes[:, 4].astype(int)
            # leaves that no training row reached have no value, as in _add
            values = np.array([leaves[k] if 0 <= k < len(leaves) else np.nan for k in leaf])
            parts.append((nodes[:, 0].astype(int), nodes[:, 1], left, right, values))

        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            out = np.full(len(features), start)
            if len(features):
                rows, every = np.stack(features.to_numpy()), np.arange(len(features))
                for feature, threshold, left, right, values in parts:
                    at = np.zeros(len(rows), dtype=int)
                    while True:
                        to = np.where(rows[every, feature[at]] <= threshold[at], left[at], right[at])
                        if np.array_equal(to, at):
                            break
                        at = to
                    out += step * values[at]
            return pd.Series(out)

        return score

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{i:04d}")
        meta = [(self.alpha, self.start, self.step, self.leaves)]
        schema = "alpha double, start double, step double, leaves array<array<double>>"
        spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> QuantileBoost:
        spark = SparkSession.getActiveSession()
        schema = "alpha double, start double, step double, leaves array<array<double>>"
        meta = spark.read.schema(schema).json(f"{path}/meta").first()
        leaves = [list(values) for values in meta["leaves"]]
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree-{i:04d}") for i in range(len(leaves))]
        return cls(meta["alpha"], meta["start"], meta["step"], trees, leaves)


def train_quantile_boost(
    train: DataFrame,
    validation: DataFrame,
    alpha: float,
    label: str = "y",
    rounds: int = 300,
    depth: int = 5,
    step: float = 0.05,
    patience: int = 20,
    cut_every: int = 10,
) -> QuantileBoost:
    """Gradient boosting on the quantile loss, with early stopping on the validation rows.

    Each round fits a tree to the sign of the residual and sets every leaf to the quantile of its
    residuals. A round moves to the driver one value per leaf (at most 2 ** depth) and one loss.
    Running predictions are carried along and written to the checkpoint folder every
    ``cut_every`` rounds, so no round repeats more than that many earlier ones.
    """
    columns = ["features", label]
    start = train.agg(F.percentile_approx(label, alpha, 10_000)).first()[0]
    model = QuantileBoost(alpha, float(start), step)
    rows = cut_lineage(train.select(*columns).withColumn("_f", F.lit(float(start))))
    held = cut_lineage(validation.select(*columns).withColumn("_f", F.lit(float(start))))
    best, best_size, worse = held.agg(pinball(label, "_f", alpha)).first()[0], 0, 0
    for i in range(rounds):
        residual = F.col(label) - F.col("_f")
        sign = F.when(residual >= 0, alpha).otherwise(alpha - 1.0)
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="_g", predictionCol="_tree", leafCol="_leaf",
            maxDepth=depth, seed=SEED + i,
        ).fit(rows.withColumn("_g", sign))
        per_leaf = (
            tree.transform(rows)
            .groupBy(F.col("_leaf").cast("int").alias("leaf"))
            .agg(F.percentile_approx(residual, alpha, 10_000).alias("value"))
            .collect()
        )
        values = [0.0] * (max((r["leaf"] for r in per_leaf), default=0) + 1)
        for r in per_leaf:
            values[r["leaf"]] = float(r["value"])
        model.trees.append(tree)
        model.leaves.append(values)
        rows, held = model._add(rows, "_f", i), model._add(held, "_f", i)
        if (i + 1) % cut_every == 0:
            rows, held = cut_lineage(rows), cut_lineage(held)
        loss = held.agg(pinball(label, "_f", alpha)).first()[0]
        if loss is not None and (best is None or loss < best):
            best, best_size, worse = loss, i + 1, 0
        else:
            worse += 1
            if worse >= patience:
                break
    model.trees, model.leaves = model.trees[:best_size], model.leaves[:best_size]
    return model


def quantile_name(alpha: float) -> str:
    return f"p{round(alpha * 100):02d}"


def predict_quantiles(models: dict[str, HistBoost], df: DataFrame) -> DataFrame:
    """Add one prediction column per quantile model."""
    for name, model in models.items():
        df = model.predict(df, name)
    return df


# --- near-arrival choice ------------------------------------------------------------------


@dataclass(frozen=True)
class NearChoice:
    """How to predict close to arrival: a mode and, for blends, threshold and weight."""

    mode: str
    threshold: float
    weight: float
    near_mae: float | None
    within_tolerance: float | None

    def prediction(self, p50: Column, naive: Column, specialist: Column) -> Column:
        if self.mode == "global":
            return p50
        if self.mode == "naive":
            return naive
        if self.mode == "specialist":
            return specialist
        other = naive if self.mode == "blend_naive" else specialist
        return near_blend(p50, other, naive, self.threshold, self.weight)


def near_candidates(
    validation: DataFrame,
    y: str = "y",
    p50: str = "p50",
    naive: str = "naive",
    specialist: str = "specialist",
) -> list[NearChoice]:
    """Near-arrival error and within-tolerance rate of every candidate, in trial order.

    A blend treats a row differently only by whether its naive estimate is within the threshold.
    So rows near arrival are aggregated once, by the band between neighbouring thresholds, for
    every weight; each candidate is then a sum over at most seven bands.
    """
    others = {"naive": naive, "specialist": specialist}
    band = None
    for threshold in BLEND_THRESHOLDS:
        above = F.coalesce(~(F.col(naive) <= threshold), F.lit(True)).cast("int")
        band = above if band is None else band + above
    columns = []
    for other, column in others.items():
        for j, weight in enumerate(BLEND_WEIGHTS):
            blended = F.col(p50) * (1.0 - weight) + F.col(column) * weight
            error = F.abs(F.col(y) - blended)
            columns += [
                F.sum(error).alias(f"{other}_e{j}"),
                F.count_if(error <= TOLERANCE_MIN).alias(f"{other}_w{j}"),
            ]
    bands = (
        validation.where(F.col(y) <= NEAR_ARRIVAL_MIN)
        .groupBy(band.alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), *columns)
        .collect()
    )
    n = sum(b["n"] for b in bands)
    last = len(BLEND_WEIGHTS) - 1

    def choice(mode: str, threshold: float, weight: float, other: str, j: int, upto: int) -> NearChoice:
        if not n:
            return NearChoice(mode, threshold, weight, None, None)
        at = [j if b["band"] <= upto else 0 for b in bands]
        error = sum(b[f"{other}_e{k}"] for b, k in zip(bands, at))
        within = sum(b[f"{other}_w{k}"] for b, k in zip(bands, at))
        return NearChoice(mode, threshold, weight, error / n, within / n)

    everywhere, first = len(BLEND_THRESHOLDS), BLEND_THRESHOLDS[0]
    out = [
        choice("global", first, 0.0, "naive", 0, everywhere),
        choice("naive", first, 0.0, "naive", last, everywhere),
        choice("specialist", first, 0.0, "specialist", last, everywhere),
    ]
    for i, threshold in enumerate(BLEND_THRESHOLDS):
        for j, weight in enumerate(BLEND_WEIGHTS):
            for other in others:
                out.append(choice(f"blend_{other}", threshold, weight, other, j, i))
    return out


def close(a: float, b: float) -> bool:
    """Equal up to a relative 1e-5 of ``b`` and an absolute 1e-8."""
    return abs(a - b) <= 1e-8 + 1e-5 * abs(b)


def choose_near(candidates: list[NearChoice]) -> NearChoice:
    """Go through the candidates in order; a later one wins with a smaller error, or with about
    the same error and a higher within-tolerance rate."""
    best = candidates[0]
    for c in candidates[1:]:
        if c.near_mae is None or isnan(c.near_mae) or best.near_mae is None:
            continue
        if c.near_mae < best.near_mae or (
            close(c.near_mae, best.near_mae) and c.within_tolerance > best.within_tolerance
        ):
            best = c
    return best


def choices_df(spark: SparkSession, choices: list[NearChoice]) -> DataFrame:
    rows = [(i, c.mode, c.threshold, c.weight, c.near_mae, c.within_tolerance) for i, c in enumerate(choices)]
    return spark.createDataFrame(
        rows,
        "trial int, mode string, threshold double, weight double, near_mae double, within_tolerance double",
    )
