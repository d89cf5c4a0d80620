"""Text quality by a sparse ensemble of rules over text statistics.

Statistics of every whole text are DataFrame expressions, computed in one read. Boosted trees are
grown on the labelled rows (at most about ``max_rows``, chosen by hash); every path from a root to a
node is a conjunctive rule. A lasso logistic regression over the rules' indicators and the capped
statistics keeps few of them. The kept rules compile to one column expression, so scoring needs no
Python and no second read of the texts.

Defined results: null and blank texts have statistics of zero and are scored like all others; label
rows that repeat or contradict each other are averaged and count as 1 from one half; without both
labels every score is the share of label 1 (0.5 without any label); other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import SPACE, stage, word_count

MAX_ROWS = 20_000
TREES = 12
DEPTH = 3
LASSO = 0.002


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), body.alias("text"), word_count(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("lines", lines)
    words = F.filter(F.split(F.lower("text"), f"{SPACE}+"), lambda x: x != "")
    rows = rows.withColumn("distinct_words", F.size(F.array_distinct(words)))

    def kept(pattern):
        # length of what is left when all else is removed
        return F.length(F.regexp_replace("text", pattern, "")).cast("double")

    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    w = F.greatest(F.col("words"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size("lines"), F.lit(1)).cast("double")
    return rows.select(
        "doc_id",
        F.log1p("words").alias("log_words"),
        (F.length("text") / w).alias("word_length"),
        (kept(r"[^A-Z]+") / n).alias("capitals"),
        (kept(r"[^0-9]+") / n).alias("digits"),
        (kept(r"[\p{L}\p{N}\s.,]+") / n).alias("symbols"),
        (kept(r"[^!?#$%&*|~^<>{}=+]+") / w).alias("marks_per_word"),
        (kept(r"[^.,;:]+") / w).alias("stops_per_word"),
        (F.col("distinct_words") / w).alias("distinct_share"),
        (F.size(F.array_distinct("lines")) / n_lines).alias("distinct_lines"),
        (w / n_lines).alias("words_per_line"),
        (F.length(F.regexp_replace("text", r"(?s)(.)\1*", "$1")) / n).alias("unrepeated"),
        (kept(r"[^\x{80}-\x{10FFFF}]+") / n).alias("non_ascii"),
    )


@dataclass
class RuleModel:
    rules: list[tuple[list[tuple[str, str, float]], float]]  # conditions (statistic, <= or >, cut), weight
    linear: list[tuple[str, float, float, float]]  # statistic, low, high, weight
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(_all(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        for name, low, high, weight in self.linear:
            total = total + F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-total))


def _all(conditions) -> Column:
    out = F.lit(True)
    for name, side, cut in conditions:
        out = out & (F.col(name) <= cut if side == "<=" else F.col(name) > cut)
    return out


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(description: str, names: list[str]) -> set[tuple[tuple[str, str, float], ...]]:
    """Every path from a root to a node below it, from the text form of a tree ensemble."""
    found, path = set(), []
    for line in description.splitlines():
        split = _SPLIT.match(line)
        if line.lstrip().startswith("Tree "):
            path = []
        if split:
            indent = len(split[1])
            while path and path[-1][0] >= indent:
                path.pop()
            path.append((indent, (names[int(split[3])], split[4], float(split[5]))))
            found.add(tuple(sorted({c for _, c in path})))
    return found


def fit(stats: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS, trees: int = TREES, lasso: float = LASSO, seed: int = 3) -> RuleModel:
    """Rules and weights from labelled rows where ``train`` (over doc_id) holds."""
    names = [c for c in stats.columns if c != "doc_id"]
    known = labels.filter(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    label = (F.avg(F.col("quality").cast("double")) >= 0.5).cast("double")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(label.alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    known = known.filter(draw < int((1 << 30) * min(1.0, max_rows / max(1, n))))
    sample = stage(stats.join(known, "doc_id").repartition(4, "doc_id").sortWithinPartitions("doc_id"))
    rows, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not rows or ones in (0, rows):
        share = ((ones or 0) + 1) / (rows + 2) if rows else 0.5
        return RuleModel([], [], _logit(share))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(sample).select("label", "features")
    forest = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=0.8, maxBins=64, seed=seed, minInstancesPerNode=5).fit(ready)
    paths = sorted(tree_paths(forest.toDebugString, names))
    low_high = sample.agg(*[F.percentile_approx(c, [0.025, 0.975]).alias(c) for c in names]).first()
    bounds = [(c, *low_high[c]) for c in names if low_high[c][1] > low_high[c][0]]
    inputs = [F.when(_all(p), 1.0).otherwise(0.0).alias(f"r{k}") for k, p in enumerate(paths)]
    inputs += [F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b)).alias(f"l{k}") for k, (c, a, b) in enumerate(bounds)]
    matrix = stage(sample.select("label", *inputs))
    wide = VectorAssembler(inputCols=[c for c in matrix.columns if c != "label"], outputCol="features").transform(matrix).select("label", "features")
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60).fit(wide)
    weights = model.coefficients.toArray()
    rules = [(list(p), float(w)) for p, w in zip(paths, weights) if w]
    linear = [(*b, float(w)) for b, w in zip(bounds, weights[len(paths) :]) if w]
    return RuleModel(rules, linear, float(model.intercept))


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))
