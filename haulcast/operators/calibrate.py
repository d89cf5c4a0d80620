"""Calibration of prediction intervals on held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eta import bucket_index, scaled_interval
from ..schema import (
    BUCKET_COVERAGE,
    CALIBRATION_BUCKETS,
    MIN_HALF_WIDTH,
    POSTHOC_COVERAGE,
    TARGET_COVERAGE,
    WIDE_COVERAGE,
)
from .metrics import interval_report
from .quantiles import linear_quantiles, quantile_higher, quantiles_higher


def overshoot() -> Column:
    """How far the truth lies outside [p10, p90]; 0 inside."""
    y = F.col("y")
    return F.greatest(F.col("p10") - y, y - F.col("p90"), F.lit(0.0))


def required_scale() -> Column:
    """The widening factor at which the interval just covers the truth."""
    mid = (F.col("p10") + F.col("p90")) * 0.5
    half = F.greatest((F.col("p90") - F.col("p10")) * 0.5, F.lit(MIN_HALF_WIDTH))
    return F.abs(F.col("y") - mid) / half


def conformal_qhat(validation: DataFrame, alpha: float = 1 - TARGET_COVERAGE) -> float:
    """Additive widening: the (1 - alpha) order statistic of the overshoots."""
    return quantile_higher(validation, overshoot(), round(1.0 - alpha, 12))


def _at_least_one(factor: float | None) -> float | None:
    return None if factor is None else max(1.0, factor)


def interval_scale(rows: DataFrame, target: float = TARGET_COVERAGE) -> float | None:
    """Smallest common widening factor, at least 1, that covers ``target`` of the rows; None without rows."""
    return _at_least_one(quantile_higher(rows, required_scale(), target))


def interval_scales(rows: DataFrame, targets: list[float]) -> dict[float, float]:
    """``interval_scale`` for several targets in the same passes."""
    found = quantiles_higher(rows, {str(t): (required_scale(), t) for t in targets})
    return {t: _at_least_one(found[str(t)]) for t in targets}


@dataclass(frozen=True)
class BucketScales:
    """Widening factors by bucket of the median prediction (``len(scales) + 1`` edges)."""

    edges: list[float]
    scales: list[float]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (b, float(self.edges[b]), float(self.edges[b + 1]), float(s))
            for b, s in enumerate(self.scales)
        ]
        return spark.createDataFrame(rows, "bucket int, lo double, hi double, scale double")


def quantile_edges(rows: DataFrame, value: str = "p50", bins: int = CALIBRATION_BUCKETS) -> list[float]:
    """Distinct edges of equally filled buckets; a single bucket for a degenerate column."""
    edges = sorted(set(linear_quantiles(rows, value, [i / bins for i in range(bins + 1)])))
    if len(edges) > 2 or not edges:
        return edges
    return [edges[0], edges[-1] + 1e-6]


def fit_bucket_scales(
    validation: DataFrame,
    target: float = BUCKET_COVERAGE,
    bins: int = CALIBRATION_BUCKETS,
) -> BucketScales:
    """A widening factor per bucket of the median prediction; 1 for a bucket without rows."""
    edges = quantile_edges(validation, "p50", bins)
    bucket = bucket_index(F.col("p50"), edges)
    wanted = {
        str(b): (F.when(bucket == b, required_scale()), target) for b in range(len(edges) - 1)
    }
    found = quantiles_higher(validation, wanted)
    return BucketScales(edges, [max(1.0, found[b]) if found[b] is not None else 1.0 for b in wanted])


def join_bucket_scale(rows: DataFrame, fitted: BucketScales) -> DataFrame:
    """Add ``bucket`` and its ``scale``. The table has at most as many rows as buckets."""
    table = fitted.to_df(rows.sparkSession).select("bucket", "scale")
    bucket = bucket_index(F.col("p50"), fitted.edges).cast("int")
    return rows.withColumn("bucket", bucket).join(F.broadcast(table), "bucket")


def apply_bucket_scales(rows: DataFrame, fitted: BucketScales) -> DataFrame:
    """Add the bucket-wise widened interval as ``low`` and ``high``."""
    low, high = scaled_interval(F.col("p10"), F.col("p90"), F.col("scale"))
    return join_bucket_scale(rows, fitted).withColumn("low", low).withColumn("high", high)


@dataclass(frozen=True)
class Calibration:
    """Everything fitted for the interval report."""

    scale_80: float
    scale_90: float
    scale_posthoc: float
    buckets: BucketScales
    qhat: float


def fit_calibration(validation: DataFrame, test: DataFrame) -> Calibration:
    """Fit all calibrators; only the post-hoc scale looks at the test rows."""
    scales = interval_scales(validation, [TARGET_COVERAGE, WIDE_COVERAGE])
    return Calibration(
        scale_80=scales[TARGET_COVERAGE],
        scale_90=scales[WIDE_COVERAGE],
        scale_posthoc=interval_scale(test, POSTHOC_COVERAGE),
        buckets=fit_bucket_scales(validation),
        qhat=conformal_qhat(validation),
    )


def calibration_report(test: DataFrame, fitted: Calibration) -> DataFrame:
    """Coverage of the raw and of every calibrated interval, all measured in one pass."""
    p10, p90 = F.col("p10"), F.col("p90")
    rows = join_bucket_scale(test, fitted.buckets)
    report = interval_report(
        rows,
        {
            "raw": (p10, p90),
            "scaled_80": scaled_interval(p10, p90, fitted.scale_80),
            "scaled_90": scaled_interval(p10, p90, fitted.scale_90),
            "target_805": scaled_interval(p10, p90, fitted.scale_posthoc),
            "bucketed_85": scaled_interval(p10, p90, F.col("scale")),
            "conformal_80": (p10 - F.lit(fitted.qhat).cast("double"), p90 + F.lit(fitted.qhat).cast("double")),
        },
    )
    return report.withColumn("is_posthoc", F.col("method") == "target_805")
