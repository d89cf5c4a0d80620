"""Error metrics of arrival-time predictions, all as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NEAR_ARRIVAL_MIN, TOLERANCE_MIN


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mae(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def rmse(y, p) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.avg(e * e))


def mape(y, p) -> Column:
    """Mean absolute error in percent of the truth; rows with truth 0 do not count."""
    y = _c(y)
    return F.avg(F.when(y != 0, F.abs((y - _c(p)) / F.nullif(y, F.lit(0.0))))) * 100


def pinball(y, p, q: float) -> Column:
    e = _c(y) - _c(p)
    return F.avg(F.when(e >= 0, e * q).otherwise(e * (q - 1)))


def coverage(y, low, high) -> Column:
    return F.avg(((_c(y) >= _c(low)) & (_c(y) <= _c(high))).cast("double"))


def report_columns(
    y: Column | str,
    p50: Column | str,
    p10: Column | str | None = None,
    p90: Column | str | None = None,
    near_min: float = NEAR_ARRIVAL_MIN,
    tolerance_min: float = TOLERANCE_MIN,
) -> list[Column]:
    """The aggregates of a full report; parts that cannot be computed come out null."""
    near = _c(y) <= near_min
    error = F.abs(_c(y) - _c(p50))
    columns = [
        mae(y, p50).alias("mae"),
        rmse(y, p50).alias("rmse"),
        mape(y, p50).alias("mape"),
        F.count_if(near).cast("double").alias("near_arrival_n"),
        F.avg(F.when(near, error)).alias("near_arrival_mae"),
        F.avg(F.when(near, (error <= tolerance_min).cast("double"))).alias("within_tolerance_rate"),
    ]
    if p10 is not None:
        columns.append(pinball(y, p10, 0.1).alias("pinball_p10"))
    if p90 is not None:
        columns.append(pinball(y, p90, 0.9).alias("pinball_p90"))
    if p10 is not None and p90 is not None:
        columns.append(coverage(y, p10, p90).alias("coverage_p10_p90"))
        columns.append(F.count_if(_c(p10) > _c(p90)).alias("crossed"))
    return columns


def evaluate(
    df: DataFrame,
    y: str = "y",
    p50: str = "p50",
    p10: str | None = None,
    p90: str | None = None,
    by: Sequence[str] = (),
    **limits: float,
) -> DataFrame:
    """Full report over all rows, or one per group of ``by``."""
    columns = report_columns(y, p50, p10, p90, **limits)
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def model_comparison(df: DataFrame, models: dict[str, str], y: str = "y") -> DataFrame:
    """One report row per model, with the gain in MAE over the ``naive`` and ``baseline`` models.

    All models are measured in one pass over the wide table; the single result row is then
    turned into one row per model.
    """
    reports = [
        F.struct(F.lit(name).alias("model"), F.struct(*report_columns(y, column)).alias("r"))
        for name, column in models.items()
    ]
    wide = df.agg(*[r.alias(f"_{i}") for i, r in enumerate(reports)])
    rows = wide.select(F.explode(F.array(*wide.columns)).alias("m"), *wide.columns)
    positions = {name: f"_{i}" for i, name in enumerate(models)}
    gains = [
        (
            (F.col(f"{positions[base]}.r.mae") - F.col("m.r.mae"))
            / F.col(f"{positions[base]}.r.mae")
            * 100
        ).alias(f"gain_vs_{base}_pct")
        for base in ("naive", "baseline")
        if base in positions
    ]
    return rows.select("m.model", "m.r.*", *gains)


def interval_report(
    df: DataFrame, intervals: dict[str, tuple[Column, Column]], y: str = "y"
) -> DataFrame:
    """Coverage and mean width of several interval versions of the same rows, in one pass."""
    columns = [
        F.struct(
            F.lit(name).alias("method"),
            coverage(y, low, high).alias("coverage"),
            F.avg(high - low).alias("mean_width"),
            F.count_if(low > high).alias("crossed"),
        ).alias(f"_{i}")
        for i, (name, (low, high)) in enumerate(intervals.items())
    ]
    wide = df.agg(*columns)
    return wide.select(F.explode(F.array(*wide.columns)).alias("m")).select("m.*")
