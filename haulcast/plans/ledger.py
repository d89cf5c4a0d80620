"""A table of the figures of each run, so that milestones can be compared."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "milestone string, slice string, metric string, value double, run_id string"


def record_run(report: DataFrame, path: str, run_id: str, milestone: str, slices: list[str] | None = None) -> None:
    """Write the numeric columns of ``report``, one row per metric and slice, under ``run_id``.

    ``slices`` names the columns that tell the report's rows apart. A run is one partition and is
    replaced as a whole: writing a run again, as after a failure, leaves one set of its rows and
    does not touch the other runs.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r} must be of letters, digits, '_', '.' and '-'")
    slices = slices or []
    numeric = [c for c, t in report.dtypes if c not in slices and t.split("(")[0] in NUMERIC]
    if not numeric:
        raise ValueError("the report has no numeric columns")
    figures = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in slices])
    rows = report.select((name if slices else F.lit("")).alias("slice"), F.explode(figures).alias("f"))
    (
        rows.select(F.lit(milestone).alias("milestone"), "slice", "f.metric", "f.value", F.lit(run_id).alias("run_id"))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


# types of figures that fit a double
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All recorded figures; run ids stay text, whatever they look like."""
    return spark.read.schema(SCHEMA).parquet(path)


def compare_runs(runs: DataFrame, before: str, after: str) -> DataFrame:
    """Figures of two runs side by side, with the change and its share; missing ones are null."""

    def of(run: str, name: str) -> DataFrame:
        return runs.where(F.col("run_id") == run).select("slice", "metric", F.col("value").alias(name))

    change = F.col("after") - F.col("before")
    return (
        of(before, "before")
        .join(of(after, "after"), ["slice", "metric"], "full")
        .select(
            "slice",
            "metric",
            "before",
            "after",
            change.alias("change"),
            F.when(F.col("before") != 0, change / F.abs(F.col("before")) * 100).alias("change_pct"),
        )
    )


def history(runs: DataFrame, metric: str) -> DataFrame:
    """One metric over all runs."""
    return runs.where(F.col("metric") == metric).select("run_id", "milestone", "slice", "value")
