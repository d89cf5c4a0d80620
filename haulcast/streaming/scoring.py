"""Streams scored by saved models; a newer version takes over between two micro-batches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.training import Trained, with_naive


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the completely saved versions under ``root``, oldest first.

    ``Trained.save`` writes its state last, so a version counts once the state's success mark is there.
    """
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/state/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found)


def publish(spark: SparkSession, trained: Trained, root: str) -> int:
    """Save ``trained`` as the next version under ``root``; running streams take it up by themselves."""
    number = max(versions(spark, root), default=0) + 1
    trained.save(f"{root}/version={number}")
    return number


def score_all(trained: Trained, rows: DataFrame) -> DataFrame:
    """Every row with the predictions of ``trained``; null where a feature is missing (null or NaN).

    The complete rows get what ``Trained.predict`` gives them.
    """
    rows = rows if "naive" in rows.columns else with_naive(rows)
    number = {f.name for f in rows.schema if f.dataType.typeName() in ("float", "double")}
    missing = reduce(
        or_, [F.col(c).isNull() | (F.isnan(c) if c in number else F.lit(False)) for c in (*trained.columns, "naive")]
    )
    scored = trained.predict(rows.where(~missing))
    return scored.unionByName(rows.where(missing), allowMissingColumns=True)


def score_stream(rows: DataFrame, root: str, target: str, checkpoint: str) -> None:
    """Score a stream of feature rows into a table, each micro-batch by the newest version under ``root``.

    All rows of a batch are scored by one version, named in ``model_version``; the folder is looked at
    once per batch and a version is loaded once. Batches are written under their number, so one that
    is repeated after a failure replaces its rows (then scored by the version that is newest by
    that time) instead of adding to them.
    """
    loaded: dict[int, Trained] = {}

    def write(batch: DataFrame, number: int) -> None:
        found = versions(batch.sparkSession, root)
        if not found:
            raise ValueError(f"no saved models under {root}")
        if found[-1] not in loaded:
            loaded.clear()
            loaded[found[-1]] = Trained.load(f"{root}/version={found[-1]}")
        scored = score_all(loaded[found[-1]], batch)
        scored.withColumn("model_version", F.lit(found[-1])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
