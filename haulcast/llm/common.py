"""Helpers shared by the corpus operators: staged tables, connected components, small expressions."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcast.session import checkpoint_root

# The separators of words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The copy outlives lost executors; the folder is dropped when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/haulcast-{uuid.uuid4().hex}"
    schema = df.schema
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


FILTER_BITS = 1 << 27  # most bits of a key filter: two million words of 64
KEY_BITS = 16  # bits per key up to that size


def split_by_keys(rows: DataFrame, keys: DataFrame, column: Column, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that surely have none).

    ``column`` names a row's key, ``key`` that of ``keys``, both of one type. A bit per hashed key decides. The
    filter's words are broadcast; there are at most ``FILTER_BITS / 64`` of them at any number of keys, and with
    more keys than it has room for more rows count as possible ones. So whole rows need no shuffle where
    only few of them are affected; the possible ones are to be joined with the keys themselves.
    """
    bits = min(FILTER_BITS, 1 << max(10, (KEY_BITS * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = stage(keys.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))).withColumn("_word", F.shiftright("_place", 6))
    marked = rows.join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr("getbit(_bits, cast(_place % 64 as int)) = 1"), F.lit(False))
    extra = ["_word", "_place", "_bits"]
    return marked.filter(hit).drop(*extra), marked.filter(~hit).drop(*extra)


def worker_cache() -> dict:
    """Objects that a Python worker keeps from task to task, such as loaded tokenizers.

    Functions of this package travel by value, so their modules' globals do not outlive a task.
    """
    return sys.modules.setdefault("haulcast_worker_cache", types.ModuleType("haulcast_worker_cache")).__dict__


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text; null and blank texts have none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(body == "", 0).otherwise(F.size(F.split(body, f"{SPACE}+"))).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of a key written as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest reachable node for every node of the given edges, by repeated minimum labels."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Edges of one partition become the edges of a star per connected part."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if found:
        node, root = local_roots(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge (columns a, b: long).

    Each round contracts the edges inside every partition to stars and relabels each node by its
    smallest neighbour, so edges shrink to the parts that still cross partitions.
    """
    edges = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_contract, "a long, b long"))
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        step = smallest.select(F.col("a").alias("root"), "p")
        if labels is None:
            labels = stage(smallest.select(F.col("a").alias("node"), F.col("p").alias("root")))
        else:
            labels = stage(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        edges = (
            edges.join(smallest.select("a", F.col("p").alias("pa")), "a")
            .join(smallest.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct()
        )
        edges = stage(edges.mapInArrow(_contract, "a long, b long"))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def positions(rows: DataFrame, group: list[str], order: list[Column | str], task_rows: int = 1 << 16) -> DataFrame:
    """``rows`` with ``pos``: the 0-based place of a row in its group by ``order``; group columns hold no nulls.

    Rows are range-partitioned, so a group of any size spreads over tasks; ties are ordered by their
    place in the input. Only one row per (task, group) takes part in the running sum of counts.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [*group, *order, "_row"]
    parts = max(1, -(-rows.count() // task_rows))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).alias("_task")
    runs = placed.groupBy(*group, task).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = stage(runs.select(*group, "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    return placed.withColumn("_task", task).join(runs, [*group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")
