"""Session settings and the lineage cut shared by the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime-settable options the plans rely on.
#  - co-partition on a subset of the join keys: rows already hashed on (vehicle, chunk) are
#    joined with summaries on (vehicle, chunk, trip) without being shuffled a second time;
#  - timestamps are naive UTC everywhere.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches for Python are bounded by size as well as by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # recording the call site of every column expression dominates plan building
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session (idempotent).

    Functions of this package that run in Python workers are sent along with the tasks, so the
    package need not be installed on the executors.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, app: str = "haulcast") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", own_checkpoint_folder())
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    A session on one machine that names none gets a folder of its own, removed when it ends; on a
    cluster the setting is required, since executors do not see each other's local folders.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    root = root or context.getCheckpointDir() or ""
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = own_checkpoint_folder()
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def own_checkpoint_folder() -> str:
    """A folder for the checkpoints of a single-machine session, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="haulcast-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy.

    The copy lives in shared storage, so losing an executor loses nothing.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
