"""Session helpers: creation for scripts and tests, and reliable materialisation."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of a session, once."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='run-package-')}/{package.name}", "zip", package.parent, package.name
        )
        context.addPyFile(archive)  # Spark hands it to every executor
        _shipped.add(context.applicationId)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidyorder")
        .config("spark.driver.memory", os.environ.get("TIDYORDER_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-checkpoint-")
    context.setCheckpointDir(configured)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and cut its lineage.

    Used where a result is read several times (routing tables, step outputs in the
    order tree). The files survive executor loss, unlike cached blocks.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """Deletes the files of the `materialize`d tables that these read, for tables nobody reads again."""
    for df in tables:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            kept = leaf.rdd().getCheckpointFile() if leaf.nodeName() == "LogicalRDD" else None
            if kept is not None and kept.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def brief_shuffles(work: Callable) -> Callable:
    """For work on the table that is its first argument: the shuffle files of each action in it go
    when the action ends, and do not wait until the driver collects garbage. Nothing in it
    may run the very same DataFrame twice, unless it is materialised."""

    @wraps(work)
    def run(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            return work(df, *args, **kwargs)
        finally:
            conf.set(_CLEANUP, before)

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for an intermediate file set."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def parallel_tasks(spark: SparkSession) -> int:
    """Task count for compute-heavy stages whose bytes are small: adaptive coalescing by
    size would run them in a handful of tasks."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Enough partitions for a compute-heavy pass over a materialised table; a table that
    already has them is not shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)
