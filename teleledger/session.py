"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import importlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: safe on a session somebody else built.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Bytes of an exchange are compressed; sorting them takes up to forty times as many.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A page deeper than this is sorted with spill, not held in a heap per task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


_shipped: set[str] = set()
#: What a stateful stream's processor is made of; all else is imported where it runs.
_BY_VALUE = ("functions", "streaming", "operators", "schema")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; its Python functions run there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / package.name), "zip", package.parent, package.name)
    context.addPyFile(archive)
    # The worker that plans a stateful stream starts without added files: its processor travels by value.
    for part in _BY_VALUE:
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{package.name}.{part}"))
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Make a session ready for the operators: settings, and the package on the executors."""
    ship(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "teleledger", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="teleledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a result that several branches read: computed once, survives lost executors."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; Spark has no call of its own for that."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """As ``cut``, for results of many wide rows: Parquet takes fewer bytes than a checkpoint and is read by column. The steps
    that led to the table are done, and their shuffles given up."""
    spark = df.sparkSession
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    drop_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have executors delete the shuffles of steps that are done: they keep the files until the driver collects what refers to
    them, which a job of many steps may never see. Those of a step that ended just now may stay until the next call."""
    spark.sparkContext._jvm.java.lang.System.gc()
