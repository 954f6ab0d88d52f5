"""Session building and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: set[str] = set()


def build_session(app: str = "tastegrid", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings every test and bench shares."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TASTEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        at = getattr(spark, "_tastegrid_shared", None)
        if at is None:
            at = "file://" + tempfile.mkdtemp(prefix="tastegrid-")
            spark._tastegrid_shared = at
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when Python ends."""
    at = f"{shared_dir(spark)}/tastegrid/{spark.sparkContext.applicationId}"
    if at not in _RUNS:
        _RUNS.add(at)
        atexit.register(_remove, spark, at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


def settle(df: DataFrame, name: str = "step", release: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder, read again. Survives the loss of executors.

    release: for jobs of many steps; Spark deletes the shuffle files of a step when its plan is collected as garbage on the
    driver, which this asks for, as a driver with room to spare would otherwise let them pile up on the executors' disks."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tastegrid_path = path
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a settled table that no plan reads any more."""
    path = getattr(df, "_tastegrid_path", None)
    if path:
        _remove(df.sparkSession, path)


def parallelism(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions for CPU-heavy Python stages on small inputs: a multiple of the cores, at least the shuffle setting."""
    cores = spark.sparkContext.defaultParallelism
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * cores)


def spread(df: DataFrame) -> DataFrame:
    """The rows for a CPU-heavy Python stage: as the scan splits them, or spread evenly where its splits would be fewer than
    the tasks the cluster takes. Only inputs of less than that many splits are ever shuffled, so the number of tasks follows
    the bytes; a heavy stage gets smaller ones by spark.sql.files.maxPartitionBytes."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    tasks = parallelism(spark)
    return df if size >= tasks * split else df.repartition(tasks)
