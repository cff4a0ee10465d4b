"""Session settings the library expects."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("motorlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # longer generated methods are left to the interpreter by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A cluster names it in ``spark.checkpoint.dir``.  Only a session without that
    setting (tests, a laptop) gets a temporary folder, and only a local master
    may: executors on other machines could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="motorlens-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


# folders of written tables of this process
_folders: list[str] = []


def _path(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def table_folder(spark: SparkSession) -> str:
    """A new folder for written tables, beside the shared checkpoints; it goes when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    _folders.append(folder)
    return folder


def drop_tables(spark: SparkSession) -> int:
    """Remove the tables written so far, once the results that rest on them have been read; returns how many went."""
    dropped = 0
    while _folders:
        path, files = _path(spark, _folders.pop())
        dropped += bool(files.delete(path, True))
    return dropped


def materialise(df: DataFrame) -> DataFrame:
    """Store an intermediate result as a table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but computes the plan once and leaves file
    sizes behind, by which later joins are planned.
    """
    spark = df.sparkSession
    folder = table_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
