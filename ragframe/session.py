"""Session helpers: local sessions, shared scratch space, small inputs."""

from __future__ import annotations

import tempfile
import uuid

import ragframe
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "ragframe", cores: str = "8") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package() -> None:
    """Send the package's own code along with tasks, for workers without it."""
    cloudpickle.register_pickle_by_value(ragframe)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that does
    not (a test) gets a folder of this machine.
    """
    try:
        named = spark.conf.get("spark.checkpoint.dir", None)
    except PySparkException:
        named = None
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ragframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions for the cores; leave a big one alone.

    A table of one small file is one scan task; expensive work per row should
    not wait for it. Scans with enough splits are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
