"""Session settings the operators rely on, and the shared folder they may write to."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession

# Functions sent to Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["weftwork"])

# AQE splits a hot join key at run time and turns a join into a broadcast only
# after it has seen the real size of the side, so no operator hints a broadcast
# of a side that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # A job's shuffle files go when it ends; else they stay until the driver collects garbage, and a query of many jobs keeps those of all.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# Spark compares compressed or estimated bytes with its limit of 10 MB, and what it then holds on the driver is up to a
# hundred times larger, for each join that runs at the time. A limit that the session itself sets stays.
BROADCAST, BROADCAST_DEFAULT, BROADCAST_LIMIT = "spark.sql.autoBroadcastJoinThreshold", 10 << 20, 2 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
WAVES = 16  # shuffle partitions a core to start from; AQE merges those that turn out small
# What a task of the ETL part reads: rows are thin there and grow a lot in memory, so both are a quarter or less of Spark's.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": (64 << 20, 16 << 20), "spark.sql.files.maxPartitionBytes": (128 << 20, 16 << 20)}
FINE_PARTITIONS = 1024


def tune(spark: SparkSession, fine: bool = False) -> SparkSession:
    """Apply the run-time settings; safe to call on every query.

    A shuffle starts from several partitions a core, unless the session says how many
    or asks for more by ``spark.sql.shuffle.partitions``, so that partitions fit in memory at any input size. ``fine``: at least
    FINE_PARTITIONS of them and TASK_BYTES a task, where the session has left these to Spark.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(BROADCAST).rstrip("b") == str(BROADCAST_DEFAULT):
        spark.conf.set(BROADCAST, str(BROADCAST_LIMIT))
    waves = max(WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ours = {INITIAL_PARTITIONS: (waves, max(waves, FINE_PARTITIONS)), **TASK_BYTES}
    for key, (coarse, small) in ours.items():
        coarse, small = str(coarse), str(small)
        if spark.conf.get(key, None) in (None, spark.conf.get(f"weftwork.{key}", None)):  # nobody's or ours
            spark.conf.set(key, small if fine else coarse)
            spark.conf.set(f"weftwork.{key}", small if fine else coarse)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session starts from."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, by: str | Column, rows: int, each: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``by`` over partitions of about ``each`` rows, at least one a core.

    For thin rows that grow in their task: AQE would merge partitions by the bytes of the thin rows, and so a task would
    hold ever more of what they grow to.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), by)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session, as in tests, gets a temporary folder of its own; a
    cluster without the setting is an error, because a machine-local folder
    would lose data with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("weftwork.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="weftwork-")
        spark.conf.set("weftwork.shared.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/weftwork/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the files. ``compression``: the session's codec unless given."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Ends the growth of lineage in iterative jobs and pins the output of range
    partitioning, so a lost executor never changes row numbers already used.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
