"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep splitting a hot person even where that costs a shuffle above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # shuffle files go when the statement that made them ends; otherwise they stay until the driver collects its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: settings of a running session that its owner does not have to make
RUNNING = ("spark.sql.adaptive.", "spark.sql.classic.shuffleDependency.")


def prepare_session(spark: SparkSession) -> SparkSession:
    """Turn adaptive execution, the splitting of skewed joins and the deletion of read shuffle files on in a running session."""
    for key, value in SETTINGS.items():
        if key.startswith(RUNNING):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("carepath")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a local one only in local mode.

    ``spark.checkpoint.dir`` names the shared folder. A machine-local folder would lose
    data with its executor, so outside local mode an unset folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="carepath-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several steps read, and go on from the written one.

    Unlike a cached table it outlives its executors, is read column by column, and
    ends the plan: what follows is planned from its size and not from its history.
    """
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    _WRITTEN.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_materialised(spark: SparkSession) -> None:
    """Delete the tables this program has written with :func:`materialise`."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
