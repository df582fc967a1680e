"""Intermediate tables in the folder that all executors share.

The folder is the one named by spark.checkpoint.dir. Only where that setting is
missing and Spark runs on one machine (tests), a temporary folder of this machine is used; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder in the shared one; nothing exists there yet.

    Results are read from these files, so they stay; the application's folder can be deleted when it has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-siftmark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siftmark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more: what was made of them has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered_checkpoint(df: DataFrame) -> DataFrame:
    """`df` with its partitions and their order fixed in the shared checkpoint folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        shared_path(df.sparkSession, "none")
    return df.checkpoint(eager=True)
