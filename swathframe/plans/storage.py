"""Durable scratch tables in the folder that the cluster shares.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``, so that a lost
executor never loses the only copy of an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one, but only if all of Spark is on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="swathframe-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends, whole or not."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


def saved(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; the result has no lineage."""
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
