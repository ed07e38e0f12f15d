"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the context's checkpoint folder. A session
    on one machine (``local[...]``) that has neither gets a temporary one; on a cluster
    executors could not see each other's temporary folders, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:  # the setting itself is fixed once a session runs
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its size is then known, and what
    reads it does not make it anew."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of rows that a Python worker is sent at a time.
ARROW_BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless the user has set a bound: ten
    thousand rows, which Spark sends otherwise, may be 64 MB in each of a task's two
    processes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "64MB", str(64 << 20)):
        spark.conf.set(name, ARROW_BATCH)
