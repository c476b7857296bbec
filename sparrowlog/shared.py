"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where the session names none and all run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sparrowlog-")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, for rows that several jobs read."""
    where = scratch(df.sparkSession, what)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer files than there are cores, dealt out by its keys, so that what reads it isn't one task; larger ones as they are."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n, *keys) if len(scan.inputFiles()) < n else scan
