"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A local session without it, as in tests, gets one of its own; on a cluster, where a local folder would not be
    shared, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def reused(df: DataFrame) -> DataFrame:
    """df for several uses: computed once and kept in the shared folder, unless it has been already."""
    plan = df._jdf.queryExecution().logical()
    return df if plan.getClass().getSimpleName() == "LogicalRDD" else checkpointed(df)
