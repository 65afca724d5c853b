"""What the corpus operators share: text normalisation, checkpoints, batch sizes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import shared_folder

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Rows in one Arrow batch to Python. Texts may hold 100 KB and more, so the default of 10,000 rows is too many.
ARROW_ROWS = 1000
#: And its bytes: a batch ends with the row that passes this, so very long texts travel alone.
ARROW_BYTES = 16 << 20


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z alone. Text of one byte a character takes the fast built-in; only other text pays for translate."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def no_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole texts within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
