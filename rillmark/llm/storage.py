"""Session preparation, intermediate tables and joins whose broadcast side is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.session import materialize, scratch_path, tune

# A side of a join is copied to all executors only up to this many rows of a few numbers each (about 32 MB).
BROADCAST_ROWS = 500_000

__all__ = ["BROADCAST_ROWS", "materialize", "measured", "prepare", "scratch_path"]


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: small Arrow batches, so that long texts stay within a worker's memory."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def measured(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored, narrow table as a join side: broadcast when its counted rows allow it, else left to Spark's joins."""
    return F.broadcast(side) if side.count() <= rows else side

