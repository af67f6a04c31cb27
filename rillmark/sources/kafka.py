"""Native Kafka source and sink (needs Spark's Kafka connector on the class path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topics(
    spark: SparkSession, servers: str, names: Sequence[str], stream: bool = True, starting: str = "latest",
    per_trigger: int | None = None, options: dict[str, str] | None = None,
) -> DataFrame:
    """Topic records with their coordinates and the value as text."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(names))
    reader = reader.option("startingOffsets", starting)
    if stream and per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    rows = reader.options(**(options or {})).load()
    return rows.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition",
        "offset", "timestamp")


def write(df: DataFrame, servers: str, checkpoint: str | None = None, options: dict[str, str] | None = None):
    """Produce (topic, key, value) rows; a stream needs a checkpoint folder."""
    settings = {"kafka.bootstrap.servers": servers, **(options or {})}
    rows = df.select("topic", "key", "value")
    if df.isStreaming:
        return rows.writeStream.format("kafka").options(**settings).option("checkpointLocation", checkpoint)
    return rows.write.format("kafka").options(**settings)
