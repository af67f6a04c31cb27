"""Sinks: topic tables, fan-out, exports, per-entity folders, state and logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json_object
from rillmark.session import materialize


def topic_records(
    df: DataFrame, topic: Column, key: Column, identifier: str = "", topicid: int = -999,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(topic, key, value): every row as a JSON value with identifier and topicid."""
    fields = [F.col(c) for c in (columns or df.columns)]
    value = F.to_json(F.struct(*fields, F.lit(identifier).alias("identifier"), F.lit(topicid).alias("topicid")))
    return df.select(topic.alias("topic"), key.cast("string").alias("key"), value.alias("value"))


def split_valid(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be produced (JSON objects), and the quarantined rest."""
    marked = df.withColumn("_ok", is_json_object(F.col(value)))
    return marked.filter("_ok").drop("_ok"), marked.filter("not _ok").drop("_ok")


def append_topic(df: DataFrame, path: str) -> None:
    """Append records to a topic table, one folder per topic."""
    df.write.mode("append").partitionBy("topic").parquet(path)


def fan_out(df: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """Write one result to several targets; a failing target does not stop the others.

    The result is stored once, so every target gets the same rows without
    computing them again.  Returns (target, status, message).
    """
    spark = df.sparkSession
    df = materialize(df, "fan-out")
    rows = []
    for name, write in targets.items():
        try:
            write(df)
            rows.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 - the status table reports it
            rows.append((name, "failed", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "target string, status string, message string")


def export(df: DataFrame, path: str, kind: str) -> None:
    """Result table as CSV (with header) or JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export: {kind}")


def by_entity(df: DataFrame, path: str, entity: str = "entity", parts: int = 4) -> None:
    """Training rows or models in one folder per entity.

    Rows are grouped by entity so that a task writes few folders, in ``parts``
    shares so that a large entity is written by several tasks.  The tasks put
    their files into place themselves: the driver would do it one by one.
    """
    share = F.pmod(F.xxhash64(*[c for c in df.columns if c != entity]), F.lit(parts))
    df.repartition(F.col(entity), share).write.mode("overwrite").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(entity).parquet(path)


def by_file(df: DataFrame, path: str, file: str, value: str) -> None:
    """Enriched JSON lines back per source file."""
    df.select(file, value).write.mode("overwrite").partitionBy(file).text(path)


def log_record(level: str, service: str, at: Column, message: Column) -> Column:
    """Structured stage log record."""
    return F.struct(
        F.lit(level).alias("level"), F.date_format(at, "yyyy-MM-dd_HH:mm:ss").alias("time"),
        F.lit(service).alias("service"), message.alias("message"))


# ---- baseline state ---------------------------------------------------------

BASELINE_SCHEMA = "event_type string, share double, last_baseline_time timestamp_ntz"


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored category shares with the time they were taken, or None on a cold start."""
    try:
        return spark.read.schema(BASELINE_SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def next_baseline(stored: DataFrame | None, current: DataFrame, now: str, hours: float) -> DataFrame:
    """The baseline to keep: replaced when there is none or it is old enough.

    ``now`` is the batch's clock.  The table has one row per category.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    fresh = current.select("event_type", "share", moment.alias("last_baseline_time"))
    if stored is None:
        return fresh
    taken = stored.agg(F.max("last_baseline_time").alias("t")).scalar()
    elapsed = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(taken.cast("timestamp"))) / 3_600_000_000
    due = taken.isNull() | (elapsed >= hours)
    kept = stored.filter(~due)
    return kept.unionByName(fresh.filter(due))
