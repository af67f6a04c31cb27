"""Records pushed to or pulled from other systems, once they have landed as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json, is_json_object, json_elements, json_get
from rillmark.operators.extract import walk
from rillmark.operators.windows import last_n

# Where each system keeps its list of records and their payload.
SYSTEM_PATHS = {
    "kafka": ([], ["value"]),
    "rabbitmq": ([], ["payload"]),
    "redis": (["{command}"], []),
    "scada": ([], []),
    "splunk": (["results"], []),
    "elasticsearch": (["hits", "hits"], ["_source"]),
    "clickhouse": (["data"], []),
    "influxdb": ([], []),
    "logstash": ([], []),
}


def pushed(df: DataFrame, body: str, default_topic: str, keep: Sequence[str] = ()) -> DataFrame:
    """(topic, value) of pushed bodies: one object or an array of objects.

    ``sendtotopic`` inside a record chooses its topic.
    """
    items = df.select(*keep, F.explode(json_elements(F.col(body))).alias("value"))
    items = items.filter(is_json_object(F.col("value")))
    return items.withColumn("topic", F.coalesce(json_get(F.col("value"), "sendtotopic"), F.lit(default_topic)))


def checked(df: DataFrame, field: str) -> DataFrame:
    """Adds ``reason``: null for valid JSON texts, else why the record is rejected."""
    reason = F.when(F.col(field).isNull() | (F.trim(field) == ""), "empty").when(
        ~is_json(F.col(field)), "not valid JSON")
    return df.withColumn("reason", reason)


def pulled(
    df: DataFrame, response: str, root: Sequence[str], payload: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """JSON objects inside a system's responses.

    ``root`` leads to the list of records (a single object counts as a list of
    one) and ``payload`` to the document inside a record, which may be JSON
    text itself.  Everything that is not an object is dropped.
    """
    listed = walk(F.col(response), list(root))
    rows = df.select(*keep, F.explode(json_elements(listed)).alias("_item"))
    out = rows.withColumn("value", walk(F.col("_item"), list(payload))).drop("_item")
    return out.filter(is_json_object(F.col("value")))


def pulled_from(system: str, df: DataFrame, response: str, keep: Sequence[str] = (), command: str = "") -> DataFrame:
    """:func:`pulled` with the paths of a named system."""
    root, payload = SYSTEM_PATHS[system]
    return pulled(df, response, [command if p == "{command}" else p for p in root], payload, keep)


def last_records(topic_table: DataFrame, rollback: int, partition: int = -1) -> DataFrame:
    """Newest ``rollback`` records of every topic partition, or of one partition."""
    rows = topic_table if partition == -1 else topic_table.filter(F.col("partition") == partition)
    return last_n(rows, ["topic", "partition"], ["offset"], rollback).drop("rn")


def topic_results(topic_table: DataFrame, topics: Sequence[str], rollback: int) -> DataFrame:
    """One JSON document per topic with its newest records in order.

    The rollback bounds the document of a topic.
    """
    rows = last_n(topic_table.filter(F.col("topic").isin(list(topics))), ["topic"], ["offset", "partition"], rollback)
    listed = F.sort_array(F.collect_list(F.struct("offset", "partition", "value")))
    reads = F.transform(listed, lambda r: r["value"])
    body = F.concat(F.lit('{"StreamTopicDetails":{"TopicReads":['), F.array_join(reads, ","), F.lit("]}}"))
    return rows.groupBy("topic").agg(F.count("*").alias("records"), body.alias("document"))


def topic_reads(df: DataFrame, document: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records of a read envelope; upper- and lower-case spellings are accepted."""
    doc = F.col(document)
    reads = F.coalesce(
        json_get(doc, "StreamTopicDetails.TopicReads"), json_get(doc, "streamtopicdetails.topicreads"))
    return df.select(*keep, F.explode(json_elements(reads)).alias("record"))
