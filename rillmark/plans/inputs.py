"""How the given tables stand in for the streams the operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.plans.registry import Tables
from rillmark.session import spread


def measurements(t: Tables) -> DataFrame:
    """Events as long-form measurements: user = entity, type = subtopic."""
    return t.events.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("subtopic"), "value", "ts",
        F.col("event_id").alias("msgid"),
    )


def shipments(t: Tables) -> DataFrame:
    """Line items as a second numeric stream: supplier = entity, flag = subtopic."""
    return spread(t.lineitem.select("l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate", "l_orderkey",
                                    "l_linenumber", "l_partkey")).select(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("subtopic"),
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("msgid"),
    )


def settle(col: Column, places: int) -> Column:
    """Round for comparison; a nudge far below the last place settles exact halves."""
    return F.round(col + 10.0 ** -(places + 3), places)


# The same two streams for the check, cut to the rollback window.
WINDOW_SQL = """
SELECT *, row_number() OVER g AS rn, row_number() OVER a AS k,
  avg(x) OVER p AS m, stddev_pop(x) OVER p AS sd, lag(x) OVER a AS px, lag(ts) OVER a AS pts
FROM (SELECT user_id AS entity, event_type AS subtopic, value AS x, ts, event_id AS msgid, props FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 800)
WINDOW g AS (PARTITION BY entity, subtopic ORDER BY ts DESC, msgid DESC),
  a AS (PARTITION BY entity, subtopic ORDER BY ts, msgid), p AS (PARTITION BY entity, subtopic)
"""

SHIPMENT_SQL = """
SELECT l_suppkey AS entity, l_returnflag AS subtopic, l_extendedprice AS x, l_shipdate AS ts,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS msgid FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag
  ORDER BY l_shipdate DESC, concat_ws('-', l_orderkey, l_linenumber, l_partkey) DESC) <= {n}
"""


def iot_records(t: Tables) -> DataFrame:
    """Events as nested JSON device readings."""
    doc = F.struct(
        F.struct(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dsn"),
            F.col("event_type").alias("property_name"),
            F.concat(F.col("event_type"), F.lit(" meter")).alias("display_name"),
            F.concat(F.lit("M"), (F.col("user_id") % 4).cast("string")).alias("oem_model"),
        ).alias("metadata"),
        F.struct(
            F.col("event_id").alias("id"), F.col("value"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        ).alias("datapoint"),
        F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k")).alias("lat"),
        F.col("user_id").cast("string").alias("long"),
    )
    return spread(t.events).select("event_id", F.to_json(doc).alias("payload"))


IOT_CRITERIA = (
    "uid=metadata.dsn,filter:allrecords~subtopics=metadata.property_name~values=datapoint.value~"
    "identifiers=metadata.display_name~datetime=datapoint.updated_at~msgid=datapoint.id~latlong=lat:long"
)


def observations(t: Tables) -> DataFrame:
    """Line items as nested clinical-style observations with two array components.

    The second component is missing when the tax is zero.
    """
    def component(code: str, value: str):
        coding = F.array(F.struct(F.lit(code).alias("code"), F.lit(f"{code} text").alias("display")))
        return F.struct(
            F.struct(coding.alias("coding")).alias("code"),
            F.struct(F.col(value).alias("value")).alias("valueQuantity"),
        )

    both = F.array(component("disc", "l_discount"), component("tax", "l_tax"))
    one = F.array(component("disc", "l_discount"))
    doc = F.struct(
        F.struct(F.concat(F.lit("Patient/"), F.col("l_suppkey").cast("string")).alias("reference")).alias("subject"),
        F.when(F.col("l_linestatus") == "F", "Observation").otherwise("Other").alias("resourceType"),
        F.when(F.col("l_tax") > 0, both).otherwise(one).alias("component"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"),
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
    )
    return spread(t.lineitem).select("l_orderkey", "l_linenumber", F.to_json(doc).alias("payload"))


OBSERVATION_CRITERIA = (
    "uid=subject.reference,filter:resourceType=Observation~"
    "subtopics=component.0.code.coding.0.code,component.1.code.coding.0.code~"
    "values=component.0.valueQuantity.value,component.1.valueQuantity.value~"
    "identifiers=component.0.code.coding.0.display,component.1.code.coding.0.display~"
    "datetime=effectiveDateTime~msgid=id:line~latlong="
)


def hosts(t: Tables) -> DataFrame:
    """Orders as flat host status records: two packet counts and a text status."""
    failed = F.col("o_orderstatus") == "F"
    doc = F.struct(
        F.concat(F.lit("host"), (F.col("o_custkey")).cast("string")).alias("hostName"),
        F.when(failed, F.lit(0)).otherwise(F.col("o_orderkey")).alias("inboundpackets"),
        F.when(failed, F.lit(0)).otherwise(F.col("o_custkey")).alias("outboundpackets"),
        F.when(failed, F.lit("FAILURE")).otherwise(F.lit("SUCCESS")).alias("pingStatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("lastUpdated"),
    )
    return spread(t.orders).select("o_orderkey", F.to_json(doc).alias("payload"))


HOST_CRITERIA = (
    "uid=hostName,filter:allrecords~subtopics=hostName,hostName,hostName~"
    "values=inboundpackets,outboundpackets,pingStatus~identifiers=inboundpackets,outboundpackets,pingStatus~"
    "datetime=lastUpdated~msgid=~latlong="
)


def preprocessed(t: Tables) -> DataFrame:
    """Events as preprocessed records."""
    return t.events.select(
        "event_id",
        F.col("event_type").alias("variable"),
        F.when(F.col("event_id") % 3 == 0, "Avg").when(F.col("event_id") % 3 == 1, "Trend").otherwise("AnomProb").alias(
            "preprocesstype"),
        F.concat(F.col("event_type"), F.lit("~device~uid=u"), F.col("user_id").cast("string")).alias("identifier"),
        F.col("value").alias("hyperprediction"),
    )


PREPROCESSED_SQL = """SELECT event_id, event_type AS variable,
  CASE event_id % 3 WHEN 0 THEN 'Avg' WHEN 1 THEN 'Trend' ELSE 'AnomProb' END AS preprocesstype,
  event_type || '~device~uid=u' || user_id AS identifier, value AS hyperprediction, user_id FROM events"""


def document_lines(t: Tables) -> DataFrame:
    """Documents as log files: every line with its number."""
    texts = spread(t.documents.select("doc_id", "text"))
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_pos", "line")).select(
        "doc_id", (F.col("_pos") + 1).alias("line_number"), "line"
    )


LINES_SQL = """SELECT doc_id, line, line_number FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_number
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
