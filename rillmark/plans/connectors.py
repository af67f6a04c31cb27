"""Queries that write the tables in a source's form and read them through it, and queries for the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions.jsonpath import json_get
from rillmark.operators import ml, scada, threat
from rillmark.plans import inputs
from rillmark.plans.extraction import FIELDS, SCALING, derived
from rillmark.plans.inputs import LINES_SQL
from rillmark.plans.registry import query, register
from rillmark.session import scratch_path, spread
from rillmark.sources import files, landing, ranges, sinks
from rillmark.streaming.state import drain


def _order_lines(t):
    """Orders as JSON lines with blanks around and semicolons inside."""
    doc = F.to_json(F.struct(
        "o_orderkey", "o_totalprice", F.concat("o_orderstatus", F.lit(";"), "o_orderpriority").alias("note")))
    return t.orders.select(F.concat(F.lit("  "), doc, F.lit(" ")).alias("value"))


@query(
    "src_json_lines",
    "SELECT o_orderkey, o_totalprice, o_orderstatus || ' ' || o_orderpriority AS note FROM orders",
)
def src_json_lines(t):
    path = scratch_path(t.spark, "json-lines")
    _order_lines(t).write.text(path)
    lines = files.json_lines(t.spark, path)
    parsed = F.from_json("value", "o_orderkey bigint, o_totalprice double, note string")
    return lines.select(parsed.alias("d")).select("d.*")


@query(
    "src_folder_messages",
    r"""SELECT 'orders' AS topic, '{o:' || o_orderkey || ' p ' || o_orderpriority || '}' AS message FROM orders
    UNION ALL SELECT 'suppliers', s_name || ' & co' FROM supplier""".replace(" & co", " co"),
)
def src_folder_messages(t):
    """Two folders with a topic each; quotes go, separators become single blanks."""
    base = scratch_path(t.spark, "folders")
    t.orders.select(F.concat(F.lit("{'o':"), F.col("o_orderkey").cast("string"), F.lit(' "p";& '), "o_orderpriority",
                             F.lit("}")).alias("value")).write.text(f"{base}/a")
    t.supplier.select(F.concat("s_name", F.lit(" & co")).alias("value")).write.text(f"{base}/b")
    return files.folder_messages(t.spark, [f"{base}/a", f"{base}/b"], ["orders", "suppliers"]).select("topic", "message")


# A chunk is the longest beginning of at most 1,024 bytes, cut back behind its last blank; then it is cleaned.
_CHUNK_SQL = r"""WITH RECURSIVE c AS (
    SELECT doc_id, 0 AS n, '' AS piece, coalesce(text, '') AS rest FROM documents
    UNION ALL
    SELECT doc_id, n + 1, left(rest, k), substr(rest, k + 1) FROM (
      SELECT doc_id, n, rest, CASE WHEN contains(left(rest, m), ' ') THEN length(regexp_extract(left(rest, m), '(?s)^.* ')) ELSE m END AS k
      FROM (SELECT *, CASE WHEN strlen(rest) <= 1024 THEN length(rest)
        ELSE list_max(list_filter(range(256, 1025), lambda i: strlen(left(rest, i)) <= 1024)) END AS m FROM c WHERE rest <> '')))
  SELECT * FROM (SELECT doc_id, n AS chunk_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '["'']', '', 'g'),
    '\\n|\\r|[\n\r;&]', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' +', ' ', 'g') AS chunk FROM c WHERE n > 0)
  WHERE chunk <> ''"""


@query("txt_document_chunks", _CHUNK_SQL)
def txt_document_chunks(t):
    """Chunks of at most 1,024 bytes of every whole document."""
    return files.chunk_texts(t.documents, ["doc_id"], "text", 1024)


@query(
    "src_chunks",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '["'']', '', 'g'), '[\s;&]', '', 'g')) AS digest,
      0::BIGINT AS oversized FROM documents""",
)
def src_chunks(t):
    """The chunks of a document hold its whole text, none longer than the limit."""
    chunks = files.chunk_texts(t.documents, ["doc_id"], "text", 1024)
    packed = F.regexp_replace("chunk", r"[\s;&]", "")
    listed = F.sort_array(F.collect_list(F.struct("chunk_no", packed.alias("t"))))
    return chunks.groupBy("doc_id").agg(
        F.md5(F.array_join(F.transform(listed, lambda c: c["t"]), "")).alias("digest"),
        F.count_if(F.octet_length("chunk") > 1024).alias("oversized"))


@query(
    "src_numbered_lines",
    f"SELECT doc_id, count(*) AS lines, true AS consecutive FROM ({LINES_SQL}) GROUP BY doc_id",
)
def src_numbered_lines(t):
    """Line numbers inside the files written for the documents; a document's lines follow each other."""
    path = scratch_path(t.spark, "lines")
    inputs.document_lines(t).select(F.concat_ws("|", "doc_id", "line_number", F.regexp_replace("line", r"[\r\n]", " "))
                                    .alias("value")).write.text(path)
    lines = files.numbered_lines(t.spark, path)
    doc = F.split_part("line", F.lit("|"), F.lit(1)).cast("long")
    gap = F.col("line_number") - F.split_part("line", F.lit("|"), F.lit(2)).cast("long")
    return lines.groupBy(doc.alias("doc_id")).agg(
        F.count("*").alias("lines"), (F.min(gap) == F.max(gap)).alias("consecutive"))


@query(
    "src_unread_lines",
    f"""WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, max(line_number) AS n FROM l GROUP BY doc_id)
    SELECT l.doc_id, line_number FROM l JOIN s USING (doc_id) LEFT JOIN labels USING (doc_id)
    WHERE line_number > CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN CASE WHEN n < 2 THEN 0 ELSE 2 END ELSE 0 END""",
)
def src_unread_lines(t):
    """Good documents were read up to line 2, the others have shrunk since, unlabelled ones are new."""
    lines = inputs.document_lines(t).withColumnRenamed("doc_id", "path")
    marks = t.labels.select(
        F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, 2).otherwise(1 << 40).alias("lines_read"))
    return files.unread_lines(lines, marks).select(F.col("path").alias("doc_id"), "line_number")


@query(
    "src_appended_lines",
    f"SELECT doc_id, count(*) AS lines, doc_id % 2 AS pass FROM ({LINES_SQL}) GROUP BY doc_id",
)
def src_appended_lines(t):
    """Lines that a folder of files has got since the last pass, each read once by byte ranges."""
    base = scratch_path(t.spark, "appended")
    marked = inputs.document_lines(t).select("doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "line").alias("value"))
    for part in (0, 1):
        marked.filter(F.col("doc_id") % 2 == part).select("value").write.mode("append").text(f"{base}/in")
        lines = ranges.appended_lines(t.spark, f"{base}/in", "part-*", 1 << 20)
        drain(lines.withColumn("pass", F.lit(part)).writeStream.format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/checkpoint"))
    out = t.spark.read.schema("file string, position bigint, line string, pass int").parquet(f"{base}/out")
    doc = F.split_part("line", F.lit("|"), F.lit(1)).cast("long")
    return out.groupBy(doc.alias("doc_id"), F.col("pass").cast("long").alias("pass")).agg(F.count("*").alias("lines"))


@query(
    "src_rest_push",
    """SELECT o_orderkey, o_orderstatus, topic FROM (
      SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'urgent' ELSE 'raw' END AS topic FROM orders
      UNION ALL SELECT o_orderkey, 'copy', 'raw' FROM orders WHERE o_orderkey % 2 = 0)""",
)
def src_rest_push(t):
    """One object or an array of objects; ``sendtotopic`` picks the topic; scalars are dropped."""
    one = F.to_json(F.struct(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "urgent").alias("sendtotopic")))
    copy = F.to_json(F.struct("o_orderkey", F.lit("copy").alias("o_orderstatus")))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), one, F.lit(","), copy, F.lit(",7]"))).otherwise(one)
    out = landing.pushed(t.orders.select(body.alias("body")), "body", "raw")
    return out.select(
        json_get(F.col("value"), "o_orderkey").cast("long").alias("o_orderkey"),
        json_get(F.col("value"), "o_orderstatus").alias("o_orderstatus"), "topic")


@query(
    "src_rpc_push",
    """SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'empty' END AS reason FROM events""",
)
def src_rpc_push(t):
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat("props", F.lit("}"))).otherwise(F.lit(" "))
    return landing.checked(t.events.select("event_id", text.alias("message")), "message").select("event_id", "reason")


def _responses(t, system: str):
    """Events as responses of a system: an object, a text-encoded object, a number and bad text."""
    record = F.to_json(F.struct("event_id", "value"))
    quoted = F.concat(F.lit('"'), F.replace(record, F.lit('"'), F.lit('\\"')), F.lit('"'))
    key = {"kafka": "value", "rabbitmq": "payload", "elasticsearch": "_source"}.get(system)

    def item(value):
        return F.concat(F.lit(f'{{"{key}":'), value, F.lit("}")) if key else value

    items = F.concat_ws(",", *[item(v) for v in (record, quoted, F.lit("12"), F.lit('"no json"'))])
    listed = F.concat(F.lit("["), items, F.lit("]"))
    wrap = {
        "redis": ('{"lrange":', "}"), "splunk": ('{"results":', "}"), "clickhouse": ('{"meta":[],"data":', "}"),
        "elasticsearch": ('{"took":3,"hits":{"total":1,"hits":', "}}"),
    }.get(system, ("", ""))
    whole = F.concat(F.lit(wrap[0]), listed, F.lit(wrap[1]))
    if system in ("scada", "influxdb", "logstash"):
        whole = F.when(F.col("event_id") % 2 == 0, record).otherwise(whole)
    return spread(t.events.select("event_id", "value")).select(whole.alias("response"))


def _pull_query(system: str) -> None:
    def run(t):
        out = landing.pulled_from(system, _responses(t, system), "response", command="lrange")
        return out.select(
            json_get(F.col("value"), "event_id").cast("long").alias("event_id"),
            json_get(F.col("value"), "value").cast("double").alias("value"))

    twice = "event_id % 2 = 1" if system in ("scada", "influxdb", "logstash") else "true"
    register(
        f"src_pull_{system}",
        run,
        f"SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE {twice}",
    )


for _system in landing.SYSTEM_PATHS:
    _pull_query(_system)


def event_topics(t):
    """Events as a topic table."""
    return t.events.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"),
        F.col("props").alias("value"), F.col("ts").alias("timestamp"))


@query(
    "src_last_records",
    """SELECT event_type AS topic, event_id AS "offset" FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id DESC) <= 100""",
)
def src_last_records(t):
    return landing.last_records(event_topics(t), 100).select("topic", "offset")


@query(
    "src_topic_results",
    """SELECT event_type AS topic, count(*) AS records, string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id)
      AS reads FROM (SELECT * FROM events WHERE event_type IN ('click', 'view')
      QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200) GROUP BY event_type""",
)
def src_topic_results(t):
    """One read envelope per topic with its newest 200 records, opened again."""
    docs = landing.topic_results(event_topics(t), ["click", "view"], 200)
    reads = F.from_json(json_get(F.col("document"), "StreamTopicDetails.TopicReads"), "array<struct<k:string>>")
    return docs.select("topic", "records", F.array_join(F.transform(reads, lambda r: r["k"]), ",").alias("reads"))


@query(
    "src_read_envelope",
    "SELECT event_id, event_type, value FROM events",
)
def src_read_envelope(t):
    """Records of envelopes in both spellings."""
    record = F.to_json(F.struct("event_id", "event_type", "value"))
    upper = F.concat(F.lit('{"StreamTopicDetails":{"TopicReads":['), record, F.lit("]}}"))
    lower = F.concat(F.lit('{"streamtopicdetails":{"topicreads":['), record, F.lit("]}}"))
    docs = t.events.select(F.when(F.col("event_id") % 2 == 0, upper).otherwise(lower).alias("document"))
    parsed = F.from_json("record", "event_id bigint, event_type string, value double")
    return landing.topic_reads(docs, "document").select(parsed.alias("r")).select("r.*")


@query(
    "src_devices",
    """SELECT s_suppkey::VARCHAR AS dsn, s_name AS identifier, 'n' || s_nationkey AS lat, 'e' || s_acctbal AS long
    FROM supplier""",
)
def src_devices(t):
    path = scratch_path(t.spark, "devices")
    t.supplier.select(
        "s_suppkey", F.lit("oem"), "s_name", F.lit("1"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
        F.concat(F.lit("E"), F.col("s_acctbal").cast("string"))).write.csv(path)
    return files.devices(t.spark, path).select("dsn", "identifier", "lat", "long")


@query("src_tactic_matrix", "SELECT DISTINCT p_type AS tactic, p_name AS technique FROM part")
def src_tactic_matrix(t):
    """JSON maps of lists, here one small document per part."""
    docs = t.part.select(F.to_json(F.create_map("p_type", F.array("p_name"))).alias("value"))
    return files.matrix_rows(docs).distinct()


@query(
    "src_rule_maps",
    """SELECT p_partkey, 0 AS ord, p_brand AS name, p_name AS pattern, p_type AS tactic FROM part
    UNION ALL SELECT p_partkey, 1, 'second', 'x', 'y' FROM part""",
)
def src_rule_maps(t):
    """JSON maps of rules keep their declared order."""
    first = F.struct(F.col("p_name").alias("pattern"), F.col("p_type").alias("mitre_tactic"),
                     F.col("p_partkey").cast("string").alias("mitre_technique"))
    second = F.struct(F.lit("x").alias("pattern"), F.lit("y").alias("mitre_tactic"),
                      F.col("p_partkey").cast("string").alias("mitre_technique"))
    docs = t.part.select(F.to_json(F.create_map("p_brand", first, F.lit("second"), second)).alias("value"))
    return files.rule_rows(docs).select(
        F.col("technique").cast("long").alias("p_partkey"), "ord", "name", "pattern", "tactic")


@query(
    "src_weight_maps",
    """SELECT 'attack_complexity_weights' AS part, 0 AS ord, s_name AS keyword, s_acctbal AS weight FROM supplier
    UNION ALL SELECT 'attack_complexity_weights', 1, 'a', 2.5 FROM supplier
    UNION ALL SELECT 'fallbacks', 0, 'default_a_w', s_nationkey FROM supplier""",
)
def src_weight_maps(t):
    """Weight profiles keep the declared order of their keywords; a missing map gives no rows."""
    doc = F.struct(
        F.create_map("s_name", "s_acctbal", F.lit("a"), F.lit(2.5)).alias("attack_complexity_weights"),
        F.create_map(F.lit("default_a_w"), F.col("s_nationkey").cast("double")).alias("fallbacks"))
    return files.weight_rows(t.supplier.select(F.to_json(doc).alias("value")))


@query(
    "src_term_files",
    """WITH l AS (SELECT trim(line) AS line, i FROM (SELECT unnest(x) AS line, generate_subscripts(x, 1) AS i
      FROM (SELECT string_split(text, chr(10)) AS x FROM benchmark)) WHERE trim(line) <> '')
    SELECT DISTINCT CASE WHEN i = 1 THEN 'plain' WHEN i = 2 THEN 'regex' ELSE 'group' END AS kind,
      CASE WHEN i = 1 THEN replace(line, ',', ' ') ELSE line END AS term, true AS every FROM l""",
)
def src_term_files(t):
    """Plain, ``rgx:`` and ``~~~`` lines of a term folder marked as AND."""
    path = scratch_path(t.spark, "terms")
    lines = t.benchmark.select(F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.trim("line") != "")
    marked = F.concat(F.when(F.col("i") == 0, "").when(F.col("i") == 1, "rgx:").otherwise("~~~"), F.trim("line"))
    lines.select(marked.alias("value")).write.text(path)
    return files.term_files(t.spark, [f"@{path}"]).select("kind", F.trim("term").alias("term"), "every")


@query(
    "src_inventory",
    """SELECT 'text' AS kind, count(DISTINCT source) AS folders FROM documents
    UNION ALL SELECT 'binary', count(DISTINCT lang) FROM documents""",
)
def src_inventory(t):
    """Text and binary files of a document folder."""
    path = scratch_path(t.spark, "documents")
    t.documents.select("source", "text").write.partitionBy("source").text(f"{path}/a")
    t.documents.select("lang", "doc_id").write.partitionBy("lang").parquet(f"{path}/b")
    found = files.inventory(t.spark, path).filter(F.col("length") > 0)
    folder = F.regexp_extract("path", r"/([^/]+=[^/]+)/[^/]+$", 1)
    return found.groupBy("kind").agg(F.countDistinct(folder).alias("folders"))


# ---- sinks ------------------------------------------------------------------


@query(
    "snk_topic_records",
    """SELECT event_type AS topic, event_id::VARCHAR AS key, event_id, value, 'readings' AS identifier, 7 AS topicid
    FROM events""",
)
def snk_topic_records(t):
    """Rows produced as JSON to a topic table and read back."""
    path = scratch_path(t.spark, "topics")
    rows = sinks.topic_records(
        t.events, F.col("event_type"), F.col("event_id"), "readings", 7, columns=["event_id", "value"])
    sinks.append_topic(rows, path)
    back = t.spark.read.schema("key string, value string, topic string").parquet(path)
    parsed = F.from_json("value", "event_id bigint, value double, identifier string, topicid int")
    return back.select("topic", "key", parsed.alias("v")).select("topic", "key", "v.*")


@query(
    "snk_fan_out",
    """SELECT target, status, n FROM (SELECT 'csv' AS target, 'ok' AS status, count(*) AS n FROM nation
      UNION ALL SELECT 'json', 'ok', count(*) FROM nation UNION ALL SELECT 'broken', 'failed', NULL)""",
)
def snk_fan_out(t):
    """One result to several targets; the failing one does not stop the others."""
    path = scratch_path(t.spark, "fan")
    status = sinks.fan_out(t.nation, {
        "csv": lambda df: sinks.export(df, f"{path}/csv", "csv"),
        "broken": lambda df: sinks.export(df, f"{path}/x", "unknown"),
        "json": lambda df: sinks.export(df, f"{path}/json", "json"),
    })
    counts = t.spark.read.option("header", True).csv(f"{path}/csv").agg(F.count("*").alias("n")).withColumn(
        "target", F.lit("csv")).unionByName(t.spark.read.schema(t.nation.schema).json(f"{path}/json").agg(
            F.count("*").alias("n")).withColumn("target", F.lit("json")))
    return status.join(counts, "target", "left").select("target", "status", "n")


# The constant parts of the data-exchange envelope.
EXCHANGE_KIND = "dataset--data:opendes:dataset--Well:1.0"
EXCHANGE_ACL = {"viewers": ["data.default.viewers@[default]"], "owners": ["data.default.owners@[default]"]}
EXCHANGE_LEGAL = {
    "legaltags": ["data.default.legaltag@[default]"], "otherRelevantDataCountries": ["US", "CA"], "hostingCountry": "US",
}
EXCHANGE_TYPE = "OilAndGas:SeparatorRealtime"
EXCHANGE_DOMAIN = {"type": "WellProduction", "subType": "SeparatorAnalytics"}
EXCHANGE_PRECISION = {"RawFields": "3 decimal places", "ComputedAnalytics": "full precision"}


@query(
    "snk_exchange_envelope",
    f"""SELECT l_orderkey, l_linenumber, '{EXCHANGE_KIND}' AS kind, 'US' AS hosting, 'CA' AS second_country,
      'vessel-' || l_suppkey || '-' || (epoch_us(l_shipdate) // 1000000) AS id,
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS acquired,
      CASE WHEN l_suppkey = 1 THEN 'North_Drum_1' ELSE 'Vessel_' || l_suppkey END AS well,
      l_quantity AS quantity, 8 AS computed, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS modified, '1.0.0' AS osd,
      'SeparatorAnalytics' AS sub_domain, {len(FIELDS)} AS raw_fields, true AS scaled, '1.0' AS version, 8 AS listed,
      'full precision' AS precision, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS computed_at FROM lineitem""",
)
def snk_exchange_envelope(t):
    """Nested envelope of every reading, read back field by field."""
    doc = scada.exchange_record(
        derived(t), F.col("l_suppkey"), {"1": "North Drum 1"}, F.lit("SCADA"), F.col("l_shipdate"), EXCHANGE_KIND,
        EXCHANGE_ACL, EXCHANGE_LEGAL, EXCHANGE_TYPE, len(FIELDS), bool(SCALING), EXCHANGE_DOMAIN, EXCHANGE_PRECISION)
    rows = derived(t).select("l_orderkey", "l_linenumber", doc.alias("doc"))
    schema = (
        "kind string, legal struct<hostingCountry:string,otherRelevantDataCountries:array<string>>, data struct<ID:string,"
        "AcquisitionTime:string,WellUWI:string,SeparatorMetrics:struct<RawFields:map<string,double>,"
        "meta:struct<numComputedVars:int,version:string,computedAt:string,scalingApplied:boolean,numRawFields:int,"
        "computedVarList:array<string>,precision:struct<ComputedAnalytics:string>>>>,"
        "meta struct<osdVersion:string,modificationTime:string,domain:struct<subType:string>>")
    parsed = rows.select("l_orderkey", "l_linenumber", F.from_json("doc", schema).alias("d"))
    return parsed.select(
        "l_orderkey", "l_linenumber", "d.kind", F.col("d.legal.hostingCountry").alias("hosting"),
        F.col("d.legal.otherRelevantDataCountries")[1].alias("second_country"), F.col("d.data.ID").alias("id"),
        F.col("d.data.AcquisitionTime").alias("acquired"), F.col("d.data.WellUWI").alias("well"),
        F.col("d.data.SeparatorMetrics.RawFields")["quantity"].alias("quantity"),
        F.col("d.data.SeparatorMetrics.meta.numComputedVars").alias("computed"),
        F.col("d.meta.modificationTime").alias("modified"), F.col("d.meta.osdVersion").alias("osd"),
        F.col("d.meta.domain.subType").alias("sub_domain"), F.col("d.data.SeparatorMetrics.meta.numRawFields").alias("raw_fields"),
        F.col("d.data.SeparatorMetrics.meta.scalingApplied").alias("scaled"),
        F.col("d.data.SeparatorMetrics.meta.version").alias("version"),
        F.size("d.data.SeparatorMetrics.meta.computedVarList").alias("listed"),
        F.col("d.data.SeparatorMetrics.meta.precision.ComputedAnalytics").alias("precision"),
        F.col("d.data.SeparatorMetrics.meta.computedAt").alias("computed_at"))


def _export_query(kind: str) -> None:
    def run(t):
        path = scratch_path(t.spark, "export")
        sinks.export(t.supplier, path, kind)
        reader = t.spark.read.schema(t.supplier.schema)
        return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)

    register(f"snk_export_{kind}", run, "SELECT * FROM supplier")


for _kind in ("csv", "json"):
    _export_query(_kind)


@query(
    "snk_by_entity",
    """SELECT l_suppkey AS entity, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem
    GROUP BY l_suppkey""",
)
def snk_by_entity(t):
    """Models kept in one folder per entity."""
    path = scratch_path(t.spark, "models")
    models = ml.fit_linear(t.lineitem.withColumnRenamed("l_suppkey", "entity"), ["entity"], "l_extendedprice",
                           ["l_quantity"])
    sinks.by_entity(models, path)
    back = t.spark.read.schema("coefficients array<double>, n bigint, entity bigint").parquet(path)
    return back.select("entity", F.round(F.col("coefficients")[1], 4).alias("slope"))


@query(
    "snk_baseline_state",
    """WITH a AS (SELECT event_type, round_even(count(*) / (SELECT count(*) FROM events), 4) AS share FROM events
      GROUP BY event_type),
    b AS (SELECT event_type, round_even(count(*) / (SELECT count(*) FROM events WHERE value > 50), 4) AS share
      FROM events WHERE value > 50 GROUP BY event_type)
    SELECT 'start' AS step, event_type, share FROM a UNION ALL SELECT 'young', event_type, share FROM a
    UNION ALL SELECT 'due', event_type, share FROM b""",
)
def snk_baseline_state(t):
    """The stored baseline is kept while young and replaced when due."""
    first = threat.distribution(t.events, "event_type")
    second = threat.distribution(t.events.filter("value > 50"), "event_type")
    path = scratch_path(t.spark, "baseline")
    start = sinks.next_baseline(sinks.load_baseline(t.spark, f"{path}/0"), first, "2024-03-01 00:00:00", 24)
    start.write.parquet(f"{path}/0")
    stored = sinks.load_baseline(t.spark, f"{path}/0")
    young = sinks.next_baseline(stored, second, "2024-03-01 23:00:00", 24)
    due = sinks.next_baseline(stored, second, "2024-03-02 00:00:00", 24)
    steps = [stored.withColumn("step", F.lit("start")), young.withColumn("step", F.lit("young")),
             due.withColumn("step", F.lit("due"))]
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).select("step", "event_type", "share")


@query(
    "snk_by_file",
    "SELECT source AS file, doc_id, n_chars FROM documents",
)
def snk_by_file(t):
    """Enriched JSON lines back per source file."""
    path = scratch_path(t.spark, "by-file")
    rows = t.documents.select(F.col("source").alias("file"), F.to_json(F.struct("doc_id", "n_chars")).alias("value"))
    sinks.by_file(rows, path, "file", "value")
    back = t.spark.read.schema("value string, file string").text(path)
    parsed = F.from_json("value", "doc_id bigint, n_chars bigint")
    return back.select("file", parsed.alias("d")).select("file", "d.*")


@query(
    "snk_coefficients_topic",
    """SELECT 'coefficients' AS topic, l_suppkey::VARCHAR AS key, 'slope' AS name,
      round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem GROUP BY l_suppkey""",
)
def snk_coefficients_topic(t):
    """A named coefficient of every entity's model on its own topic."""
    models = ml.fit_linear(t.lineitem, ["l_suppkey"], "l_extendedprice", ["l_quantity"])
    named = ml.named_coefficients(models, ["l_suppkey"], {1: "slope"})
    rows = sinks.topic_records(named, F.lit("coefficients"), F.col("l_suppkey"))
    parsed = F.from_json("value", "name string, value double")
    out = rows.select("topic", "key", parsed.alias("v")).select("topic", "key", "v.*")
    return out.withColumn("value", F.round("value", 4))


@query(
    "snk_stage_log",
    """SELECT event_id, 'INFO' AS level, strftime(ts, '%Y-%m-%d_%H:%M:%S') AS time, 'preprocess' AS service,
      'read ' || event_type AS message FROM events""",
)
def snk_stage_log(t):
    record = sinks.log_record("INFO", "preprocess", F.col("ts"), F.concat(F.lit("read "), "event_type"))
    return t.events.select("event_id", record.alias("r")).select("event_id", "r.*")
