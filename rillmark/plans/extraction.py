"""Queries for projections and extraction from nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json_object, json_elements, json_get
from rillmark.functions.text import clean_answer, clean_for_ingest, tilde_head, tilde_uid
from rillmark.operators import extract as ex
from rillmark.operators import prompts, scada, stats
from rillmark.plans import inputs
from rillmark.plans.inputs import LINES_SQL, PREPROCESSED_SQL, SHIPMENT_SQL, WINDOW_SQL
from rillmark.plans.registry import query
from rillmark.session import spread

_LONG = ("entity", "subtopic", "value_num", "identifier", "msgid", "lat", "lon")


@query(
    "prj_criteria_extract",
    """SELECT 'u' || user_id AS entity, event_type AS subtopic, value AS value_num,
      event_type || ' meter' AS identifier, event_id::VARCHAR AS msgid, epoch_us(ts) // 1000000 AS unix,
      CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS lat,
      user_id::DOUBLE AS lon FROM events""",
)
def prj_criteria_extract(t):
    out = ex.extract(inputs.iot_records(t), "payload", ex.parse_criteria(inputs.IOT_CRITERIA))
    return out.select(*_LONG, F.unix_seconds("event_time").alias("unix"))


_OBS_SQL = """SELECT 'Patient/' || l_suppkey AS entity, subtopic, value_num, subtopic || ' text' AS identifier,
  l_orderkey || ':' || l_linenumber AS msgid
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, 'disc' AS subtopic, l_discount AS value_num FROM lineitem
      WHERE l_linestatus = 'F'
      UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem
      WHERE l_linestatus = 'F' AND l_tax > 0)"""


@query("prj_array_path_record_filter", _OBS_SQL)
def prj_array_path_record_filter(t):
    """Array-indexed paths, a record filter and a message id joined from two fields."""
    out = ex.extract(inputs.observations(t), "payload", ex.parse_criteria(inputs.OBSERVATION_CRITERIA))
    return out.select("entity", "subtopic", "value_num", "identifier", "msgid")


@query("prj_double_encoded_payload", _OBS_SQL)
def prj_double_encoded_payload(t):
    """The observation document travels as JSON text inside a JSON document."""
    wrapped = inputs.observations(t).select(
        F.to_json(F.struct(F.struct(F.col("payload").alias("payload")).alias("payload"))).alias("payload"))
    spec = inputs.OBSERVATION_CRITERIA.replace("=Observation~", "=Observation,payload=payload.payload~")
    out = ex.extract(wrapped, "payload", ex.parse_criteria(spec))
    return out.select("entity", "subtopic", "value_num", "identifier", "msgid")


@query(
    "prj_positional_unpivot",
    """WITH h AS (SELECT *, o_orderstatus = 'F' AS bad FROM orders)
    SELECT o_orderkey, 'host' || o_custkey AS entity, 'inboundpackets' AS identifier,
      (CASE WHEN bad THEN 0 ELSE o_orderkey END)::DOUBLE AS value_num,
      (CASE WHEN bad THEN 0 ELSE o_orderkey END)::VARCHAR AS value_str FROM h
    UNION ALL SELECT o_orderkey, 'host' || o_custkey, 'outboundpackets',
      (CASE WHEN bad THEN 0 ELSE o_custkey END)::DOUBLE, (CASE WHEN bad THEN 0 ELSE o_custkey END)::VARCHAR FROM h
    UNION ALL SELECT o_orderkey, 'host' || o_custkey, 'pingStatus', NULL,
      CASE WHEN bad THEN 'FAILURE' ELSE 'SUCCESS' END FROM h""",
)
def prj_positional_unpivot(t):
    spec = ex.parse_criteria(inputs.HOST_CRITERIA)
    out = ex.extract(inputs.hosts(t), "payload", spec, keep=("o_orderkey",))
    return out.select("o_orderkey", "entity", "identifier", "value_num", "value_str")


@query(
    "prj_static_attributes",
    """SELECT 'u' || user_id AS entity, 'M' || (user_id % 4) AS oem, 'n/a' AS location,
      CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') ELSE 'n/a' END AS lat_text,
      event_id::VARCHAR AS msgid FROM events""",
)
def prj_static_attributes(t):
    attributes = ex.parse_attributes("oem=metadata.oem_model,lat_text=lat,location=n/a")
    out = ex.extract(inputs.iot_records(t), "payload", ex.parse_criteria(inputs.IOT_CRITERIA), attributes)
    return out.select("entity", "oem", "lat_text", "location", "msgid")


@query(
    "prj_identifier_parts",
    "SELECT event_id, event_type AS variable, 'u' || user_id AS uid FROM events",
)
def prj_identifier_parts(t):
    return inputs.preprocessed(t).select(
        "event_id", tilde_head(F.col("identifier")).alias("variable"), tilde_uid(F.col("identifier")).alias("uid"))


@query(
    "prj_stream_name",
    """SELECT DISTINCT 'topicid8_' || event_type || '_preprocessed_' || t AS stream
    FROM events, (SELECT unnest(['AnomProb', 'Avg', 'Trend', 'IQR']) AS t)""",
)
def prj_stream_name(t):
    names = F.array(*[stats.stream_name(8, F.col("event_type"), k) for k in ("anomprob", "avg", "trend", "IQR")])
    return t.events.select(F.explode(names).alias("stream")).distinct()


@query(
    "prj_walk_path",
    """SELECT event_id, event_type AS name, NULL::VARCHAR AS past_scalar, NULL::VARCHAR AS absent,
      value AS found FROM events""",
)
def prj_walk_path(t):
    doc = F.col("payload")
    return inputs.iot_records(t).select(
        "event_id",
        ex.walk(doc, ["metadata", "property_name"]).alias("name"),
        ex.walk(doc, ["metadata", "property_name", "deeper"]).alias("past_scalar"),
        ex.walk(doc, ["nothing"]).alias("absent"),
        ex.walk(doc, ["datapoint", "value"]).cast("double").alias("found"),
    )


@query(
    "prj_keep_json_objects",
    "SELECT event_id, event_id % 5 AS shape FROM events WHERE event_id % 5 < 2",
)
def prj_keep_json_objects(t):
    """Objects and text-encoded objects stay; arrays, scalars and bad text go."""
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.col("props"))
        .when(shape == 1, F.to_json(F.array(F.col("props"))))
        .when(shape == 2, F.concat(F.lit("[["), F.col("props"), F.lit("]]")))
        .when(shape == 3, F.col("value").cast("string"))
        .otherwise(F.substring("props", 1, 4))
    )
    rows = t.events.select("event_id", shape.alias("shape"), F.explode(json_elements(text)).alias("item"))
    return rows.filter(is_json_object(F.col("item"))).select("event_id", "shape")


FIELDS = ["quantity", "price", "discount", "tax", "spare"]
SCALING = {"price": 1000, "discount": 100, "tax": 100}
VARIABLES = (
    "total = price * quantity, net = total * (1 - discount), share = tax / discount, root = quantity ** 0.5,"
    "late = later + 1, later = quantity - 1, odd = (discount - tax) ** 0.5, nothing = spare / (tax - tax)"
)


def readings(t):
    """Line items as register readings; a zero register is not reported."""
    registers = F.array(
        "l_quantity", F.round("l_extendedprice").alias("p"), F.round(F.col("l_discount") * 100),
        F.round(F.col("l_tax") * 100), F.lit(0.0), F.col("l_linenumber").cast("double"),
    ).cast("array<int>")
    return spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", registers.alias("registers")))


def derived(t):
    rows = readings(t)
    return scada.derive(rows, scada.from_registers(F.col("registers"), FIELDS), SCALING, VARIABLES)


_READ_SQL = """SELECT *, round(l_extendedprice) / 1000 AS price, round(l_discount * 100) / 100 AS disc,
  round(l_tax * 100) / 100 AS tax, l_quantity AS q FROM lineitem"""


@query(
    "src_register_fields",
    """SELECT l_orderkey, l_linenumber, f AS field, v AS value FROM (
      SELECT l_orderkey, l_linenumber, unnest(['quantity', 'price', 'discount', 'tax', 'spare', 'reg_0006']) AS f,
        unnest([l_quantity, round(l_extendedprice), round(l_discount * 100), round(l_tax * 100), 0.0::DOUBLE,
          l_linenumber::DOUBLE]) AS v FROM lineitem) WHERE v <> 0""",
)
def src_register_fields(t):
    return scada.register_rows(readings(t), "registers", FIELDS, ("l_orderkey", "l_linenumber"))


@query(
    "prj_scale_fields",
    f"SELECT l_orderkey, l_linenumber, q, round(price, 6) AS price, round(disc, 6) AS disc FROM ({_READ_SQL})",
)
def prj_scale_fields(t):
    rows = readings(t).withColumn("readings", scada.register_fields(F.col("registers"), FIELDS))
    scaled = scada.scale(scada.from_map(F.col("readings"), FIELDS), SCALING)
    return rows.select(
        "l_orderkey", "l_linenumber", scaled["quantity"].alias("q"), F.round(scaled["price"], 6).alias("price"),
        F.round(scaled["discount"], 6).alias("disc"))


@query(
    "prj_create_variables",
    f"""SELECT l_orderkey, l_linenumber, round(price * q + 1e-7, 4) AS total,
      round(price * q * (1 - disc) + 1e-7, 4) AS net,
      round(coalesce(tax / nullif(disc, 0), 0), 6) AS share, round(sqrt(q), 6) AS root, 0.0::DOUBLE AS late,
      q - 1 AS later, round(CASE WHEN disc >= tax THEN sqrt(disc - tax) ELSE 0 END, 6) AS odd,
      0.0::DOUBLE AS nothing FROM ({_READ_SQL})""",
)
def prj_create_variables(t):
    v = F.col("computed_analytics")
    return derived(t).select(
        "l_orderkey", "l_linenumber", *[inputs.settle(v[n], 4).alias(n) for n in ("total", "net")],
        *[F.round(v[n], 6).alias(n) for n in ("share", "root", "late", "later", "odd", "nothing")])


@query(
    "prj_rounded_fields",
    f"""SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS price, round(l_discount * 100) AS discount,
      round_even(sqrt(q), 6) AS root, 13 AS fields FROM ({_READ_SQL})""",
)
def prj_rounded_fields(t):
    raw = F.col("raw_fields")
    return derived(t).select(
        "l_orderkey", "l_linenumber", raw["price"].alias("price"), raw["discount"].alias("discount"),
        raw["root"].alias("root"), F.size(raw).alias("fields"))


@query(
    "prj_vessel_name",
    """SELECT s_suppkey, CASE s_suppkey WHEN 1 THEN 'North_Drum_1' WHEN 2 THEN 'Holding_Basin_2'
      ELSE 'Vessel_' || s_suppkey END AS name FROM supplier""",
)
def prj_vessel_name(t):
    names = {"1": "North Drum 1", "2": "Holding Basin 2"}
    return t.supplier.select("s_suppkey", ex.rename_vessel(F.col("s_suppkey"), names).alias("name"))


@query(
    "prj_normalise_prediction",
    f"""SELECT event_id, CASE event_id % 2 WHEN 0 THEN round_even(hyperprediction, 0)
        ELSE round_even(hyperprediction * 100, 0) END::BIGINT AS hp,
      CASE WHEN event_id % 4 IN (1, 3) THEN 'probability prediction' WHEN event_id % 4 = 0 THEN 'prediction'
        ELSE preprocesstype END AS pt,
      CASE WHEN event_id % 4 = 2 THEN variable ELSE 'machine learning' END AS pv, 'u' || user_id AS uid
    FROM ({PREPROCESSED_SQL})""",
)
def prj_normalise_prediction(t):
    kind = F.col("event_id") % 4
    rows = inputs.preprocessed(t).withColumn(
        "islogistic", F.when(kind.isin(1, 3), "1").when(kind == 0, "0"))
    return ex.normalise_prediction(rows).select("event_id", "hp", "pt", "pv", "uid")


def _mixed_records(t):
    """Events as the four kinds of result record."""
    key = F.concat(F.lit("k"), F.col("event_id").cast("string"))
    kind = F.col("event_id") % 4
    value, topic = F.col("value"), F.col("event_type")
    risk = F.to_json(F.struct(
        F.struct(value.alias("Riskscore")).alias("Riskresults"), topic.alias("Producedto"), key.alias("Kafkakey"),
        F.col("event_id").alias("Offset")))
    pred = F.to_json(F.struct(
        value.alias("Hyperprediction"), topic.alias("Produceto"), key.alias("kafkakey"),
        F.col("event_id").alias("Offset")))
    best = F.to_json(F.struct(
        F.struct(value.alias("ObjectiveFunctionValue")).alias("OptimizedValues"),
        F.struct(topic.alias("Produceto"), key.alias("kafkakey")).alias("AdditionDetails"),
        F.col("event_id").alias("Offset")))
    pre = F.to_json(F.struct(
        value.alias("hyperprediction"), topic.alias("Topic"),
        F.when(F.col("event_id") % 8 == 3, "").otherwise(key).alias("kafkakey"), F.col("event_id").alias("Offset")))
    return t.events.select(
        F.when(kind == 0, risk).when(kind == 1, pred).when(kind == 2, best).otherwise(pre).alias("record"))


@query(
    "prj_common_shape",
    """SELECT CASE event_id % 4 WHEN 0 THEN 'risk' WHEN 1 THEN 'prediction' WHEN 2 THEN 'optimisation'
        ELSE 'preprocessed' END AS kind, event_type AS topic, value AS prediction, 'k' || event_id AS kafkakey,
      event_id::VARCHAR AS "offset" FROM events WHERE event_id % 8 <> 3""",
)
def prj_common_shape(t):
    out = ex.common_shape(_mixed_records(t), "record")
    return out.select("kind", "topic", F.col("prediction").cast("double").alias("prediction"), "kafkakey", "offset")


@query(
    "prj_raw_data",
    f"""SELECT entity, subtopic, array_to_string(list(x ORDER BY k), ',') AS rawdata
    FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def prj_raw_data(t):
    out = stats.raw_data(inputs.measurements(t))
    text = F.transform("rawdata", lambda v: v.cast("string"))
    return out.select("entity", "subtopic", F.array_join(text, ",").alias("rawdata"))


@query(
    "prj_clean_for_ingest",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '["'']', '', 'g'),
      '\\n|\\r|[\n\r;&]', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' +', ' ', 'g')) AS digest FROM documents""",
)
def prj_clean_for_ingest(t):
    return t.documents.select("doc_id", F.md5(clean_for_ingest(F.col("text"))).alias("digest"))


_ANSWER = "text"
for _old, _new in (
    ("\"", ""), ("''", ""), ("`", ""), ("chr(10)", ""), ("\\n", ""), ("chr(9)", ""), ("\\t", ""), ("chr(13)", ""),
    ("\\r", ""), ("\\*", ""), ("\\ ", ""), ("\\\\", "\\"),
):
    _ANSWER = f"replace({_ANSWER}, {_old if _old.startswith('chr') else chr(39) + _old + chr(39)}, '{_new}')"
_ANSWER = rf"regexp_replace({_ANSWER}, '\\([1-9])', '\1', 'g')"
_ANSWER = rf"regexp_replace(lower({_ANSWER}), '\\([a-z\-*1-9''{{}}`])', '\1', 'g')"


@query("prj_clean_answer", f"SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations")
def prj_clean_answer(t):
    return t.conversations.select("conv_id", "turn", clean_answer(F.col("text")).alias("answer"))


@query(
    "prj_validate_json",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'patched' WHEN 2 THEN 'patched'
      ELSE 'rejected' END AS status,
      CASE event_id % 4 WHEN 0 THEN '{"Response": "' || event_type || '"}'
        WHEN 1 THEN '{"Response": "' || event_type || '","Model": "m1","Embedding":"e1", "Temperature":"0.1"}'
        WHEN 2 THEN '{"Response": "' || event_type || '","Model": "m1","Embedding":"e1", "Temperature":"0.1"}' END
        AS text FROM events""",
)
def prj_validate_json(t):
    """Complete, cut, wrongly closed and hopeless answers."""
    head = F.concat(F.lit('{"Response": "'), F.col("event_type"))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(head, F.lit('"}'))).when(kind == 1, head).when(
        kind == 2, F.concat(head, F.lit("}"))).otherwise(F.concat(F.lit("} "), F.col("event_type")))
    fixed, status = prompts.check_json(text, "m1", "e1", "0.1")
    return t.events.select("event_id", status.alias("status"), F.when(status != "rejected", fixed).alias("text"))


@query(
    "prj_prompt_rows",
    f"""SELECT event_id, 'Device data.  Data: ' || hyperprediction || ' (Identifier=' || variable || '), .  Is '
      || variable || ' normal?' AS message FROM ({PREPROCESSED_SQL})
    WHERE preprocesstype IN ('Avg', 'AnomProb') AND (variable LIKE '%click%' OR variable LIKE '%view%')""",
)
def prj_prompt_rows(t):
    out = prompts.record_prompts(
        inputs.preprocessed(t), "hyperprediction", "Device data", "Is --identifier-- normal?", "AVG,anom", "Click,view")
    return out.select("event_id", "message")


@query(
    "prj_prompt_batch",
    f"""SELECT count(*) AS records, 'Device data.  Data: ' || string_agg(hyperprediction || ' (Identifier=' || variable
      || '), ', '' ORDER BY event_id) || '.  Summarise.' AS message
    FROM (SELECT * FROM ({PREPROCESSED_SQL}) ORDER BY event_id DESC LIMIT 200) WHERE preprocesstype = 'Trend'""",
)
def prj_prompt_batch(t):
    return prompts.batch_prompt(
        inputs.preprocessed(t), "hyperprediction", ["event_id"], "Device data", "Summarise.", 200, types="trend")


@query(
    "prj_prompt_raw_values",
    f"""SELECT entity, 'Packets.  Data: ' || string_agg(x, ', ' ORDER BY ts, msgid) || ', . Any change?' AS message
    FROM ({SHIPMENT_SQL.format(n=50)}) WHERE subtopic = 'R' GROUP BY entity""",
)
def prj_prompt_raw_values(t):
    raw = stats.raw_data(inputs.shipments(t), maxrows=50)
    rows = raw.withColumn("identifier", F.concat("subtopic", F.lit("flag~uid="), F.col("entity").cast("string")))
    values = rows.withColumn("rawdata", F.transform("rawdata", lambda v: v.cast("string")))
    return prompts.raw_prompts(values, "rawdata", "Packets", "Any change?", "rflag").select("entity", "message")


@query(
    "prj_prompt_budget",
    f"""WITH b AS (SELECT doc_id, line_number, trim(line[16:]) || '. ' AS body FROM ({LINES_SQL})),
    c AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY line_number
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(length(body)) OVER (PARTITION BY doc_id) AS whole FROM b)
    SELECT doc_id, 'Logs. Here are the messages: ' || string_agg(
      CASE WHEN whole > 300 THEN left(body, greatest(299 - before, 0)::BIGINT) ELSE body END, '' ORDER BY line_number)
      || '. Explain.' AS message FROM c WHERE whole <= 300 OR before < 299 GROUP BY doc_id""",
)
def prj_prompt_budget(t):
    return prompts.budget_prompts(
        inputs.document_lines(t), ["doc_id"], "line_number", "line", 300, "Logs", "Explain.")


@query(
    "srt_character_budget",
    f"""WITH c AS (SELECT doc_id, line_number, line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id
        ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(length(line)) OVER (PARTITION BY doc_id) AS whole FROM ({LINES_SQL}))
    SELECT doc_id, line_number, length(CASE WHEN whole > 500 THEN left(line, (499 - before)::BIGINT) ELSE line END) AS kept
    FROM c WHERE CASE WHEN whole > 500 THEN before < 499 ELSE length(line) > 0 END""",
)
def srt_character_budget(t):
    from rillmark.operators.windows import cut_at_budget

    out = cut_at_budget(inputs.document_lines(t), ["doc_id"], "line_number", "line", 500, "piece", chunk=16)
    return out.select("doc_id", "line_number", F.length("piece").cast("long").alias("kept"))


def agent_levels(t):
    """Conversation turns as agent, lead and supervisor records."""
    level = F.when(F.col("role") == "user", "agent").when(F.col("role") == "assistant", "lead").otherwise("supervisor")
    record = F.concat(F.lit('{"Agent_Name": "'), F.col("role"), F.lit('", "Turn": '), F.col("turn").cast("string"),
                      F.when(F.col("turn") % 5 == 4, F.lit("")).otherwise(F.lit("}")))
    return t.conversations.select("conv_id", "turn", level.alias("level"), record.alias("record"))


_FILL = '{"Status": "no data found", "Agent_Name": "%s", "Response": "%s", "Topic": "na"}'


@query(
    "prj_combine_agents",
    f"""WITH r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'agent' WHEN 'assistant' THEN 'lead'
        ELSE 'supervisor' END AS level,
      CASE WHEN turn % 5 <> 4 THEN '{{"Agent_Name": "' || role || '", "Turn": ' || turn || '}}' END AS record
      FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, level ORDER BY turn DESC) AS rn FROM r QUALIFY rn <= 20)
    SELECT conv_id, count(record) FILTER (WHERE level = 'agent') AS agents, '[' ||
      coalesce(string_agg(record, ',' ORDER BY turn) FILTER (WHERE level = 'agent'),
        '{_FILL % ("", "no data found")}') || ',' ||
      coalesce(max(record) FILTER (WHERE level = 'lead' AND rn = 1),
        '{_FILL % ("Team Lead agent", "no data found")}') || ',' ||
      coalesce(max(record) FILTER (WHERE level = 'supervisor' AND rn = 1),
        '{_FILL % ("Supervisor agent", prompts.SUPERVISOR_ERROR)}') || ']' AS document
    FROM n GROUP BY conv_id""",
)
def prj_combine_agents(t):
    return prompts.combine_agents(agent_levels(t), ["conv_id"], ["turn"], "record", 20)


@query(
    "prj_enriched_record",
    """SELECT event_id, s_name AS identifier, s_acctbal AS lat, s_nationkey::DOUBLE AS long, value
    FROM events JOIN supplier ON user_id = s_suppkey""",
)
def prj_enriched_record(t):
    """A JSON reading joined with the looked-up position of its device."""
    from rillmark.operators.joins import device_lookup

    devices = t.supplier.select(
        F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("dsn"), F.col("s_name").alias("identifier"),
        F.col("s_acctbal").alias("lat"), F.col("s_nationkey").cast("double").alias("long"),
        F.col("s_suppkey").alias("ord"))
    rows = inputs.iot_records(t).withColumn("dsn", json_get(F.col("payload"), "metadata.dsn"))
    joined = device_lookup(rows, devices, "dsn", "ord")
    record = F.to_json(F.struct(
        F.from_json("payload", "datapoint struct<value: double>").alias("reading"), "lat", "long", "identifier"))
    return joined.select("event_id", record.alias("record")).select(
        "event_id", json_get(F.col("record"), "identifier").alias("identifier"),
        json_get(F.col("record"), "lat").cast("double").alias("lat"),
        json_get(F.col("record"), "long").cast("double").alias("long"),
        json_get(F.col("record"), "reading.datapoint.value").cast("double").alias("value"))
