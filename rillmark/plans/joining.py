"""Queries for joins, window functions, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import joins, ml, prompts, scada, windows
from rillmark.plans import inputs
from rillmark.plans.inputs import LINES_SQL, WINDOW_SQL
from rillmark.plans.registry import query


@query(
    "jn_device_lookup",
    """SELECT event_id, min(c_name) AS identifier, arg_min(c_acctbal, c_custkey) AS lat
    FROM events JOIN customer ON user_id = c_nationkey GROUP BY event_id""",
)
def jn_device_lookup(t):
    """The lookup repeats keys: the first entry counts; unmatched readings are dropped."""
    devices = t.customer.select(
        F.col("c_nationkey").cast("long").alias("dsn"), F.col("c_name").alias("identifier"),
        F.col("c_acctbal").alias("lat"), F.col("c_custkey").alias("ord"))
    rows = t.events.select("event_id", F.col("user_id").alias("dsn"))
    return joins.device_lookup(rows, devices, "dsn", "ord").select("event_id", "identifier", "lat")


@query(
    "jn_streams_side_by_side",
    f"""SELECT entity, date_trunc('day', ts)::DATE::VARCHAR AS "window",
      round(avg(x) FILTER (WHERE subtopic = 'click'), 6) AS click,
      max(x) FILTER (WHERE subtopic = 'view') AS view FROM ({WINDOW_SQL})
    WHERE subtopic IN ('click', 'view') GROUP BY 1, 2""",
)
def jn_streams_side_by_side(t):
    out = joins.align_streams(
        inputs.measurements(t), {"click": "avg", "view": "max"}, bucket=F.date_format("ts", "yyyy-MM-dd"))
    return out.select("entity", "window", F.round("click", 6).alias("click"), "view")


@query(
    "jn_training_matrix",
    f"""WITH r AS (SELECT entity, subtopic, x, row_number() OVER (PARTITION BY entity, subtopic
      ORDER BY ts DESC, msgid DESC) AS idx FROM ({inputs.SHIPMENT_SQL.format(n=1000)})),
    w AS (SELECT entity, idx, max(x) FILTER (WHERE subtopic = 'A') AS a, max(x) FILTER (WHERE subtopic = 'N') AS n,
      max(x) FILTER (WHERE subtopic = 'R') AS r FROM r GROUP BY entity, idx),
    c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS rows FROM w
      WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL)
    SELECT entity, idx, a AS "A", n AS "N", r AS "R" FROM c WHERE rows >= 30""",
)
def jn_training_matrix(t):
    return joins.training_matrix(inputs.shipments(t), ["A", "N", "R"])


@query(
    "jn_asof",
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
    v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    j AS (SELECT c.event_id, c.ts, v.ts AS vts, v.value FROM c ASOF LEFT JOIN v
      ON c.user_id = v.user_id AND c.ts >= v.ts)
    SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(vts) <= 21600000000 THEN value END AS view_value FROM j""",
)
def jn_asof(t):
    clicks = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = t.events.filter("event_type = 'view'").select("user_id", "ts", "value")
    return joins.asof_join(clicks, views, ["user_id"], "ts", "value", 6 * 3600, "view_value").select(
        "event_id", "view_value")


@query(
    "jn_entity_mentions",
    f"""WITH e AS (SELECT DISTINCT unnest([regexp_extract(text, '^[^ ]+'), regexp_extract(text, '^[^ ]+ [^ ]+')]) AS word
      FROM conversations)
    SELECT doc_id, line_number, word FROM ({LINES_SQL}), e
    WHERE word <> '' AND contains(line, ' ' || word || ' ')""",
)
def jn_entity_mentions(t):
    """Lines holding " <entity> " for a word or a pair of words that the other stream begins with."""
    heads = F.array(F.regexp_extract("text", "^[^ ]+", 0), F.regexp_extract("text", "^[^ ]+ [^ ]+", 0))
    entities = t.conversations.select(F.explode(heads).alias("word"))
    out = joins.entity_mentions(inputs.document_lines(t), "line", entities, "word", " --entity-- ")
    return out.select("doc_id", "line_number", "word")


KNOWLEDGE = {
    "The": ["thereon", "ened", "of the"],
    "Der": ["einschtz", "von", "licher"],
    "License": ["MIT License", "Public License"],
    "Resource Use": ["token =", "MIT License", "la de"],
}
_KNOWN = """SELECT * FROM (VALUES (1, 'The', ['thereon', 'ened', 'of the']), (2, 'Der', ['einschtz', 'von', 'licher']),
  (3, 'License', ['MIT License', 'Public License']), (4, 'Resource Use', ['token =', 'MIT License', 'la de']))
  AS k(ord, tactic, techs)"""


@query(
    "jn_knowledge_match",
    f"""WITH l AS ({LINES_SQL}), k AS (SELECT tactic, unnest(techs) AS tech FROM ({_KNOWN})),
    m AS (SELECT doc_id, line_number, tactic, tech, contains(line, tactic) AS by_tactic, contains(line, tech) AS by_tech
      FROM l, k WHERE contains(line, tactic) OR contains(line, tech)),
    s AS (SELECT doc_id, line_number, bool_or(by_tactic) AS named FROM m GROUP BY ALL),
    u AS (SELECT m.doc_id, m.line_number, named,
        list(DISTINCT replace(tactic, ' ', '_') ORDER BY replace(tactic, ' ', '_'))
          FILTER (WHERE CASE WHEN named THEN by_tactic ELSE by_tech END) AS tactics,
        list(DISTINCT replace(tech, ' ', '_') ORDER BY replace(tech, ' ', '_'))
          FILTER (WHERE by_tech AND (by_tactic OR NOT named)) AS techs
      FROM m JOIN s USING (doc_id, line_number) GROUP BY ALL)
    SELECT l.doc_id, l.line_number,
      CASE WHEN len(techs) > 0 THEN array_to_string(tactics, '-') ELSE 'na' END AS tactic,
      CASE WHEN len(techs) > 0 THEN array_to_string(techs, '-') ELSE 'na' END AS technique
    FROM l LEFT JOIN u USING (doc_id, line_number)""",
)
def jn_knowledge_match(t):
    lines = inputs.document_lines(t).withColumn("hit", joins.knowledge_match(F.col("line"), KNOWLEDGE))
    return lines.select("doc_id", "line_number", "hit.tactic", "hit.technique")


@query(
    "jn_changed_files",
    """SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.doc_id IS NULL OR l.toxic = 1""",
)
def jn_changed_files(t):
    """Inventory against the recorded files; toxic ones have a changed stamp."""
    inventory = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("modificationTime"))
    known = t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("path"), (F.col("n_chars") + F.col("toxic")).alias("modificationTime"))
    return joins.changed_files(inventory, known).select(
        F.col("path").alias("doc_id"), F.col("modificationTime").alias("n_chars"))


@query(
    "jn_simulation_bias",
    """WITH s AS (SELECT o_orderkey, o_custkey AS vessel, o_orderdate AS ts, o_totalprice AS simulated FROM orders),
    m AS (SELECT o_custkey AS vessel, o_orderdate + INTERVAL 2 DAY AS ts, max(o_totalprice * 0.9) AS measured
      FROM orders GROUP BY ALL)
    SELECT o_orderkey, round(simulated - CASE WHEN epoch_us(s.ts) - epoch_us(m.ts) <= 5184000000000
      THEN measured END, 4) AS bias FROM s ASOF LEFT JOIN m ON s.vessel = m.vessel AND s.ts >= m.ts""",
)
def jn_simulation_bias(t):
    sim = t.orders.select("o_orderkey", F.col("o_custkey").alias("vessel"), F.col("o_orderdate").alias("ts"),
                          F.col("o_totalprice").alias("simulated"))
    meas = t.orders.groupBy(
        F.col("o_custkey").alias("vessel"), (F.col("o_orderdate") + F.expr("interval 2 days")).alias("ts")
    ).agg(F.max(F.col("o_totalprice") * 0.9).alias("measured"))
    out = joins.simulation_bias(sim, meas, "vessel", "ts", 60 * 86400)
    return out.select("o_orderkey", F.round("bias", 4).alias("bias"))


@query(
    "jn_vessel_inflow",
    """SELECT s_suppkey AS id, round(coalesce(sum(l_quantity), 0), 2) AS inflow,
      round(coalesce(sum(l_quantity * l_discount), 0), 2) AS gas FROM supplier
    LEFT JOIN lineitem ON l_partkey = s_suppkey GROUP BY s_suppkey""",
)
def jn_vessel_inflow(t):
    vessels = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    edges = t.lineitem.select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"),
                              F.col("l_quantity").alias("f_in"), F.col("l_discount").alias("f_gas"))
    out = scada.vessel_inflow(vessels, edges)
    return out.select("id", F.round("inflow", 2).alias("inflow"), F.round("gas", 2).alias("gas"))


@query(
    "jn_topic_positions",
    """SELECT conv_id, turn, unnest(['first', 'second']) AS topic,
      unnest(['About ' || lower(text) || '?', 'Who is ' || lower(role) || '?']) AS prompt FROM conversations""",
)
def jn_topic_positions(t):
    """Agent topics are paired with topic documents by position."""
    asks = F.lit("first<<-About <<data>>? ->> second <<-Who is <<data>>?->>third<<-unused")
    pairs = prompts.pair_topics(asks, F.array("text", "role"))
    out = t.conversations.select("conv_id", "turn", F.explode(pairs).alias("p"))
    return out.select("conv_id", "turn", "p.topic", F.trim("p.prompt").alias("prompt"))


@query(
    "jn_model_to_entity",
    """WITH m AS (SELECT l_suppkey AS entity, regr_slope(l_extendedprice, l_quantity) AS s,
      regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY l_suppkey)
    SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 3) AS prediction FROM lineitem JOIN m ON entity = l_suppkey""",
)
def jn_model_to_entity(t):
    rows = t.lineitem.withColumnRenamed("l_suppkey", "entity")
    models = ml.fit_linear(rows, ["entity"], "l_extendedprice", ["l_quantity"])
    out = ml.predict(rows, models, ["entity"], ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(
    "win_last_n",
    """SELECT user_id AS entity, event_id AS msgid, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20""",
)
def win_last_n(t):
    return windows.last_n(inputs.measurements(t), ["entity"], ["ts", "msgid"], 20).select("entity", "msgid", "rn")


@query(
    "win_first_per_key",
    f"""SELECT doc_id, line, line_number FROM ({LINES_SQL})
    QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY line_number) = 1""",
)
def win_first_per_key(t):
    return windows.first_by(inputs.document_lines(t), ["doc_id", "line"], ["line_number"])


@query(
    "win_record_highs",
    """WITH r AS (SELECT event_id, event_type, value, max(value) OVER (PARTITION BY event_type ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
    SELECT event_id, event_type, value FROM r WHERE value > greatest(coalesce(seen, 0), 0)""",
)
def win_record_highs(t):
    rows = t.events.select("event_id", "event_type", "value")
    return windows.record_highs(rows, ["event_type"], "event_id", "value", chunk=1024)


@query(
    "win_gap_to_previous",
    f"""SELECT msgid, epoch_us(ts) - epoch_us(pts) AS gap_us FROM ({WINDOW_SQL})""",
)
def win_gap_to_previous(t):
    from rillmark.operators.stats import KEYS, ORDER, micros

    rows = windows.last_n(inputs.measurements(t), KEYS, ORDER, 800).withColumn("us", micros(F.col("ts")))
    return windows.gap_to_previous(rows, KEYS, F.col("rn").desc(), "us", "gap_us").select("msgid", "gap_us")


@query(
    "win_step_to_previous",
    f"SELECT msgid, round(x - px, 4) AS step FROM ({WINDOW_SQL})",
)
def win_step_to_previous(t):
    from rillmark.operators.stats import KEYS, ORDER

    rows = windows.last_n(inputs.measurements(t), KEYS, ORDER, 800)
    out = windows.gap_to_previous(rows, KEYS, F.col("rn").desc(), "value", "step")
    return out.select("msgid", F.round("step", 4).alias("step"))


@query(
    "win_dedupe_delivery",
    """SELECT kafkakey, event_id, value FROM (SELECT user_id || '-' || event_type AS kafkakey, event_id, value FROM events)
    QUALIFY row_number() OVER (PARTITION BY kafkakey ORDER BY event_id) = 1""",
)
def win_dedupe_delivery(t):
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    return windows.first_by(t.events.select(key.alias("kafkakey"), "event_id", "value"), ["kafkakey"], ["event_id"])


@query("win_line_number", f"SELECT doc_id, line_number, length(line) AS n FROM ({LINES_SQL})")
def win_line_number(t):
    return inputs.document_lines(t).select("doc_id", "line_number", F.length("line").cast("long").alias("n"))


@query(
    "win_sequence_index",
    f"SELECT msgid, k::INTEGER AS k FROM ({WINDOW_SQL})",
)
def win_sequence_index(t):
    from pyspark.sql import Window

    from rillmark.operators.stats import KEYS, ORDER

    rows = windows.last_n(inputs.measurements(t), KEYS, ORDER, 800)
    size = F.count("*").over(Window.partitionBy(*KEYS))
    return rows.select("msgid", (size - F.col("rn") + 1).cast("int").alias("k"))


@query("srt_offset_descending", "SELECT event_id, value FROM events ORDER BY event_id DESC")
def srt_offset_descending(t):
    return t.events.select("event_id", "value").orderBy(F.desc("event_id"))


@query("srt_time_descending", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC")
def srt_time_descending(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query("srt_newest", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 800")
def srt_newest(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(800).select("event_id", "value")


@query("srt_page", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 60")
def srt_page(t):
    return windows.page(t.events, [F.desc("ts"), F.desc("event_id")], 30, 3).select("event_id", "value")


@query(
    "srt_first_declared_match",
    f"""SELECT doc_id, line_number, CASE WHEN regexp_matches(line, 'token = "') THEN 'secret'
      WHEN regexp_matches(line, '[0-9]{{16}}') THEN 'card' WHEN contains(line, 'License') THEN 'license' END AS rule
    FROM ({LINES_SQL}) WHERE regexp_matches(line, 'token = "|[0-9]{{16}}|License')""",
)
def srt_first_declared_match(t):
    rules = [("secret", 'token = "'), ("card", "[0-9]{16}"), ("license", "License")]
    rule = F.coalesce(*[F.when(F.rlike("line", F.lit(p)), F.lit(n)) for n, p in rules])
    out = inputs.document_lines(t).withColumn("rule", rule)
    return out.filter(F.col("rule").isNotNull()).select("doc_id", "line_number", "rule")


@query(
    "set_union_topics",
    """SELECT 'events' AS topic, count(*) AS n, round(sum(value), 2) AS total FROM events
    UNION ALL SELECT 'shipments', count(*), round(sum(l_extendedprice), 2) FROM lineitem""",
)
def set_union_topics(t):
    both = inputs.measurements(t).withColumn("topic", F.lit("events")).unionByName(
        inputs.shipments(t).withColumn("topic", F.lit("shipments")), allowMissingColumns=True)
    return both.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "set_distinct_terms",
    """SELECT DISTINCT trim(term) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS term FROM benchmark
      UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part) WHERE trim(term) <> ''""",
)
def set_distinct_terms(t):
    files = t.benchmark.select(F.explode(F.split("text", "\n")).alias("term"))
    config = t.part.select(F.col("p_name").alias("term")).unionByName(t.part.select(F.col("p_type").alias("term")))
    terms = files.unionByName(config).select(F.trim("term").alias("term"))
    return terms.filter("term <> ''").distinct()


@query(
    "set_merge_agents",
    """SELECT level, count(*) AS n FROM (SELECT CASE role WHEN 'user' THEN 'agent' WHEN 'assistant' THEN 'lead'
      ELSE 'supervisor' END AS level FROM conversations) GROUP BY level""",
)
def set_merge_agents(t):
    from rillmark.plans.extraction import agent_levels

    rows = agent_levels(t)
    parts = [rows.filter(F.col("level") == level) for level in ("agent", "lead", "supervisor")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return merged.groupBy("level").agg(F.count("*").alias("n"))
