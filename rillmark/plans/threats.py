"""Queries for log threat scoring, search terms and entity memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json_object
from rillmark.operators import memory, prompts, stats, terms, threat
from rillmark.plans import inputs
from rillmark.plans.inputs import LINES_SQL
from rillmark.plans.registry import query
from rillmark.session import materialize, spread

# Example configuration: rules, tactic matrix and weights are user input.
MATRIX = {
    "Credential Access": ["Unsecured Credentials", "Steal Application Access Token"],
    "Discovery": ["Software Discovery"],
    "Collection": ["Data from Local System"],
}
RULES = {
    "secret_token": {
        "pattern": r'token = "(?P<entity>[0-9a-f]+)"(?P<rest>.{3})?',
        "mitre_tactic": "Credential Access", "mitre_technique": "Unsecured Credentials"},
    "license_notice": {
        "pattern": r"(?P<entity>MIT License)|General (?P<entity_alt>Public License)(?P<version>, version \d)?",
        "mitre_tactic": "Discovery", "mitre_technique": "Software Discovery"},
    "windows_cbs_generic_stream": {
        "pattern": "pathetic", "mitre_tactic": "Discovery", "mitre_technique": "Software Discovery"},
    "card_number": {
        "pattern": r"(?P<entity>[0-9]{16})", "mitre_tactic": "Collection", "mitre_technique": "Screen Capture"},
}
PROFILE = {
    "attack_complexity_weights": {"credential": 8.0, "unsecured": 2.0, "isolation": 6.5, "discovery": 3.0},
    "entity_vulnerability_weights": {"license": 1.5, "example.com": 6.0, "mail": 9.0, ".2": 7.0},
    "fallbacks": {"default_a_w": 5.0, "default_e_w": 4.5, "network_ip_e_w": 7.5},
}


def rules():
    return threat.rules_from(RULES, MATRIX)


# The check spells word boundaries out, since its \b knows only ASCII words.
_B, _E = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_IP = rf"{_B}(\d{{1,3}}(?:\.\d{{1,3}}){{3}}){_E}"
_IP6 = rf"{_B}((?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}){_E}"
_FS = (
    r'(?i)(?:[a-zA-Z]:\\(?:[^\\\s<>:"/|?*]+\\)*[^\\\s<>:"/|?*]+'
    r'|/(?:bin|etc|var|usr|opt|tmp|root|home|sys|proc|lib|run|mnt)/[^\s<>:"|?*]+'
    rf"|{_B}[a-zA-Z0-9_\-.]+\.(?:exe|dll|bat|sh|ps1|vbs|py|elf|bin|conf|ini|cfg|log|zip|tar|gz){_E})"
)
_URL = rf"{_B}(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{{2,}}{_E}"
_BOX = r"(?i)^(Router|Switch|Firewall|Core-SW|Edge|Gateway|LoadBalancer)-\S+"


_PAGE_SQL = """SELECT doc_id, line_number, regexp_replace(line, '[<>]', ' ', 'g') AS line FROM (
  SELECT page_id AS doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_number
  FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))"""


def _entity_sql(lines: str) -> str:
    return rf"""WITH l AS ({lines}),
    tok AS (SELECT doc_id, line_number, unnest(t) AS raw, generate_subscripts(t, 1) AS i
      FROM (SELECT doc_id, line_number, regexp_split_to_array(trim(line), '\s+') AS t FROM l)),
    c AS (SELECT *, regexp_replace(raw, '^[:,\[\]()"''\-_]+|[:,\[\]()"''\-_]+$', '', 'g') AS tk FROM tok),
    k AS (SELECT *, CASE WHEN regexp_matches(tk, '{_IP}') THEN 'network_ip'
      WHEN regexp_matches(tk, '{_IP6}') THEN 'network_ip_v6'
      WHEN regexp_matches(tk, '{_FS}') THEN 'filesystem_resource'
      WHEN regexp_matches(tk, '{_URL}') THEN 'network_endpoint_domain'
      WHEN regexp_matches(tk, '{_BOX}') THEN 'network_appliance' END AS cat,
      lower(tk) IN ('root', 'administrator', 'trustedinstaller', 'sshd', 'kubelet', 'system') AS account FROM c),
    h AS (SELECT doc_id, line_number, arg_min(cat, i) FILTER (WHERE cat IS NOT NULL) AS cat,
      arg_min(CASE cat WHEN 'network_ip' THEN regexp_extract(tk, '{_IP}', 1)
        WHEN 'network_ip_v6' THEN regexp_extract(tk, '{_IP6}', 1) ELSE tk END, i) FILTER (WHERE cat IS NOT NULL) AS ent,
      arg_min(tk, i) FILTER (WHERE account) AS acc FROM k GROUP BY ALL),
    ent AS (SELECT doc_id, line_number, coalesce(ent, acc) AS entity,
      coalesce(cat, 'privileged_system_context') AS category FROM h WHERE coalesce(ent, acc) IS NOT NULL)"""


def page_lines(t):
    """Pages as log files: every line with its number, tags apart."""
    lines = spread(t.pages.select("page_id", "html")).select(F.col("page_id").alias("doc_id"), F.posexplode(F.split("html", "\n")).alias("_pos", "line"))
    return lines.select("doc_id", (F.col("_pos") + 1).alias("line_number"), F.regexp_replace("line", "[<>]", " ").alias("line"))


@query("txt_line_entities", _entity_sql(LINES_SQL) + " SELECT doc_id, line_number, entity, category FROM ent")
def txt_line_entities(t):
    from rillmark.functions.text import strip

    lines = inputs.document_lines(t).withColumn("hit", threat.line_entity(strip(F.col("line"))))
    return lines.filter(F.col("hit").isNotNull()).select("doc_id", "line_number", "hit.entity", "hit.category")


@query(
    "txt_page_entities",
    _entity_sql(_PAGE_SQL) + " SELECT doc_id, line_number, entity, category FROM ent",
)
def txt_page_entities(t):
    from rillmark.functions.text import strip

    rows = page_lines(t).select("doc_id", "line_number", threat.line_entity(strip(F.col("line"))).alias("hit"))
    return rows.filter(F.col("hit").isNotNull()).select("doc_id", "line_number", "hit.entity", "hit.category")


_RULES_SQL = r"""rl AS (SELECT doc_id, line_number, line,
    CASE WHEN regexp_matches(line, 'token = "[0-9a-f]+"') THEN 'secret_token'
      WHEN regexp_matches(line, 'MIT License|General Public License') THEN 'license_notice'
      WHEN contains(line, 'pathetic') THEN 'windows_cbs_generic_stream'
      WHEN regexp_matches(line, '[0-9]{16}') THEN 'card_number' END AS rule FROM l),
  rh AS (SELECT doc_id, line_number, rule AS event_type, CASE rule
      WHEN 'secret_token' THEN regexp_extract(line, 'token = "([0-9a-f]+)"', 1)
      WHEN 'card_number' THEN regexp_extract(line, '[0-9]{16}')
      ELSE CASE WHEN regexp_extract(line, '(MIT License)|General (Public License)', 1) <> '' THEN 'MIT License'
        ELSE 'Public License' END END AS entity,
    CASE rule WHEN 'secret_token' THEN 'Credential Access' WHEN 'card_number' THEN 'Collection' ELSE 'Discovery' END
      AS tactic,
    CASE rule WHEN 'secret_token' THEN 'Unsecured Credentials' WHEN 'card_number' THEN 'Screen Capture'
      ELSE 'Software Discovery' END AS technique, rule <> 'card_number' AS validated
    FROM rl WHERE rule IS NOT NULL AND rule <> 'windows_cbs_generic_stream')"""


@query(
    "txt_rule_match",
    f"WITH l AS ({LINES_SQL}), {_RULES_SQL} SELECT * FROM rh",
)
def txt_rule_match(t):
    """Rule hits with entity, tactic, technique and the matrix check; one noise rule is silent."""
    found = threat.elements(inputs.document_lines(t), "line", rules(), ["doc_id", "line_number"])
    return found.filter(~F.col("event_type").startswith("threat_vector_")).drop("attributes")


@query(
    "txt_json_lines",
    """SELECT event_id, 'native_structured_telemetry' AS event_type,
      CASE WHEN event_id % 3 = 0 THEN 'u' || user_id WHEN event_id % 3 = 1 THEN event_type ELSE event_id::VARCHAR END
        AS entity, 'Initial Access' AS tactic,
      CASE event_id % 3 WHEN 0 THEN event_id || '|' || event_type || '|u' || user_id
        WHEN 1 THEN event_id || '|' || event_type ELSE event_id || '|' || value END AS attributes FROM events""",
)
def txt_json_lines(t):
    kind = F.col("event_id") % 3
    line = F.to_json(F.struct(
        "event_id", F.when(kind == 0, F.col("event_type")).alias("kind"),
        F.when(kind == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("username"),
        F.when(kind == 1, F.col("event_type")).alias("image"),
        F.when(kind == 2, F.col("value")).alias("value")))
    rows = t.events.select("event_id", F.concat(F.lit("  "), line, F.lit(" ")).alias("line"))
    out = threat.elements(rows, "line", rules(), ["event_id"])
    return out.select("event_id", "event_type", "entity", "tactic", F.array_join("attributes", "|").alias("attributes"))


def _elements_sql(lines: str) -> str:
    return f"""{_entity_sql(lines)}, {_RULES_SQL},
    el AS (SELECT doc_id, line_number, event_type, entity, tactic, technique, validated FROM rh
      UNION ALL SELECT doc_id, line_number, 'threat_vector_' || category, entity,
        CASE category WHEN 'filesystem_resource' THEN 'Defense Evasion' ELSE 'Discovery' END,
        'Targeted Resource Asset Isolation (' || category || ')', false
      FROM ent WHERE (doc_id, line_number) NOT IN (SELECT (doc_id, line_number) FROM rl WHERE rule IS NOT NULL)),
    un AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY line_number) = 1)"""


_DOC_EL = _elements_sql(LINES_SQL)
_SCORE_SQL = """round_even(sqrt(CASE WHEN contains(lower(tactic), 'credential') OR contains(lower(technique), 'credential')
    THEN 8.0 WHEN contains(lower(technique), 'unsecured') THEN 2.0 WHEN contains(lower(technique), 'isolation') THEN 6.5
    WHEN contains(lower(tactic), 'discovery') OR contains(lower(technique), 'discovery') THEN 3.0 ELSE 5.0 END::DOUBLE *
  CASE WHEN contains(lower(entity), 'license') THEN 1.5 WHEN contains(lower(entity), 'example.com') THEN 6.0
    WHEN contains(lower(entity), 'mail') THEN 9.0 WHEN contains(lower(entity), '.2') THEN 7.0
    WHEN regexp_matches(entity, '""" + _IP + """') THEN 7.5 ELSE 4.5 END::DOUBLE) * 10, 2)"""


def document_elements(t):
    found = threat.elements(inputs.document_lines(t), "line", rules(), ["doc_id", "line_number"])
    return threat.unique_elements(found, "doc_id", "line_number")


def page_elements(t):
    """Elements of the pages, whose categories serve as the stored baseline."""
    found = threat.elements(page_lines(t), "line", rules(), ["doc_id", "line_number"])
    return threat.unique_elements(found, "doc_id", "line_number")


@query(
    "txt_fallback_elements",
    _DOC_EL + """, tk AS (SELECT doc_id, line_number, regexp_split_to_array(trim(line), '\\s+')[:8] AS t FROM l)
    SELECT doc_id, line_number, event_type, entity, tactic, technique,
      array_to_string(t, '|') || '|' || replace(event_type, 'threat_vector_', '') AS attributes, len(t) + 1 AS n
    FROM un JOIN tk USING (doc_id, line_number) WHERE event_type LIKE 'threat%'""",
)
def txt_fallback_elements(t):
    rows = document_elements(t).filter(F.col("event_type").startswith("threat_vector_"))
    named = threat.numbered_attributes(F.col("attributes"))
    return rows.select(
        "doc_id", "line_number", "event_type", "entity", "tactic", "technique",
        F.array_join(F.map_values(named), "|").alias("attributes"), F.size(named).cast("long").alias("n"))


@query(
    "prj_numbered_attributes",
    _elements_sql(LINES_SQL) + """, tk AS (SELECT doc_id, line_number, regexp_split_to_array(trim(line), '\\s+')[:8] AS t FROM l),
    a AS (SELECT doc_id, line_number, list_append(t, replace(event_type, 'threat_vector_', '')) AS v
      FROM un JOIN tk USING (doc_id, line_number) WHERE event_type LIKE 'threat%')
    SELECT doc_id, line_number, 'attr' || generate_subscripts(v, 1) AS name, unnest(v) AS value FROM a""",
)
def prj_numbered_attributes(t):
    rows = document_elements(t).filter(F.col("event_type").startswith("threat_vector_"))
    return rows.select(
        "doc_id", "line_number", F.explode(threat.numbered_attributes(F.col("attributes"))).alias("name", "value"))


@query(
    "txt_pattern_score",
    _DOC_EL + f" SELECT doc_id, line_number, {_SCORE_SQL} AS pattern_score FROM un",
)
def txt_pattern_score(t):
    weights = threat.Weights.from_profile(PROFILE)
    score = threat.pattern_score(F.col("tactic"), F.col("technique"), F.col("entity"), weights)
    return document_elements(t).select("doc_id", "line_number", score.alias("pattern_score"))


@query(
    "jn_first_weight",
    """SELECT event_id, CASE WHEN contains(event_type, 'ick') THEN 8.0 WHEN contains(event_type, 'c') THEN 3.0
      WHEN contains(event_type, 'e') THEN 2.0 ELSE 5.0 END::DOUBLE AS weight FROM events""",
)
def jn_first_weight(t):
    """The first keyword in declared order decides, not the best one."""
    weight = threat.first_weight([F.col("event_type")], {"ick": 8, "c": 3, "e": 2})
    return t.events.select("event_id", F.coalesce(weight, F.lit(5.0)).alias("weight"))


@query(
    "jn_rule_validated",
    """SELECT * FROM (VALUES ('secret_token', true), ('license_notice', true), ('windows_cbs_generic_stream', true),
      ('card_number', false)) v(event_type, validated)
    WHERE event_type IN (SELECT event_type FROM (SELECT CASE WHEN contains(text, 'token = "') THEN 'secret_token'
      WHEN contains(text, 'MIT License') THEN 'license_notice' END AS event_type FROM documents))""",
)
def jn_rule_validated(t):
    """Rule table against the exploded tactic matrix, for rules seen in the documents."""
    spark = t.spark
    listed = spark.createDataFrame(
        [(r.name, r.tactic, r.technique) for r in rules()], "event_type string, tactic string, technique string")
    known = spark.createDataFrame(
        [(tactic, tech) for tactic, techs in MATRIX.items() for tech in techs], "tactic string, technique string")
    checked = listed.join(known.withColumn("hit", F.lit(True)), ["tactic", "technique"], "left")
    seen = t.documents.select(
        F.when(F.contains("text", F.lit('token = "')), "secret_token").when(
            F.contains("text", F.lit("MIT License")), "license_notice").alias("event_type")).distinct()
    return checked.join(seen, "event_type", "left_semi").select(
        "event_type", F.coalesce("hit", F.lit(False)).alias("validated"))


@query(
    "agg_category_distribution",
    _DOC_EL + """ SELECT event_type, round_even(count(*) / (SELECT count(*) FROM un), 4) AS share FROM un
    GROUP BY event_type""",
)
def agg_category_distribution(t):
    return threat.distribution(document_elements(t), "event_type")


@query(
    "srt_category_distribution",
    _DOC_EL + """ SELECT event_type, share, row_number() OVER (ORDER BY share DESC, event_type) AS place
    FROM (SELECT event_type, round_even(count(*) / (SELECT count(*) FROM un), 4) AS share FROM un GROUP BY event_type)""",
)
def srt_category_distribution(t):
    ranked = threat.ranked_distribution(document_elements(t), "event_type")
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.col("share").desc(), "event_type")))


def _drift_sql(target: str) -> str:
    pages = _elements_sql(_PAGE_SQL).removeprefix("WITH ")
    return f"""WITH cur AS ({_DOC_EL} SELECT event_type, round_even(count(*) / (SELECT count(*) FROM un), 4) AS a
      FROM un GROUP BY event_type),
    base AS (WITH {pages} SELECT event_type, round_even(count(*) / (SELECT count(*) FROM un), 4) AS b
      FROM un GROUP BY event_type),
    {target} AS (SELECT event_type, round_even((ga - gb) * ln(ga / gb), 4) AS drift FROM (SELECT event_type,
      greatest(coalesce(a, 0.0001), 0.0001) AS ga, greatest(coalesce(b, 0.0001), 0.0001) AS gb
      FROM cur FULL JOIN base USING (event_type)))"""


@query("agg_stability_index", _drift_sql("d") + " SELECT event_type, drift FROM d")
def agg_stability_index(t):
    current = threat.distribution(document_elements(t), "event_type")
    baseline = threat.distribution(page_elements(t), "event_type")
    return threat.stability_index(baseline, current, "event_type")


@query(
    "jn_drift_to_rows",
    _drift_sql("d") + f""", e AS ({_DOC_EL} SELECT * FROM un)
    SELECT doc_id, line_number, coalesce(drift, 0.2979) AS drift FROM e LEFT JOIN d USING (event_type)""",
)
def jn_drift_to_rows(t):
    found = materialize(document_elements(t), "elements")
    baseline = threat.distribution(page_elements(t), "event_type")
    drift = threat.stability_index(baseline, threat.distribution(found, "event_type"), "event_type")
    return threat.with_drift(found, drift, "event_type").select("doc_id", "line_number", "drift")


@query(
    "agg_batch_moments",
    "SELECT round(avg(l_discount * l_quantity), 6) AS mu, round(stddev_pop(l_discount * l_quantity), 6) AS sigma FROM lineitem",
)
def agg_batch_moments(t):
    rows = t.lineitem.withColumn("s", F.col("l_discount") * F.col("l_quantity"))
    return threat.batch_moments(rows, "s").select(F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query(
    "win_batch_logistic",
    """WITH m AS (SELECT avg(value * 1.001) AS mu, stddev_pop(value * 1.001) AS sigma FROM events)
    SELECT event_id, CASE WHEN sigma = 0 THEN 50.0 ELSE
      round_even(100 / (1 + exp(-(round_even(value * 1.001, 2) - mu) / sigma)), 2) END AS score FROM events, m""",
)
def win_batch_logistic(t):
    rows = t.events.withColumn("exact", F.col("value") * 1.001)
    rows = rows.withColumn("shown", F.bround("exact", 2))
    return threat.normalise(rows, "exact", "shown", "score").select("event_id", "score")


@query(
    "txt_raw_score",
    _DOC_EL + f""" SELECT doc_id, line_number, round_even({_SCORE_SQL} * exp(0.2979), 2) AS raw_score FROM un""",
)
def txt_raw_score(t):
    """Raw score with the cold-start drift."""
    out = threat.score_batch(document_elements(t), threat.Weights.from_profile(PROFILE))
    return out.select("doc_id", "line_number", "raw_score")


@query(
    "threat_scores",
    _drift_sql("d") + f""", e AS ({_DOC_EL} SELECT * FROM un),
    s AS (SELECT doc_id, line_number, event_type, entity, {_SCORE_SQL} AS ps, coalesce(drift, 0.2979) AS dr
      FROM e LEFT JOIN d USING (event_type)),
    m AS (SELECT avg(ps * exp(dr)) AS mu, stddev_pop(ps * exp(dr)) AS sigma FROM s)
    SELECT doc_id, line_number, event_type, entity, ps AS pattern_score, dr AS drift,
      round_even(ps * exp(dr), 2) AS raw_score,
      round_even(100 / (1 + exp(-(round_even(ps * exp(dr), 2) - mu) / sigma)), 2) AS normalised_score FROM s, m""",
)
def threat_scores(t):
    """The whole scoring of one batch of files against a stored baseline."""
    baseline = threat.distribution(page_elements(t), "event_type")
    out = threat.score_batch(document_elements(t), threat.Weights.from_profile(PROFILE), baseline)
    return out.select("doc_id", "line_number", "event_type", "entity", "pattern_score", "drift", "raw_score",
                      "normalised_score")


SEARCH = r"rgx:[0-9]{3}\.[0-9]+ ~~~ |token =,License ~~~ @the,von ~~~ que la"
_FOUND = r"""concat_ws('|', CASE WHEN regexp_matches({t}, '[0-9]{{3}}\.[0-9]+') THEN '[0-9]{{3}}\.[0-9]+' END,
  CASE WHEN contains({t}, 'token =') THEN 'token =' END, CASE WHEN contains({t}, 'License') THEN 'License' END,
  CASE WHEN contains({t}, 'the') AND contains({t}, 'von') THEN 'the|von' END,
  CASE WHEN contains({t}, 'que la') THEN 'que la' END)"""


@query(
    "txt_search_groups",
    f"SELECT doc_id, line_number, {_FOUND.format(t='line')} AS found FROM ({LINES_SQL}) WHERE {_FOUND.format(t='line')} <> ''",
)
def txt_search_groups(t):
    """Regex, OR and AND groups of search terms over all lines."""
    hits = terms.found_terms(F.col("line"), terms.parse_groups(SEARCH))
    rows = inputs.document_lines(t).withColumn("hits", hits).filter(F.size("hits") > 0)
    return rows.select("doc_id", "line_number", F.array_join("hits", "|").alias("found"))


@query(
    "txt_term_table",
    """SELECT doc_id, item_id FROM documents d JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS term
      FROM benchmark) b ON contains(d.text, b.term) WHERE term <> '' GROUP BY ALL""",
)
def txt_term_table(t):
    """A growing table of known passages looked up in whole texts."""
    lines = t.benchmark.select("item_id", F.explode(F.split("text", "\n")).alias("term"))
    keyed = lines.withColumn("term_id", F.concat_ws(":", F.col("item_id").cast("string"), F.md5("term")))
    out = terms.match_term_table(spread(t.documents.select("doc_id", "text")), ["doc_id"], "text", keyed, "term", "term_id")
    return out.select("doc_id", F.split_part("term_id", F.lit(":"), F.lit(1)).cast("long").alias("item_id")).distinct()


@query(
    "txt_encoded_terms",
    """SELECT conv_id, turn, base64(encode(text)) AS encoded, text AS decoded, NULL::VARCHAR AS broken FROM conversations""",
)
def txt_encoded_terms(t):
    """Terms as they travel, and back; what is no base64 is no term."""
    from rillmark.functions.text import decode_terms, encode_terms

    rows = t.conversations.select("conv_id", "turn", encode_terms(F.col("text")).alias("encoded"))
    return rows.select("*", decode_terms(F.col("encoded")).alias("decoded"), decode_terms(F.concat(F.lit("?"), "encoded")).alias("broken"))


@query(
    "txt_answer_flag",
    "SELECT conv_id, turn, contains(text, 'ouen') OR contains(text, 'x ' || role) AS found FROM conversations",
)
def txt_answer_flag(t):
    flag = prompts.answer_flag(F.col("text"), F.col("role"), ["ouen", "x --identifier--"])
    return t.conversations.select("conv_id", "turn", flag.alias("found"))


@query(
    "txt_reject_formula",
    f"""SELECT doc_id, contains(text, '=') AND (contains(text, 'Answer:') OR contains(text, 'A:')) AS rejected,
      length(CASE WHEN contains(text, '=') AND (contains(text, 'Answer:') OR contains(text, 'A:'))
        THEN '{prompts.NO_RESULT}' ELSE text END) AS n
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A: ' || text ELSE text END AS text FROM documents)""",
)
def txt_reject_formula(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A: "), F.col("text"))).otherwise(F.col("text"))
    rows = t.documents.select("doc_id", text.alias("text"))
    out = prompts.reject_formula(F.col("text"))
    return rows.select("doc_id", (out == prompts.NO_RESULT).alias("rejected"), F.length(out).cast("long").alias("n"))


@query(
    "snk_json_only",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'produce' ELSE 'quarantine' END AS target FROM events",
)
def snk_json_only(t):
    """Only valid JSON objects may be produced; the rest is set aside."""
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.substring("props", 2, 100))
    return t.events.select(
        "event_id", F.when(is_json_object(text), "produce").otherwise("quarantine").alias("target"))


# Entity memory over the documents: source = entity, 40 documents = one window.
_MEM_TERMS = "|token =,License ~~~ rgx:[0-9]{16} ~~~ |pathetic,scum"


def memory_texts(t):
    texts = spread(t.documents.select("source", "doc_id", "text"))
    return texts.select(F.col("source").alias("entity"), F.floor(F.col("doc_id") / 40).alias("window"), "text")


def _memory_counts(t):
    hits = memory.window_hits(memory_texts(t), "text", terms.parse_groups(_MEM_TERMS))
    return memory.memory_counts(hits, remember=20)


def _memory_anomaly(t):
    rows = t.documents.select(
        F.col("source").alias("entity"), F.lit("size").alias("subtopic"), F.col("n_chars").alias("value"),
        F.col("doc_id").alias("ts"), F.col("doc_id").alias("msgid"))
    return stats.window_stats(rows, ["anomprob"])


_MEM_SQL = r"""WITH w AS (SELECT source AS entity, doc_id // 40 AS win, bool_or(contains(text, 'token =')) AS t1,
    bool_or(contains(text, 'License')) AS t2, bool_or(regexp_matches(text, '[0-9]{16}')) AS t3,
    bool_or(contains(text, 'pathetic')) AS t4, bool_or(contains(text, 'scum')) AS t5,
    row_number() OVER (PARTITION BY source ORDER BY doc_id // 40 DESC) AS rn FROM documents
    GROUP BY source, doc_id // 40 QUALIFY rn <= 20),
  p AS (SELECT *, (t1 OR t2 OR t3 OR t4 OR t5) AS hit,
    (t1 AND coalesce(bool_or(t1) OVER o, false)) OR (t2 AND coalesce(bool_or(t2) OVER o, false))
    OR (t3 AND coalesce(bool_or(t3) OVER o, false)) OR (t4 AND coalesce(bool_or(t4) OVER o, false))
    OR (t5 AND coalesce(bool_or(t5) OVER o, false)) AS again
    FROM w WINDOW o AS (PARTITION BY entity ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT entity, count(*) AS windows_seen, count_if(hit)::BIGINT AS attack_windows,
    count_if(again)::BIGINT AS pattern_windows FROM p GROUP BY entity),
  a AS (SELECT entity, 100 * (1 - exp(-power(arg_max(coalesce((x - m) / nullif(sd, 0), 0), k), 2) / 2)) AS anomprob
    FROM (SELECT source AS entity, n_chars AS x, doc_id AS k, avg(n_chars) OVER p AS m, stddev_pop(n_chars) OVER p AS sd
      FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 800)
      WINDOW p AS (PARTITION BY source)) GROUP BY entity),
  s AS (SELECT c.*, attack_windows / windows_seen AS attack_score, least(1.0, pattern_windows / 6) AS pattern_score,
    anomprob / 100 AS anomaly_score FROM c JOIN a USING (entity)),
  f AS (SELECT *, (attack_score + pattern_score + anomaly_score) / 3 AS rtms_score FROM s)"""


@query("st_memory_counts", _MEM_SQL + " SELECT * FROM c")
def st_memory_counts(t):
    """Remembered windows, windows with a hit and windows with a repeated term per entity."""
    return _memory_counts(t)


@query(
    "st_memory_scores",
    _MEM_SQL + """ SELECT entity, round(attack_score, 6) AS attack_score, round(pattern_score, 6) AS pattern_score,
      round(anomaly_score, 6) AS anomaly_score, round(rtms_score, 6) AS rtms_score,
      CASE WHEN rtms_score < 0.4 THEN 'low' WHEN rtms_score < 0.7 THEN 'medium' ELSE 'high' END AS activity_level,
      CASE WHEN rtms_score < 0.4 THEN 'low' WHEN rtms_score < 0.7 THEN 'medium' ELSE 'high' END || ' activity: hits in '
        || attack_windows || ' of ' || windows_seen || ' windows, ' || pattern_windows || ' repeated' AS comment
    FROM f""",
)
def st_memory_scores(t):
    out = memory.memory_scores(_memory_counts(t), _memory_anomaly(t), 6)
    scores = [F.round(c, 6).alias(c) for c in ("attack_score", "pattern_score", "anomaly_score", "rtms_score")]
    return out.select("entity", *scores, "activity_level", "comment")


@query(
    "st_memory_without_events",
    _MEM_SQL + """ SELECT entity, round(anomprob / 100, 6) AS rtms_score, CASE WHEN anomprob / 100 < 0.4 THEN 'low'
      WHEN anomprob / 100 < 0.7 THEN 'medium' ELSE 'high' END AS activity_level FROM a""",
)
def st_memory_without_events(t):
    out = memory.memory_scores(None, _memory_anomaly(t), 6)
    return out.select("entity", F.round("rtms_score", 6).alias("rtms_score"), "activity_level")


@query(
    "snk_route_by_score",
    _MEM_SQL + """ SELECT entity, 'rtmstopic' AS topic FROM f WHERE rtms_score > 0.5
    UNION ALL SELECT entity, 'attacktopic' FROM f WHERE attack_score > 0.6
    UNION ALL SELECT entity, 'patterntopic' FROM f WHERE pattern_score > 0.4""",
)
def snk_route_by_score(t):
    out = memory.memory_scores(_memory_counts(t), _memory_anomaly(t), 6)
    return memory.route_scores(out, {
        "rtms_score": (0.5, "rtmstopic"), "attack_score": (0.6, "attacktopic"), "pattern_score": (0.4, "patterntopic"),
    }).select("entity", "topic")
