"""Queries for the condition language and the other filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import conditions as cond
from rillmark.operators.prompts import answer_flag
from rillmark.plans import inputs
from rillmark.plans.inputs import LINES_SQL, PREPROCESSED_SQL
from rillmark.plans.registry import query, register

NOW = "2024-02-01 00:00:00"

# Row conditions over the nested device records: name -> (condition, SQL test).
ROW_CONDITIONS = {
    "equal": ("custom:metadata.property_name~condition:equal error", "event_type = 'error'"),
    "greaterthan": ("custom:datapoint.value~condition:greaterthan 100", "value > 100"),
    "lessthan": ("custom:datapoint.value~condition:lessthan 5.5", "value < 5.5"),
    "equalor": ("custom:metadata.property_name~condition:equalor click,view", "event_type IN ('click', 'view')"),
    "containsor": ("custom:metadata.property_name~condition:containsor ick,sign",
                   "contains(event_type, 'ick') OR contains(event_type, 'sign')"),
    "containsand": ("custom:metadata.display_name~condition:containsand ur,se m",
                    "contains(event_type || ' meter', 'ur') AND contains(event_type || ' meter', 'se m')"),
    "fieldcontainsor": ("custom:datapoint.value~condition:greaterthan 50,fieldcontainsor,metadata.oem_model,M1,M2",
                        "value > 50 AND user_id % 4 IN (1, 2)"),
    "fieldcontainsand": ("custom:datapoint.value~condition:fieldcontainsand,metadata.display_name,view,meter",
                         "event_type = 'view'"),
    "fieldcontainsnot": ("custom:datapoint.value~condition:fieldcontainsnot,metadata.oem_model,M0,M3",
                         "user_id % 4 NOT IN (0, 3)"),
    "fieldequalor": ("custom:datapoint.value~condition:fieldequalor,metadata.dsn,u1,u20,u77", "user_id IN (1, 20, 77)"),
    "fieldlessthanor": ("custom:datapoint.value~condition:fieldlessthanor,datapoint.value,3,9", "value < 3 OR value < 9"),
    "fieldlessthanand": ("custom:datapoint.value~condition:fieldlessthanand,datapoint.value,3,9",
                         "value < 3 AND value < 9"),
    "fieldgreaterthanor": ("custom:datapoint.value~condition:fieldgreaterthanor,datapoint.value,150,90",
                           "value > 150 OR value > 90"),
    "fieldgreaterthanand": ("custom:datapoint.value~condition:fieldgreaterthanand,datapoint.value,150,90",
                            "value > 150 AND value > 90"),
}


def _row_query(name: str, spec: str, test: str) -> None:
    def run(t):
        rows = inputs.iot_records(t)
        parsed = cond.parse_condition(spec + "~toplevelarray:~returnarray:_all")
        return cond.apply_conditions(rows, parsed, cond.json_fields(F.col("payload"))).select("event_id")

    register(f"flt_{name}", run, f"SELECT event_id FROM events WHERE {test}")


for _name, (_spec, _test) in ROW_CONDITIONS.items():
    _row_query(_name, _spec, _test)


def _tagged(t):
    """Line items with an array-valued JSON field."""
    doc = F.struct(F.array("l_returnflag", "l_linestatus", F.concat(F.lit("n"), F.col("l_linenumber").cast("string")))
                   .alias("tags"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.to_json(doc).alias("payload"))


@query(
    "flt_equaland",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def flt_equaland(t):
    spec = cond.parse_condition("custom:tags~condition:equaland R,F")
    out = cond.apply_conditions(_tagged(t), spec, cond.json_fields(F.col("payload")))
    return out.select("l_orderkey", "l_linenumber")


@query(
    "flt_fieldequaland",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 2",
)
def flt_fieldequaland(t):
    spec = cond.parse_condition("custom:other~condition:fieldequaland,tags,A,n2")
    out = cond.apply_conditions(_tagged(t), spec, cond.json_fields(F.col("payload")))
    return out.select("l_orderkey", "l_linenumber")


# Group conditions per device: name -> (condition, SQL aggregate, SQL row test).
GROUP_CONDITIONS = {
    "sum": ("sum,greaterthan,3400", "sum(value)", "sum_value", "> 3400", "true"),
    "avg": ("avg,lessthan,49.5", "avg(value)", "avg_value", "< 49.5", "true"),
    "count": ("count,greaterthan,70", "count(*)", "count_value", "> 70", "true"),
    "sumif": ("sumif,greaterthan,1200,fieldcontainsor,metadata.property_name,click,view",
              "sum(CASE WHEN event_type IN ('click', 'view') THEN value END)", "sumif_value", "> 1200", "true"),
    "avgif": ("avgif,greaterthan,50,fieldequalor,metadata.property_name,error",
              "avg(CASE WHEN event_type = 'error' THEN value END)", "avgif_value", "> 50", "true"),
}


def _group_query(name: str, spec: str, agg: str, label: str, test: str, rows_sql: str) -> None:
    def run(t):
        rows = t.events.withColumn("entity", F.col("user_id"))
        names = {"datapoint.value": "value", "metadata.property_name": "event_type"}
        parsed = cond.parse_condition(f"custom:datapoint.value~condition:{spec}~returnarray:_all")
        out = cond.apply_conditions(rows, parsed, lambda p: F.col(names[p]).cast("string"), ["entity"])
        value = F.col(label) if name == "count" else inputs.settle(F.col(label), 4)
        return out.select("entity", value.alias(label))

    shown = agg if name == "count" else f"round({agg} + 1e-7, 4)"
    register(
        f"flt_{name}",
        run,
        f"SELECT user_id AS entity, {shown} AS {label} FROM events WHERE {rows_sql} GROUP BY user_id HAVING {agg} {test}",
    )


for _name, _args in GROUP_CONDITIONS.items():
    _group_query(_name, *_args)


def _timed(t, condition):
    parsed = cond.parse_condition(f"custom:datapoint.created_at~condition:{condition}~returnarray:_all")
    rows = t.events.withColumn("entity", F.col("user_id"))
    names = {"datapoint.created_at": "ts", "metadata.property_name": "event_type"}
    return cond.apply_conditions(
        rows, parsed, lambda p: F.col(names[p]).cast("string"), ["entity"], F.col("ts"), NOW)


_GAP = "(epoch_us(max(ts)) - epoch_us(min(ts))) / (count(*) - 1)::DOUBLE"


@query(
    "flt_timediff",
    f"""SELECT user_id AS entity, round({_GAP} / 3600000000, 4) AS timediff_value FROM events
    WHERE NOT contains(event_type, 'signup') GROUP BY user_id HAVING {_GAP} / 3600000000 > 13""",
)
def flt_timediff(t):
    out = _timed(t, "timediff_-5_hour,greaterthan,13,fieldcontainsnot,metadata.property_name,signup")
    return out.select("entity", F.round("timediff_value", 4).alias("timediff_value"))


@query(
    "flt_compound",
    f"""SELECT user_id AS entity, count(*) AS count_value FROM events GROUP BY user_id
    HAVING {_GAP} / 3600000000 > 9 AND count(*) > 60""",
)
def flt_compound(t):
    return _timed(t, "timediff_-5_hour,greaterthan,9,count,greaterthan,60").select("entity", "count_value")


@query(
    "flt_dataage",
    f"""SELECT event_id FROM events
    WHERE (epoch_us(TIMESTAMP '{NOW}') - (epoch_us(ts) - 5 * 3600000000::BIGINT)) / 86400000000 > 20""",
)
def flt_dataage(t):
    return _timed(t, "dataage_-5_day,greaterthan,20").select("event_id")


def _inspections(t):
    """Line items as inspection documents: two areas with one checklist answer each."""
    def area(name, answer):
        return F.struct(F.lit(name).alias("area"), F.array(F.struct(answer.alias("response"))).alias("checklist"))

    doc = F.struct(
        F.col("l_suppkey").alias("Plant_Name"), F.col("l_orderkey").alias("Visit"),
        F.array(
            area("flag", F.when(F.col("l_returnflag") == "R", "No").otherwise("Yes")),
            area("status", F.when(F.col("l_linestatus") == "F", "No").otherwise("Yes")),
        ).alias("Inspection_Details"),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus", F.to_json(doc).alias("payload"))


@query(
    "flt_array_elements",
    """SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS "Plant_Name", 'flag' AS area FROM lineitem
      WHERE l_returnflag = 'R'
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR, 'status' FROM lineitem WHERE l_linestatus = 'F'""",
)
def flt_array_elements(t):
    """Array elements that pass, with document fields and element attributes."""
    spec = cond.parse_condition(
        "custom:Inspection_Details.0.checklist.0.response~condition:equal No~toplevelarray:Inspection_Details~"
        "returnarray:Plant_Name~customattrs:area~customarray:checklist")
    out = cond.match_array_elements(_inspections(t), "payload", spec, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "Plant_Name", "area")


@query(
    "flt_return_fields",
    """SELECT l_orderkey, l_linenumber, '{"Plant_Name":' || l_suppkey || ',"Visit":' || l_orderkey ||
      ',"Inspection_Details":[{"area":"flag","checklist":[{"response":"' ||
      CASE WHEN l_returnflag = 'R' THEN 'No' ELSE 'Yes' END || '"}]},{"area":"status","checklist":[{"response":"' ||
      CASE WHEN l_linestatus = 'F' THEN 'No' ELSE 'Yes' END || '"}]}]}' AS record
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'""",
)
def flt_return_fields(t):
    """``returnarray:_all`` keeps the whole record."""
    spec = cond.parse_condition(
        "custom:Inspection_Details.0.checklist.0.response~condition:equal No,fieldcontainsor,area,flag~"
        "toplevelarray:Inspection_Details~returnarray:_all~customattrs:area")
    rows = _inspections(t).filter("l_linestatus = 'O'")
    return cond.match_array_elements(rows, "payload", spec, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "record")


@query(
    "flt_bounds",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount NOT BETWEEN 0 AND 0.05 THEN 'l_discount' END,
      CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'l_quantity' END) AS out_of_bounds FROM lineitem""",
)
def flt_bounds(t):
    bounds = {"l_quantity": (5, 45), "l_discount": (0, 0.05)}
    return cond.check_bounds(t.lineitem, bounds).select(
        "l_orderkey", "l_linenumber", F.array_join("out_of_bounds", ",").alias("out_of_bounds"))


@query(
    "flt_type_and_identifier",
    f"""SELECT event_id FROM ({PREPROCESSED_SQL}) WHERE lower(preprocesstype) LIKE '%anom%'
      AND (lower(identifier) LIKE '%purchase%' OR lower(identifier) LIKE '%uid=u11%')""",
)
def flt_type_and_identifier(t):
    rows = inputs.preprocessed(t)
    return rows.filter(
        cond.matches_any(F.col("preprocesstype"), "ANOM")
        & cond.matches_any(F.col("identifier"), "purchase,UID=u11") & cond.matches_any(F.col("variable"), "")
    ).select("event_id")


@query("flt_drop_empty", f"SELECT count(*) AS kept FROM ({LINES_SQL}) WHERE trim(line) <> ''")
def flt_drop_empty(t):
    return inputs.document_lines(t).filter(F.trim("line") != "").agg(F.count("*").alias("kept"))


@query(
    "flt_retention",
    f"""SELECT event_id FROM events
    WHERE (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000 <= 100""",
)
def flt_retention(t):
    from rillmark.operators.stats import age

    return t.events.filter(age(F.col("ts"), NOW, 0, "hour") <= 100).select("event_id")


@query(
    "flt_score_threshold",
    """SELECT l_orderkey, l_linenumber, l_discount >= 0.05 AS risky, l_discount > 0.05 AS routed FROM lineitem""",
)
def flt_score_threshold(t):
    """Reaching the threshold marks a risk; only exceeding it routes a score."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") >= 0.05).alias("risky"),
        (F.col("l_discount") > 0.05).alias("routed"))


@query(
    "flt_found_only",
    "SELECT conv_id, turn FROM conversations WHERE contains(text, 'que') OR contains(text, 'role ' || role)",
)
def flt_found_only(t):
    """Only answers that hold a search term are passed on."""
    found = answer_flag(F.col("text"), F.col("role"), ["que", "role --identifier--"])
    return t.conversations.filter(found).select("conv_id", "turn")


@query("flt_entity", "SELECT event_id FROM events WHERE user_id = 42")
def flt_entity(t):
    return cond.select_entities(inputs.measurements(t), 42).select(F.col("msgid").alias("event_id"))


@query("flt_entity_all", "SELECT count(*) AS n, count(DISTINCT user_id) AS entities FROM events")
def flt_entity_all(t):
    rows = cond.select_entities(cond.select_entities(inputs.measurements(t), -999), -1)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
