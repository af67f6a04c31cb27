"""Queries for the window statistics and the other aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import reports, stats
from rillmark.functions import tools
from rillmark.plans.inputs import SHIPMENT_SQL, WINDOW_SQL, measurements, settle, shipments
from rillmark.plans.registry import query, register

NOW = "2024-02-01 00:00:00"

_Z = "coalesce((x - m) / nullif(sd, 0), 0)"
# Statistic type -> SQL aggregate over the window rows.
TYPE_SQL = {
    "min": "min(x)",
    "max": "max(x)",
    "sum": "sum(x)",
    "avg": "avg(x)",
    "count": "count(x)::DOUBLE",
    "diff": "arg_max(x, k) - arg_min(x, k)",
    "diffmargin": "100 * (arg_max(x, k) - arg_min(x, k)) / nullif(abs(arg_min(x, k)), 0)",
    "variance": "var_pop(x)",
    "varied": "CASE WHEN count(DISTINCT x) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "outliers": f"count_if(abs({_Z}) > 3)::DOUBLE",
    "outliers2-5": f"count_if(abs({_Z}) BETWEEN 2 AND 5)::DOUBLE",
    "anomprob": f"100 * (1 - exp(-power(arg_max({_Z}, k), 2) / 2))",
    "anomprob2-5": f"100.0 * count_if(abs({_Z}) BETWEEN 2 AND 5) / count(*)",
    "anomprob3": f"100.0 * count_if(abs({_Z}) >= 3) / count(*)",
    "gm": "CASE WHEN min(x) > 0 THEN exp(avg(CASE WHEN x > 0 THEN ln(x) END)) END",
    "hm": "CASE WHEN min(x) > 0 THEN count(x) / sum(1 / nullif(x, 0)) END",
    "trend": "regr_slope(x, k)",
    "IQR": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "trimean": "(quantile_cont(x, 0.25) + 2 * quantile_cont(x, 0.5) + quantile_cont(x, 0.75)) / 4",
    "cv": "stddev_pop(x) / nullif(avg(x), 0)",
    "skewness": "avg(power(x - m, 3)) / nullif(power(any_value(sd), 3), 0)",
    "kurtosis": "avg(power(x - m, 4)) / nullif(power(any_value(sd), 4), 0) - 3",
    "consistency": "100 * greatest(0, 1 - abs(stddev_pop(x) / nullif(avg(x), 0)))",
    "raw": "arg_max(x, k)",
}


def _type_query(kind: str, sql_expr: str) -> None:
    def run(t):
        out = stats.window_stats(measurements(t), [kind])
        return out.select("entity", "subtopic", settle(F.col(f"`{kind}`"), 6).alias("hyperprediction"))

    register(
        "agg_" + kind.lower().replace("-", "_"),
        run,
        f"SELECT entity, subtopic, round({sql_expr} + 1e-9, 6) AS hyperprediction FROM ({WINDOW_SQL}) "
        "GROUP BY entity, subtopic",
    )


for _kind, _sql in TYPE_SQL.items():
    _type_query(_kind, _sql)

register(
    "agg_spikedetect",
    lambda t: stats.preprocess(measurements(t), ["spikedetect"]),
    f"""SELECT entity, subtopic, 'spikedetect' AS preprocesstype,
    count_if(abs(x - px) > 3 * dsd)::DOUBLE AS hyperprediction
    FROM (SELECT *, stddev_pop(x - px) OVER (PARTITION BY entity, subtopic) AS dsd FROM ({WINDOW_SQL}))
    GROUP BY entity, subtopic""",
)


@query(
    "agg_multi_types",
    f"""WITH s AS (SELECT entity, subtopic, round(avg(x), 6) AS a, round(regr_slope(x, k), 6) AS t,
      round({TYPE_SQL['anomprob']}, 6) AS p FROM ({WINDOW_SQL}) GROUP BY entity, subtopic)
    SELECT entity, subtopic, unnest(['avg', 'trend', 'anomprob']) AS preprocesstype,
      unnest([a, t, p]) AS hyperprediction FROM s""",
)
def agg_multi_types(t):
    out = stats.preprocess(measurements(t), ["avg", "trend", "anomprob"])
    return out.withColumn("hyperprediction", F.round("hyperprediction", 6))


@query(
    "agg_type_per_stream",
    f"""SELECT entity, subtopic, CASE subtopic WHEN 'click' THEN 'avg' ELSE 'max' END AS preprocesstype,
      round(CASE subtopic WHEN 'click' THEN avg(x) ELSE max(x) END, 6) AS hyperprediction
    FROM ({WINDOW_SQL}) WHERE subtopic IN ('click', 'view') GROUP BY entity, subtopic""",
)
def agg_type_per_stream(t):
    streams = stats.pair_streams(["click", "view"], ["avg", "max"])
    out = stats.per_stream_stats(measurements(t), streams)
    return out.withColumn("hyperprediction", F.round("hyperprediction", 6))


@query(
    "agg_shipment_window_stats",
    f"""SELECT entity, subtopic, round(avg(x) + 1e-7, 4) AS avg, round(stddev_pop(x) / nullif(avg(x), 0), 6) AS cv,
      round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25) + 1e-7, 4) AS iqr, min(x) AS min, max(x) AS max
    FROM ({SHIPMENT_SQL.format(n=200)}) GROUP BY entity, subtopic""",
)
def agg_shipment_window_stats(t):
    out = stats.window_stats(shipments(t), ["avg", "cv", "iqr", "min", "max"], maxrows=200)
    return out.select(
        "entity", "subtopic", settle(F.col("avg"), 4).alias("avg"), F.round("cv", 6).alias("cv"),
        settle(F.col("iqr"), 4).alias("iqr"), "min", "max",
    )


def _clean_query(kind: str, good: str, extra: str) -> None:
    def run(t):
        return stats.clean(measurements(t), kind).drop("ts")

    keep = int(kind.rsplit("_", 1)[1])
    register(
        "agg_" + kind,
        run,
        f"""SELECT entity, subtopic, x AS hyperprediction, msgid FROM
        (SELECT w.*, {extra} FROM ({WINDOW_SQL}) w) WHERE {good}
        QUALIFY row_number() OVER (PARTITION BY entity, subtopic ORDER BY ts DESC, msgid DESC) <= {keep}""",
    )


_P = "OVER (PARTITION BY entity, subtopic)"
_clean_query(
    "datacleaniqr_10000",
    "x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)",
    f"quantile_cont(x, 0.25) {_P} AS q1, quantile_cont(x, 0.75) {_P} AS q3",
)
_clean_query("datacleanstd2_5", f"abs({_Z}) <= 2", "1 AS one")


@query(
    "agg_datacleanmad_10000",
    f"""WITH a AS (SELECT *, median(x) {_P} AS med FROM ({WINDOW_SQL})),
    b AS (SELECT *, median(abs(x - med)) {_P} AS mad FROM a)
    SELECT entity, subtopic, x AS hyperprediction, msgid FROM b
    WHERE CASE WHEN mad = 0 THEN x = med ELSE abs(x - med) <= 3 * 1.4826 * mad END""",
)
def agg_datacleanmad(t):
    return stats.clean(measurements(t), "datacleanmad_10000").drop("ts")


@query(
    "agg_geodiff",
    f"""WITH p AS (SELECT entity, subtopic, arg_min(lat, k) AS la1, arg_min(lon, k) AS lo1,
      arg_max(lat, k) AS la2, arg_max(lon, k) AS lo2
      FROM (SELECT *, x % 90 AS lat, json_extract_string(props, '$.k')::DOUBLE AS lon FROM ({WINDOW_SQL}))
      GROUP BY entity, subtopic)
    SELECT entity, subtopic, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(la2 - la1) / 2), 2)
      + cos(radians(la1)) * cos(radians(la2)) * power(sin(radians(lo2 - lo1) / 2), 2)))), 4) AS hyperprediction
    FROM p""",
)
def agg_geodiff(t):
    """Distance between the first and last position; positions come from value and payload."""
    events = t.events.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("subtopic"), "value", "ts",
        F.col("event_id").alias("msgid"), (F.col("value") % 90).alias("lat"),
        F.get_json_object("props", "$.k").cast("double").alias("lon"),
    )
    out = stats.window_stats(events, ["geodiff"])
    return out.select("entity", "subtopic", F.round("geodiff", 4).alias("hyperprediction"))


@query(
    "agg_uniquestrcount",
    f"""SELECT entity, subtopic, count(DISTINCT json_extract_string(props, '$.k'))::DOUBLE AS hyperprediction
    FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def agg_uniquestrcount(t):
    events = t.events.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("subtopic"), "value", "ts",
        F.col("event_id").alias("msgid"), F.get_json_object("props", "$.k").alias("value_str"),
    )
    out = stats.window_stats(events, ["uniquestrcount"])
    return out.select("entity", "subtopic", F.col("uniquestrcount").alias("hyperprediction"))


@query(
    "agg_avgtimediff",
    f"""SELECT entity, subtopic, round(avg(epoch_us(ts) - epoch_us(pts)) / 1e6 + 1e-7, 4) AS hyperprediction
    FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def agg_avgtimediff(t):
    out = stats.window_stats(measurements(t), ["avgtimediff"])
    return out.select("entity", "subtopic", settle(F.col("avgtimediff"), 4).alias("hyperprediction"))


@query(
    "agg_timediff",
    f"""SELECT entity, subtopic, 'timediff' AS preprocesstype,
      round(avg(epoch_us(ts) - epoch_us(pts)) / 1e6 + 1e-7, 4) AS hyperprediction FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def agg_timediff(t):
    """The mean gap as an emitted record."""
    out = stats.preprocess(measurements(t), ["timediff"])
    return out.withColumn("hyperprediction", settle(F.col("hyperprediction"), 4))


@query(
    "agg_dataage",
    f"""SELECT entity, subtopic, round(min(epoch_us(TIMESTAMP '{NOW}') - (epoch_us(ts) - 5 * 3600000000::BIGINT))
      / 3600000000, 6) AS hyperprediction FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def agg_dataage(t):
    out = stats.window_stats(measurements(t), ["dataage_-5_hour"], now=NOW)
    return out.select("entity", "subtopic", F.round(F.col("`dataage_-5_hour`"), 6).alias("hyperprediction"))


@query(
    "agg_window_metadata",
    f"""SELECT entity, subtopic, epoch_us(min(ts)) // 1000000 AS window_start_unix,
      epoch_us(max(ts)) // 1000000 AS window_end_unix, count(*) AS numberofmessages,
      array_to_string(list_sort(list(msgid)), ',') AS msgiddata
    FROM ({WINDOW_SQL}) GROUP BY entity, subtopic""",
)
def agg_window_metadata(t):
    out = stats.window_metadata(measurements(t))
    return out.select(
        "entity", "subtopic", "window_start_unix", "window_end_unix", "numberofmessages",
        F.array_join(F.transform("msgiddata", lambda e: e.cast("string")), ",").alias("msgiddata"),
    )


@query(
    "agg_describe",
    """SELECT l_suppkey AS entity, count(l_quantity) AS n, round_even(avg(l_quantity), 2) AS mean,
      round_even(stddev_samp(l_quantity), 2) AS std, min(l_quantity) AS min, max(l_quantity) AS max
    FROM lineitem GROUP BY l_suppkey""",
)
def agg_describe(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("entity"), "l_quantity")
    return stats.describe(rows, ["entity"], "l_quantity")


@query(
    "agg_average_verdict",
    """SELECT event_type, round_even(avg(value), 0) AS average,
      'The average value is ' || printf('%.1f', round_even(avg(value), 0)) || ', and it is ' ||
      CASE WHEN round_even(avg(value), 0) >= 50 THEN 'outside normal limits because it exceeds: '
      ELSE 'within normal limits because it does not exceed: ' END || '50.0' AS verdict
    FROM events GROUP BY event_type""",
)
def agg_average_verdict(t):
    return stats.average_verdict(t.events, ["event_type"], "value", 50)


@query(
    "agg_risk_summary",
    "SELECT l_returnflag, count_if(l_discount >= 0.08) AS anomaly_found, count(*) AS anomaly_total, "
    "count_if(l_discount >= 0.08) || ' found out of ' || count(*) AS label FROM lineitem GROUP BY l_returnflag",
)
def agg_risk_summary(t):
    return reports.risk_summary(t.lineitem, ["l_returnflag"], "l_discount", F.lit(0.08))


_OPT_SQL = """(SELECT o_orderstatus AS dependent, o_totalprice AS objective,
  (o_custkey % 10)::DOUBLE AS v1, (o_orderkey % 7)::DOUBLE AS v2 FROM orders)"""


def _optimisations(t):
    values = F.create_map(
        F.lit("custkey"), (F.col("o_custkey") % 10).cast("double"),
        F.lit("orderkey"), (F.col("o_orderkey") % 7).cast("double"),
    )
    return t.orders.select(
        F.col("o_orderstatus").alias("dependent"), F.col("o_totalprice").alias("objective"),
        values.alias("optimal_values"),
    )


@query(
    "agg_optimisation_objective",
    f"SELECT dependent, round(avg(objective), 2) AS mean_objective FROM {_OPT_SQL} GROUP BY dependent",
)
def agg_optimisation_objective(t):
    return reports.mean_objective(_optimisations(t), ["dependent"], "objective")


@query(
    "agg_optimisation_variables",
    f"""SELECT dependent, variable, round(sum(v), 2) AS total, count(v) AS n, round(avg(v), 2) AS mean,
      min(v) AS min, max(v) AS max
    FROM (SELECT dependent, 'custkey' AS variable, v1 AS v FROM {_OPT_SQL}
      UNION ALL SELECT dependent, 'orderkey', v2 FROM {_OPT_SQL}) GROUP BY dependent, variable""",
)
def agg_optimisation_variables(t):
    return reports.variable_report(_optimisations(t), ["dependent"], "optimal_values")


@query(
    "agg_list_tools",
    """SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax, l_quantity) AS largest,
      round_even((l_discount + l_tax + l_quantity) / 3, 2) AS average FROM lineitem""",
)
def agg_list_tools(t):
    xs = F.array("l_discount", "l_tax", "l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", tools.list_max(xs).alias("largest"), tools.list_average(xs).alias("average")
    )


@query(
    "udf_named_tools",
    """SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS added, greatest(l_discount, l_tax, l_quantity) AS largest,
      round_even((l_discount + l_tax + l_quantity) / 3, 2) AS average FROM lineitem""",
)
def udf_named_tools(t):
    """The scalar tools called by name from SQL."""
    tools.register_tools(t.spark)
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "tool_add(l_quantity, l_tax) AS added",
        "tool_max(array(l_discount, l_tax, l_quantity)) AS largest",
        "tool_average(array(l_discount, l_tax, l_quantity)) AS average")


@query(
    "agg_response_rollup",
    """SELECT conv_id, role, count(*) AS responses, sum(length(text))::BIGINT AS characters,
      array_to_string(list(turn ORDER BY turn), ',') AS turns
    FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 50)
    GROUP BY conv_id, role""",
)
def agg_response_rollup(t):
    out = reports.response_rollup(t.conversations, ["conv_id", "role"], ["turn"], "text", 50)
    return out.select(
        "conv_id", "role", "responses", "characters",
        F.array_join(F.transform("answers", lambda a: a["turn"].cast("string")), ",").alias("turns"),
    )
