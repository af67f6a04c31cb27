import json
import math

import pytest
from pyspark.sql import functions as F

from rillmark.functions import text
from rillmark.functions.jsonpath import is_json, is_json_object, json_elements, json_path, with_json_paths
from rillmark.operators import conditions as cond
from rillmark.operators import extract as ex
from rillmark.operators import prompts, scada
from tests.conftest import rows


def _docs(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)],
                                 "id int, payload string")


def test_paths(spark):
    assert json_path("a.0.b-c.d") == "$.a[0]['b-c'].d"
    df = _docs(spark, {"a": [{"b": 1}, {"b": "x"}], "c": {"d": None}}, {"a": []}, "broken {", {"a": 3})
    out = with_json_paths(df, "payload", {"p": "a.0.b", "q": "a.1.b", "r": "c.d", "s": "none.at.all"})
    assert rows(out.select("id", "p", "q", "r", "s"))[0] == (0, "1", "x", None, None)
    assert all(r[1:] == (None, None, None, None) for r in rows(out.select("id", "p", "q", "r", "s"))[1:])
    both = with_json_paths(df, "payload", {"whole": "c", "part": "c.d", "first": "a.0.b"}).orderBy("id").first()
    assert both["first"] == "1" and both["whole"] is not None


@pytest.mark.parametrize("value, valid, obj", [
    ('{"a":1}', True, True), (' {"a":{"b":[1]}} ', True, True), ("[1]", True, False), ("1", True, False),
    ('"x"', True, False), ("null", True, False), ("", False, False), ('{"a":1}}', False, False), ('{"a":1},{"b":2}', False, False),
    ('{"a":1}],[{"b":2}', False, False), ('{"a":1},"|end|"', False, False), ("{'a':1}", False, False), (None, False, False),
    ('{"a"', False, False),
])
def test_json_validity(spark, value, valid, obj):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(is_json(F.col("v")).alias("j"), is_json_object(F.col("v")).alias("o")).first()
    assert (row["j"], row["o"]) == (valid, obj)


def test_elements_of_arrays_and_single_objects(spark):
    df = spark.createDataFrame([('[{"a":1},"x",[2]]',), ('{"b":1}',)], "v string")
    got = [r[0] for r in df.select(json_elements(F.col("v"))).collect()]
    assert got == [['{"a":1}', "x", "[2]"], ['{"b":1}']]


SPEC = ("uid=subject.reference,filter:kind=Obs,payload=payload.payload~subtopics=component.0.code,component.1.code~"
        "values=component.0.value,component.1.value~identifiers=component.0.name,component.1.name~datetime=at~"
        "msgid=id:line~latlong=")


def test_criteria():
    spec = ex.parse_criteria(SPEC)
    assert (spec.uid, spec.record_filter, spec.payload) == ("subject.reference", ("kind", "Obs"), "payload.payload")
    assert spec.msgid == ["id", "line"] and spec.latlong == []
    with pytest.raises(ValueError):
        ex.parse_criteria("uid=a~subtopics=x,y~values=z")
    with pytest.raises(ValueError):
        ex.parse_criteria("uid=a~wrong=b")
    assert ex.parse_attributes("oem=a.b,lat=n/a") == {"oem": "a.b", "lat": None}


def test_missing_component_and_other_kinds(spark):
    def doc(kind, components):
        inner = {"subject": {"reference": "p1"}, "kind": kind, "component": components, "at": "2024-01-02", "id": 7, "line": 2}
        return {"payload": json.dumps({"payload": json.dumps(inner)})}

    df = _docs(spark, doc("Obs", [{"code": "c0", "value": 1.5, "name": "n0"}, {"code": "c1", "value": "text", "name": "n1"}]),
               doc("Obs", [{"code": "c0", "value": 2}]), doc("Obs", []), doc("Other", [{"code": "c0", "value": 1}]), "junk")
    out = ex.extract(df, "payload", ex.parse_criteria(SPEC), {"oem": None, "who": "subject.reference"}, keep=("id",))
    got = sorted(out.select("id", "subtopic", "value_num", "value_str", "identifier", "msgid", "oem", "who").collect())
    assert [tuple(r) for r in got] == [
        (0, "c0", 1.5, "1.5", "n0", "7:2", "n/a", "p1"), (0, "c1", None, "text", "n1", "7:2", "n/a", "p1"),
        (1, "c0", 2.0, "2", None, "7:2", "n/a", "p1")]


def test_terms():
    parsed = cond.parse_terms("timediff_-5_hour,greaterthan,30,fieldcontainsnot,m.oem,A,B,count,greaterthan,10")
    assert [(t.name, t.op, t.values) for t in parsed] == [
        ("timediff_-5_hour", "greaterthan", ["30"]), ("fieldcontainsnot", None, ["m.oem", "A", "B"]),
        ("count", "greaterthan", ["10"])]
    assert [t.name for t in cond.parse_terms("equalor a,b")] == ["equalor"]
    for bad in ("nothing,1", "sum,equalor,3", "equal"):
        with pytest.raises(ValueError):
            cond.parse_terms(bad)


def test_missing_fields_do_not_pass_negations(spark):
    df = _docs(spark, {"a": "xy"}, {"b": 1}, {"a": "z"})
    resolve = cond.json_fields(F.col("payload"))
    spec = cond.parse_condition("custom:a~condition:fieldcontainsnot,a,x")
    assert rows(cond.apply_conditions(df, spec, resolve).select("id")) == [(2,)]


def test_group_conditions_on_edges(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "bad", "x"), ("c", "9", "z")], "entity string, v string, k string")
    names = {"v": "v", "k": "k"}
    spec = cond.parse_condition("custom:v~condition:sumif,greaterthan,0,fieldequalor,k,x")
    out = cond.apply_conditions(df, spec, lambda p: F.col(names[p]), ["entity"])
    assert rows(out) == [("a", 1.0)]


def test_selection_and_bounds(spark):
    df = spark.createDataFrame([("1", 5.0), ("2", 50.0)], "entity string, v double")
    assert cond.select_entities(df, -999).count() == cond.select_entities(df, "-1").count() == 2
    assert cond.select_entities(df, 1).count() == 1
    out = cond.check_bounds(df, {"v": (0, 10)})
    assert rows(out.select("entity", "out_of_bounds")) == [("1", []), ("2", ["v"])]


def test_text_cleaning(spark):
    df = spark.createDataFrame([('\t "a";b&c\\n\r\n d\'e  ',)], "t string")
    assert df.select(text.clean_for_ingest(F.col("t"))).first()[0] == "a b c de"
    answer = spark.createDataFrame([("He said: \"A\\nB\" `x`\t\\1 \\z \\\\q",)], "t string")
    assert answer.select(text.clean_answer(F.col("t"))).first()[0] == "he said: ab x1 z q"


FIELDS = {
    "vesselIndex": 27.0, "operatingPressure": 66.67, "operatingTemperature": 123.42, "gasFlowRate": 217.28,
    "gasDensity": 1.195, "gasCompressabilityFactor": 0.842, "gasViscosity": 1.2777e-05, "hclFlowRate": 25.08,
    "hclDensity": 1484.0, "hclViscosity": 0.000895, "hclSurfaceTension": 0.065, "waterFlowRate": 39.318,
    "waterDensity": 10.0, "waterViscosity": 0.00118, "waterSurfaceTension": 0.07128, "hclWaterSurfaceTension": 0.03311,
    "phseInversionCriticalWaterCut": 0.261, "solidFlowRate": 9.99, "solidDensity": 14.9,
}
FORMULAS = (
    "Qg=gasFlowRate,Qw=waterFlowRate,Qh=hclFlowRate,Qs=solidFlowRate,F_liq=Qh+Qw+Qs,"
    "rho_l=(Qh*gasDensity+Qw*waterDensity+Qs*2500)/F_liq,F_total=Qg+F_liq,f_gas=Qg/F_total,"
    "raw_co=(Qw+Qh+Qs)/((Qw+Qh+Qs)+Qg+1e-6),carryover=(15.0*(raw_co**0.3))/1000,"
    "density_ratio=waterDensity/(gasDensity+1e-6),emulsion_ratio=waterSurfaceTension/(hclWaterSurfaceTension+1e-6)"
)


def test_derived_variables_known_values(spark):
    df = spark.createDataFrame([(FIELDS,)], "readings map<string,double>")
    out = scada.derive(df, scada.from_map(F.col("readings"), list(FIELDS)), {}, FORMULAS).first()
    want = {"F_liq": 74.388, "rho_l": 341.428061, "F_total": 291.668, "f_gas": 0.7449565945, "raw_co": 0.2550434046,
            "carryover": 0.009955784519, "density_ratio": 8.368193834, "emulsion_ratio": 2.152758902}
    for name, value in want.items():
        assert out["computed_analytics"][name] == pytest.approx(value, rel=1e-8)
        assert out["raw_fields"][name] == round(out["computed_analytics"][name], 6)
    assert out["raw_fields"]["gasViscosity"] == 1.3e-05


@pytest.mark.parametrize("formula, want", [
    ("y = x / z", 0.0), ("y = nope + 1", 0.0), ("y = later, later = 2", 0.0), ("y = x ** 2 - 1", 8.0),
    ("y = (0 - x) ** 0.5", 0.0), ("y = x +", 0.0), ("y = 7 // 2 + 7 % 4", 6.0), ("y = -x if x > 2 else x", -3.0),
    ("y = __import__", 0.0), ("y = 1e308 * 1e308", 0.0), ("a = y2, y2 = 4, a = y2, y = a", 4.0), ("y = 'text'", 0.0),
])
def test_expressions(spark, formula, want):
    df = spark.createDataFrame([(3.0, 0.0)], "x double, z double")
    out, names = scada.create_variables(df, formula, {"x": "x", "z": "z"})
    assert out.select(names["y"]).first()[0] == want


def test_registers(spark):
    df = spark.createDataFrame([(1, [5, 0, 7, 9])], "id int, r array<int>")
    assert rows(scada.register_rows(df, "r", ["a", "b", "c"], ("id",))) == [
        (1, "a", 5.0), (1, "c", 7.0), (1, "reg_0004", 9.0)]


def test_topology(spark):
    vessels = spark.createDataFrame([(1, "a"), (2, "b"), (11, "c")], "id int, name string")
    edges = spark.createDataFrame([(11, 1, 0.8, 0.5), (2, 1, 6.2, 0.0), (1, 11, 3.0, 1.0), (2, 11, 3.2, 0.0)],
                                  "from int, to int, f_in double, f_gas double")
    got = {r["id"]: (round(r["inflow"], 6), round(r["gas"], 6)) for r in scada.vessel_inflow(vessels, edges).collect()}
    assert got == {1: (7.0, 0.4), 2: (0.0, 0.0), 11: (6.2, 3.0)}


def test_check_json(spark):
    texts = ['{"a": "b"}', '{"Response": "cut', '{"Response": "x}', '{"Model": "m', "}", "  "]
    df = _docs(spark, *texts)
    value, status = prompts.check_json(F.col("payload"), "m", "e", "0.1")
    got = {r["id"]: (r["s"], r["v"]) for r in df.select("id", status.alias("s"), value.alias("v")).collect()}
    assert [got[i][0] for i in range(6)] == ["valid", "patched", "patched", "patched", "rejected", "rejected"]
    assert json.loads(got[2][1])["Model"] == "m" and json.loads(got[3][1]) == {"Model": "m"}


def test_batch_prompt_keeps_all_records(spark):
    df = spark.createDataFrame([(i, "Avg", f"v{i}~uid=1", float(i)) for i in range(5)],
                               "n int, preprocesstype string, identifier string, hp double")
    row = prompts.batch_prompt(df, "hp", ["n"], "Ctx", "Go.", 3).first()
    assert row["message"] == "Ctx.  Data: 2.0 (Identifier=v2), 3.0 (Identifier=v3), 4.0 (Identifier=v4), .  Go."
    assert prompts.batch_prompt(df, "hp", ["n"], "Ctx", "Go.", 3, types="zzz").count() == 0


def test_combined_document_is_json(spark):
    df = spark.createDataFrame([(1, 1, "agent", '{"x": 1}'), (1, 2, "lead", "broken"), (2, 1, "supervisor", '{"y": 2}')],
                               "k int, n int, level string, rec string")
    got = {r["k"]: json.loads(r["document"]) for r in prompts.combine_agents(df, ["k"], ["n"], "rec", 10).collect()}
    assert got[1][0] == {"x": 1} and got[1][1]["Agent_Name"] == "Team Lead agent" and len(got[1]) == 3
    assert got[2][0]["Status"] == "no data found" and got[2][2] == {"y": 2}


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([("0.125", "1", "a~u=x"), ("2.5", "0", "a~u=x"), ("2.5", None, "a~u=x")],
                               "hyperprediction string, islogistic string, identifier string").withColumn(
        "preprocesstype", F.lit("Avg"))
    got = [(r["hp"], r["pt"], r["pv"], r["uid"]) for r in ex.normalise_prediction(df).collect()]
    assert got == [(12, "probability prediction", "machine learning", "x"), (2, "prediction", "machine learning", "x"),
                   (2, "Avg", "a", "x")]
    assert math.isclose(got[0][0], round(12.5))
