import base64
import json
import math

import pytest
from pyspark.sql import functions as F

from rillmark.operators import memory, terms, threat
from rillmark.functions.text import java_regex, strip
from rillmark.sources import files, sinks
from tests.conftest import rows


def _entity(spark, line):
    row = spark.createDataFrame([(line,)], "l string").select(threat.line_entity(strip(F.col("l"))).alias("h")).first()
    return None if row["h"] is None else tuple(row["h"])


@pytest.mark.parametrize("line, want", [
    ("login from 10.0.0.7, port 22", ("10.0.0.7", "network_ip")),
    ("peer fe80:0:0:0:1:2:3:4 up", ("fe80:0:0:0:1:2:3:4", "network_ip_v6")),
    ("opened /etc/passwd now", ("/etc/passwd", "filesystem_resource")),
    (r"ran C:\Windows\cmd.exe today", (r"C:\Windows\cmd.exe", "filesystem_resource")),
    ("edited [nginx.conf]", ("nginx.conf", "filesystem_resource")),
    ("GET https://evil.example.com/x?y", ("https://evil.example.com/x?y", "network_endpoint_domain")),
    ("reboot of Router-1 done", ("Router-1", "network_appliance")),
    ("su by (root) ok", ("root", "privileged_system_context")),
    ("Administrator changed 1.2.3.4", ("1.2.3.4", "network_ip")),
    ("rooted in the system's past", None),
    ("plain words only", None),
    ("a-Router-1", None),
    ("first a.sh then 9.9.9.9", ("a.sh", "filesystem_resource")),
    ("ü1.2.3.4 is glued", None),
    ("_1.2.3.4_", ("1.2.3.4", "network_ip")),
])
def test_entity_cascade(spark, line, want):
    assert _entity(spark, line) == want


def test_hand_computed_scores(spark):
    weights = threat.Weights()
    df = spark.createDataFrame([("Discovery", "x", "10.1.1.1"), ("Discovery", "x", "host")], "t string, q string, e string")
    got = [r[0] for r in df.select(threat.pattern_score(F.col("t"), F.col("q"), F.col("e"), weights)).collect()]
    assert got == [61.24, round(math.sqrt(5 * 4.5) * 10, 2)]
    assert threat.Weights.from_profile({"fallbacks": {"default_a_w": 4.0}}).default_complexity == 4.0


def test_drift_cases(spark):
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "event_type string, share double")
    now = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "event_type string, share double")
    got = dict(rows(threat.stability_index(base, now, "event_type")))
    assert got["a"] == 0.0182 and got["c"] == 0.6901


def test_raw_and_single_row_batch(spark):
    found = spark.createDataFrame(
        [("f", 1, "threat_vector_network_ip", "10.1.1.1", "Discovery", "x", False, ["a"])],
        "file string, line_number int, event_type string, entity string, tactic string, technique string, "
        "validated boolean, attributes array<string>")
    row = threat.score_batch(found, threat.Weights()).first()
    assert (row["pattern_score"], row["raw_score"], row["normalised_score"]) == (61.24, 82.49, 50.0)


RULES = threat.rules_from({
    "login": {"pattern": r"user=(?P<entity>\w+)|uid=(?P<entity_alt>\w+) from (?P<src>\S+)", "mitre_tactic": "T1",
              "mitre_technique": "Q1"},
    "windows_cbs_generic_stream": {"pattern": "CBS", "mitre_tactic": "T1", "mitre_technique": "Q9"},
    "late": {"pattern": "user", "mitre_tactic": "T2", "mitre_technique": "Q2"},
    "broken": {"pattern": "(", "mitre_tactic": "T2", "mitre_technique": "Q2"},
}, {"T1": ["Q1"]})


def test_elements_kinds(spark):
    lines = [
        "user=ann in", "uid=bob from 1.1.1.1", "CBS 2.2.2.2", "a user", "", "  ", "no interest",
        json.dumps({"a": 1, "user": "eve", "x": None}), json.dumps({"z": "first"}), "{broken 3.3.3.3}", "{}",
        '{"a": 1}}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, line string")
    got = {r["n"]: r for r in threat.elements(df, "line", RULES, ["n"]).collect()}
    assert set(got) == {0, 1, 3, 7, 8, 9, 10}
    assert (got[0]["event_type"], got[0]["entity"], got[0]["validated"], got[0]["attributes"]) == ("login", "ann", True, [])
    assert (got[1]["entity"], got[1]["attributes"]) == ("bob", ["1.1.1.1"])
    assert (got[3]["event_type"], got[3]["entity"], got[3]["validated"]) == ("late", "unknown_entity", False)
    assert (got[7]["entity"], got[7]["attributes"], got[7]["tactic"]) == ("eve", ["1", "eve"], "Initial Access")
    assert got[8]["entity"] == "first" and got[10]["entity"] == "unclassified"
    assert got[9]["event_type"] == "threat_vector_network_ip"


def test_first_element_per_file_and_entity(spark):
    df = spark.createDataFrame([("f", 3, "1.1.1.1"), ("f", 1, "1.1.1.1"), ("g", 9, "1.1.1.1")], "file string, n int, line string")
    out = threat.unique_elements(threat.elements(df, "line", [], ["file", "n"]), "file", "n")
    assert rows(out.select("file", "n")) == [("f", 1), ("g", 9)]


def test_regex_translation():
    assert java_regex(r"(?P<a_b>x)(?P=a_b)\Z") == r"(x)\1\z"


def test_numbered_attributes(spark):
    row = spark.createDataFrame([(["x", None, "y"],)], "a array<string>").select(
        threat.numbered_attributes(F.col("a")).alias("m")).first()
    assert row["m"] == {"attr1": "x", "attr2": "y"}


def test_term_groups(spark):
    groups = terms.parse_groups(r"rgx:p([a-z]+)ch ~~~ |authentication failure,--entity-- bad ~~~ @x y,z ~~~ plain")
    assert [(g.terms, g.every, g.regex) for g in groups] == [
        (("p([a-z]+)ch",), False, True), (("authentication failure", "--entity-- bad"), False, False),
        (("x y", "z"), True, False), (("plain",), False, False)]
    df = spark.createDataFrame(
        [("bob", "a patch, bob bad"), ("al", "bob bad"), ("al", "x y only"), ("al", "x y and z")], "e string, t string")
    got = [r[0] for r in df.select(terms.found_terms(F.col("t"), groups, F.col("e"))).collect()]
    assert got == [["p([a-z]+)ch", "--entity-- bad"], [], [], ["x y", "z"]]
    good, bad = terms.valid_groups([terms.TermGroup(("(",), regex=True), *groups])
    assert len(good) == 4 and len(bad) == 1


def test_term_table_against_brute_force(spark):
    texts = ["the quick brown fox", "quick", "xbrown foxy", "über alles gut so", "", "a-b c", "ends with q", "== --> x"]
    needles = ["quick brown fox", "brown fox", "q", "k b", "alles", "ber alles gut s", "zz", "a-b", "the quick brown fox", "->", " --", "=", "> x"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "no int, term string")
    got = rows(terms.match_term_table(t, ["id"], "text", n, "term", "no"))
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if y in x)


def test_patterns_of_either_engine_are_rejected_with_a_reason(spark):
    rules = [threat.Rule("bad", "user=[^[]+x", "t", "u"), threat.Rule("open", "(", "t", "u"),
             threat.Rule("good", r"user=(?P<entity>\w+)", "t", "u")]
    rejected = threat.rejected_rules(spark, rules).collect()
    assert [r["name"] for r in rejected] == ["bad", "open"] and all(r["reason"] for r in rejected)
    df = spark.createDataFrame([("f", 1, "user=bob")], "file string, n int, line string")
    assert [r["entity"] for r in threat.elements(df, "line", rules, ["file", "n"]).collect()] == ["bob"]
    groups = terms.parse_groups("rgx:[^[]b ~~~ rgx:b+")
    assert [g.terms for g in terms.valid_groups(groups)[1]] == [("[^[]b",)]
    assert df.select(terms.found_terms(F.col("line"), groups)).first()[0] == ["b+"]


def test_many_short_terms(spark):
    t = spark.createDataFrame([(i, f"x w{i} y") for i in range(0, 20_000, 1000)], "id int, text string")
    n = spark.range(20_000).selectExpr("id AS no", "concat('w', id, ' ') AS term")
    got = rows(terms.match_term_table(t, ["id"], "text", n, "term", "no"))
    assert got == [(i, i) for i in range(0, 20_000, 1000)]


def test_many_terms(spark):
    spec = "|" + ",".join(f"t{i:03d}" for i in range(130))
    df = spark.createDataFrame([("e", 0, "t000 t129"), ("e", 1, "t129"), ("e", 2, "t001"), ("f", 0, "none")],
                               "entity string, window long, text string")
    counts = memory.memory_counts(memory.window_hits(df, "text", terms.parse_groups(spec)), 10)
    assert rows(counts) == [("e", 3, 3, 1), ("f", 1, 0, 0)]


def test_remembered_windows_and_levels(spark):
    data = [("e", w, "hit" if w in (0, 9) else "no") for w in range(10)]
    df = spark.createDataFrame(data, "entity string, window long, text string")
    hits = memory.window_hits(df, "text", terms.parse_groups("hit"))
    assert rows(memory.memory_counts(hits, 10)) == [("e", 10, 2, 1)]
    assert rows(memory.memory_counts(hits, 5)) == [("e", 5, 1, 0)]
    levels = spark.createDataFrame([(0.1,), (0.4,), (0.7,)], "s double").select(memory.activity_level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["low", "medium", "high"]


def test_reference_files(spark, scratch):
    import os

    os.makedirs(scratch)
    profile = {"attack_complexity_weights": {"z": 1.0, "a": 2.5}, "entity_vulnerability_weights": {"k": 3},
               "fallbacks": {"default_a_w": 5}}
    docs = {"matrix.json": {"T": ["q1", "q2"]}, "weights.json": profile,
            "rules.json": {"z": {"pattern": "x", "mitre_tactic": "T", "mitre_technique": "q1"},
                           "a": {"pattern": "y", "mitre_tactic": "T", "mitre_technique": "q7"}}}
    for name, doc in docs.items():
        with open(f"{scratch}/{name}", "w") as f:
            json.dump(doc, f, indent=1)
    assert rows(files.tactic_matrix(spark, f"{scratch}/matrix.json")) == [("T", "q1"), ("T", "q2")]
    assert [r["name"] for r in files.rule_table(spark, f"{scratch}/rules.json").orderBy("ord").collect()] == ["z", "a"]
    weights = rows(files.weight_table(spark, f"{scratch}/weights.json"))
    assert ("attack_complexity_weights", 1, "a", 2.5) in weights and len(weights) == 4


def test_baseline_clock(spark, scratch):
    now = spark.createDataFrame([("a", 1.0)], "event_type string, share double")
    assert sinks.load_baseline(spark, scratch) is None
    sinks.next_baseline(None, now, "2024-01-01 00:00:00", 24).write.parquet(scratch)
    stored = sinks.load_baseline(spark, scratch)
    new = spark.createDataFrame([("b", 1.0)], "event_type string, share double")
    young = sinks.next_baseline(stored, new, "2024-01-01 23:59:59", 24).collect()
    due = sinks.next_baseline(stored, new, "2024-01-02 00:00:00", 24).collect()
    assert [r["event_type"] for r in young] == ["a"] and [r["event_type"] for r in due] == ["b"]


def test_encoded_terms(spark):
    from rillmark.functions.text import decode_terms, encode_terms

    texts = ["rgx:a+ ~~~ |x,y", "é" * 100, "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", encode_terms(F.col("t")).alias("e"))
    got = df.select("t", "e", decode_terms(F.col("e")).alias("d"), decode_terms(F.concat(F.lit("*"), "e")).alias("b")).collect()
    assert [r["d"] for r in got] == texts and got[0]["b"] is None
    assert [r["e"] for r in got] == [t if t is None else base64.b64encode(t.encode()).decode() for t in texts]
