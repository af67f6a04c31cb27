import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.operators import joins, windows
from tests.conftest import rows


def _hot(spark, n=3000, seed=1):
    rng = random.Random(seed)
    # One key holds more than a third of the rows.
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", i, rng.randrange(500)) for i in range(n)]
    return data, spark.createDataFrame(data, "key string, pos long, v long").repartition(8)


@pytest.mark.parametrize("salts", [1, 16])
def test_last_n_is_independent_of_salting(spark, salts):
    data, df = _hot(spark)
    want = []
    for key in {d[0] for d in data}:
        newest = sorted((d for d in data if d[0] == key), key=lambda d: -d[1])[:7]
        want += [(*d, i + 1) for i, d in enumerate(newest)]
    assert rows(windows.last_n(df, ["key"], ["pos"], 7, salts)) == sorted(want)


def test_hot_keys_are_split_at_any_shuffle_width(spark):
    _, df = _hot(spark)
    plan = windows.last_n(df, ["key"], ["pos"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_last_n_cuts_before_the_shuffle(spark):
    _, df = _hot(spark)
    plan = windows.last_n(df, ["key"], ["pos"], 2000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("chunk", [1, 64, 1 << 20])
def test_prefix_values(spark, how, chunk):
    data, df = _hot(spark, 800)
    got = {(r["key"], r["pos"]): (r["out"], r["whole"]) for r in
           windows.prefix_values(df, ["key"], "pos", "v", how, "out", chunk, total="whole").collect()}
    fold = sum if how == "sum" else max
    for key in {d[0] for d in data}:
        mine = [d for d in data if d[0] == key]
        for i, d in enumerate(mine):
            before = [e[2] for e in mine[:i]]
            assert got[d[0], d[1]] == (fold(before) if before else None, fold(e[2] for e in mine))


def test_record_highs_start_above_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 3.0), ("a", 3, 3.0), ("a", 4, 2.0), ("a", 5, 9.0), ("b", 1, -1.0)],
                               "d string, pos long, v double")
    assert rows(windows.record_highs(df, ["d"], "pos", "v", 2)) == [("a", 2, 3.0), ("a", 5, 9.0)]


@pytest.mark.parametrize("budget", [1, 2, 3, 4, 5, 6, 9, 10, 11])
def test_cut_at_budget_like_one_string(spark, budget):
    texts = ["ab", "cde", "", "fghij"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "k string, pos long, t string")
    out = windows.cut_at_budget(df, ["k"], "pos", "t", budget, "piece", chunk=2)
    joined = "".join(r["piece"] for r in sorted(out.collect(), key=lambda r: r["pos"]))
    whole = "".join(texts)
    assert joined == (whole[: budget - 1] if len(whole) > budget else whole)


def test_first_by_keeps_columns(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 5, None)], "k string, o int, v string")
    assert rows(windows.first_by(df, ["k"], ["o"])) == [("x", 1, "a"), ("y", 5, None)]


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)

    def side(n):
        return [(rng.choice("ab"), start + timedelta(seconds=rng.randrange(4000)), i) for i in range(n)]

    left, right = side(150), side(60)
    ldf = spark.createDataFrame(left, "k string, ts timestamp_ntz, id int")
    rdf = spark.createDataFrame(right, "k string, ts timestamp_ntz, v int")
    got = {r["id"]: r["out"] for r in joins.asof_join(ldf, rdf, ["k"], "ts", "v", 100, "out").collect()}
    for key, ts, ident in left:
        near = [(r[1], r[2]) for r in right if r[0] == key and timedelta(0) <= ts - r[1] <= timedelta(seconds=100)]
        latest = max((m[0] for m in near), default=None)
        assert got[ident] in ({v for t, v in near if t == latest} if near else {None})
    assert len(got) == len(left)


def test_entity_mentions_need_whole_words(spark):
    texts = spark.createDataFrame([(1, "unknown bob logged in"), (2, "unknown bobby"), (3, "known bob"), (4, "unknown al")],
                                  "id int, text string")
    names = spark.createDataFrame([("bob",), ("al",), ("bob",)], "name string")
    out = joins.entity_mentions(texts, "text", names, "name", "unknown --entity--")
    assert rows(out.select("id", "name")) == [(1, "bob"), (4, "al")]


def test_entity_mentions_of_any_text(spark):
    names = ["Router-1", "10.0.0.5", "10.0.0.50", "New York", "bob", "a", "--", "x", "\\E+", "one two three four five", None, ""]
    cases = {
        "from --entity-- denied": ["from Router-1 denied", "from 10.0.0.5 denied", "from New York denied", "from -- denied",
                                   "from \\E+ denied", "from one two three four five denied", "from  denied", None],
        "x --entity-- x": ["x a x bob x x x", "xx a xx"],
        "id=--entity--": ["id=10.0.0.50, id=New Yorker", "id=--bob", "id=bobid=a"],
        "--entity--:": ["10.0.0.5: Router-1:", "bbob: New York:", "one two three four five:"],
        "--entity--": ["x New York, bobby 10.0.0.5", "bob--"],
    }
    known = spark.createDataFrame([(n,) for n in names], "name string")
    for term, texts in cases.items():
        before, after = term.split("--entity--")
        want = []
        for k, text in enumerate(texts):
            for name in filter(None, names):
                edges = "" if before else r"(?<!\w)", "" if after else r"(?!\w)"
                if text and re.search(edges[0] + re.escape(before + name + after) + edges[1], text):
                    want.append((k, name))
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        got = joins.entity_mentions(df, "text", known, "name", term)
        assert rows(got.select("id", "name")) == sorted(want), term


def test_knowledge_match_cases(spark):
    matrix = {"Initial Access": ["Valid Accounts", "Phishing"], "Impact": ["Data Destruction"], "Other": ["Phishing"]}
    texts = ["Initial Access by Valid Accounts", "Impact alone", "Phishing seen", "nothing",
             "Impact and Initial Access: Phishing, Data Destruction"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["h"]["tactic"], r["h"]["technique"]) for r in df.withColumn(
        "h", joins.knowledge_match(F.col("text"), matrix)).collect()}
    assert got[0] == ("Initial_Access", "Valid_Accounts")
    assert got[1] == ("na", "na")  # a named tactic without technique is not looked at again
    assert got[2] == ("Initial_Access-Other", "Phishing")
    assert got[3] == ("na", "na")
    assert got[4] == ("Impact-Initial_Access", "Data_Destruction-Phishing")


def test_device_lookup_first_match(spark):
    devices = spark.createDataFrame([("d1", "late", 5), ("d1", "first", 1), ("d2", "x", 2)], "dsn string, ident string, ord int")
    readings = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "dsn string, id int")
    assert rows(joins.device_lookup(readings, devices, "dsn", "ord")) == [("d1", 1, "first"), ("d2", 2, "x")]


def test_hot_lookup_key_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id").cast("string")))
        readings = spark.range(0, 60_000, 1, 16).select("id", key.alias("dsn"))
        devices = readings.select("dsn", F.col("id").alias("ord"), F.md5("dsn").alias("ident"))
        out = joins.device_lookup(readings, devices, "dsn", "ord")
        assert len(out.collect()) == 60_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString().lower()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_page(spark):
    out = windows.page(spark.range(100), [F.desc("id")], 30, 4)
    assert rows(out) == [(i,) for i in range(10)]


def test_mentions_travel_without_their_text(spark):
    """Long lines: a place takes a few characters along, not its line; long entities are still found, once a row."""
    import contextlib
    import io

    long = "Deep " + "x" * 80 + " end"
    names = spark.createDataFrame([("Router-1",), (long,), (long[:70],), ("b" * 64,), ("b" * 65,)], "name string")
    lines = [" ".join(["at Router-1 up"] * 3000), f"at {long} at {long} at {long[:70]} at", f"at {long}!", f"at {'b' * 64} at {'b' * 65}", f"at {'b' * 66}"]
    texts = spark.createDataFrame([(1, lines[0]), (1, lines[0]), *enumerate(lines[1:], 2), (9, None)], "id int, text string").repartition(3)
    out = joins.entity_mentions(texts, "text", names, "name", "at --entity--").select("id", "name")
    assert rows(out) == sorted([(1, "Router-1"), (1, "Router-1"), (2, long), (2, long[:70]), (3, long), (4, "b" * 64), (4, "b" * 65)])
    plain = joins.entity_mentions(texts, "text", names.filter("length(name) < 60"), "name", "at --entity--").select("id", "name")
    with contextlib.redirect_stdout(io.StringIO()) as said:
        plain.explain("formatted")
    moved = [x for x in said.getvalue().split("\n\n") if re.match(r"\s*\(\d+\) Exchange", x) and "RoundRobin" not in x]
    assert moved and not any("text#" in x for x in moved)
