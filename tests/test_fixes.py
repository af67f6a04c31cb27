"""Cases that the registered queries do not reach."""

import datetime as dt

from pyspark.sql import functions as F

from rillmark.operators import conditions as cond
from rillmark.operators import joins, stats
from rillmark.sources import sinks


def test_same_aggregate_twice(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", 1.0), ("c", 20.0)], "k string, v double")
    spec = cond.parse_condition("custom:v~condition:sum,greaterthan,2,sum,lessthan,9")
    got = cond.apply_conditions(df, spec, lambda p: F.col(p), ["k"])
    assert [r["k"] for r in got.collect()] == ["a"]


def test_fractional_band(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("e", "s", float(k), t0 + dt.timedelta(seconds=k), f"m{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "entity string, subtopic string, value double, ts timestamp, msgid string")
    got = stats.preprocess(df, ["avg", "outliers2.5-5"], maxrows=10).collect()
    assert {r["preprocesstype"] for r in got} == {"avg", "outliers2.5-5"}


def test_asof_tie(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t0, 1)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", t0, 5.0), ("a", t0, 9.0), ("a", t0, 7.0)], "k string, ts timestamp, v double")
    for parts in (1, 3):
        got = joins.asof_join(left, right.repartition(parts), ["k"], "ts", "v", 10, "out").collect()
        assert [r["out"] for r in got] == [9.0]


def test_whole_failure_text(spark):
    def fail(df):
        raise RuntimeError("x" * 900)

    got = sinks.fan_out(spark.range(1), {"bad": fail}).first()
    assert got["status"] == "failed" and got["message"] == "RuntimeError: " + "x" * 900
