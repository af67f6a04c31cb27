import math
import random
import statistics as st

import pytest

from rillmark.operators import stats
from rillmark.operators.windows import last_n
from tests.conftest import rows


def _df(spark, values, entity="e", subtopic="s"):
    data = [(entity, subtopic, v, i, i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "entity string, subtopic string, value double, ts long, msgid long")


def _one(spark, values, kind, maxrows=800):
    row = stats.window_stats(_df(spark, values), [kind], maxrows).collect()
    assert len(row) == 1
    return row[0][kind]


VALUES = [4.0, 8.0, 1.0, 9.0, 2.0, 40.0]
MEAN, SD = st.fmean(VALUES), st.pstdev(VALUES)
Z = [(v - MEAN) / SD for v in VALUES]


@pytest.mark.parametrize("kind, want", [
    ("min", 1.0), ("max", 40.0), ("sum", 64.0), ("avg", MEAN), ("count", 6.0), ("diff", 36.0), ("diffmargin", 900.0),
    ("variance", SD**2), ("varied", 1.0), ("raw", 40.0), ("cv", SD / MEAN),
    ("anomprob", 100 * (1 - math.exp(-Z[-1] ** 2 / 2))), ("anomprob2-5", 100 / 6), ("outliers2-5", 1.0),
    ("outliers", 0.0), ("anomprob3", 0.0), ("gm", math.exp(st.fmean(math.log(v) for v in VALUES))),
    ("hm", st.harmonic_mean(VALUES)), ("IQR", 8.75 - 2.5), ("trimean", (2.5 + 2 * 6.0 + 8.75) / 4),
    ("trend", st.linear_regression(range(1, 7), VALUES).slope), ("spikedetect", 0.0),
    ("consistency", 100 * max(0, 1 - SD / MEAN)),
    ("skewness", st.fmean(z**3 for z in Z)), ("kurtosis", st.fmean(z**4 for z in Z) - 3),
])
def test_hand_values(spark, kind, want):
    assert _one(spark, VALUES, kind) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind, want", [
    ("anomprob", 0.0), ("outliers", 0.0), ("anomprob3", 0.0), ("varied", 0.0), ("variance", 0.0), ("consistency", 100.0),
    ("trend", 0.0), ("diff", 0.0),
])
def test_equal_values(spark, kind, want):
    assert _one(spark, [5.0] * 4, kind) == want


@pytest.mark.parametrize("kind, want", [
    ("avg", 3.0), ("variance", 0.0), ("trend", None), ("anomprob", 0.0), ("spikedetect", 0.0), ("IQR", 0.0)])
def test_single_row(spark, kind, want):
    assert _one(spark, [3.0], kind) == want


@pytest.mark.parametrize("kind", ["gm", "hm"])
def test_means_need_positive_values(spark, kind):
    assert _one(spark, [1.0, 0.0, 2.0], kind) is None
    assert _one(spark, [1.0, -2.0], kind) is None


def test_diffmargin_from_zero(spark):
    assert _one(spark, [0.0, 2.0], "diffmargin") is None


def test_spike(spark):
    assert _one(spark, [1.0] * 20 + [100.0] + [100.0] * 20, "spikedetect") == 1.0


def test_empty_gives_no_row(spark):
    assert stats.preprocess(_df(spark, []), ["avg"]).count() == 0


def test_order_of_input_does_not_matter(spark):
    kinds = ["avg", "trend", "diff", "spikedetect", "anomprob", "IQR"]
    data = [("e", "s", random.Random(i).random(), i, i) for i in range(60)]
    schema = "entity string, subtopic string, value double, ts long, msgid long"
    a = stats.window_stats(spark.createDataFrame(data, schema), kinds).collect()[0]
    random.Random(5).shuffle(data)
    b = stats.window_stats(spark.createDataFrame(data, schema).repartition(7), kinds).collect()[0]
    assert [a[k] for k in kinds] == pytest.approx([b[k] for k in kinds])


def test_rollback_uses_newest_rows(spark):
    assert _one(spark, list(map(float, range(100))), "min", maxrows=10) == 90.0


def test_nulls_are_skipped(spark):
    assert _one(spark, [1.0, None, 3.0], "avg") == 2.0


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        stats.preprocess(_df(spark, [1.0]), ["nothing"])
    with pytest.raises(ValueError):
        stats.clean(_df(spark, [1.0]), "datacleanfoo_5")
    with pytest.raises(ValueError):
        stats.pair_streams(["a", "b"], ["avg"])


def test_cleaning(spark):
    values = [10.0, 11.0, 10.5, 9.5, 10.2, 500.0, 10.1]
    for kind in ("datacleaniqr_100", "datacleanstd2_100", "datacleanmad_100"):
        left = stats.clean(_df(spark, values), kind)
        assert 500.0 not in {r["hyperprediction"] for r in left.collect()} and left.count() == 6
    newest = stats.clean(_df(spark, values), "datacleaniqr_2")
    assert sorted(r["hyperprediction"] for r in newest.collect()) == [10.1, 10.2]
    flat = stats.clean(_df(spark, [3.0, 3.0, 3.0, 4.0]), "datacleanmad_9")
    assert [r["hyperprediction"] for r in flat.collect()] == [3.0] * 3


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_all_types_share_one_exchange(spark, scratch):
    """All statistics run on the partitioning of the rollback, which is one exchange of rows of a known, small size."""
    kinds = ["avg", "trend", "IQR", "anomprob", "spikedetect", "skewness"]
    unknown = _df(spark, VALUES)
    assert exchanges(stats.window_stats(unknown, kinds)) == exchanges(last_n(unknown, stats.KEYS, stats.ORDER, 800)) == 2
    unknown.write.parquet(scratch)
    known = spark.read.parquet(scratch)
    assert exchanges(stats.window_stats(known, kinds)) == exchanges(last_n(known, stats.KEYS, stats.ORDER, 800)) == 1
    assert rows(stats.window_stats(known, kinds)) == rows(stats.window_stats(unknown, kinds))


def test_stream_names(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(stats.stream_name(8, F.lit("Voltage"), "anomprob").alias("n")).collect()
    assert rows(spark.createDataFrame(got)) == [("topicid8_Voltage_preprocessed_AnomProb",)]


def test_verdict_reaching_the_threshold_is_outside(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0)], "k string, v double")
    got = {r["k"]: r["verdict"] for r in stats.average_verdict(df, ["k"], "v", 3).collect()}
    assert "outside" in got["a"] and "within" in got["b"]
