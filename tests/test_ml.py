import math
import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import joins, ml, vectors
from tests.conftest import rows


def test_label_logic(spark):
    logic = ml.parse_logic("classification_name=p:Voltage_AnomProb=70,n:Current=-n,4:T=1,2")
    assert (logic.name, logic.ranges) == ("p", {"Voltage_AnomProb": (70.0, None), "Current": (None, 4.0), "T": (1.0, 2.0)})
    assert ml.parse_logic("classification_name=q;a-b=12,22;c=-n,4;").ranges == {"a-b": (12.0, 22.0), "c": (None, 4.0)}
    with pytest.raises(ValueError):
        ml.parse_logic("wrong=1")
    df = spark.createDataFrame([(70.0, 4.0, 1.0), (69.9, 4.0, 1.0), (80.0, 4.1, 1.0), (80.0, None, 1.0)],
                               "Voltage_AnomProb double, Current double, T double")
    assert [r[0] for r in df.select(ml.label(logic)).collect()] == [1, 0, 0, 0]


def test_linear_models_recover_coefficients(spark):
    rng = random.Random(2)
    data = []
    for e, (a, b, c) in {"e1": (1, 2, -3), "e2": (5, 0, 1)}.items():
        for _ in range(200):
            x, y = rng.random(), rng.random() * 1e4
            data.append((e, x, y, a + b * x + c * y))
    df = spark.createDataFrame(data, "e string, x double, y double, t double")
    got = {r["e"]: r["coefficients"] for r in ml.fit_linear(df, ["e"], "t", ["x", "y"]).collect()}
    assert got["e1"] == pytest.approx([1, 2, -3], abs=1e-6) and got["e2"] == pytest.approx([5, 0, 1], abs=1e-6)
    scored = ml.predict(df, ml.fit_linear(df, ["e"], "t", ["x", "y"]), ["e"], ["x", "y"])
    assert scored.filter(F.abs(F.col("prediction") - F.col("t")) > 1e-5).count() == 0


def test_logistic_gradient_vanishes(spark):
    rng = random.Random(5)
    data = []
    for e in ("a", "b"):
        for _ in range(300):
            x, y = rng.gauss(0, 1), rng.gauss(10, 3)
            p = 1 / (1 + math.exp(-(0.5 + 1.5 * x - 0.4 * (y - 10))))
            data.append((e, x, y, int(rng.random() < p)))
    data += [("one", 1.0, 2.0, 1), ("one", 2.0, 1.0, 1)]
    df = spark.createDataFrame(data, "e string, x double, y double, t int")
    got = {r["e"]: r for r in ml.fit_logistic(df, "e", "t", ["x", "y"], ridge=0.0).collect()}
    assert set(got) == {"a", "b"}
    for e, row in got.items():
        b = row["coefficients"]
        assert row["gradient"] < 1e-6 and b[1] > 0.8 and b[2] < -0.2
        mine = [d for d in data if d[0] == e]
        residual = [d[3] - 1 / (1 + math.exp(-(b[0] + b[1] * d[1] + b[2] * d[2]))) for d in mine]
        assert abs(sum(residual)) < 1e-6 and abs(sum(r * d[1] for r, d in zip(residual, mine))) < 1e-6


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([("e", float(i), int(i > 5)) for i in range(12)], "e string, x double, t int")
    row = ml.fit_logistic(df, "e", "t", ["x"]).first()
    assert all(math.isfinite(c) for c in row["coefficients"]) and row["coefficients"][1] > 0


def test_model_choice(spark):
    data = [("e", float(x), math.exp(0.3 * x)) for x in range(1, 30)] + [("f", float(x), 2.0 * x + 1) for x in range(1, 30)]
    df = spark.createDataFrame(data, "e string, x double, y double")
    best = {r["e"]: r["algorithm"] for r in ml.best_models(ml.search_models(df, ["e"], "y", "x"), ["e"], "fit").collect()}
    assert best == {"e": "log-lin", "f": "lin-lin"}


def test_seasons(spark):
    df = spark.createDataFrame([(1,), (7,), (10,)], "m int")
    out = df.select(ml.season(F.col("m"), {"w": [12, 1], "s": [7], "off": [-1]}))
    assert [r[0] for r in out.collect()] == ["w", "s", None]


def test_split_is_repeatable_and_complete(spark):
    df = spark.range(1000)
    train, test = ml.split_rows(df, ["id"], 75)
    assert train.count() + test.count() == 1000 and 680 < train.count() < 820
    assert rows(ml.split_rows(df.repartition(5), ["id"], 75)[0]) == rows(train)


def test_cumulative_share_against_brute_force(spark):
    rng = random.Random(1)
    values = [3.0] * 400 + [rng.random() * 10 for _ in range(800)]
    out = ml.cumulative_share(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    for row in out:
        assert row["upto"] == pytest.approx(sum(x <= row["v"] for x in values) / len(values))
        assert row["below"] == pytest.approx(sum(x < row["v"] for x in values) / len(values))
    assert len(out) == len(set(values))


@pytest.mark.parametrize("family, draw", [
    ("normal", lambda r: r.gauss(50, 3)), ("exponential", lambda r: r.expovariate(0.2)),
    ("uniform", lambda r: r.uniform(2, 9)), ("lognormal", lambda r: r.lognormvariate(0, 1)),
])
def test_distributions(spark, family, draw):
    rng = random.Random(11)
    df = spark.createDataFrame([(draw(rng),) for _ in range(2000)], "v double")
    assert ml.fit_distributions(df, "v", 2).first()["family"] == family


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double").select(ml.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.0249979, 0.5, 0.8413447], abs=1e-6)


def test_peers(spark):
    data = [("a", "s", 1.0), ("b", "s", 2.0), ("c", "s", 3.0), ("d", "s", 100.0), ("x", "t", 1.0)]
    got = {r["e"]: r for r in ml.peer_anomaly(spark.createDataFrame(data, "e string, g string, v double"), "e", "g", "v", 0.99).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["d"]["peer"] == pytest.approx(2.0) and got["d"]["flag"]
    assert got["a"]["peers"] == 3 and not got["a"]["flag"]


def _points(spark, n=300, dim=8):
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, v array<float>").repartition(5)


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("block", [4096, 4])
def test_nearest_against_brute_force(spark, metric, block):
    data, df = _points(spark)
    queries = df.filter("id < 9").withColumnRenamed("id", "q")
    out = vectors.nearest(df, "id", "v", queries, "q", metric, 4, block=block)
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in out.collect()}
    import numpy as np

    base = np.array([d[1] for d in data], dtype="float32").astype("float64")
    for q in range(9):
        x = base[q]
        far = {
            "cosine": 1 - base @ x / (np.linalg.norm(base, axis=1) * np.linalg.norm(x)),
            "euclid": np.linalg.norm(base - x, axis=1), "dot": -(base @ x), "manhattan": np.abs(base - x).sum(axis=1),
        }[metric]
        for rank, i in enumerate(np.argsort(far, kind="stable")[:4], 1):
            assert got[q, rank][0] == i
            assert abs(got[q, rank][1]) == pytest.approx(abs(far[i]), abs=1e-9)
    assert len(got) == 36


def test_nearest_meets_in_blocks(spark, monkeypatch):
    """Blocks meet, not rows; neither side is collected; nulls are left out; a grid of many cells finds the same."""
    _, df = _points(spark)
    queries = df.filter("id < 40").withColumnRenamed("id", "q").union(spark.createDataFrame([(99, None)], "q long, v array<float>"))
    one = vectors.nearest(df.union(spark.createDataFrame([(999, None)], "id long, v array<float>")), "id", "v", queries, "q")
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Cartesian" not in text and "NestedLoop" not in text
    monkeypatch.setattr(vectors, "CELL", 3)
    many = vectors.nearest(df, "id", "v", queries, "q", block=7)
    near = lambda df: rows(df.withColumn("distance", F.round(F.abs("distance"), 9)))
    assert near(one) == near(many) and one.count() == 120
    assert vectors.nearest(df, "id", "v", queries.limit(0), "q").count() == 0


def test_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])], "l int, v array<float>")
    assert rows(vectors.label_centroids(df, "l", "v", 2)) == [(0, [2.0, 3.0]), (1, [5.0, 5.0])]


def test_training_matrix_needs_enough_rows(spark):
    data = [("a", s, float(i), i, i) for s in "xy" for i in range(40)] + [("b", s, float(i), i, i) for s in "xy" for i in range(10)]
    df = spark.createDataFrame(data, "entity string, subtopic string, value double, ts long, msgid long")
    out = joins.training_matrix(df, ["x", "y"], maxrows=35)
    assert out.count() == 35 and {r["entity"] for r in out.collect()} == {"a"}


@pytest.mark.parametrize("sizes, windows", [((3, 2), 0), ((3, 2, 9, 47, 48), 1), ((3, 9, 48, 49, 200), 3)])
def test_streams_within_the_window_are_only_summed(spark, sizes, windows):
    """Newest three rows against brute force; rows are ranked only where a stream has more, those of long streams twice."""
    rng = random.Random(3)
    data = [(e, s, None if rng.random() < 0.2 else rng.random(), i // 2, i)
            for e, n in zip((None, 1, 2, 3, 4), sizes) for s in "xyzu" for i in range(n if s != "z" or e != 1 else 0)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "entity long, subtopic string, value double, ts long, msgid long")
    out = joins.align_streams(df, {"x": "avg", "y": "max", "z": "count", "no": "count"}, maxrows=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == windows
    got = {r["entity"]: (r["x"], r["y"], r["z"], r["no"]) for r in out.collect()}
    assert len(got) == len(sizes)
    for e in got:
        x, y, z = ([d[2] for d in sorted(data, key=lambda d: -d[4]) if d[:2] == (e, s)][:3] for s in "xyz")
        x, y, z = ([v for v in found if v is not None] for found in (x, y, z))
        want = (sum(x) / len(x) if x else None, max(y, default=None), len(z), 0)
        assert got[e] == pytest.approx(want)


def test_clusters_read_their_subjects_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, float(i % 2) * 50, float(i) if i else None) for i in range(40)], "s int, a double, b double")
    counted = df.rdd.map(lambda r: (seen.add(1), tuple(r))[1])
    out = ml.clusters(spark.createDataFrame(counted, df.schema), "s", ["a", "b"], 2, 10)
    assert out.count() == 40 and out.filter("cluster IS NULL").count() == 1 and seen.value == 40


def test_clusters_and_correlation(spark):
    data = [(i, float(i % 2) * 50 + i * 0.01, float(i % 2) * 20, float(-i)) for i in range(40)]
    df = spark.createDataFrame(data, "s int, a double, b double, c double")
    groups = {r["s"] % 2: r["cluster"] for r in ml.clusters(df, "s", ["a", "b"], 2, 10).collect()}
    assert groups[0] != groups[1]
    holes = df.union(spark.createDataFrame([(50, None, 1.0, 1.0), (51, 1.0, None, 1.0)], df.schema))
    got = {r["s"]: r["cluster"] for r in ml.clusters(holes, "s", ["a", "b"], 2, 10).collect()}
    assert len(got) == 42 and got[50] is None and got[51] is None and got[0] == got[2]
    pairs = ml.correlated_factors(df.withColumn("k", F.lit(1)), "k", ["a", "b", "c"], 0.9).collect()
    assert [(r["factor_x"], r["factor_y"]) for r in pairs] == [("a", "b")]
