"""As-of join: hot keys and streams."""

import random
from datetime import datetime, timedelta

import pytest

from rillmark.operators.joins import asof_join
from rillmark.streaming import keyed
from rillmark.streaming.state import drain
from tests.conftest import rows

START = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, ts timestamp, id int", "k string, ts timestamp, v double"


def sides(seed, n, span, keys):
    r = random.Random(seed)
    at = lambda: START + timedelta(milliseconds=r.randrange(span * 1000))
    left = [(r.choice(keys), at(), k) for k in range(n)]
    right = [(r.choice(keys), at(), float(k)) for k in range(n)]
    return left, right + [(k, t, v + 0.5) for k, t, v in right[: n // 10]] + [(k, t, -1.0) for k, t, _ in left[: n // 10]]


def brute(left, right, tolerance):
    out = []
    for k, t, i in left:
        found = max(((u, v) for q, u, v in right if q == k and u <= t), default=None)
        out.append((i, found[1] if found and t - found[0] <= timedelta(seconds=tolerance) else None))
    return sorted(out)


@pytest.mark.parametrize("span,segments", [(50, 8), (50, 1024), (5000, 8), (400, 1)])
def test_asof_in_segments(spark, span, segments):
    """All rows of one key inside one tolerance, and rows far apart; null keys are a key, null stamps find nothing."""
    left, right = sides(span, 300, span, ["hot", "hot", "hot", "b", None])
    df = spark.createDataFrame([*left, ("b", None, 999)], LEFT)
    got = asof_join(df, spark.createDataFrame(right, RIGHT), ["k"], "ts", "v", 60, "found", segments=segments).select("id", "found")
    assert rows(got.filter("id < 999")) == brute(left, right, 60) and got.filter("id = 999").first()["found"] is None


def test_hot_key_is_spread(spark):
    """One key, all rows inside one tolerance: no task of the scan has more than twice the median."""
    from pyspark.sql import functions as F

    left = spark.range(40_000).selectExpr("'hot' AS k", "timestamp_micros(1704067200000000 + id * 80000) AS ts", "id")
    right = left.select("k", "ts", F.col("id").cast("double").alias("v"))
    found = asof_join(left, right, ["k"], "ts", "v", 3600, "found").withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = sorted(r["count"] for r in found.groupBy("p").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(counts) == 8 and counts[-1] <= 2 * counts[4]
    assert found.filter("found <> id").count() == 0


def test_streams(spark, scratch):
    """Rows out of order within the delay; the sides arrive in files of their own; a last row lets all others go."""
    left, right = sides(3, 120, 2000, ["a", "b", None])
    end = START + timedelta(days=1)
    r = random.Random(1)
    for name, data, schema, last in (("l", left, LEFT, ("z", end, 999)), ("r", right, RIGHT, ("z", end, 0.0))):
        late = sorted(data, key=lambda x: x[1] + timedelta(seconds=r.randrange(100)))
        for part in (late[:60], late[60:], [last]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/{name}")
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/{name}")
    found = keyed.asof_rows(stream("l", LEFT), stream("r", RIGHT), ["k"], "ts", "v", 60, "2 days", "found")
    drain(found.writeStream.format("parquet").option("path", f"{scratch}/o").option("checkpointLocation", f"{scratch}/c"))
    assert spark.read.schema(found.schema).parquet(f"{scratch}/o").count() == 0  # nothing is certain yet
    for name, schema in (("l", LEFT), ("r", RIGHT)):
        spark.createDataFrame([("z", end + timedelta(days=9), 9)], schema.replace("double", "int")).selectExpr(
            "k", "ts", "CAST(id AS int) AS id" if name == "l" else "CAST(v AS double) AS v").coalesce(1).write.mode("append").parquet(f"{scratch}/{name}")
    found = keyed.asof_rows(stream("l", LEFT), stream("r", RIGHT), ["k"], "ts", "v", 60, "2 days", "found")
    drain(found.writeStream.format("parquet").option("path", f"{scratch}/o").option("checkpointLocation", f"{scratch}/c"))
    got = spark.read.parquet(f"{scratch}/o").select("id", "found")
    assert rows(got.filter("id < 999")) == brute(left, right, 60)
