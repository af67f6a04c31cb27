"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.select(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every linked id.

    Takes integer columns ``a`` and ``b``; returns ``id`` and ``label`` for ids that are not their own label.
    Alternates large-star and small-star steps until the links are stars, so the number of rounds grows with the
    logarithm of a component's size.  Every round is written to the shared folder; only a count and a checksum reach
    the driver.  Repeated, reversed and null links are allowed, self links are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        step = _large_star(edges).filter("a <> b").distinct()
        edges = materialize(_small_star(step).filter("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
