"""Exact Jaccard joins over sets of hashes, by products of bounded prefixes.

Both set joins of this subpackage (whole documents, single lines) run the same steps:

1. ``columns``: every set sends a prefix of its hashes, rarest first, to the columns of the incidence matrix.  Columns
   of one set are dropped.  Two sets of Jaccard J >= t share at least ``k = 1 + n // 20`` hashes (n of the smaller one)
   within prefixes of ``n - ceil(t n) + k``: the k-th shared hash has all other shared ones behind it.
2. ``lists``: the columns of a set, now ordered by their exact frequency.  A set that keeps fewer than k cannot have a
   partner; of the others only the first ``m - k + 1`` columns are needed.
3. ``candidates``: overlap counts of the lists are accumulated for pairs of a column, and a pair whose count, together
   with everything behind both prefixes, stays below ``t (n1 + n2) / (1 + t)`` is discarded.

Order is a question of speed only: hashes known to be frequent come last, the rest in order of their value.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize

# Frequent hashes known to all tasks: at most this many, 3 MB.
FREQUENT_BOUND = 200_000


def prefix_length(n: int, percent: int) -> int:
    """How many hashes of a set of ``n`` go to the columns."""
    return min(n, n - -(-percent * n // 100) + shared(n))


def shared(n):
    """Hashes that two similar sets share at least within their prefixes; ``n`` of the smaller one."""
    return 1 + n // 20


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first hashes of a sorted set, those of the sorted array ``frequent`` last and by rank."""
    size = prefix_length(len(own), percent)
    if not len(frequent):
        return own[:size]
    at = np.searchsorted(frequent, own)
    at[at == len(frequent)] = 0
    known = frequent[at] == own
    rare = own[~known]
    if len(rare) >= size:
        return rare[:size]
    late = own[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate((rare, late[: size - len(rare)]))


def frequent_hashes(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent hashes and their rank, rarest first, from partial counts (``h``, ``df``).

    Only hashes with at least total / FREQUENT_BOUND occurrences are taken, so there are FREQUENT_BOUND at most.
    """
    total = counts.agg(F.sum("df")).first()[0] or 0
    least = max(16, math.ceil(total / FREQUENT_BOUND))
    found = counts.groupBy("h").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).toPandas()
    found = found.sort_values(["df", "h"])
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.int64)


def columns(rows: DataFrame) -> DataFrame:
    """Incidence columns of two sets or more: rows (``h``, ``c``, ``n``) with their frequency ``df``.

    ``rows`` may repeat.  One exchange by ``h`` serves all of it; repeats are removed from the
    few columns that are left.
    """
    by = Window.partitionBy("h")
    cells = rows.repartition("h").withColumn("low", F.min("c").over(by)).withColumn("high", F.max("c").over(by))
    cells = cells.filter("low <> high").select("h", "c", "n").dropDuplicates(["h", "c", "n"])
    return cells.withColumn("df", F.count("*").over(by))


def lists(cells: DataFrame, percent: int) -> DataFrame:
    """Per set ``c`` of size ``n``: all its columns in order of frequency, if enough for a partner.

    A list is bounded by the set's prefix.
    """
    least = F.expr(f"1 + ceil({percent} * n / 100) div 20")
    return (
        cells.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
        .withColumn("least", least).filter(F.size("hs") >= F.col("least"))
        .select("c", "n", F.col("hs.h").alias("hs"), (F.size("hs") - F.col("least") + 1).cast("int").alias("used"))
    )


def spread(listed: DataFrame) -> DataFrame:
    """Cells (``h``, ``id``, ``n``) that candidates are looked for in; ``left``: columns of the list from there on."""
    cells = listed.select("id", "n", F.size("hs").alias("m"), F.posexplode(F.slice("hs", F.lit(1), F.col("used"))).alias("at", "h"))
    cells = cells.select("id", "n", "h", (F.col("m") - F.col("at")).alias("left"))
    return cells.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1").drop("df")


def near_sizes(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _open(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells of columns whose sets are not yet all in one component, with their ``label``."""
    by = Window.partitionBy("h")
    return (
        cells.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        .withColumn("low", F.min("label").over(by)).withColumn("high", F.max("label").over(by))
        .filter("low <> high").drop("low", "high")
    )


def needed(percent: int) -> str:
    """SQL: how many columns the lists of a similar pair share at least, given the sizes ``na`` and ``nb``."""
    behind = [f"({n} - least({n}, {n} - ceil({percent} * {n} / 100) + 1 + {n} div 20))" for n in ("na", "nb")]
    return f"(ceil({percent} * (na + nb) / {100 + percent}) - greatest({behind[0]}, {behind[1]}))"


def hub_pairs(cells: DataFrame, labels: DataFrame, percent: int, draw: int | None = None) -> DataFrame:
    """One hub of every column with each other set of it: as many pairs as cells, whatever the group's size.

    The hub is the smallest set, which most columns of a group share, or one that each column draws for itself.
    """
    by = Window.partitionBy("h")
    order = F.col("n") if draw is None else F.xxhash64("h", "id", F.lit(draw))
    pick = F.min(F.struct(order.alias("order"), "id", "n", "label")).over(by)
    found = (
        _open(cells, labels).withColumn("hub", pick)
        .selectExpr("hub.id AS a", "hub.n AS na", "hub.label AS la", "id AS b", "n AS nb", "label")
        .filter("la <> label").filter(near_sizes("na", "nb", percent))
    )
    return found.select("a", "na", "b", "nb").distinct()


def rest_pairs(cells: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of a column that still are in different components.

    A similar pair is found at the first column both lists hold, where enough of both lists is left.
    """
    left = materialize(_open(cells, labels), "open-cells")
    right = left.selectExpr("h", "id AS b", "n AS nb", "label AS lb", "left AS rb")
    pairs = left.selectExpr("h", "id AS a", "n AS na", "label AS la", "left AS ra").join(right, "h")
    pairs = pairs.filter("a < b AND la <> lb").filter(near_sizes("na", "nb", percent))
    pairs = pairs.filter(f"least(ra, rb) >= {needed(percent)}")
    return pairs.select("a", "na", "b", "nb").distinct()


def above_bound(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose accumulated overlap and what is left behind the prefixes reach the needed overlap."""
    one = listed.select(F.col("id").alias("a"), F.col("hs").alias("ha"))
    two = listed.select(F.col("id").alias("b"), F.col("hs").alias("hb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .filter(F.size(F.array_intersect("ha", "hb")) >= F.expr(needed(percent)))
        .select("a", "na", "b", "nb")
    )
