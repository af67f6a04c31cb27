"""Entity memory: scores from what an entity did in its past windows.

The scores follow this package's own definition (README): the share of
windows with a matching text, the recurrence of terms, and the entity's anomaly
probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.terms import TermGroup, term_keys
from rillmark.operators.windows import last_n

LOW_BELOW, MEDIUM_BELOW = 0.4, 0.7


def window_hits(texts: DataFrame, text: str, groups: Sequence[TermGroup]) -> DataFrame:
    """One row per (entity, window) with the keys of the terms seen (see ``terms.term_keys``).

    Keys are collected as sets before the shuffle, so a busy entity sends one
    row per task and window.
    """
    found = texts.select("entity", "window", term_keys(F.col(text), groups, F.col("entity")).alias("terms"))
    return merge_hits(found)


def merge_hits(hits: DataFrame) -> DataFrame:
    """Rows of the same (entity, window) as one."""
    rows = hits.select("entity", "window", F.explode_outer("terms").alias("term"))
    return rows.groupBy("entity", "window").agg(F.collect_set("term").alias("terms"))


def memory_counts(hits: DataFrame, remember: int, maxwindows: int = 10_000) -> DataFrame:
    """Windows seen, windows with a hit and windows with a repeated term, per entity.

    A term is repeated where an earlier remembered window has it, too.
    """
    kept = last_n(hits, ["entity"], ["window"], min(remember, maxwindows))
    seen = kept.select("entity", "rn", F.explode_outer("terms").alias("term"))
    oldest = F.max("rn").over(Window.partitionBy("entity", "term"))
    again = F.col("term").isNotNull() & (F.col("rn") < oldest)
    windows = seen.withColumn("again", again).groupBy("entity", "rn").agg(
        F.count("term").alias("hits"), F.bool_or("again").alias("again"))
    return windows.groupBy("entity").agg(
        F.count("*").alias("windows_seen"),
        F.count_if(F.col("hits") > 0).alias("attack_windows"),
        F.count_if("again").alias("pattern_windows"),
    )


def activity_level(score: Column) -> Column:
    """``low`` below 0.4, ``medium`` below 0.7, else ``high``."""
    return F.when(score < LOW_BELOW, "low").when(score < MEDIUM_BELOW, "medium").otherwise("high")


def memory_scores(
    counts: DataFrame | None, anomaly: DataFrame, pattern_threshold: int
) -> DataFrame:
    """Attack, pattern and combined score with activity level and comment.

    ``anomaly`` has (entity, anomprob on a 0-100 scale).  Without an event
    stream the combined score is the anomaly part alone.
    """
    part = F.coalesce(F.col("anomprob") / 100, F.lit(0.0))
    if counts is None:
        rows = anomaly.select("entity", part.alias("rtms_score"))
        return rows.withColumn("activity_level", activity_level(F.col("rtms_score")))
    rows = counts.join(anomaly.select("entity", "anomprob"), "entity", "left")
    rows = rows.withColumns({
        "attack_score": F.col("attack_windows") / F.col("windows_seen"),
        "pattern_score": F.least(F.lit(1.0), F.col("pattern_windows") / pattern_threshold),
        "anomaly_score": part,
    })
    mean = (F.col("attack_score") + F.col("pattern_score") + F.col("anomaly_score")) / 3
    rows = rows.withColumn("rtms_score", mean)
    rows = rows.withColumn("activity_level", activity_level(F.col("rtms_score")))
    comment = F.format_string(
        "%s activity: hits in %d of %d windows, %d repeated", "activity_level", "attack_windows", "windows_seen",
        "pattern_windows")
    return rows.withColumn("comment", comment).drop("anomprob")


def route_scores(df: DataFrame, routes: dict[str, tuple[float, str]]) -> DataFrame:
    """One row per topic whose score exceeds its threshold (0 to all of them)."""
    topics = [F.when(F.col(c) > limit, F.lit(topic)) for c, (limit, topic) in routes.items()]
    return df.withColumn("topic", F.explode(F.array_compact(F.array(*topics))))
