"""Report tables behind the result views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.windows import last_n


def risk_summary(df: DataFrame, keys: Sequence[str], score: str, threshold: Column) -> DataFrame:
    """How many scores reach the threshold, of how many."""
    found = F.count_if(F.col(score) >= threshold)
    return df.groupBy(*keys).agg(
        found.alias("anomaly_found"),
        F.count("*").alias("anomaly_total"),
        F.concat(found.cast("string"), F.lit(" found out of "), F.count("*").cast("string")).alias("label"),
    )


def mean_objective(df: DataFrame, keys: Sequence[str], objective: str) -> DataFrame:
    """Mean objective value of the optimisation records."""
    return df.groupBy(*keys).agg(F.round(F.avg(objective), 2).alias("mean_objective"))


def variable_report(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Sum, count, mean, minimum and maximum of every optimised variable."""
    long = df.select(*keys, F.explode(values).alias("variable", "value"))
    return long.groupBy(*keys, "variable").agg(
        F.round(F.sum("value"), 2).alias("total"),
        F.count("value").alias("n"),
        F.round(F.avg("value"), 2).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def response_rollup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, maxrows: int
) -> DataFrame:
    """Answers of the newest ``maxrows`` records per topic, in order."""
    rows = last_n(df, keys, order, maxrows)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("responses"),
        F.sum(F.length(text)).alias("characters"),
        F.sort_array(F.collect_list(F.struct(*order, text))).alias("answers"),
    )
