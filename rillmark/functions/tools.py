"""Scalar tools that can be called by name from SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def list_max(col: Column) -> Column:
    """Largest element of an array; 0 for an empty one."""
    return F.coalesce(F.array_max(col), F.lit(0.0))


def list_average(col: Column) -> Column:
    """Mean of an array rounded half-even to 2 places; 0 for an empty one."""
    total = F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.bround(F.try_divide(total, F.size(col)), 2), F.lit(0.0))


def register_tools(spark: SparkSession) -> None:
    """Make the tools available in SQL as temporary SQL functions (no Python workers)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tool_add(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN a + b"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tool_max(xs ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN coalesce(array_max(xs), 0D)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION tool_average(xs ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "coalesce(bround(try_divide(aggregate(xs, 0D, (acc, x) -> acc + x), size(xs)), 2), 0D)"
    )
