"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillmark.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[["Tables"], DataFrame], sql: str | None = None) -> None:
    """Add a query; ``sql`` is the equivalent statement for the check."""
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(tune(spark), sf_dir))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    """Decorator form of :func:`register`."""

    def wrap(fn):
        register(name, fn, sql)
        return fn

    return wrap


class Tables:
    """Tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
