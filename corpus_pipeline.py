"""A training-data pipeline: each stage works on all documents that its predecessor kept.

Columns beyond ``doc_id``, ``text``, ``lang``, ``source`` pass through all stages but the last, whatever their names.  A
row with a null ``doc_id`` cannot be named by a verdict: it passes the filters, and the mix leaves it out.  Rows that
repeat an id are one document: all of them stay or go.  Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.decontaminate import contained
from rillmark.llm.mixing import mix
from rillmark.llm.near_duplicates import jaccard_classes
from rillmark.llm.quality import judge
from rillmark.llm.queries import VOCABULARY, tokenizer_path
from rillmark.llm.storage import materialize, measured, prepare
from rillmark.llm.token_files import encoded


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Documents whose id is not among the given ones; null ids stay."""
    return docs.join(measured(materialize(ids.select("doc_id").distinct(), name)), "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those that the rules or the robust distance reject.

    Null and empty texts have fewer than ten words and go, but for rows with a null id.  A document with a rejected row
    goes whole.
    """
    return _without(docs, judge(docs).filter("NOT kept"), "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words are linked with nothing and stay.  Rows of one id are no copies of each other.
    """
    return _without(docs, jaccard_classes(docs).filter("doc_id <> component_id"), "later")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; a document goes whole when its rows together hold one.
    """
    return _without(docs, contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "held")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows.

    Documents without words, and rows with a null id, are taken never.  Rows that repeat an id are taken as often as the
    most taken of them.
    """
    taken = mix(docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    free = (f"_{k}" for k in range(len(docs.columns) + 3))  # names that the documents don't use
    key, times, copy = (name for name, _ in zip((n for n in free if n not in docs.columns), range(3)))
    copies = materialize(taken.select(F.col("doc_id").alias(key), F.col("copies").alias(times)), "copies")
    met = docs.join(measured(copies), F.col("doc_id") == F.col(key))
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, and per row its place in them as they are read back.

    Null and empty texts have their end id only; repeated ids follow each other, null ids come first.
    """
    return encoded(docs, tokenizer_path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

# The quality rules and the token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
