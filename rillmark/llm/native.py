"""Word arrays and shingle hashes in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, as a Java pattern and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use many times.

    A generator over a one-element array is a step that the optimizer does not merge with the steps above it, so an
    expensive array is built once per row and not once per use.
    """
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(column)))
    return df


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _pairs(one: Column, two: Column, shift: int) -> Column:
    """Hash of every entry with the entry ``shift`` behind it; null-padded at the end."""
    return F.zip_with(one, F.slice(two, F.lit(shift + 1), F.greatest(F.size(two), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def with_windows(df: DataFrame, tokens: Column, name: str, keep: list[str]) -> DataFrame:
    """Add ``name``: a 64-bit hash of every run of five tokens, and ``n_words``; other columns: ``keep``.

    Fewer than five tokens give an empty array.
    """
    df = once(df, _w=F.transform(tokens, lambda w: F.xxhash64(w)))
    df = once(df, _p=_pairs(F.col("_w"), F.col("_w"), 1))
    df = once(df, _q=_pairs(F.col("_p"), F.col("_p"), 2))
    df = once(df, **{name: F.slice(_pairs(F.col("_q"), F.col("_w"), 4), F.lit(1), F.greatest(F.size("_w") - 4, F.lit(0)))})
    return df.select(*keep, F.size("_w").cast("long").alias("n_words"), name)
