"""Count windows, ordering and prefix computations that stay bounded per task.

A rollback window is "the newest N rows of a key".  Everything that needs the
whole group in order (percentiles, steps, lists of values) runs after it, so no
group ever exceeds N rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.session import HOT_KEY_PARTS, estimated_splits

DEFAULT_CHUNK = 65_536


def last_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    salts: int = HOT_KEY_PARTS,
    rank: str = "rn",
) -> DataFrame:
    """Newest ``n`` rows per key with their rank (1 = newest).

    ``order`` must end in a unique tie-break.  Each map task keeps at most n
    rows per key before the shuffle.  Where the input may come from more than
    ``salts`` full splits, a key is then cut to n rows in ``salts`` independent
    parts, so that only ``n * salts`` of its rows meet in one task.  Below that
    the map side alone leaves no more, and one exchange is enough.
    """
    newest = [F.col(c).desc() for c in order]
    if salts > 1 and estimated_splits(df) > salts:
        part = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*newest)
        df = part.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank, "_salt")
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record per key as an aggregate, so a repeated key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, "_first.*").select(*df.columns)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per key, whatever the sizes and the key skew.

    A small lookup is broadcast by Spark's own measure.  A large one that was
    just aggregated already sits on the join key, which would keep adaptive
    execution from splitting the rows of a hot key; the rebalance gives the
    join two plain shuffles again.
    """
    return rows.join(lookup.hint("rebalance"), list(keys), how)


def prefix_values(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    how: str,
    out: str,
    chunk: int = DEFAULT_CHUNK,
    total: str | None = None,
) -> DataFrame:
    """Aggregate of ``value`` over all earlier rows of the key (current excluded).

    ``position`` is a whole number that orders the key's rows.  Rows are split
    into position chunks; chunk totals are prefixed over the few chunk rows and
    joined back, so a hot key is spread over many tasks.  ``how`` is ``sum``
    or ``max``; a key's first row gets null.  ``total`` names an optional
    column with the aggregate of the whole key.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    merge = (lambda a, b: F.coalesce(a + b, a, b)) if how == "sum" else (lambda a, b: F.greatest(a, b))
    chunked = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    totals = chunked.groupBy(*keys, "_chunk").agg(agg(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_kc"),
        agg("_total").over(before).alias("_carry"),
        agg("_total").over(Window.partitionBy(*keys)).alias("_all"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("_local", agg(value).over(inside))
    cond = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, cond, "left")
    extra = [F.col("_all").alias(total)] if total else []
    return joined.withColumn(out, merge(F.col("_local"), F.col("_carry"))).select(*df.columns, out, *extra)


def record_highs(
    df: DataFrame, keys: Sequence[str], position: str, value: str, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Rows whose value exceeds every earlier value of the key (start 0)."""
    seen = prefix_values(df, keys, position, value, "max", "_seen", chunk)
    return seen.filter(F.col(value) > F.greatest(F.coalesce(F.col("_seen"), F.lit(0.0)), F.lit(0.0))).drop("_seen")


def cut_at_budget(
    df: DataFrame, keys: Sequence[str], position: str, text: str, budget: int, out: str,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Texts of a key in order until their joined length passes ``budget``.

    A key whose texts are longer than the budget keeps its first
    ``budget - 1`` characters; the others keep everything.
    """
    sized = df.withColumn("_len", F.length(text).cast("long"))
    run = prefix_values(sized, keys, position, "_len", "sum", "_before", chunk, total="_whole")
    left = F.lit(budget - 1) - F.coalesce(F.col("_before"), F.lit(0))
    run = run.withColumn("_left", F.when(F.col("_whole") > budget, left).otherwise(F.col("_len")))
    kept = run.filter(F.col("_left") > 0)
    cut = F.substring(F.col(text), F.lit(1), F.least(F.col("_left"), F.col("_len")).cast("int"))
    return kept.withColumn(out, cut).drop("_len", "_before", "_whole", "_left")


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def gap_to_previous(df: DataFrame, keys: Sequence[str], order: Column, value: str, out: str) -> DataFrame:
    """Gap of a value to the previous row of the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))
