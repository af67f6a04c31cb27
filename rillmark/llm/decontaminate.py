"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.native import once, with_windows, words
from rillmark.llm.storage import materialize, measured, prepare

WORDS = 5


def _tokens(text: Column) -> Column:
    return words(F.lower(text))


def _runs(df: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct five-word runs of every row as texts, one row each."""
    df = once(df.select(*keep, F.col("text")), _w=_tokens(F.col("text")))
    at = F.sequence(F.lit(1), F.size("_w") - (WORDS - 1))
    df = df.filter(F.size("_w") >= WORDS).select(*keep, "_w", F.explode(at).alias("_i"))
    return df.select(*keep, F.array_join(F.slice("_w", F.col("_i"), F.lit(WORDS)), " ").alias("run")).distinct()


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """MinHash sketch of every item: its smallest ``k`` run hashes (``item_id``, ``h``).

    Items are partitioned by size, in powers of two.  A document that holds ``percent`` of an item's n distinct runs
    misses at most n - ceil(percent n), so of any one more it holds at least one.  ``k`` is that number for the
    largest item of the partition, so every document with enough containment meets the sketch.
    """
    runs = items.select("item_id", F.explode(F.array_distinct("h")).alias("h"))
    sets = runs.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    sets = sets.withColumn("part", F.floor(F.log2(F.size("hs"))).cast("int"))
    largest = sets.groupBy("part").agg(F.max(F.size("hs")).alias("n"))
    k = F.expr(f"CAST(n - ceil({percent} * n / 100) + 1 AS int)")
    return sets.join(largest, "part").select("item_id", F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the whole word sequence of an item of fewer than WORDS words: ``doc_id``, ``item_id``.

    These items are partitions of their own, one per number of words, of which only those that occur are looked up.
    """
    whole = items.select("item_id", _tokens(F.col("text")).alias("_w")).filter(F.size("_w").between(1, WORDS - 1))
    whole = materialize(whole.select("item_id", F.size("_w").alias("n"), F.array_join("_w", " ").alias("run")).distinct(), "short-items")
    sizes = sorted(r["n"] for r in whole.select("n").distinct().collect())
    if not sizes:
        return docs.limit(0).selectExpr("doc_id", "CAST(NULL AS bigint) AS item_id")

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.array_join(F.slice("_w", i, n), " "))

    every = F.array_distinct(F.flatten(F.array(*(runs(n) for n in sizes))))
    held = once(docs, _w=_tokens(F.col("text"))).select("doc_id", F.explode(every).alias("run"))
    return held.join(measured(whole.select("item_id", "run")), "run").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """Benchmark items inside documents: one row per document and item held to ``percent`` or more.

    Takes ``doc_id``, ``text`` and ``item_id``, ``text``; other columns are ignored.  Containment counts an item's
    distinct runs of five lower-cased words; returns ``doc_id``, ``item_id``, ``n_runs`` of the item, ``n_held``.
    Document runs are only hashed and looked up in the sketches (see ``sketches``), where hashes above the largest
    sketch value are dropped first; what is met is verified on the runs as text.

    An item of fewer than five words is one run, its whole sequence of words, and is held where the document has that
    sequence.  Null and empty texts have no runs and match nothing.  Rows with a null id are left out, repeated ids are
    one document or item with the runs of all its rows; a short row beside a longer one of its id adds nothing.  Empty
    tables give an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    items = materialize(benchmark.filter("item_id IS NOT NULL").select("item_id", "text"), "items")
    wanted = materialize(sketches(with_windows(items, _tokens(F.col("text")), "h", ["item_id"]), percent), "sketches")
    long = wanted.select("item_id").distinct()
    short = _short(docs, items).join(measured(long), "item_id", "left_anti").selectExpr("doc_id", "item_id", "1L AS n_runs", "1L AS n_held")
    top = wanted.agg(F.max("h")).first()[0]
    if top is None:
        return short

    hashed = with_windows(docs, _tokens(F.col("text")), "h", ["doc_id"])
    hashed = hashed.select("doc_id", F.explode("h").alias("h")).filter(F.col("h") <= top)
    met = hashed.join(measured(wanted), "h").select("doc_id", "item_id").distinct()
    met = materialize(met, "met")

    runs = materialize(_runs(items, ["item_id"]), "item-runs")
    sizes = runs.groupBy("item_id").agg(F.count("*").alias("n_runs"))
    ids = materialize(met.select("doc_id").distinct(), "met-documents")
    texts = docs.join(measured(ids), "doc_id", "left_semi")
    held = _runs(texts, ["doc_id"]).join(measured(runs), "run").select("doc_id", "item_id")
    held = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_held"))
    found = held.join(met, ["doc_id", "item_id"]).join(measured(sizes), "item_id")
    return found.filter(f"100 * n_held >= {percent} * n_runs").select("doc_id", "item_id", "n_runs", "n_held").unionByName(short)
