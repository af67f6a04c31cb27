"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, measured, prepare
from rillmark.llm.words import chunks, word_bounds

# Rows that one task orders at a time, about.
RUN_ROWS = 4096


def _sizes(batches):
    """Word count of every text."""
    for batch in batches:
        counts = [np.diff(word_bounds(flat, offsets)[2]) for _, flat, offsets in chunks(batch.column("text"))]
        size = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), size], names=["doc_id", "source", "size"])


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Target of every source: ``source``, ``source_size``, ``target``.

    Sources by code point, null last, take the weights in turn.  Shares of ``share`` times all sizes are proportional
    to the weights, except that no source gets more than ``repeats`` times its size: with the sources in order of
    size by weight, the first whose fair share of what is left fits ends the capped ones.  One row per source is
    ordered in one task.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = own.withColumn("at", (F.row_number().over(every) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("at") + 1))
    ranked = ranked.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("taken", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("taken")) / F.col("rest"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(fits).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 7) -> DataFrame:
    """How often every document is taken: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    Takes ``doc_id``, ``text``, ``source``; other columns are ignored.  A document's size is its number of words.
    A hash of seed and ``doc_id`` shuffles the documents of a source; copy number e of a document has the virtual
    finish time ``(e * source size + cumulated size up to it) / target``.  All copies in order of that time (then
    source, hash, id) are taken up to the total of the targets.

    Both running sums are cut into runs of about RUN_ROWS rows by ranges of the hash and of the time; only totals per
    run are summed in order, so a source of any size is spread over all tasks.  The order does not depend on the
    partitioning, so reruns agree.

    Null and empty texts have size 0 and take nothing; a source of size 0 has target 0.  A null source is a source.
    Repeated rows are documents of their own.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text", "CAST(source AS string) AS source")
    rows = rows.mapInArrow(_sizes, "doc_id long, source string, size long")
    rows = materialize(rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    plan = materialize(targets(rows, weights, share, repeats), "targets")
    bits = max(1, math.ceil(math.log2(rows.count() / RUN_ROWS + 1)))

    # Cumulated sizes within each source.
    rows = rows.withColumn("run", F.shiftright("u", 64 - bits)).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "run").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(within)).join(runs, ["key", "run"])
    plan = plan.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    rows = rows.join(measured(plan), "key")
    finish = [
        F.when(F.col("size") > 0, (F.lit(e) * F.col("source_size") + F.col("before") + F.col("own")) / F.col("target")).alias(f"f{e}")
        for e in range(repeats)
    ]
    rows = materialize(rows.select("doc_id", "source", "key", "u", "size", "source_size", "target", *finish), "finish")

    # The last copy taken, in the order of finish times.
    place = lambda f: F.struct(F.col(f).alias("f"), "key", "u", "doc_id")
    copies = rows.select("size", F.explode(F.array(*(place(f"f{e}") for e in range(repeats)))).alias("p"))
    copies = copies.filter("p.f IS NOT NULL")
    budget = plan.agg(F.sum("target")).first()[0] or 0.0
    run = F.floor(F.col("p.f") / (1 + F.col("p.f")) * (1 << bits)).cast("long")
    totals = copies.groupBy(run.alias("run")).agg(F.sum("size").alias("total"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    last = totals.withColumn("upto", F.sum("total").over(before)).filter(F.col("upto") > budget + 1e-6)
    last = last.orderBy("run").first()
    if last is None:
        taken = [F.col(f"f{e}").isNotNull() for e in range(repeats)]
    else:
        edge = copies.filter(run == last["run"])
        order = Window.orderBy("p", "size").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("upto", F.sum("size").over(order) + (last["upto"] - last["total"]))
        edge = edge.filter(F.col("upto") > budget + 1e-6).orderBy("upto").select("p").first()["p"]
        first_out = F.struct(F.lit(edge["f"]).alias("f"), F.lit(edge["key"]).alias("key"), F.lit(edge["u"]).cast("long").alias("u"), F.lit(edge["doc_id"]).cast("long").alias("doc_id"))
        taken = [F.col(f"f{e}").isNotNull() & (place(f"f{e}") < first_out) for e in range(repeats)]
    count = sum((t.cast("int") for t in taken[1:]), taken[0].cast("int"))
    return rows.withColumn("copies", count).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
