"""N-gram Jaccard join of documents: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from rillmark.llm import shingle_join as S
from rillmark.llm.components import components
from rillmark.llm.storage import materialize, measured, prepare
from rillmark.llm.words import chunks, fingerprint, shingle_sets

# A hash counts as frequent in a batch when this many different sets of it hold it.
FREQUENT_IN_BATCH = 4


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and shingle sets of a batch, chunk by chunk."""
    for first, flat, offsets in chunks(batch.column("text")):
        own = shingle_sets(flat, offsets, width)
        yield np.arange(first, first + len(own)), own


def _signatures(width: int):
    """Per document its set size and fingerprint; per batch the hashes that several sets hold (``h``, ``df``)."""

    def run(batches):
        for batch in batches:
            ids, n, f1, f2, fresh, seen = batch.column("doc_id").to_numpy(zero_copy_only=False), [], [], [], [], set()
            for _, sets in _sets(batch, width):
                for own in sets:
                    mark = fingerprint(own) if len(own) else (0, 0)
                    n.append(len(own)), f1.append(mark[0]), f2.append(mark[1])
                    if len(own) and mark not in seen:
                        seen.add(mark)
                        fresh.append(own)
            h, df = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.zeros(0, np.uint64),) * 2
            often = df >= FREQUENT_IN_BATCH
            h, df = h[often].view(np.int64), df[often].astype(np.int64)
            none, zeros = pa.nulls(len(h), pa.int64()), pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), from_pandas=True), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), zeros, zeros],
                names=["doc_id", "n", "f1", "f2", "h", "df"])
            if len(h):
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.array(h), pa.array(df)], names=["doc_id", "n", "f1", "f2", "h", "df"])

    return run


def _cells(width: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """Prefix cells (``h``, ``c``, ``n``) of every set of a batch, once per set."""

    def run(batches):
        for batch in batches:
            seen = set()
            for _, sets in _sets(batch, width):
                h, c, n = [], [], []
                for own in sets:
                    if not len(own) or (mark := fingerprint(own)) in seen:
                        continue
                    seen.add(mark)
                    first = S.prefix(own, frequent, rank, percent)
                    h.append(first), c.append(np.full(len(first), mark[0])), n.append(np.full(len(first), len(own)))
                if h:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(c)), pa.array(np.concatenate(n).astype(np.int32))],
                        names=["h", "c", "n"])

    return run


def _whole_sets(width: int):
    """Every document's whole set as bytes."""

    def run(batches):
        for batch in batches:
            for rows, sets in _sets(batch, width):
                ids = batch.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "own"])

    return run


@pandas_udf(LongType())
def overlap(one: pd.Series, two: pd.Series) -> pd.Series:
    """Entries of the product of two incidence rows."""
    out = []
    for x, y in zip(one, two):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out.append(int((y[at] == x).sum()))
    return pd.Series(out)


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` whose whole sets are similar."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = materialize(ids, "candidate-ids")
    texts = docs.join(measured(ids), "doc_id", "left_semi").select("doc_id", "text")
    sets = materialize(texts.mapInArrow(_whole_sets(width), "id long, own binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    both = both.withColumn("overlap", overlap("x", "y"))
    return both.filter(f"{100 + percent} * overlap >= {percent} * (na + nb)").select("a", "b")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Classes of near-duplicate documents, exactly.

    Takes integer ``doc_id`` and ``text`` (further columns are ignored) and returns per row ``doc_id``,
    ``n_shingles`` (size of its set of distinct runs of ``words`` words; a shorter text is one run) and
    ``component_id``, the smallest doc_id reachable over pairs whose Jaccard similarity is ``percent`` or more.

    Equal sets are joined by their fingerprint first, so copies cost one row each.  The others meet in the columns
    of the incidence matrix (see ``shingle_join``): first each column's hub with all its sets, which joins large
    groups of near copies with few pairs; then all pairs of a column that are still in different components.
    Surviving pairs are multiplied whole.

    Null and empty texts have no shingles and link with nothing, not even each other.  Rows with a null ``doc_id``
    are left out.  Rows that repeat a ``doc_id`` are expected to repeat the text; each returns a row.  An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    schema = "doc_id long, n long, f1 long, f2 long, h long, df long"
    signed = materialize(docs.mapInArrow(_signatures(words), schema), "signatures")
    frequent, rank = S.frequent_hashes(signed.filter("h IS NOT NULL").select("h", "df"))
    members = signed.filter("n IS NOT NULL").select("doc_id", "n", "f1", "f2")
    filled = members.filter("n > 0")
    classes = materialize(filled.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")

    cells = docs.mapInArrow(_cells(words, percent, frequent, rank), "h long, c long, n int")
    cells = materialize(S.columns(cells), "cells")
    listed = S.lists(cells, percent).join(classes.select(F.col("f1").alias("c"), F.col("n").cast("int").alias("n"), "id"), ["c", "n"])
    listed = materialize(listed.select("id", "n", "hs", "used"), "lists")
    cells = materialize(S.spread(listed), "list-cells")

    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, label long")
    for step in (
        lambda: S.hub_pairs(cells, labels, percent),
        lambda: S.hub_pairs(cells, labels, percent, draw=1),
        lambda: S.hub_pairs(cells, labels, percent, draw=2),
        lambda: S.rest_pairs(cells, labels, percent),
    ):
        pairs = materialize(S.above_bound(step(), listed, percent), "pairs")
        if not pairs.isEmpty():
            links = materialize(links.union(_linked(docs, pairs, words, percent)), "links")
            labels = components(links)
    named = classes.join(labels, "id", "left").select("f1", "f2", "n", F.coalesce("label", "id").alias("component_id"))
    named = materialize(named, "class-labels")
    return members.join(named, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
