"""Line deduplication: an exact set-similarity join of lines, of which later matches are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm import shingle_join as S
from rillmark.llm.near_duplicates import overlap
from rillmark.llm.storage import materialize, measured, prepare
from rillmark.llm.words import chunks, segment_fingerprints, segment_sets

# A hash counts as frequent in a batch when this many different lines of it hold it.
FREQUENT_IN_BATCH = 8

_ID = "struct<d:bigint,l:int>"


def _line_sets(batch: pa.RecordBatch, width: int):
    """Per chunk: row and number of every line with tokens, where its hashes begin and end, all hashes in order."""
    for first, flat, offsets in chunks(batch.column("text")):
        newline = np.flatnonzero(flat == 10) + 1
        per_row = np.diff(np.searchsorted(newline - 1, offsets)) + 1
        begin = np.sort(np.concatenate((offsets[:-1], newline)))
        row = np.repeat(np.arange(len(per_row)), per_row)
        number = np.arange(len(begin)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        segment, found = segment_sets(flat, np.append(begin, len(flat)), width)
        if not len(found):
            continue
        edges = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        line = segment[edges]
        yield first + row[line], number[line], edges, np.append(edges[1:], len(found)), found


def _signatures(width: int):
    """Per line with tokens its place, set size and fingerprint; per batch the hashes that many lines hold."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            fresh, seen = [], set()
            for row, number, begin, end, found in _line_sets(batch, width):
                one, two = segment_fingerprints(begin, found)
                first = np.unique(one, return_index=True)[1]
                first = first[[m not in seen for m in one[first].tolist()]]
                seen.update(one[first].tolist())
                keep = np.zeros(len(begin), bool)
                keep[first] = True
                fresh.append(found[np.repeat(keep, end - begin)])
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row], pa.int64()), pa.array(number.astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                     pa.array(one), pa.array(two), none, none],
                    names=["d", "l", "n", "f1", "f2", "h", "df"])
            h, df = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.zeros(0, np.uint64),) * 2
            often = df >= FREQUENT_IN_BATCH
            if often.any():
                h, df = h[often].view(np.int64), df[often].astype(np.int64)
                none, small = pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.int32())
                yield pa.RecordBatch.from_arrays([none, small, small, none, none, pa.array(h), pa.array(df)], names=["d", "l", "n", "f1", "f2", "h", "df"])

    return run


def _cells(width: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """Prefix cells (``h``, ``c``, ``n``), once per different line of a batch."""

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, begin, end, found in _line_sets(batch, width):
                one, _ = segment_fingerprints(begin, found)
                first = np.unique(one, return_index=True)[1]
                first = np.sort(first[[m not in seen for m in one[first].tolist()]])
                seen.update(one[first].tolist())
                size = (end - begin)[first]
                take = np.repeat(begin[first] - np.cumsum(size) + size, size) + np.arange(size.sum())
                own, line = found[take], np.repeat(np.arange(len(first)), size)
                if len(frequent):  # frequent hashes last, by rank
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    late = np.where(frequent[at] == own, rank[at] + 1, 0)
                    moved = np.zeros(len(first), bool)
                    moved[line[late > 0]] = True
                    moved = np.flatnonzero(moved[line])
                    own[moved] = own[moved][np.lexsort((own[moved], late[moved], line[moved]))]
                length = np.minimum(size, size - -(-percent * size // 100) + S.shared(size))
                begins = np.cumsum(size) - size
                pick = np.arange(len(own)) - np.repeat(begins, size) < np.repeat(length, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[pick].view(np.int64)), pa.array(one[first][line[pick]]), pa.array(size[line[pick]].astype(np.int32))],
                    names=["h", "c", "n"])

    return run


def _whole_sets(width: int):
    """Whole sets of the lines named by ``lines``, as bytes."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            wanted = [set(x) for x in batch.column("lines").to_pylist()]
            for row, number, begin, end, found in _line_sets(batch, width):
                keep = [k for k, (r, l) in enumerate(zip(row.tolist(), number.tolist())) if l in wanted[r]]
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[keep]], pa.int64()), pa.array(number[keep].astype(np.int32)),
                         pa.array([found[begin[k] : end[k]].tobytes() for k in keep], pa.binary())],
                        names=["d", "l", "own"])

    return run


def _similar(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Later ids of those ``pairs`` whose whole sets are similar."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    lines = ids.groupBy(F.col("id.d").alias("doc_id")).agg(F.collect_set("id.l").alias("lines"))
    lines = materialize(lines, "candidate-lines")
    texts = docs.join(measured(lines), "doc_id").select("doc_id", "text", "lines")
    sets = materialize(texts.mapInArrow(_whole_sets(width), "d long, l int, own binary"), "line-sets")
    sets = sets.dropDuplicates(["d", "l"]).select(F.struct("d", "l").alias("id"), "own")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b").withColumn("overlap", overlap("x", "y"))
    return both.filter(f"{100 + percent} * overlap >= {percent} * (na + nb)").select(F.col("b").alias("id")).distinct()


def repeated_lines(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Lines that repeat an earlier one: ``doc_id``, ``line`` (counted from 0).

    Takes integer ``doc_id`` and ``text``; other columns are ignored.  Lines are cut at ``\\n`` and ordered by
    (doc_id, line).  A line's tokens are its distinct runs of ``words`` lower-cased words; a shorter line is one token.
    A line repeats an earlier one when the Jaccard similarity of their tokens is ``percent`` or more; earlier lines
    that are removed themselves count.

    Equal lines are joined by fingerprint: all but the first are removed.  The first ones are joined by prefixes of
    their rarest tokens under length and positional filters (see ``shingle_join``), first with the earliest line of
    every token, which settles large groups with few pairs, then those not settled with all earlier ones; what passes
    is verified on the whole sets.

    Lines without words are never removed.  Null and empty texts have none.  Rows with a null id are left out; rows
    that repeat an id are expected to repeat the text and count once.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    schema = "d long, l int, n int, f1 long, f2 long, h long, df long"
    signed = materialize(docs.mapInArrow(_signatures(words), schema), "line-signatures")
    frequent, rank = S.frequent_hashes(signed.filter("h IS NOT NULL").select("h", "df"))
    lines = signed.filter("n IS NOT NULL").select(F.struct("d", "l").alias("id"), "n", "f1", "f2")
    firsts = lines.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    firsts = materialize(firsts, "first-lines")
    repeated = materialize(firsts.filter("id <> last").select("f1", "f2", "n", F.col("id").alias("first")), "repeated-lines")
    copies = lines.join(measured(repeated), ["f1", "f2", "n"]).filter("id <> first").select("id")

    cells = materialize(S.columns(docs.mapInArrow(_cells(words, percent, frequent, rank), "h long, c long, n int")), "line-cells")
    listed = S.lists(cells, percent).join(firsts.select(F.col("f1").alias("c"), "n", "id"), ["c", "n"])
    listed = materialize(listed.select("id", "n", "hs", "used"), "line-lists")
    cells = materialize(S.spread(listed), "list-cells")
    settled = docs.sparkSession.createDataFrame([], f"id {_ID}")
    for step in (_first_pairs, _earlier_pairs):
        pairs = materialize(S.above_bound(step(cells, settled, percent), listed, percent), "line-pairs")
        if not pairs.isEmpty():
            settled = materialize(settled.union(_similar(docs, pairs, words, percent)).distinct(), "settled")
    found = copies.union(settled).distinct()
    return found.select(F.col("id.d").alias("doc_id"), F.col("id.l").alias("line"))


def _first_pairs(cells: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """The earliest line of every column with each other line of it."""
    low = cells.groupBy("h").agg(F.min(F.struct("id", "n")).alias("low"))
    pairs = cells.join(low, "h").selectExpr("low.id AS a", "low.n AS na", "id AS b", "n AS nb").filter("a <> b")
    return pairs.filter(S.near_sizes("na", "nb", percent)).distinct()


def _earlier_pairs(cells: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Lines not settled with all earlier ones of their columns."""
    later = cells.join(settled, "id", "left_anti").selectExpr("h", "id AS b", "n AS nb", "left AS rb")
    pairs = cells.selectExpr("h", "id AS a", "n AS na", "left AS ra").join(later, "h").filter("a < b")
    pairs = pairs.filter(S.near_sizes("na", "nb", percent)).filter(f"least(ra, rb) >= {S.needed(percent)}")
    return pairs.select("a", "na", "b", "nb").distinct()


def without_repeats(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Documents with the lines of ``repeated_lines`` taken out of ``text``; all columns stay."""
    gone = removed.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("_gone", i))
    df = docs.join(gone, "doc_id", "left")
    return df.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(docs.columns)
