"""Packing of documents into token sequences of a fixed capacity, by exact complements and then by best fit."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, prepare
from rillmark.llm.token_files import _encoder
from rillmark.llm.words import chunks

CAPACITY = 4096
# A slot's key holds its length above this many bits of rank.
_RANK_BITS = 44


def _cut(path: str, capacity: int, keep: bool):
    """Pieces of every document, each numbered among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs = batch.column("doc_id").cast(pa.int64())
            for first, flat, offsets in chunks(batch.column("text")):
                ids, counts = encoder.encode(flat, offsets)
                ids = ids.astype("<u4", copy=False)
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                ends = np.cumsum(length)  # a document's pieces follow each other, as its ids do
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (b - k) : 4 * b]) for k, b in zip(length.tolist(), ends.tolist())]
                order = np.argsort(length, kind="stable")
                own = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(own) - own, own) + seen[length[order]]
                seen += own
                columns = {
                    "doc_id": docs.take(pa.array(doc + first)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "block": pa.array(np.full(len(doc), block, np.int32)), "nth": pa.array(nth)}
                if keep:
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep: bool = False) -> DataFrame:
    """Written table of pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``block``, ``nth`` and, with
    ``keep``, their ``ids``.

    Takes ``doc_id``, ``text``; other columns are ignored.  A document is its token ids and the end id; one of more than
    ``capacity`` ids is cut, its last piece may be shorter.  Null and empty texts are one piece of one id; repeated rows
    are documents of their own; null ids stay null.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long" + ", ids array<int>" * keep
    return materialize(rows.mapInArrow(_cut(tokenizer, capacity, keep), schema), "pieces")


class _Sums:
    """Which lengths are left, and in how many ways one, two or three of them add up to every sum.

    The numbers of ways are the first three powers of the set of lengths under convolution; without a length x they are
    those of ``S - x``, so removing one is a few shifts.  They ignore how often a length is there: ``find`` looks at
    the counts.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.one, self.two, self.three = (np.zeros(len(counts), np.int64) for _ in range(3))
        for x in np.flatnonzero(counts).tolist():
            self._change(x, 1)

    def _change(self, x: int, sign: int) -> None:
        n = len(self.one)
        shifted = lambda a, by: np.concatenate((np.zeros(min(by, n), np.int64), a[: max(n - by, 0)]))
        self.three += sign * 3 * shifted(self.two, x) + 3 * shifted(self.one, 2 * x)
        self.two += sign * 2 * shifted(self.one, x)
        if 3 * x < n:
            self.three[3 * x] += sign
        if 2 * x < n:
            self.two[2 * x] += 1
        self.one[x] += sign

    def take(self, used: Counter, times: int) -> None:
        for x, k in used.items():
            self.counts[x] -= k * times
            if not self.counts[x]:
                self._change(x, -1)

    def find(self, gap: int, opened: int, most: int) -> list[int] | None:
        """Up to ``most`` (three) lengths that fill a gap exactly beside the opening piece: fewest first, then the longest."""
        there = lambda *some: all(self.counts[x] >= k for x, k in Counter((opened, *some)).items())
        if self.one[gap] and there(gap):
            return [gap]
        for a, b in self._pairs(gap, gap) if most > 1 else ():
            if there(a, b):
                return [a, b]
        if most > 2 and self.three[gap]:
            longest = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
            for a in longest[(self.one[longest] > 0) & (self.two[gap - longest] > 0)].tolist():
                for b, c in self._pairs(gap - a, a):
                    if there(a, b, c):
                        return [a, b, c]
        return None

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        if total < 2 or not self.two[total]:
            return
        longer = np.arange(min(total - 1, most), (total + 1) // 2 - 1, -1)
        for a in longer[(self.one[longer] > 0) & (self.one[total - longer] > 0)].tolist():
            yield a, total - a


def fill(counts: np.ndarray, capacity: int, most: int = 3) -> list[tuple[int, Counter]]:
    """How often which lengths go into a sequence together, given how many pieces there are of every length.

    From the longest piece on, pieces whose gap up to ``most`` others fill exactly are used up with them, as often as
    their counts allow.  What is left goes, longest first, where the least room remains.
    """
    counts = counts.copy()
    sums, patterns = _Sums(counts), []
    for x in range(capacity, 0, -1):
        while counts[x]:
            found = [] if x == capacity else sums.find(capacity - x, x, most)
            if found is None:
                break
            used = Counter((x, *found))
            times = min(int(counts[y]) // k for y, k in used.items())
            patterns.append((times, used))
            sums.take(used, times)
    rooms: dict[int, list[tuple[int, Counter]]] = {}
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            gap = min((g for g in rooms if g >= x), default=None)
            times, used = rooms[gap].pop() if gap else (left, Counter())
            copies = min((gap or capacity) // x, left)
            filled = min(times, left // copies)
            if gap and filled < times:
                rooms[gap].append((times - filled, used))
            if gap and not rooms[gap]:
                del rooms[gap]
            rooms.setdefault((gap or capacity) - copies * x, []).append((filled, used + Counter({x: copies})))
            left -= filled * copies
    return patterns + [pattern for some in rooms.values() for pattern in some]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, Counter]]:
    """The ``fill`` with the fewest sequences.  Where long pieces are so many that each needs a sequence of its own, short
    ones are better not used up two and three at a time, so single and pair complements are tried on their own as well."""
    return min((fill(counts, capacity, most) for most in (3, 2, 1)), key=lambda found: sum(times for times, _ in found))


class Slots:
    """Where the pieces of every length go: arrays over runs of ranks, sorted by length and first rank."""

    def __init__(self, patterns: list[tuple[int, Counter]]):
        rows, sequence, used = [], 0, Counter()
        for times, lengths in patterns:
            offset = 0
            for length in sorted(lengths, reverse=True):
                copies = lengths[length]
                rows.append(((length << _RANK_BITS) + used[length], sequence, copies, offset, length))
                used[length] += times * copies
                offset += copies * length
            sequence += times
        self.sequences = sequence
        self.key, self.sequence, self.copies, self.offset, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given their ranks among those of their length."""
        key = (length << _RANK_BITS) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        within, copies = key - self.key[at], self.copies[at]
        return self.sequence[at] + within // copies, self.offset[at] + within % copies * length


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: Slots = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = slots.of(length, rank)
            rest = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (see ``cut``) with ``sequence_id`` and ``offset``, without ``block`` and ``nth``.

    A piece's place depends on its length alone, so the plan is made from one count per length, ``capacity`` rows at
    most whatever the number of pieces, and holds runs of pieces of equal length.  A piece finds its run by its rank among
    those of its length: its number in its block and those of the blocks before.  No piece moves for that beyond one join.
    """
    spark = pieces.sparkSession
    blocks = materialize(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "blocks")
    counts = np.zeros(capacity + 1, np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["block", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    ranked = ranked.select(*(c for c in pieces.columns if c not in ("block", "nth")), "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_placed(slots), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Place of every piece of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.  An empty table gives an empty result; see ``cut`` for other cases."""
    return place(cut(docs, tokenizer, capacity), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids``, ``doc_ids`` and ``offsets`` of their pieces."""
    placed = place(cut(docs, tokenizer, capacity, keep=True), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
