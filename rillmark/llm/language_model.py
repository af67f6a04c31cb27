"""LM scoring: cross-entropy difference of a target and a background n-gram model over one vocabulary.

Both models are word-pair models smoothed by words.  A document is scored by the pairs of all other documents::

    P(w | v) = (n(v, w) + S p(w)) / (n(v) + S)        p(w) = (n(w) + 1) / (N + V)

``n(v, w)`` counts the pair and ``n(v)`` the word with any word behind it, outside the document; ``n(w)``, of ``N`` words,
counts the word everywhere.  The vocabulary is all words that occur twice, ``V`` with the unknown word, which all others
are and which is in no pair; so the probabilities behind a word sum to one, less its share of unknown words.  The
background model counts all documents, the target model the target ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, measured, prepare
from rillmark.llm.words import chunks, mix, word_bounds, word_hashes

# Words and pairs with at least total / FREQUENT occurrences are held by every task (together about 30 MB), so none of
# their many rows meet in one.  All others travel to the bucket of their hash; none is left out.
FREQUENT = 1 << 18
# Occurrences from which a word is known, in a corpus of any size.
LEAST = 2
# Weight of the word distribution in the distribution after a word.
SMOOTHING = 64.0
# Words of a bucket and of a task that reads buckets, about, and entries that a task gathers before it sends them off.
BUCKET = 1 << 18
TASK = 1 << 23
FLUSH = 1 << 20

_COUNTS = "kind int, h long, n long, t long, ln long, lt long"
_WORD, _PAIR, _BEGIN = range(3)
# Stands before the first word of a document.
_START = np.uint64(0x9D5C_1F0B_37A8_E264)


def _neighbours(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of all words with the word before, and the index of every document's first word."""
    starts, _, begin = word_bounds(flat, offsets)
    words = word_hashes(flat, starts)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[begin[:-1][begin[:-1] < begin[1:]]] = _START
    return words, mix(before * np.uint64(0xD1342543DE82EF95) + words), begin


def _leading(begin: np.ndarray) -> np.ndarray:
    """Whether a word has another behind it."""
    out = np.ones(int(begin[-1]), bool)
    out[begin[1:][np.diff(begin) > 0] - 1] = False
    return out


def _sums(kind: int, keys: np.ndarray, *values: np.ndarray, least: int = 1) -> pa.RecordBatch:
    """Sums of every key; the first value is the one to reach ``least``."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    sums = [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]
    sums += [np.zeros(len(first), np.int64)] * (4 - len(sums))
    kept = sums[0] >= least
    columns = [np.full(int(kept.sum()), kind, np.int32), keys[first][kept].view(np.int64), *(s[kept] for s in sums)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "h", "n", "t", "ln", "lt"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, beginnings of documents, and pairs that are common in a stretch of the text."""
    words, pairs, marks, leads, begun = [], [], [], [], np.zeros(2, np.int64)

    def flush():
        w, p, m, lead = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (words, pairs, marks, leads))
        yield _sums(_WORD, w, np.ones(len(w)), m, lead, m * lead)
        yield _sums(_PAIR, p, np.ones(len(p)), least=max(2, len(p) // (2 * FREQUENT)))
        for x in (words, pairs, marks, leads):
            x.clear()

    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for first, flat, offsets in chunks(batch.column("text")):
            w, p, begin = _neighbours(flat, offsets)
            count, own = np.diff(begin), target[first : first + len(offsets) - 1]
            for x, new in ((words, w), (pairs, p), (marks, np.repeat(own, count)), (leads, _leading(begin))):
                x.append(new)
            begun += ((count > 0).sum(), own[count > 0].sum())
        if sum(map(len, words)) >= FLUSH:
            yield from flush()
    yield from flush()
    yield _sums(_BEGIN, np.array([_START]), *begun.reshape(2, 1))


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of every wanted key among the sorted keys; their number for absent ones."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def _count_common(shared):
    """Occurrences of the pairs that are common somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        sums = np.zeros((2, len(keys) + 1))
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for first, flat, offsets in chunks(batch.column("text")):
                _, pairs, begin = _neighbours(flat, offsets)
                at = _at(keys, pairs)
                marks = np.repeat(target[first : first + len(offsets) - 1], np.diff(begin))
                sums[0] += np.bincount(at, minlength=len(keys) + 1)
                sums[1] += np.bincount(at, weights=marks, minlength=len(keys) + 1)
        n, t = sums[:, :-1].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(t)], names=["h", "n", "t"])

    return run


class Frequent:
    """What every task holds: sorted frequent words and pairs with their counts, and the totals.

    Counts are pairs (background, target) of columns: ``word`` of the word, ``lead`` of it before another, ``pair``.
    """

    def __init__(self, words, pairs, totals: tuple[int, int], size: int, unknown: tuple[int, int]):
        order = np.argsort(words["h"].to_numpy(np.int64).view(np.uint64))
        self.words = words["h"].to_numpy(np.int64).view(np.uint64)[order]
        self.word, self.lead = words[["n", "t"]].to_numpy(float)[order], words[["ln", "lt"]].to_numpy(float)[order]
        order = np.argsort(pairs["h"].to_numpy(np.int64).view(np.uint64))
        self.pairs = pairs["h"].to_numpy(np.int64).view(np.uint64)[order]
        self.pair = pairs[["n", "t"]].to_numpy(float)[order]
        self.whole = np.array(totals, float) + size
        self.unknown = -np.log(SMOOTHING * (np.array(unknown, float) + 1) / self.whole)

    def word_loss(self, n: np.ndarray, lead: np.ndarray, mark: np.ndarray, count: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """Part of the loss of a word's occurrences in a document, as words and as words before others."""
        own = leads[:, None] * np.column_stack((np.ones(len(mark)), mark))
        return -count[:, None] * np.log(SMOOTHING * (n + 1) / self.whole) + leads[:, None] * np.log(np.maximum(lead - own, 0) + SMOOTHING)

    def pair_gain(self, n: np.ndarray, word: np.ndarray, mark: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What the pairs of other documents take off that, given the counts of the pair and its second word."""
        others = n - count[:, None] * np.column_stack((np.ones(len(mark)), mark))
        return count[:, None] * np.log1p(others * self.whole / (SMOOTHING * (word + 1)))


def _groups(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, key): the first place of each, and for every place its group."""
    both = mix(keys + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, first, group = np.unique(both, return_index=True, return_inverse=True)
    return first, group


# Columns of an entry, each stored byte plane by byte plane: a word or pair, what tells its pairs or its second word apart,
# the document, the pair's occurrences in it, those of the word and of the word before others, and two marks.
_FIELDS = (("k1", np.uint64), ("k2", np.uint64), ("r", np.uint32), ("c", np.uint32), ("cw", np.uint32), ("lw", np.uint32), ("mark", np.uint8))
_TARGET, _RARE = 1, 2
_WIDTH = sum(np.dtype(t).itemsize for _, t in _FIELDS)


def _pack(entries: dict[str, np.ndarray], part: slice) -> bytes:
    return b"".join(entries[name][part].view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for name, kind in _FIELDS)


def _unpack(bodies: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    for base, n, body in bodies:
        planes, at = np.frombuffer(body, np.uint8).reshape(_WIDTH, n), 0
        for name, kind in _FIELDS:
            size = np.dtype(kind).itemsize
            parts[name].append(np.ascontiguousarray(planes[at : at + size].T).view(kind).ravel())
            at += size
        parts["r"][-1] = parts["r"][-1].astype(np.int64) + base
    return {name: np.concatenate(some) for name, some in parts.items()}


_SENT = "b long, r long, doc_id long, n_tokens long, lb double, lt double, n int, body binary"


def _entries(shared, buckets: int):
    """Per document the loss by what the task knows, and entries for the rest, packed per bucket of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Frequent = shared.value
        row = base = TaskContext.get().partitionId() << 40
        held: list[dict[str, np.ndarray]] = []

        def flush():
            if not held:
                return
            entries = {name: np.concatenate([h[name] for h in held]) for name, _ in _FIELDS}
            held.clear()
            order = np.argsort(entries["k1"])
            for name in entries:
                entries[name] = entries[name][order]
            at = (entries["k1"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]), [len(at)]))
            rows = {"b": [], "r": [], "n": [], "body": []}
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for name, value in (("b", int(at[a])), ("r", base), ("n", z - a), ("body", _pack(entries, slice(a, z)))):
                    rows[name].append(value)
            yield _row(len(rows["b"]), _SENT_SCHEMA, b=rows["b"], r=rows["r"], n=rows["n"], body=rows["body"])

        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for first, flat, offsets in chunks(batch.column("text")):
                words, pairs, begin = _neighbours(flat, offsets)
                count = np.diff(begin)
                doc = np.repeat(np.arange(len(count)), count)
                mark = target[first : first + len(count)].astype(np.int64)
                loss = np.zeros((len(count), 2))
                start = _at(model.words, np.array([_START]))
                filled = np.flatnonzero(count)
                if len(filled):
                    own = np.column_stack((np.ones(len(filled)), mark[filled]))
                    loss[filled] += np.log(np.maximum(model.lead[start] - own, 0) + SMOOTHING)
                # The words of every document.
                one, group = _groups(doc, words)
                cw, lw = np.bincount(group, minlength=len(one)), np.bincount(group, weights=_leading(begin), minlength=len(one))
                of, known = doc[one], _at(model.words, words[one])
                here = np.flatnonzero(known < len(model.words))
                part = model.word_loss(model.word[known[here]], model.lead[known[here]], mark[of[here]], cw[here], lw[here])
                for k in range(2):
                    loss[:, k] += np.bincount(of[here], weights=part[:, k], minlength=len(count))
                # Its pairs.
                two, pair_group = _groups(doc, pairs)
                c, of, second = np.bincount(pair_group, minlength=len(two)), doc[two], known[group[two]]
                common = np.where(second < len(model.words), _at(model.pairs, pairs[two]), len(model.pairs))
                here = np.flatnonzero(common < len(model.pairs))
                part = model.pair_gain(model.pair[common[here]], model.word[second[here]], mark[of[here]], c[here])
                for k in range(2):
                    loss[:, k] -= np.bincount(of[here], weights=part[:, k], minlength=len(count))
                rest = np.flatnonzero(common == len(model.pairs))
                rare = second[rest] == len(model.words)
                # A rare word's own counts go with the first of its entries.
                head = np.zeros(len(rest), bool)
                head[np.unique(np.where(rare, group[two[rest]], -1), return_index=True)[1]] = True
                head &= rare
                own = group[two[rest]]
                entry = {
                    "k1": np.where(rare, words[two[rest]], pairs[two[rest]]), "k2": np.where(rare, pairs[two[rest]], second[rest].astype(np.uint64)),
                    "r": of[rest] + (row - base), "c": c[rest], "cw": np.where(head, cw[own], 0), "lw": np.where(head, lw[own], 0),
                    "mark": mark[of[rest]] * _TARGET + rare * _RARE}
                held.append({name: entry[name].astype(kind) for name, kind in _FIELDS})
                ids = np.arange(row, row + len(count))
                yield _row(len(ids), _SENT_SCHEMA, b=ids % buckets, r=ids, doc_id=batch.column("doc_id").slice(first, len(count)), n_tokens=count, lb=loss[:, 0], lt=loss[:, 1])
                row += len(count)
                if sum(len(h["c"]) for h in held) >= FLUSH or row - base >= 1 << 31:
                    yield from flush()
                    base = row
        yield from flush()

    return run


_SENT_SCHEMA = pa.schema({"b": pa.int64(), "r": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "lb": pa.float64(), "lt": pa.float64(), "n": pa.int32(), "body": pa.binary()})


def _row(size: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Rows with the given columns, null in all others."""
    arrays = [columns.get(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([
        pa.nulls(size, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, schema)], schema=schema)


def _total(groups: np.ndarray, n: int, e: dict[str, np.ndarray], count: np.ndarray) -> np.ndarray:
    """Occurrences of every group, in all documents and in target ones."""
    return np.column_stack((np.bincount(groups, weights=count, minlength=n), np.bincount(groups, weights=count * (e["mark"] & _TARGET), minlength=n)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal rows of sorted keys."""
    fresh = np.zeros(len(keys[0]), bool)
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.cumsum(fresh)


def _bucket(model: Frequent, bodies: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their parts of the losses, from all entries of a bucket."""
    e = _unpack(bodies)
    order = np.lexsort((e["k2"], e["k1"]))
    e = {name: x[order] for name, x in e.items()}
    rare, target = e["mark"] & _RARE > 0, (e["mark"] & _TARGET).astype(float)
    pair = _runs(e["k1"], e["k2"], rare)
    sums = _total(pair, int(pair[-1]) + 1, e, e["c"])[pair]
    word = _runs(e["k1"], rare)
    n = _total(word, int(word[-1]) + 1, e, e["cw"])[word]
    lead = _total(word, int(word[-1]) + 1, e, e["lw"])[word]
    common = np.flatnonzero(~rare)
    n[common] = model.word[e["k2"][common].astype(np.int64)]
    known = ~rare | (n[:, 0] >= LEAST)
    out = np.zeros((len(rare), 2))
    out[known] -= model.pair_gain(sums[known], n[known], target[known], e["c"][known].astype(float))
    own = np.flatnonzero(known & (e["cw"] > 0))
    out[own] += model.word_loss(n[own], lead[own], target[own], e["cw"][own].astype(float), e["lw"][own].astype(float))
    strange = np.flatnonzero(~known)
    out[strange] += model.unknown + e["lw"][strange, None] * np.log(SMOOTHING)
    return e["r"], out


# Documents of a task whose parts of the losses travel together: as many as these low bits of their numbers tell apart.
_BLOCK_BITS = 12
_PART_DDL = "block long, r long, doc_id long, n_tokens long, lb double, lt double, n int, body binary"
_PART_SCHEMA = pa.schema({"block": pa.int64(), **{f.name: f.type for f in _SENT_SCHEMA if f.name != "b"}})


def _gains(shared):
    """Documents as they came, and their parts of the losses from the buckets, packed per block of documents.

    Buckets arrive one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Frequent = shared.value
        bucket, bodies, found, size = None, [], [], 0

        def close():
            nonlocal size
            if bodies:
                found.append(_bucket(model, bodies))
                size += len(found[-1][0])
                bodies.clear()
            if size >= FLUSH:
                combine()

        def combine():
            nonlocal size
            r, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            parts = np.concatenate([f[1] for f in found])
            found[:] = [(r, np.column_stack([np.bincount(place, weights=parts[:, k], minlength=len(r)) for k in range(2)]))]
            size = len(r)

        def send():
            nonlocal size
            combine()
            r, parts = found[0]
            block = r >> _BLOCK_BITS
            cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), [len(r)])).tolist()
            low = (r & (1 << _BLOCK_BITS) - 1).astype(np.uint16)
            body = [b"".join(np.ascontiguousarray(x[a:z]).view(np.uint8).reshape(z - a, -1).T.tobytes() for x in (low, parts[:, 0], parts[:, 1]))
                    for a, z in zip(cuts, cuts[1:])]
            yield _row(len(body), _PART_SCHEMA, block=block[cuts[:-1]], n=np.diff(cuts), body=body)
            found.clear()
            size = 0

        for batch in batches:
            docs = batch.filter(batch.column("body").is_null())
            numbers = docs.column("r").to_numpy()
            yield _row(len(numbers), _PART_SCHEMA, block=numbers >> _BLOCK_BITS, **{c: docs.column(c) for c in ("r", "doc_id", "n_tokens", "lb", "lt")})
            rows = batch.filter(batch.column("body").is_valid())
            for b, r, n, body in zip(*(rows.column(c).to_pylist() for c in ("b", "r", "n", "body"))):
                if b != bucket:
                    close()
                    bucket = b
                    if size >= FLUSH // 2 and len(found) == 1:  # as many documents, each once
                        yield from send()
                bodies.append((r, n, body))
        close()
        if found:
            yield from send()

    return run


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Losses of all documents of a block, which arrives with its parts at once."""
    block, docs, sums = None, [], np.zeros((1 << _BLOCK_BITS, 2))

    def close():
        columns = list(zip(*docs)) or [()] * 5
        low = np.array(columns[0], np.int64) & (1 << _BLOCK_BITS) - 1
        loss = np.array(columns[3:], float).reshape(2, -1) + sums[low].T
        yield pa.RecordBatch.from_arrays([pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(loss[0]), pa.array(loss[1])],
                                         names=["doc_id", "n_tokens", "lb", "lt"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("block", "r", "doc_id", "n_tokens", "lb", "lt", "n", "body"))
        for b, r, doc, tokens, lb, lt, n, body in zip(*columns):
            if b != block:
                yield from close()
                block, docs, sums = b, [], np.zeros((1 << _BLOCK_BITS, 2))
            if body is None:
                docs.append((r, doc, tokens, lb, lt))
                continue
            planes = np.frombuffer(body, np.uint8).reshape(18, n)
            low = np.ascontiguousarray(planes[:2].T).view(np.uint16).ravel()
            for k in range(2):
                sums[low, k] += np.ascontiguousarray(planes[2 + 8 * k : 10 + 8 * k].T).view(np.float64).ravel()
    yield from close()


def _models(marked: DataFrame) -> tuple[Frequent, int]:
    """The frequent words and pairs with the totals, and the number of words."""
    counts = marked.mapInArrow(_count, _COUNTS).groupBy("kind", "h").agg(*(F.sum(c).alias(c) for c in ("n", "t", "ln", "lt")))
    counts = materialize(counts, "counts")
    words = counts.filter(F.col("kind") == _WORD)
    known = F.col("n") >= LEAST
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t")), F.count(F.when(known, 1)).alias("size"),
                      *(F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(f"u{c}") for c in ("n", "t"))).first()
    often = words.filter(F.col("n") >= max(LEAST, total["n"] / FREQUENT))
    often = often.unionByName(counts.filter(F.col("kind") == _BEGIN).select("kind", "h", F.lit(0).alias("n"), F.lit(0).alias("t"), F.col("n").alias("ln"), F.col("t").alias("lt")))
    common = counts.filter(F.col("kind") == _PAIR).filter(F.col("n") >= max(2, total["n"] / (2 * FREQUENT))).select("h").toPandas()
    keys = marked.sparkSession.sparkContext.broadcast(np.sort(common["h"].to_numpy(np.int64).view(np.uint64)))
    pairs = marked.mapInArrow(_count_common(keys), "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return Frequent(often.toPandas(), pairs.toPandas(), (total["n"], total["t"]), total["size"] + 1, (total["un"], total["ut"])), total["n"]


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Cross-entropy difference of every document: ``doc_id``, ``n_tokens``, ``target_loss``, ``background_loss``, ``score``.

    Takes integer ``doc_id`` and ``text``, and the ``doc_id`` of target documents; other columns are ignored.  ``score``
    is the mean per-token loss under the target model less that under the background model: the lower, the more like
    the target.

    Words are counted first, combined in every task.  Then one exchange carries what a task does not know: an entry
    per document and pair (or rare second word with the pair), packed per bucket of hashes.  A bucket holds all entries
    of its words and pairs, so it counts them and at once gives every document its part of the losses; pairs are never
    stored.  Frequent words and pairs are counted beforehand and held by every task, so they send nothing; all others
    have less than total / FREQUENT entries.  What a task holds does not grow with the corpus but for the entries of one
    bucket.

    Null and empty texts have no tokens and null losses.  Null ids stay and are no targets; null target ids mark
    nothing, repeated ones once.  Repeated rows are documents of their own, and so count for each other.  Without target
    documents the target model is uniform.  An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    marks = materialize(target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "target")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = docs.join(measured(marks.withColumn("target", F.lit(1))), "doc_id", "left").select(
        "doc_id", F.coalesce("target", F.lit(0)).alias("target"), "text")
    model, total = _models(marked)
    shared = spark.sparkContext.broadcast(model)
    sent = marked.mapInArrow(_entries(shared, max(1, total // BUCKET)), _SENT)
    parts = sent.repartition(max(total // TASK, spark.sparkContext.defaultParallelism), "b").sortWithinPartitions("b").mapInArrow(_gains(shared), _PART_DDL)
    losses = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_losses, "doc_id long, n_tokens long, lb double, lt double")
    losses = losses.selectExpr("doc_id", "n_tokens", "if(n_tokens > 0, lt / n_tokens, NULL) AS target_loss", "if(n_tokens > 0, lb / n_tokens, NULL) AS background_loss")
    return losses.withColumn("score", F.col("target_loss") - F.col("background_loss"))
