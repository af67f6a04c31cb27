"""Token ids of documents in packed files.

File format: Parquet rows, one per block of whole documents in ascending order of ``doc_id``.

* ``part``, ``block``: range of ids and number of the block within it; ``ids``: count of token ids of the block
* ``docs``: ``doc_id`` of every document; ``counts``: its number of token ids, end id included
* ``words``: the block's ids as Simple-8b words, little-endian (see ``packing``)
* ``frames``: index of the first word of every 1,024 ids, so that frames can be decoded on their own or all at once
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.llm.packing import pack, unpack
from rillmark.llm.storage import prepare, scratch_path
from rillmark.llm.words import chunks, word_bounds

END_ID = 1
# Texts are cut into pieces that the tokenizer treats alike wherever they stand; a worker remembers this many.
REMEMBERED = 600_000

# Letters below U+0250, but for the one whose small form is two characters.
_LATIN = re.compile("[a-zA-Z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+").fullmatch
# Byte-level vocabularies name a byte by its own character where that is printable, else by one from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_NAME = [chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256)].__getitem__

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


class Encoder:
    """Token ids of texts by the tokenizers library, with equal pieces encoded once.

    For tokenizers that drop white space, fold case and split at it, as the word BPE vocabularies do: a text's ids are
    those of its pieces between ASCII white space, one after the other.  Pieces also end between an ASCII letter and a
    full stop or comma, where the tokenizer's own pattern always splits, and ASCII letters are folded beforehand.
    Texts with the marks of special tokens are not folded.  A piece of Latin letters alone is one word of the
    vocabulary's model, which is asked directly; all others take the whole way through the library.
    """

    def __init__(self, path: str):
        # Spark runs a worker per core; further threads would only hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([END_ID], np.uint32)  # piece 0 is the end of a document

    def _learn(self, pieces: list[bytes]) -> None:
        ids: list = []
        rest = []
        tokenize = self.model.tokenize
        for piece in pieces:
            if piece.isalpha():  # ASCII letters
                ids.append([t.id for t in tokenize(piece.lower().decode())])
            elif _LATIN(text := piece.decode("utf-8", "replace")):
                ids.append([t.id for t in tokenize("".join(map(_BYTE_NAME, text.lower().encode())))])
            else:
                rest.append((len(ids), text))
                ids.append(None)
        if rest:
            for at in range(0, len(rest), 500):  # a few at a time: the library's results are large
                some = rest[at : at + 500]
                whole = self.tokenizer.encode_batch_fast([text for _, text in some], add_special_tokens=False)
                for (k, _), e in zip(some, whole):
                    ids[k] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.index.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))))

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with their end ids, and the number of ids of each row."""
        if b"<|" not in flat.tobytes():
            flat = _FOLD[flat]
        ends = _LETTER[flat[:-1]] & _STOP[flat[1:]]
        ends[offsets[(offsets > 0) & (offsets < len(flat))] - 1] = True  # pieces end with their row, too
        cut = np.flatnonzero(ends) + 1
        text = np.insert(flat, cut, 32)
        at = offsets + np.searchsorted(cut, offsets, "right")
        at[-1] = len(text)
        _, _, first = word_bounds(text, at)
        words = text.tobytes().split()
        if len(self.index) > REMEMBERED:
            self._forget()
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            own = [words[k] for k in missing]
            self._learn(list(set(own)))
            found[missing] = [self.index[w] for w in own]
        which = np.insert(found, first[1:], 0)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[which] - ends + lengths, lengths)]
        last = first[1:] + np.arange(len(first) - 1)
        return ids, np.diff(ends[last], prepend=0)


@functools.cache
def _encoder(path: str) -> Encoder:
    """The encoder of a worker, which serves all its tasks."""
    return Encoder(path)


def _encode(path: str):
    """Blocks of a range of documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = _encoder(path)  # a function of this module: a dictionary would be copied into every task
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column("doc_id").cast(pa.int64())
            for first, flat, offsets in chunks(batch.column("text")):
                ids, counts = encoder.encode(flat, offsets)
                words, frames = pack(ids)
                own = docs.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                        pa.array([own.to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                        pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([frames], pa.list_(pa.int64())),
                    ],
                    names=["part", "block", "ids", "docs", "counts", "words", "frames"])
                block += 1

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``doc_id``, ``text`` (further columns are ignored) into packed files below ``path``.

    ``tokenizer`` is a file all machines have.  Documents are range-sorted by id, so a task holds a range of ids, and
    a block at a time in memory.  Null and empty texts have only their end id; rows that repeat an id follow each
    other, null ids come first.  An empty table writes no block.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, block int, ids long, docs array<long>, counts array<long>, words binary, frames array<long>"
    rows.mapInArrow(_encode(tokenizer), schema).write.mode("overwrite").parquet(path)


def decode_block(words: bytes, frames: np.ndarray, ids: int) -> np.ndarray:
    """All token ids of a block."""
    return unpack(np.frombuffer(words, "<u8"), np.asarray(frames, np.int64), ids).astype("<u4")


def _decode(batches):
    """Per document of a block: its id, place in the block, number of ids and their checksum."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["words"], row["frames"], row["ids"])
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for n, b in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()),
                 pa.array([row["block"]] * len(crc), pa.int32()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "block", "inner", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of packed files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it: totals per part are summed in order of the parts, and
    those of blocks within their part.
    """
    prepare(spark)
    schema = "part int, block int, ids long, docs array<long>, counts array<long>, words binary, frames array<long>"
    blocks = spark.read.schema(schema).parquet(path)
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("inside"))
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outside"))
    places = sizes.join(parts, "part").select("part", "block", (F.col("inside") + F.col("outside")).alias("begin"))
    found = blocks.mapInArrow(_decode, "doc_id long, part int, block int, inner long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "block"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files, by default in the shared folder, and read them back (see ``read_tokens``)."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
