"""Byte ranges of files as Spark data sources: appended lines as a stream, large files in blocks.

Folders and files are paths or URIs of a file system that pyarrow knows; every task opens the file and reads its range.
"""

from __future__ import annotations

import fnmatch
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rillmark.functions.text import clean_for_ingest
from rillmark.session import materialize

# Spark plans data sources in a Python process of the driver that has no shipped packages: they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str, pattern: str = "*") -> dict[str, int]:
    """Size of every file of a folder, or of the one file, by its path as given."""
    from pyarrow import fs

    system, root = _file_system(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.File:
        return {path: found.size}
    if found.type == fs.FileType.NotFound:
        return {}
    files = system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatch(f.base_name, pattern)]
    return {path.rstrip("/") + f.path[len(root.rstrip("/")):]: f.size for f in inside}


def _read(path: str, start: int, length: int) -> bytes:
    system, inner = _file_system(path)
    with system.open_input_file(inner) as file:
        return file.read_at(length, start)


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines or chunks that begin there belong to the range."""

    path: str
    start: int
    end: int
    size: int
    first: int = 0


PIECE = 1 << 20


def _line_end(path: str, start: int, end: int) -> int:
    """End of the last whole line in a range, or its start."""
    while end > start:
        begin = max(start, end - PIECE)
        at = _read(path, begin, end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    """(file, position, line) of the lines that begin in a range; the last may reach beyond it."""
    at, rest = part.start, b""
    if at > part.first:  # the line that is under way belongs to the range before
        at -= 1
        skipping = True
    else:
        skipping = False
    read = at
    while True:
        data = _read(part.path, read, min(PIECE, part.size - read)) if read < part.size else b""
        read += len(data)
        rest += data
        while (cut := rest.find(b"\n")) >= 0 or (not data and rest):
            line, rest = (rest[:cut], rest[cut + 1 :]) if cut >= 0 else (rest, b"")
            if not skipping:
                if at >= part.end:
                    return
                yield part.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")
            skipping = False
            at += len(line) + 1
        if not data or (not skipping and at >= part.end):
            return


class AppendedLines(DataSource):
    """Stream ``appended_lines``: whole lines that files of a folder got since the last batch.

    Options: ``path``, ``pattern`` of file names (default all), ``split`` bytes per task.  Rows are (file, position,
    line), the position in bytes.  The offset of a batch is a map of file to byte position at a line's end, kept in the
    query's checkpoint, so files that did not change are not opened, and a line without an end waits for it.  A file
    shorter than its known position starts again; a removed file is forgotten.
    """

    @classmethod
    def name(cls):
        return "appended_lines"

    def schema(self):
        return "file string, position bigint, line string"

    def streamReader(self, schema):
        return _LineStream(self.options)


class _LineStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.split = int(options.get("split", str(64 << 20)))
        self.known: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        """Where the whole lines of every file end; only files of another size are looked into."""
        sizes = _files(self.path, self.pattern)
        known = {}
        for path, size in sizes.items():
            before = self.known.get(path, 0)
            if self.sizes.get(path) == size:
                known[path] = before
            else:
                known[path] = _line_end(path, before if before <= size else 0, size)
        self.known, self.sizes = known, sizes
        return known

    def partitions(self, start, end):
        found = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0
            found += [Range(path, at, min(at + self.split, stop), stop, begin) for at in range(begin, stop, self.split)]
        return found

    def read(self, partition):
        return lines_of(partition)


class FileBlocks(DataSource):
    """Batch source ``file_blocks``: the files below ``path`` in blocks of ``block`` bytes and ``ahead`` bytes beyond."""

    @classmethod
    def name(cls):
        return "file_blocks"

    def schema(self):
        return "path string, block bigint, length int, last boolean, data binary"

    def reader(self, schema):
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block, self.ahead = options["path"], int(options["block"]), int(options["ahead"])

    def partitions(self):
        return [Range(path, at, min(at + self.block, size), size)
                for path, size in sorted(_files(self.path).items()) for at in range(0, size, self.block)]

    def read(self, part):
        data = _read(part.path, part.start, min(part.end + self.ahead, part.size) - part.start)
        yield part.path, part.start // self.block, part.end - part.start, part.end == part.size, data


# A character has at most four bytes; a chunk may be longer than its size by the rest of one.
_REST = 4
# Maps of blocks, or of groups of blocks, that one task puts together.
FAN = 512


class _Cuts:
    """Where the chunk that begins at a position of a block ends."""

    def __init__(self, data: bytes, size: int):
        self.data, self.size = np.frombuffer(data, np.uint8), size
        self.inner = np.concatenate(((self.data & 0xC0) == 0x80, [False]))
        at = np.where(self.data == 32, np.arange(len(self.data)), -1)
        self.blank = np.maximum.accumulate(at) if len(at) else at

    def after(self, start: np.ndarray) -> np.ndarray:
        whole = len(self.data)
        end = np.minimum(start + self.size, whole)
        for _ in range(_REST - 1):  # back to the beginning of a character
            end = end - ((end < whole) & (end > start) & self.inner[end])
        none = end == start
        end = end + none
        for _ in range(_REST - 1):
            end = end + (none & self.inner[np.minimum(end, whole)])
        blank = self.blank[end - 1]
        return np.where(blank >= start, blank + 1, end)


def _block_maps(size: int):
    """For every place where a chunk may enter a block: where it leaves, beyond the block, and how many chunks begin inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, block, length, data in batch[["path", "block", "length", "data"]].itertuples(index=False):
                cuts = _Cuts(data, size)
                entry = np.arange(size + _REST)
                place, of, steps, own = entry.copy(), entry.copy(), np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
                while (place < length).any():
                    for _ in range(8):
                        inside = place < length
                        place[inside] = cuts.after(place[inside])
                        own += inside
                    steps += own[of]  # chains that meet go on as one
                    place, same = np.unique(place, return_inverse=True)
                    of, own = same[of], np.zeros(len(place), np.int64)
                rows.append((path, block, place[of] - length, steps))
            yield pd.DataFrame(rows, columns=["path", "node", "leaves", "count"])

    return run


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    """The map of neighbouring nodes as one."""
    group = group.sort_values("node")
    leaves, count = np.arange(len(group["leaves"].iloc[0])), 0
    for own, n in zip(group["leaves"], group["count"]):
        count = count + np.asarray(n)[leaves]
        leaves = np.asarray(own)[leaves]
    return pd.DataFrame({"path": group["path"].iloc[:1], "node": group["node"].iloc[:1] // FAN, "leaves": [leaves], "count": [count]})


def _entered(group: pd.DataFrame) -> pd.DataFrame:
    """Where the first chunk of each node begins, and the chunks before it, given both for the group."""
    group = group.sort_values("node")
    entry, before, rows = int(group["entry"].iloc[0]), int(group["before"].iloc[0]), []
    for path, node, own, n in group[["path", "node", "leaves", "count"]].itertuples(index=False):
        rows.append((path, node, entry, before))
        entry, before = int(own[entry]), before + int(n[entry])
    return pd.DataFrame(rows, columns=["path", "node", "entry", "before"])


def _cut_blocks(size: int):
    """Chunks that begin in a block, from its first one on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length, data, at, before in batch[["path", "length", "data", "entry", "before"]].itertuples(index=False):
                cuts = _Cuts(data, size)
                place = np.array([at])
                while place[0] < length:
                    end = cuts.after(place)
                    before += 1
                    rows.append((path, before, data[place[0] : end[0]].decode("utf-8", "replace")))
                    place = end
            yield pd.DataFrame(rows, columns=["path", "chunk_no", "chunk"])

    return run


def file_chunks(spark: SparkSession, path: str, size: int, block: int = 4 << 20) -> DataFrame:
    """(path, chunk_no, chunk) of every file below a path; cleaned, empty chunks dropped.

    Chunks are those of ``files.cut_chunks``.  Where a chunk ends depends on where it began, but all that a block of a
    file needs to know of those before it is where its first chunk begins, one of ``size`` places.  So every block first
    gives a map from these places to those of the block behind it.  Maps of FAN neighbours are put together until one
    is left per file, and on the way back every block learns its own place; then all blocks are cut at once.
    """
    spark.dataSource.register(FileBlocks)
    block = max(block, 4 * size)
    blocks = spark.read.format("file_blocks").option("path", path).option("block", block).option("ahead", size + _REST).load()
    schema = "path string, node bigint, leaves array<bigint>, count array<bigint>"
    levels = [blocks.mapInPandas(_block_maps(size), schema)]
    levels[0] = materialize(levels[0], "maps")
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("path", F.floor(F.col("node") / FAN).alias("_group")).applyInPandas(_composed, schema)
        levels.append(materialize(up, "maps"))
    entries = levels[-1].select("path", "node", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for maps in reversed(levels[:-1]):
        above = entries.select("path", F.col("node").alias("_group"), "entry", "before")
        met = maps.withColumn("_group", F.floor(F.col("node") / FAN)).join(above, ["path", "_group"])
        entries = met.groupBy("path", "_group").applyInPandas(
            lambda group: _entered(group), "path string, node bigint, entry bigint, before bigint")
    placed = blocks.join(entries.withColumnRenamed("node", "block"), ["path", "block"])
    chunks = placed.mapInPandas(_cut_blocks(size), "path string, chunk_no bigint, chunk string")
    return chunks.withColumn("chunk", clean_for_ingest(F.col("chunk"))).filter("chunk <> ''")


def appended_lines(spark: SparkSession, path: str, pattern: str = "*", split: int = 64 << 20) -> DataFrame:
    """Stream of (file, position, line), see :class:`AppendedLines`."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("path", path).option("pattern", pattern).option("split", str(split)).load()
