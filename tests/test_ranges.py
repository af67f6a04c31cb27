"""Appended lines and blocks of large files."""

import os
import random

import pytest

from rillmark.operators import threat
from rillmark.sources import files, ranges
from rillmark.streaming import jobs
from rillmark.streaming.state import drain
from tests.conftest import rows


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_ranges_share_the_lines(tmp_path):
    """However a file is cut, every line is read once, by the range it begins in."""
    r = random.Random(1)
    lines = ["x" * r.choice([0, 1, 3, 50]) + str(k) for k in range(300)] + ["é\r", ""]
    put(f"{tmp_path}/a", "\n".join(lines) + "\nopen")
    size = os.path.getsize(f"{tmp_path}/a")
    for split in (1, 7, 64, 1 << 20):
        found = [x for at in range(0, size, split) for x in ranges.lines_of(ranges.Range(f"{tmp_path}/a", at, min(at + split, size), size))]
        assert [x[2] for x in found] == [x.removesuffix("\r") for x in lines] + ["open"]
        assert [x[1] for x in found] == sorted({x[1] for x in found})


def test_only_new_lines_are_read(spark, scratch):
    """A file that grows, one that shrinks, one that is new, one that stays, one without a line's end."""
    folder, seen = f"{scratch}/logs", []

    def run():
        stream = ranges.appended_lines(spark, folder, "*.log", 8)
        out = f"{scratch}/out{len(seen)}"
        drain(stream.writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{scratch}/c"))
        got = spark.read.parquet(out).collect() if os.path.exists(out) else []
        seen.append(sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in got))

    put(f"{folder}/a.log", "one\ntwo\nopen")
    put(f"{folder}/b.log", "first line\nsecond line\n")
    put(f"{folder}/c.log", "stays\n")
    put(f"{folder}/d.txt", "not taken\n")
    run()
    put(f"{folder}/a.log", " end\nthree\n")
    put(f"{folder}/b.log", "new\n", "w")
    put(f"{folder}/sub/e.log", "deep\n")
    run()
    run()
    assert seen == [[("a.log", "one"), ("a.log", "two"), ("b.log", "first line"), ("b.log", "second line"), ("c.log", "stays")],
                    [("a.log", "open end"), ("a.log", "three"), ("b.log", "new"), ("e.log", "deep")], []]


def test_unchanged_files_are_not_opened(monkeypatch, tmp_path):
    put(f"{tmp_path}/a", "one\ntwo\n")
    put(f"{tmp_path}/b", "one\n")
    opened, read = [], ranges._read
    monkeypatch.setattr(ranges, "_read", lambda path, *at: opened.append(os.path.basename(path)) or read(path, *at))
    reader = ranges._LineStream({"path": str(tmp_path)})
    first = reader.latestOffset()
    put(f"{tmp_path}/b", "two\n")
    opened.clear()
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert opened == ["b"] and [(os.path.basename(p.path), p.start, p.end) for p in parts] == [("b", 4, 8)]


def test_log_scan_scores_appended_lines_only(spark, scratch):
    def run():
        drain(jobs.log_scan(ranges.appended_lines(spark, f"{scratch}/logs"), "line", "file", "position", [], threat.Weights(),
                            f"{scratch}/base", 24, lambda b: "2024-01-01 00:00:00", f"{scratch}/out", f"{scratch}/c"))

    put(f"{scratch}/logs/a.log", "from 1.1.1.1\nin /etc/x\n")
    run()
    put(f"{scratch}/logs/a.log", "from 2.2.2.2\n")
    run()
    got = spark.read.parquet(f"{scratch}/out").select("batch_id", "position", "entity")
    assert rows(got) == [(0, 0, "1.1.1.1"), (0, 13, "/etc/x"), (1, 23, "2.2.2.2")]


@pytest.mark.parametrize("size,block", [(3, 16), (40, 200), (1024, 1 << 16)])
def test_chunks_of_a_file_in_blocks(spark, scratch, monkeypatch, size, block):
    """The chain of chunks over many blocks is the one of the whole file."""
    monkeypatch.setattr(ranges, "FAN", 5)
    r = random.Random(size)
    n = 2_000_000 if size > 1000 else 6000
    text = "".join(r.choice(["a", "b", " ", "é", "日", "word ", "x" * 30, "\n", "  "]) for _ in range(n // 5))
    put(f"{scratch}/big.txt", text)
    put(f"{scratch}/small.txt", "one two")
    put(f"{scratch}/empty.txt", "")
    got = {}
    found = ranges.file_chunks(spark, scratch, size, block)
    for x in found.collect():
        got.setdefault(x["path"].rsplit("/", 1)[1], []).append((x["chunk_no"], x["chunk"]))
    cut = spark.createDataFrame([("big.txt", text), ("small.txt", "one two")], "path string, text string")
    want = {}
    for x in files.chunk_texts(cut, ["path"], "text", size).collect():
        want.setdefault(x["path"], []).append((x["chunk_no"], x["chunk"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    blocks = os.path.getsize(f"{scratch}/big.txt") // block
    assert blocks >= 16 and len(got["big.txt"]) > blocks
