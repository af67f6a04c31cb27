import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.operators import memory, stats, terms, threat
from rillmark.operators.windows import last_n
from rillmark.sources import files
from rillmark.streaming import jobs
from rillmark.streaming.keyed import latest
from rillmark.streaming.state import drain
from tests.conftest import rows

SCHEMA = "entity string, subtopic string, value double, ts timestamp_ntz, msgid long"


def _events(n=400):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    return [("hot" if rng.random() < 0.5 else f"e{rng.randrange(5)}", rng.choice("ab"), rng.random(),
             start + timedelta(seconds=rng.randrange(9999)), i) for i in range(n)]


def _staged(spark, path, data, schema, parts=4):
    """The rows as several files, so that the stream sees several batches."""
    for i in range(parts):
        spark.createDataFrame(data[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rolling_window_equals_batch(spark, scratch):
    """Nulls in keys and order included; a key with half of all rows is cut before the shuffle."""
    data = [*_events(), (None, "a", 1.0, None, 900), (None, "a", 2.0, datetime(2024, 1, 2), 901), ("e1", None, None, None, 902)]
    stream = _staged(spark, f"{scratch}/in", data, SCHEMA)
    seen = []
    drain(jobs.rolling_windows(stream, ["entity"], ["ts", "msgid"], 9, f"{scratch}/out", f"{scratch}/c", lambda w, b: seen.append(b)))
    assert seen == [0, 1, 2, 3]
    batch = last_n(spark.createDataFrame(data, SCHEMA), ["entity"], ["ts", "msgid"], 9).drop("rn")
    got = latest(spark.read.parquet(f"{scratch}/out"), ["entity"]).select(*batch.columns)
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0


def test_a_batch_emits_its_own_keys_only(spark, scratch):
    """A batch with one key emits one key; rows older than the window change nothing."""
    day = lambda d: datetime(2024, 1, d)
    parts = [[("a", "s", 1.0, day(5), 1), ("b", "s", 1.0, day(5), 2), ("a", "s", 2.0, day(6), 3)],
             [("b", "s", 3.0, day(7), 4)], [("a", "s", 0.0, day(1), 5)], [("a", "s", 9.0, day(9), 6)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    drain(jobs.rolling_windows(stream, ["entity"], ["ts", "msgid"], 2, f"{scratch}/out", f"{scratch}/c"))
    got = {}
    for r in spark.read.parquet(f"{scratch}/out").collect():
        got.setdefault(r["batch_id"], []).append((r["entity"], r["msgid"]))
    assert {b: sorted(v) for b, v in got.items()} == {0: [("a", 1), ("a", 3), ("b", 2)], 1: [("b", 2), ("b", 4)], 3: [("a", 3), ("a", 6)]}


def test_rolling_statistics_equal_batch(spark, scratch):
    data = _events()
    stream = _staged(spark, f"{scratch}/in", data, SCHEMA)
    drain(jobs.rolling_statistics(stream, ["avg", "diff"], 20, f"{scratch}/w", f"{scratch}/out", f"{scratch}/c"))
    last = latest(spark.read.parquet(f"{scratch}/out"), ["entity", "subtopic", "preprocesstype"])
    want = stats.preprocess(spark.createDataFrame(data, SCHEMA), ["avg", "diff"], 20)
    got = {r[:3]: r[3] for r in rows(last.select(*want.columns))}
    assert got == pytest.approx({r[:3]: r[3] for r in rows(want)})


def test_a_restarted_query_goes_on_from_its_state(spark, scratch):
    """A batch that failed is run again on the state of the batch before."""
    data = _events(200)
    stream = _staged(spark, f"{scratch}/in", data, SCHEMA)
    failed = []

    def emit(window, batch_id):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("executor lost")

    writer = lambda: jobs.rolling_windows(stream, ["entity"], ["ts", "msgid"], 5, f"{scratch}/out", f"{scratch}/c", emit)
    with pytest.raises(Exception, match="executor lost"):
        drain(writer())
    drain(writer())
    assert failed == [2]
    batch = last_n(spark.createDataFrame(data, SCHEMA), ["entity"], ["ts", "msgid"], 5).drop("rn")
    assert rows(latest(spark.read.parquet(f"{scratch}/out"), ["entity"]).select(*batch.columns)) == rows(batch)


MEMORY = "entity string, window long, terms array<string>"


def _remember(spark, scratch, stream, source, n):
    drain(jobs.window_hits(stream, "text", source, f"{scratch}/hits", f"{scratch}/c1"))
    drain(jobs.entity_memory(spark, f"{scratch}/hits", MEMORY, n, 10_000, f"{scratch}/out", f"{scratch}/c2"))
    return latest(spark.read.parquet(f"{scratch}/out"), ["entity"])


def test_memory_equals_batch(spark, scratch):
    rng = random.Random(8)
    data = [(rng.choice("ab"), rng.randrange(30), rng.choice(["x hit", "none", "y hit", "z"])) for _ in range(200)]
    schema = "entity string, window long, text string"
    groups = terms.parse_groups("x,y ~~~ @z,z")
    want = memory.memory_counts(memory.window_hits(spark.createDataFrame(data, schema), "text", groups), 12)
    # Windows arrive in order, as micro-batches do.
    stream = _staged(spark, f"{scratch}/in", sorted(data, key=lambda d: d[1]), schema)
    assert rows(_remember(spark, scratch, stream, lambda: groups, 12).select(*want.columns)) == rows(want)


def test_memory_over_a_reload(spark, scratch):
    """Terms inserted in front and beyond any number leave stored windows as they are."""
    data = [("e", 0, "m"), ("e", 1, "aa"), ("e", 2, "late"), ("e", 3, "late aa")]
    stream = _staged(spark, f"{scratch}/in", data, "entity string, window long, text string")
    specs = ["m,k", "aa,m,k"] + [",".join(["aa", "m"] + [f"t{i:03d}" for i in range(80)] + ["late"])] * 2
    calls = []

    def source():
        calls.append(0)
        return terms.parse_groups(specs[len(calls) - 1])

    got = _remember(spark, scratch, stream, source, 12).first()
    assert (got["windows_seen"], got["attack_windows"], got["pattern_windows"]) == (4, 4, 1)


def test_log_scan_keeps_and_replaces_the_baseline(spark, scratch):
    lines = [[("f", 1, "from 1.1.1.1"), ("f", 2, "in /etc/x")], [("g", 1, "from 2.2.2.2")], [("h", 1, "from 3.3.3.3")],
             [("i", 1, "nothing here")], [("k", 1, "at 4.4.4.4")]]
    schema = "file string, n int, line string"
    for part in lines:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    clock = ["2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-02 00:00:00", "2024-01-02 01:00:00", "2024-01-02 02:00:00"]
    drain(jobs.log_scan(stream, "line", "file", "n", [], threat.Weights(), f"{scratch}/base", 24, clock.__getitem__,
                        f"{scratch}/out", f"{scratch}/c"))
    got = {(r["batch_id"], r["entity"]): r["drift"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got[0, "1.1.1.1"] == got[0, "/etc/x"] == 0.2979  # cold start
    assert got[1, "2.2.2.2"] == got[2, "3.3.3.3"] == 0.3466  # (1 - .5) ln 2 against the first baseline
    assert got[4, "4.4.4.4"] == 0.0  # the baseline was replaced after 24 hours
    assert not [b for b, _ in got if b == 3]


def test_terms_are_read_again(spark, scratch):
    import os

    os.makedirs(f"{scratch}/terms")

    def put(text):
        with open(f"{scratch}/terms/t.txt", "w") as f:
            f.write(text)

    schema = "id int, text string"
    put("alpha\nrgx:^b.t$\n~~~@one,two\n")
    spark.createDataFrame([(1, "alpha x"), (2, "bat"), (3, "one"), (4, "one two"), (5, "new")], schema).coalesce(1).write.parquet(
        f"{scratch}/in")
    stream = spark.readStream.schema(schema).parquet(f"{scratch}/in")
    run = lambda: drain(jobs.searched(stream, ["id"], "text", [f"|{scratch}/terms"], "conf", f"{scratch}/out", f"{scratch}/c"))
    run()
    put("new\n")
    spark.createDataFrame([(6, "alpha"), (7, "new"), (8, "conf")], schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    run()
    assert rows(spark.read.parquet(f"{scratch}/out").select("id")) == [(1,), (2,), (4,), (7,), (8,)]


def test_any_number_of_terms(spark, scratch):
    """20,000 terms, among them common, short and punctuated ones, groups and patterns, against plain containment."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    texts = [(k, " ".join(word() for _ in range(40)) + rng.choice([".", " -- ", "; x", ""])) for k in range(300)] + [(300, None), (301, "")]
    plain = {" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(20_000)} | {"a", "--", "; ", "a b", "(none)"}
    every = [("a", "b c"), ("zz", "a"), (texts[0][1][:9], texts[0][1][-9:])]
    patterns = ["^a+ ", "(bad", "[gh]{5}$"]
    groups = [("plain", "any", x) for x in plain] + [(f"g{k}", "every", x) for k, g in enumerate(every) for x in g] + [(p, "regex", p) for p in patterns]
    got = {r["id"]: r["found"] for r in terms.match_groups(
        spark.createDataFrame(texts, "id int, text string"), ["id"], "text", spark.createDataFrame(groups, terms.GROUP_SCHEMA)).collect()}
    want = {}
    for k, t in texts:
        t = t or ""
        found = {x for x in plain if x in t} | {x for g in every if all(y in t for y in g) for x in g}
        found |= {p for p in ("^a+ ", "[gh]{5}$") if re.search(p, t)}
        if found:
            want[k] = sorted(found)
    assert got == want and len(want) >= 300


def test_duplicates_and_time_windows(spark, scratch):
    start = datetime(2024, 1, 1)
    data = [("k1", start), ("k1", start + timedelta(minutes=1)), ("k2", start), ("k1", start + timedelta(minutes=2))]
    stream = _staged(spark, f"{scratch}/in", data, "key string, ts timestamp", 2)
    drain(jobs.deduplicated(stream, "key", "ts", "1 hour").writeStream.format("parquet").option(
        "path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/c"))
    assert sorted(r["key"] for r in spark.read.parquet(f"{scratch}/out").collect()) == ["k1", "k2"]


def test_lines_stream(spark, scratch):
    import os

    os.makedirs(f"{scratch}/in")
    for i in range(3):
        with open(f"{scratch}/in/{i}.json", "w") as f:
            f.write(f'  {{"n":{i}}};\n\n')
    stream = files.json_lines(spark, f"{scratch}/in", stream=True, files_per_trigger=1)
    drain(stream.select(F.get_json_object("value", "$.n").alias("n")).writeStream.format("parquet").option(
        "path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/c"))
    assert rows(spark.read.parquet(f"{scratch}/out")) == [("0",), ("1",), ("2",)]


def test_terms_of_common_words_pair_few_texts(spark):
    """Every text holds both words of every term, hardly one holds them side by side: the candidates are these few."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"][:40]
    texts = [(k, " ".join(rng.sample(words, 40)) + rng.choice([".", ""])) for k in range(120)]
    table = [(f"{a[i:]} {b[:j]}", f"{a[i:]} {b[:j]}") for a in words for b in words for i, j in ((0, 2), (1, 1)) if rng.random() < 0.2]
    table = sorted({*table, ("ak al am", "ak al am"), (" ak ", " ak "), ("zz zz", "zz zz")})
    before, stored = terms.materialize, {}

    def counted(df, name):
        stored[name] = before(df, name)
        return stored[name]

    terms.materialize = counted
    try:
        got = terms.match_term_table(spark.createDataFrame(texts, "id int, text string"), ["id"], "text",
                                     spark.createDataFrame(table, "term string, key string"), "term", "key")
        want = sorted((k, x) for k, t in texts for x, _ in table if x in t)
        assert rows(got.distinct()) == want
    finally:
        terms.materialize = before
    assert stored["candidates"].count() < 2 * len(want) + len(texts)


def test_statistics_use_the_whole_rollback_window(spark, tmp_path):
    """More rows per key than the cut of 8 that once stood in the query and its SQL."""
    from rillmark.plans.registry import ORACLES, QUERIES

    assert "<= 800" in ORACLES["st_rolling_statistics"] and "<= 800" in ORACLES["st_chained_topics"]
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=i), 1, "view", float(i), None) for i in range(900)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    got = {r["preprocesstype"]: r["hyperprediction"] for r in QUERIES["st_rolling_statistics"](spark, str(tmp_path)).collect()}
    assert got == {"avg": sum(range(100, 900)) / 800, "max": 899.0}
    assert QUERIES["st_chained_topics"](spark, str(tmp_path)).first()["avg"] == got["avg"]


def test_many_keys_share_a_state(spark, scratch):
    """Keys beyond the number of parts: a part holds several, each with its own newest rows, null keys and whole numbers exact."""
    start = datetime(2024, 1, 1)
    big = 2**53 + 1
    data = [(f"k{i % 50}" if i % 50 else None, "s", float(i), start + timedelta(seconds=i), big + i) for i in range(600)]
    stream = _staged(spark, f"{scratch}/in", data, SCHEMA)
    from rillmark.streaming import keyed

    got = keyed.newest_rows(stream, ["entity"], ["ts", "msgid"], 3, parts=4)
    drain(jobs.updates(got, f"{scratch}/out", f"{scratch}/c"))
    last = latest(spark.read.parquet(f"{scratch}/out"), ["entity"])
    batch = last_n(spark.createDataFrame(data, SCHEMA), ["entity"], ["ts", "msgid"], 3).drop("rn")
    got = last.select(*batch.columns)
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0 and batch.count() == 150
