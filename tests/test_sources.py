import json
import os

import pytest
from pyspark.sql import functions as F

from rillmark.sources import files, landing, pull, ranges, sinks
from rillmark.streaming.state import drain
from tests.conftest import rows

SETTINGS = {
    "kafka": {"at": "http://h/", "group": "g", "member": "m", "topics": ["t"]},
    "rabbitmq": {"at": "http://h", "vhost": "/", "queue": "q", "count": 7},
    "redis": {"at": "http://h", "command": "LRANGE", "key": "k/1"},
    "scada": {"at": "http://h", "path": "/e/f"},
    "splunk": {"at": "http://h", "search": "search x=1 & y"},
    "elasticsearch": {"at": "http://h", "index": "i*", "search": {"size": 1}},
    "clickhouse": {"at": "http://h", "database": "d", "statement": "SELECT {x: 1}"},
    "influxdb": {"at": "http://h", "org": "my org", "flux": "from()"},
    "logstash": {"at": "http://h", "path": "e"},
}


@pytest.mark.parametrize("system", sorted(SETTINGS))
def test_requests(system):
    request = pull.build_request(system, {**SETTINGS[system], "login": {"token": "t"}})
    assert request.url.startswith("http://h/") and request.headers["Authorization"] == "Bearer t"
    assert "{" not in request.url and (request.body is not None) == (request.method == "POST")
    with pytest.raises(ValueError):
        pull.build_request("fax", {})


def test_addresses_and_bodies():
    ask = lambda system, step="read": pull.build_request(system, SETTINGS[system], step)
    assert ask("rabbitmq").url == "http://h/api/queues/%2F/q/get"
    assert json.loads(ask("rabbitmq").body) == {"count": 7, "ackmode": "ack_requeue_true", "encoding": "auto"}
    assert json.loads(ask("rabbitmq", "done").body)["ackmode"] == "ack_requeue_false"
    assert ask("redis").url == "http://h/LRANGE/k%2F1" and ask("scada").url == "http://h/e/f"
    assert ask("splunk").body == "search=search+x%3D1+%26+y&output_mode=json&exec_mode=oneshot"
    assert json.loads(ask("elasticsearch").body) == {"size": 1} and ask("clickhouse").body == "SELECT {x: 1}"
    assert ask("influxdb").url == "http://h/api/v2/query?org=my%20org"
    assert json.loads(ask("kafka", "subscribe").body) == {"topics": ["t"]} and ask("kafka").url.endswith("max_bytes=1048576")


def test_logins_and_trust(tmp_path):
    assert pull.Login("u", "p").headers() == {"Authorization": "Basic dTpw"}
    assert pull.Login(header="X: 1").headers() == {"X": "1"} and pull.Login().headers() == {}
    assert pull.Tls().context() is None
    with pytest.raises(OSError):
        pull.Tls(authority=f"{tmp_path}/none.pem").context()
    with pytest.raises(OSError):
        pull.Tls(certificate=f"{tmp_path}/none.pem", key=f"{tmp_path}/none.key").context()
    settings = {**SETTINGS["scada"], "tls": {"authority": "a.pem", "certificate": "c.pem", "key": "k.pem"}}
    assert pull.build_request("scada", settings).tls == pull.Tls("a.pem", "c.pem", "k.pem")


def _transport(request):
    import json as j

    shard = request.url.rsplit("/", 2)[-2]
    return j.dumps({"hits": {"hits": [{"_source": {"shard": shard, "n": i}} for i in range(3)] + [{"_source": 4}, {}]}})


def test_pull_in_batches_and_streams(spark, scratch):
    spark.dataSource.register(pull.pull_source(_transport))
    requests = json.dumps([{**SETTINGS["elasticsearch"], "index": f"s{i}"} for i in range(4)])
    df = spark.read.format("pull").option("system", "elasticsearch").option("requests", requests).load()
    assert df.rdd.getNumPartitions() == 4
    found = landing.pulled_from("elasticsearch", df, "response")
    assert found.count() == 12
    shards = found.select(F.get_json_object("value", "$.shard").alias("s")).distinct()
    assert rows(shards) == [("s0",), ("s1",), ("s2",), ("s3",)]


def _polled(spark, folder, log, clock):
    """One run of a polled query that ends at the clock's next whole number."""

    def transport(request):
        with open(log, "a") as f:
            f.write(request.url.rsplit("/", 1)[1] + ("" if request.body is None or "requeue_true" in request.body else " done") + "\n")
        return json.dumps([{"n": 1}, {"n": 2}])

    spark.dataSource.register(pull.pull_source(transport, lambda: float(open(clock).read())))
    stream = spark.readStream.format("pull").option("system", "rabbitmq").option("requests", json.dumps(
        [{**SETTINGS["rabbitmq"], "queue": q} for q in "ab"])).load()
    drain(stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c"))


def test_polls_go_on_after_a_restart(spark, scratch, tmp_path):
    """A poll has the clock's number, whoever started the query; messages are let go behind a stored batch only."""
    log, clock = f"{tmp_path}/log", f"{tmp_path}/clock"
    for now in (7, 8, 8, 11):
        with open(clock, "w") as f:
            f.write(str(now))
        _polled(spark, scratch, log, clock)
    got = spark.read.parquet(f"{scratch}/out").select("poll", "request")
    assert [(p, u.rsplit("/", 2)[1]) for p, u in rows(got)] == [(n, q) for n in (7, 8, 11) for q in "ab"]
    asked = open(log).read().split("\n")
    assert asked.count("get") == 6 and asked.index("get done") > 1


def test_subscription(spark, scratch):
    def feed(topic, start, end):
        return iter([f"{topic}-{i}" for i in range(start, end)])

    spark.dataSource.register(pull.subscription_source(feed, lambda topic: 5 if topic == "a" else 2))
    df = spark.read.format("subscription").option("topics", "a, b").load()
    want = [("a", i, f"a-{i}") for i in range(5)] + [("b", i, f"b-{i}") for i in range(2)]
    assert rows(df) == want
    stream = spark.readStream.format("subscription").option("topics", "a, b").load()
    query = stream.writeStream.format("parquet").option("path", f"{scratch}/out").option(
        "checkpointLocation", f"{scratch}/c").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(f"{scratch}/out").select("topic", "offset", "value")) == want


def _slow_chunks(text, size):
    """Character by character, for ASCII texts."""
    out = []
    while text:
        piece = text[:size]
        if not piece.endswith(" ") and " " in piece:
            piece = piece[: len(piece) - piece[::-1].index(" ")]
        out.append(piece)
        text = text[len(piece):]
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 8, 100])
def test_chunks(size):
    for text in ("hello big world", "  a  bb ccc", "nospacesatall", "", " ", "x y "):
        assert files.cut_chunks(text, size) == _slow_chunks(text, size)
    for text in ("éé ü日本語 x", "日本", "a é"):
        pieces = files.cut_chunks(text, size)
        assert "".join(pieces) == text
        assert all(len(p.encode()) <= size or len(p) == 1 for p in pieces)


def test_last_word_is_its_own_chunk(spark, scratch):
    os.makedirs(scratch)
    with open(f"{scratch}/a.txt", "w") as f:
        f.write("one two;three\nfour")
    out = ranges.file_chunks(spark, scratch, 1024).select("chunk_no", "chunk")
    assert rows(out) == [(1, "one"), (2, "two three four")]


def test_line_numbers_across_blocks(spark, scratch):
    os.makedirs(scratch)
    lines = [f"line {i} " + "x" * (i % 50) for i in range(1, 4001)]
    for name, part in (("big", lines), ("small", lines[:3])):
        with open(f"{scratch}/{name}.log", "w") as f:
            f.write("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = files.numbered_lines(spark, scratch)
        assert spark.read.text(scratch).rdd.getNumPartitions() > 8
        got = {(r["path"].rsplit("/", 1)[1], r["line_number"]): r["line"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("big.log", i + 1): t for i, t in enumerate(lines)} | {("small.log", i + 1): t for i, t in enumerate(lines[:3])}


def test_unread_lines(spark):
    lines = spark.createDataFrame([("a", i) for i in (1, 2, 3)] + [("b", 1), ("c", 1)], "path string, line_number long")
    marks = spark.createDataFrame([("a", 2), ("b", 9)], "path string, lines_read long")
    assert rows(files.unread_lines(lines, marks).select("path", "line_number")) == [("a", 3), ("b", 1), ("c", 1)]
    assert rows(files.line_marks(lines)) == [("a", 3), ("b", 1), ("c", 1)]


def test_folder_topics():
    assert files.folder_topics(["a", "b"], ["t"]) == [("a", "t"), ("b", "t")]
    assert files.folder_topics(["a", "b"], ["t", "u"]) == [("a", "t"), ("b", "u")]
    with pytest.raises(ValueError):
        files.folder_topics(["a", "b", "c"], ["t", "u"])


def test_message_shape(spark):
    df = spark.createDataFrame([("x",)], "m string").select(files.rtms_message(F.col("m")).alias("v"))
    assert df.first()[0] == '{"RTMSMessage":"x"}'


def test_inventory(spark, scratch):
    os.makedirs(f"{scratch}/sub")
    for name in ("a.txt", "b.pdf", "sub/c.LOG", "d"):
        with open(f"{scratch}/{name}", "w") as f:
            f.write("x")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.inventory(spark, scratch).collect()}
    assert got == {"a.txt": "text", "b.pdf": "binary", "c.LOG": "text", "d": "binary"}


def test_quarantine(spark):
    df = spark.createDataFrame([('{"a":1}',), ("[1]",), ("x",), (None,)], "v string")
    good, bad = sinks.split_valid(df, "v")
    assert good.count() == 1 and bad.count() == 3


def test_watched_folder_archives(spark, scratch):
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/a.csv", "w") as f:
        f.write("n\n1\n2\n")
    df = files.watch_csv(spark, f"{scratch}/in", "n int", f"{scratch}/done", 1)
    drain(df.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/c"))
    assert rows(spark.read.parquet(f"{scratch}/out")) == [(1,), (2,)]


def test_log_record(spark):
    row = spark.range(1).select(sinks.log_record(
        "WARN", "s", F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("m")).alias("r")).first()["r"]
    assert tuple(row) == ("WARN", "2024-01-02_03:04:05", "s", "m")


def test_responses_of_one_split_use_all_cores(spark, tmp_path):
    """A table of one file is dealt to all cores in front of the parsing."""
    from rillmark.plans.registry import QUERIES

    spark.sql("SELECT id AS event_id, id * 0.5D AS value FROM range(5)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["src_pull_rabbitmq"](spark, str(tmp_path))
    assert out.count() == 10 and "RoundRobinPartitioning" in out._jdf.queryExecution().toString()


def test_folders_are_put_into_place_by_the_tasks(spark, scratch, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen, plain = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, key, value: seen.update({key: value}) or plain(self, key, value))
    sinks.by_entity(spark.range(40).selectExpr("id", "id % 7 AS entity"), f"{scratch}/x")
    assert seen == {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    assert rows(spark.read.parquet(f"{scratch}/x").select("id", "entity")) == [(i, i % 7) for i in range(40)]
