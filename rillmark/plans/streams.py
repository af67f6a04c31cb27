"""Queries that run as streams over the tables until everything available is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import terms, threat
from rillmark.plans.inputs import WINDOW_SQL
from rillmark.plans.registry import query
from rillmark.plans.threats import _DOC_EL, _MEM_SQL, _MEM_TERMS, _SCORE_SQL, PROFILE, rules
from rillmark.session import SPREAD_BELOW, scratch_path
from rillmark.sources import files
from rillmark.streaming import jobs
from rillmark.streaming.keyed import asof_rows, latest
from rillmark.streaming.state import drain, every


def stream_of(t, name: str, files_per_trigger: int = 1000):
    """A table as a file stream; the pattern lets the table be one file or a folder of files."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(
        f"{t.sf_dir}/{name}.parquet*")


BATCHES = 4


def in_batches(rows, folder: str, order: str | None = None):
    """Rows as a stream of at least BATCHES micro-batches, by ranges of ``order`` if that is given.

    They are written as several files first, enough of them that a batch has work for all cores; a table of many
    splits keeps its number of files.
    """
    cores = min(rows.sparkSession.sparkContext.defaultParallelism, SPREAD_BELOW)
    files_ = max(BATCHES * cores, rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(files_, order) if order else rows.repartition(files_)
    dealt.write.parquet(folder)
    stream = rows.sparkSession.readStream.schema(rows.schema)
    return stream.option("maxFilesPerTrigger", -(-files_ // BATCHES)).parquet(folder)


def _measurements(events):
    return events.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("subtopic"), "value", "ts",
        F.col("event_id").alias("msgid"))


@query(
    "st_rolling_window",
    """SELECT user_id AS entity, event_id AS msgid, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) <= 20""",
)
def st_rolling_window(t):
    """The newest rows of every user, over several micro-batches."""
    base = scratch_path(t.spark, "rolling")
    stream = in_batches(_measurements(t.events), f"{base}/in")
    drain(jobs.rolling_windows(stream, ["entity"], ["ts", "msgid"], 20, f"{base}/out", f"{base}/checkpoint"))
    return latest(t.spark.read.parquet(f"{base}/out"), ["entity"]).select("entity", "msgid", "value")


# Rows of the rollback window, as in WINDOW_SQL.
WINDOW = 800


def _rolling(t, base):
    stream = in_batches(_measurements(t.events), f"{base}/in")
    drain(jobs.rolling_statistics(stream, ["avg", "max"], WINDOW, f"{base}/windows", f"{base}/pre", f"{base}/checkpoint1"))


_PRE = "entity bigint, subtopic string, preprocesstype string, hyperprediction double, batch_id bigint"


@query(
    "st_rolling_statistics",
    f"""SELECT entity, subtopic, unnest(['avg', 'max']) AS preprocesstype,
      unnest([round(a, 6), round(b, 6)]) AS hyperprediction
    FROM (SELECT entity, subtopic, avg(x) AS a, max(x) AS b FROM ({WINDOW_SQL}) GROUP BY entity, subtopic)""",
)
def st_rolling_statistics(t):
    """Statistics of every window as of its last change, over several micro-batches."""
    base = scratch_path(t.spark, "rolling")
    _rolling(t, base)
    out = latest(t.spark.read.schema(_PRE).parquet(f"{base}/pre"), ["entity", "subtopic", "preprocesstype"])
    return out.withColumn("hyperprediction", F.round("hyperprediction", 6))


@query(
    "st_chained_topics",
    f"""SELECT entity, round(avg(a), 6) AS avg, round(max(a), 6) AS max
    FROM (SELECT entity, subtopic, avg(x) AS a FROM ({WINDOW_SQL}) GROUP BY entity, subtopic) GROUP BY entity""",
)
def st_chained_topics(t):
    """raw -> window statistics -> statistics over the derived stream, each with its own checkpoint."""
    base = scratch_path(t.spark, "chain")
    _rolling(t, base)
    derived = t.spark.readStream.schema(_PRE).parquet(f"{base}/pre")
    second = derived.filter("preprocesstype = 'avg'").withColumnRenamed("batch_id", "step")
    drain(jobs.rolling_windows(second, ["entity", "subtopic"], ["step"], 1, f"{base}/out", f"{base}/checkpoint2"))
    last = latest(t.spark.read.parquet(f"{base}/out"), ["entity", "subtopic"])
    return last.groupBy("entity").agg(
        F.round(F.avg("hyperprediction"), 6).alias("avg"), F.round(F.max("hyperprediction"), 6).alias("max"))


@query("st_entity_memory", _MEM_SQL + " SELECT * FROM c")
def st_entity_memory(t):
    """The stream of documents leaves the same counts as the batch form, over several micro-batches."""
    base = scratch_path(t.spark, "memory")
    texts = t.documents.select(F.col("source").alias("entity"), F.floor(F.col("doc_id") / 40).alias("window"), "text")
    stream = in_batches(texts, f"{base}/in", "window")
    drain(jobs.window_hits(stream, "text", lambda: terms.parse_groups(_MEM_TERMS), f"{base}/hits", f"{base}/checkpoint1"))
    schema = "entity string, window bigint, terms array<string>"
    drain(jobs.entity_memory(t.spark, f"{base}/hits", schema, 20, 10_000, f"{base}/out", f"{base}/checkpoint2"))
    return latest(t.spark.read.parquet(f"{base}/out"), ["entity"])


@query(
    "st_log_scan",
    _DOC_EL + f""", s AS (SELECT doc_id, line_number, {_SCORE_SQL} AS ps FROM un),
    m AS (SELECT avg(ps * exp(0.2979)) AS mu, stddev_pop(ps * exp(0.2979)) AS sigma FROM s)
    SELECT doc_id, line_number, round_even(ps * exp(0.2979), 2) AS raw_score,
      round_even(100 / (1 + exp(-(round_even(ps * exp(0.2979), 2) - mu) / sigma)), 2) AS normalised_score FROM s, m""",
)
def st_log_scan(t):
    """New documents scored as one batch on a cold start."""
    base = scratch_path(t.spark, "scan")
    lines = stream_of(t, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("_pos", "line")).select(
        "doc_id", (F.col("_pos") + 1).alias("line_number"), "line")
    drain(jobs.log_scan(
        lines, "line", "doc_id", "line_number", rules(), threat.Weights.from_profile(PROFILE), f"{base}/baseline", 24,
        lambda batch_id: "2024-03-01 00:00:00", f"{base}/out", f"{base}/checkpoint"))
    schema = "doc_id bigint, line_number int, raw_score double, normalised_score double"
    return t.spark.read.schema(schema).parquet(f"{base}/out").select(
        "doc_id", "line_number", "raw_score", "normalised_score")


_PHRASE = "[a-z]+ [a-z]+"


@query(
    "st_reloaded_terms",
    f"""WITH ph AS (SELECT DISTINCT conv_id % 4 AS part, regexp_extract(text, '{_PHRASE}') AS term FROM conversations
      WHERE turn < 3 AND regexp_extract(text, '{_PHRASE}') <> ''),
    c AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END AS batch FROM conversations),
    f AS (SELECT c.conv_id, c.turn, ph.term FROM c JOIN ph ON ph.part = c.batch AND contains(c.text, ph.term)
      UNION SELECT conv_id, turn, unnest(['the', 'reat']) FROM c WHERE contains(text, 'the') AND contains(text, 'reat')
      UNION SELECT conv_id, turn, 'ouen' FROM c WHERE contains(text, 'ouen')
      UNION SELECT conv_id, turn, '^[A-M].*[.]$' FROM c WHERE batch = 2 AND regexp_matches(text, '^[A-M].*[.]$'))
    SELECT DISTINCT conv_id, turn, term FROM f""",
)
def st_reloaded_terms(t):
    """A text stream against a table of terms that grows with the texts; the files change between two batches."""
    base = scratch_path(t.spark, "terms")
    phrases = t.conversations.filter("turn < 3").select(
        (F.col("conv_id") % 4).alias("part"), F.regexp_extract("text", _PHRASE, 0).alias("value")).filter("value <> ''")
    texts = t.conversations.select("conv_id", "turn", "text")
    for batch in (1, 2):
        lines = phrases.filter(F.col("part") == batch).select("value")
        extra = ["~~~@the,reat"] + ["rgx:^[A-M].*[.]$"] * (batch == 2)
        lines.unionByName(t.spark.createDataFrame([(x,) for x in extra], "value string")).write.mode("overwrite").text(f"{base}/files")
        texts.filter((F.col("conv_id") % 3 == 0) == (batch == 1)).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(texts.schema).parquet(f"{base}/in")
        drain(jobs.searched(stream, ["conv_id", "turn"], "text", [f"|{base}/files"], "ouen", f"{base}/out", f"{base}/checkpoint"))
    out = t.spark.read.schema("conv_id bigint, turn bigint, found array<string>").parquet(f"{base}/out")
    return out.select("conv_id", "turn", F.explode("found").alias("term"))


@query(
    "st_asof",
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
    v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    j AS (SELECT c.event_id, c.ts, v.ts AS vts, v.value FROM c ASOF LEFT JOIN v
      ON c.user_id = v.user_id AND c.ts >= v.ts)
    SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(vts) <= 21600000000 THEN value END AS view_value FROM j""",
)
def st_asof(t):
    """Clicks and views as two streams; rows arrive out of order, each click is answered behind the watermark."""
    base = scratch_path(t.spark, "asof")
    events = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    # Behind everything, one row that belongs to no user lets the watermark pass all others.
    last = events.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.lit("click").alias("event_type"), "ts",
        F.lit(None).cast("double").alias("value"))
    in_batches(events, f"{base}/in")
    last.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    clicks = stream.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = stream.filter("event_type = 'view'").select("user_id", "ts", "value")
    found = asof_rows(clicks, views, ["user_id"], "ts", "value", 6 * 3600, "60 days", "view_value")
    drain(found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    out = t.spark.read.schema(found.schema).parquet(f"{base}/out")
    return out.filter("event_id >= 0").select("event_id", "view_value")


@query(
    "st_deduplicated",
    "SELECT DISTINCT user_id || '-' || event_type AS kafkakey, user_id FROM events",
)
def st_deduplicated(t):
    """Keys delivered many times arrive once."""
    base = scratch_path(t.spark, "dedupe")
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    rows = stream_of(t, "events").select(key.alias("kafkakey"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    unique = jobs.deduplicated(rows, "kafkakey", "ts", "60 days").select("kafkakey", "user_id")
    drain(unique.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint"))
    return t.spark.read.schema("kafkakey string, user_id bigint").parquet(f"{base}/out")


@query(
    "st_restart",
    "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
)
def st_restart(t):
    """A query that is started again with its checkpoint goes on with what has arrived since and repeats nothing."""
    base = scratch_path(t.spark, "restart")
    rows = t.events.select("event_id", "event_type")
    for part in range(2):
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        drain(stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    out = t.spark.read.schema(rows.schema).parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_polled_lines", "SELECT count(*) AS lines, count(DISTINCT s_name) AS names FROM supplier")
def st_polled_lines(t):
    """A folder of JSON lines polled with a trigger interval until it is drained."""
    base = scratch_path(t.spark, "polled")
    t.supplier.select(F.to_json(F.struct("s_suppkey", "s_name")).alias("value")).write.text(f"{base}/in")
    lines = files.json_lines(t.spark, f"{base}/in", stream=True, files_per_trigger=100)
    rows = lines.select(F.get_json_object("value", "$.s_name").alias("name"))
    query_ = rows.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(**every(0.5)).start()
    query_.processAllAvailable()
    query_.stop()
    out = t.spark.read.schema("name string").parquet(f"{base}/out")
    return out.agg(F.count("*").alias("lines"), F.countDistinct("name").alias("names"))


@query(
    "src_watch_csv",
    "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
)
def src_watch_csv(t):
    """CSV files of a watched folder; read files are archived."""
    base = scratch_path(t.spark, "watch")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(f"{base}/in")
    schema = "s_suppkey bigint, s_name string, s_acctbal double"
    rows = files.watch_csv(t.spark, f"{base}/in", schema, f"{base}/done")
    drain(rows.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint"))
    return t.spark.read.schema(schema).parquet(f"{base}/out")


@query(
    "st_event_time_windows",
    """SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean,
      min(value) AS min, max(value) AS max FROM events GROUP BY ALL""",
)
def st_event_time_windows(t):
    """Time windows with a watermark, the additional mode."""
    base = scratch_path(t.spark, "time")
    rows = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = jobs.event_time_statistics(rows, "ts", "1 day", "1 day", ["event_type"], F.col("value"))
    drain(windows.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/out")))
    schema = "window struct<start:timestamp,end:timestamp>, event_type string, n bigint, mean double, min double, max double"
    out = t.spark.read.schema(schema).parquet(f"{base}/out")
    return out.select(F.unix_seconds("window.start").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"),
                      "min", "max")
