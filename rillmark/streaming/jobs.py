"""Streaming forms of the batch operators.

Jobs hand their micro-batches to the same DataFrame functions the batch
queries use; what must be remembered per key is keyed state (``keyed``).
Outputs are written per batch id, so a repeated batch replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rillmark.operators import memory, stats, terms, threat
from rillmark.session import materialize
from rillmark.sources import files, sinks
from rillmark.streaming import keyed


def _batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def updates(stream: DataFrame, out: str, checkpoint: str, emit: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Write what each batch of an update stream emits below ``out``; ``emit`` gets it as stored.

    Stored rows can be read as often as needed, while the batch itself would run its keyed state again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        folder = _batch_folder(out, batch_id)
        batch.write.mode("overwrite").parquet(folder)
        if emit is not None:
            emit(batch.sparkSession.read.schema(batch.schema).parquet(folder), batch_id)

    return stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)


def rolling_windows(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str, checkpoint: str,
    emit: Callable[[DataFrame, int], None] | None = None,
) -> DataStreamWriter:
    """Newest ``n`` rows per key over the whole stream: each batch leaves the windows of its own keys."""
    return updates(keyed.newest_rows(stream, keys, order, n), out, checkpoint, emit)


def rolling_statistics(
    stream: DataFrame, types: Sequence[str], maxrows: int, windows: str, out: str, checkpoint: str
) -> DataStreamWriter:
    """Preprocessed records of the windows that a batch changed."""

    def emit(window: DataFrame, batch_id: int) -> None:
        stats.preprocess(window, types, maxrows).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return rolling_windows(stream, stats.KEYS, stats.ORDER, maxrows, windows, checkpoint, emit)


def window_hits(
    stream: DataFrame, text: str, term_source: Callable[[], Sequence[terms.TermGroup]], out: str, checkpoint: str
) -> DataStreamWriter:
    """Terms seen per entity and window of every batch, for :func:`entity_memory`.

    The terms are read again for every batch; what is stored are the terms' own
    texts, so terms may come, go and move.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        memory.window_hits(batch, text, term_source()).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def entity_memory(
    spark: SparkSession, hits: str, schema: str, remember: int, maxwindows: int, out: str, checkpoint: str
) -> DataStreamWriter:
    """Counts of every entity's remembered windows, chained behind :func:`window_hits`.

    ``schema`` names the types of ``entity``, ``window`` and ``terms``.  Sets
    of terms are merged, so a repeated batch of hits changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(hits)
    return updates(keyed.remembered_windows(stream, min(remember, maxwindows)), out, checkpoint)


def log_scan(
    stream: DataFrame, line: str, file: str, line_number: str, rules: Sequence[threat.Rule], weights: threat.Weights,
    baseline: str, hours: float, clock: Callable[[int], str], out: str, checkpoint: str,
) -> DataStreamWriter:
    """Score the new lines of each batch together against the stored baseline.

    ``clock`` gives the time of a batch.  Every batch leaves the baseline that
    holds after it, one row per category, under its number; the next one reads
    that, so a repeated batch sees the same one.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = threat.elements(batch, line, rules, [file, line_number])
        stored = materialize(threat.unique_elements(found, file, line_number), "elements")
        before = sinks.load_baseline(spark, _batch_folder(baseline, batch_id - 1)) if batch_id else None
        known = None if before is None or before.isEmpty() else before
        after = known if known is not None else spark.createDataFrame([], sinks.BASELINE_SCHEMA)
        if not stored.isEmpty():
            scored = threat.score_batch(stored, weights, known, stored=False)
            scored.write.mode("overwrite").parquet(_batch_folder(out, batch_id))
            after = sinks.next_baseline(known, threat.distribution(stored, "event_type"), clock(batch_id), hours)
        after.write.mode("overwrite").parquet(_batch_folder(baseline, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def searched(
    stream: DataFrame, keys: Sequence[str], text: str, folders: Sequence[str], config: str, out: str, checkpoint: str
) -> DataStreamWriter:
    """Texts with the search terms found; term files are read again for every batch.

    ``keys`` tell the texts apart.  The term files are a table like any other:
    every batch is joined with all their terms, however many.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        groups = terms.group_table(files.term_files(spark, folders)).unionByName(
            spark.createDataFrame(terms.group_rows(terms.parse_groups(config)), terms.GROUP_SCHEMA)).distinct()
        rows = materialize(batch.select(*keys, text), "texts")
        found = terms.match_groups(rows, keys, text, materialize(groups, "terms"))
        found.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Repeated deliveries within the watermark are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def event_time_statistics(
    stream: DataFrame, ts: str, delay: str, length: str, keys: Sequence[str], value: Column
) -> DataFrame:
    """Additional mode with time windows and a watermark; count windows are the default."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("window"), *keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
