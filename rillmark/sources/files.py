"""File sources: lines, folders, chunks, line numbers, lookups and reference maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.text import clean_for_ingest, strip
from rillmark.operators.terms import classify_term_lines
from rillmark.operators.windows import lookup_join, prefix_values

DEVICE_SCHEMA = "dsn string, oem string, identifier string, index string, lat string, long string"


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def json_lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """One record text per line; ``;`` becomes a blank, ends are trimmed, blank lines dropped."""
    reader = _reader(spark, stream)
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(path)
    return lines.select(strip(F.replace("value", F.lit(";"), F.lit(" "))).alias("value")).filter("value <> ''")


def folder_topics(folders: Sequence[str], topics: Sequence[str]) -> list[tuple[str, str]]:
    """(folder, topic) pairs: one topic for all folders, or one each."""
    if len(topics) == 1:
        return [(f, topics[0]) for f in folders]
    if len(topics) != len(folders):
        raise ValueError(f"{len(folders)} folders but {len(topics)} topics")
    return list(zip(folders, topics))


def folder_messages(
    spark: SparkSession, folders: Sequence[str], topics: Sequence[str], stream: bool = False
) -> DataFrame:
    """Cleaned lines of each folder's files as (topic, path, message)."""
    out = None
    for folder, topic in folder_topics(folders, topics):
        lines = _reader(spark, stream).text(folder).select(
            F.lit(topic).alias("topic"), F.col("_metadata.file_path").alias("path"),
            clean_for_ingest(F.col("value")).alias("message")).filter("message <> ''")
        out = lines if out is None else out.unionByName(lines)
    return out


def rtms_message(message: Column) -> Column:
    """``{"RTMSMessage": text}``."""
    return F.to_json(F.struct(message.alias("RTMSMessage")))


def cut_chunks(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` UTF-8 bytes, cut back to the last blank.

    A piece without a blank stays whole; characters are never split.
    """
    data, start, pieces = text.encode("utf-8"), 0, []
    while start < len(data):
        end = min(start + size, len(data))
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        blank = data.rfind(b" ", start, end)
        if blank >= 0:
            end = blank + 1
        pieces.append(data[start:end].decode("utf-8"))
        start = end
    return pieces


def chunk_texts(df: DataFrame, keys: Sequence[str], text: str, size: int) -> DataFrame:
    """(keys, chunk_no, chunk) of every text; cleaned, empty chunks dropped.

    Where a piece ends depends on where it began, so one text is cut in order
    (files in blocks: :func:`rillmark.sources.ranges.file_chunks`)
    while all texts are cut in parallel.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])
    names = list(keys)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["chunk"] = [cut_chunks(t or "", size) for t in batch[text]]
            batch["chunk_no"] = [list(range(1, len(c) + 1)) for c in batch["chunk"]]
            out = batch[[*names, "chunk_no", "chunk"]].explode(["chunk_no", "chunk"]).dropna(subset=["chunk_no"])
            yield out.astype({"chunk_no": "int32"})

    cuts = df.select(*names, text).mapInPandas(cut, schema)
    return cuts.withColumn("chunk", clean_for_ingest(F.col("chunk"))).filter("chunk <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, line) of text files of any size.

    A large file is read in blocks by many tasks.  Line ids grow by one inside
    a block, so the number is the id's distance from the block's first id plus
    the line counts of the earlier blocks; only one row per block is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    blocks = prefix_values(blocks, ["path"], "_block", "_lines", "sum", "_before", chunk=1 << 40)
    joined = lines.join(blocks.drop("_lines"), ["path", "_block"])
    number = F.col("_id") - F.col("_first") + F.coalesce("_before", F.lit(0)) + 1
    return joined.select("path", number.alias("line_number"), "line")


def unread_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines beyond each file's remembered count; a file that shrank is read again.

    ``marks`` has (path, lines_read).
    """
    sizes = lines.groupBy("path").agg(F.max("line_number").alias("_size"))
    known = sizes.join(marks, "path", "left").select("path", F.when(
        F.coalesce("lines_read", F.lit(0)) > F.col("_size"), F.lit(0)).otherwise(
        F.coalesce("lines_read", F.lit(0))).alias("_seen"))
    return lookup_join(lines, known, ["path"]).filter("line_number > _seen").drop("_seen")


def line_marks(lines: DataFrame) -> DataFrame:
    """Lines read per file, to be remembered for the next pass."""
    return lines.groupBy("path").agg(F.max("line_number").alias("lines_read"))


def devices(spark: SparkSession, path: str) -> DataFrame:
    """Device lookup without header, positions in lower case, with file order."""
    rows = spark.read.schema(DEVICE_SCHEMA).csv(path)
    return rows.withColumns({
        "lat": F.lower("lat"), "long": F.lower("long"), "ord": F.monotonically_increasing_id()})


def watch_csv(spark: SparkSession, folder: str, schema: str, archive: str, files_per_trigger: int = 100) -> DataFrame:
    """New CSV files of a folder; finished files move to the archive folder."""
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
        .option("cleanSource", "archive").option("sourceArchiveDir", archive).csv(folder)
    )


def matrix_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """(tactic, technique) rows of JSON maps of lists."""
    pairs = documents.select(F.explode(F.from_json(value, "map<string,array<string>>")).alias("tactic", "techniques"))
    return pairs.select("tactic", F.explode("techniques").alias("technique"))


def tactic_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The tactic matrix file."""
    return matrix_rows(spark.read.text(path, wholetext=True))


def rule_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """(ord, name, pattern, tactic, technique) rows of JSON maps of rules, in declared order."""
    kind = "map<string,struct<pattern:string,mitre_tactic:string,mitre_technique:string>>"
    rows = documents.select(F.posexplode(F.map_entries(F.from_json(value, kind))).alias("ord", "e"))
    return rows.select(
        "ord", F.col("e.key").alias("name"), F.col("e.value.pattern").alias("pattern"),
        F.col("e.value.mitre_tactic").alias("tactic"), F.col("e.value.mitre_technique").alias("technique"))


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """The rules file."""
    return rule_rows(spark.read.text(path, wholetext=True))


WEIGHT_PARTS = ("attack_complexity_weights", "entity_vulnerability_weights", "fallbacks")


def weight_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """(part, ord, keyword, weight) rows of the three maps of a weight profile, in declared order."""
    kind = "struct<" + ",".join(f"{p}:map<string,double>" for p in WEIGHT_PARTS) + ">"
    parsed = documents.select(F.from_json(value, kind).alias("d"))
    maps = F.array(*[
        F.struct(F.lit(p).alias("part"), F.map_entries(f"d.{p}").alias("entries")) for p in WEIGHT_PARTS])
    rows = parsed.select(F.inline(maps)).select("part", F.posexplode("entries").alias("ord", "e"))
    return rows.select("part", "ord", F.col("e.key").alias("keyword"), F.col("e.value").alias("weight"))


def weight_table(spark: SparkSession, path: str) -> DataFrame:
    """The weight profile file."""
    return weight_rows(spark.read.text(path, wholetext=True))


def term_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(folder, every, kind, term) of search-term files; ``@folder`` means all terms must hold."""
    out = None
    for folder in folders:
        lines = spark.read.text(folder.lstrip("@|"))
        rows = classify_term_lines(lines, "value").select(
            F.lit(folder.lstrip("@|")).alias("folder"), F.lit(folder.startswith("@")).alias("every"), "kind", "term")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


TEXT_SUFFIXES = ("txt", "text", "log", "conf", "def", "list", "in", "bat", "c", "h", "ksh", "pl", "srt")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, kind) of a document folder; contents are not read."""
    suffix = F.lower(F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.withColumn("kind", F.when(suffix.isin(*TEXT_SUFFIXES), "text").otherwise("binary"))
