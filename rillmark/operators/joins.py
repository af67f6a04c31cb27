"""Joins between streams, lookups and reference data.

No side is broadcast by hint unless its size is fixed by construction; Spark
chooses a broadcast from measured sizes and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.membership import may_hold
from rillmark.operators.stats import micros
from rillmark.operators.windows import first_by, last_n, lookup_join
from rillmark.session import HOT_KEY_PARTS, materialize


def device_lookup(df: DataFrame, devices: DataFrame, key: str, order: str) -> DataFrame:
    """Add the first matching device row; records without a device are dropped."""
    return lookup_join(df, first_by(devices, [key], [order]).drop(order), [key])


def align_streams(
    measurements: DataFrame, streams: dict[str, str], maxrows: int = 800, bucket: Column | None = None
) -> DataFrame:
    """Streams of one entity side by side, one aggregate function per stream.

    Without a bucket, all rows are aggregated and counted by stream first, which
    moves no rows.  Only streams of more than ``maxrows`` rows are cut to their
    newest ones, and only rows of such streams, and few others, are shuffled.
    """
    functions = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    wanted = measurements.filter(F.col("subtopic").isin(list(streams)))
    if bucket is not None:
        rows = last_n(wanted, ["entity", "subtopic"], ["ts", "msgid"], maxrows)
        return rows.withColumn("window", bucket).groupBy("entity", "window").agg(*[
            functions[fn](F.when(F.col("subtopic") == s, F.col("value"))).alias(s) for s, fn in streams.items()
        ])

    def aggregated(rows: DataFrame) -> DataFrame:
        return rows.groupBy("entity", "subtopic").agg(F.count("*").alias("_n"), *[
            functions[fn](F.when(F.col("subtopic").isin([s for s in streams if streams[s] == fn]), F.col("value"))).alias(f"_{fn}")
            for fn in dict.fromkeys(streams.values())
        ])

    every = materialize(aggregated(wanted), "streams")
    kept = every.filter(F.col("_n") <= maxrows)
    # Up to so many rows a stream meets in one task; longer ones are cut in parts first.
    most, group = maxrows * HOT_KEY_PARTS, F.xxhash64("entity", "subtopic")
    for size, salts in ((F.col("_n").between(maxrows + 1, most), 1), (F.col("_n") > most, HOT_KEY_PARTS)):
        long = every.filter(size).select(group.alias("_hash"))
        if n := long.count():
            rows = last_n(wanted.filter(may_hold(long, n)(group)), ["entity", "subtopic"], ["ts", "msgid"], maxrows, salts)
            kept = kept.unionByName(aggregated(rows))
    # A stream that passed the filter by chance is there twice, with the same values.
    found = {s: F.max(F.when(F.col("subtopic") == s, F.col(f"_{fn}"))) for s, fn in streams.items()}
    return kept.groupBy("entity").agg(*[
        (F.coalesce(found[s], F.lit(0)) if fn == "count" else found[s]).alias(s) for s, fn in streams.items()
    ])


def training_matrix(
    measurements: DataFrame, streams: Sequence[str], maxrows: int = 1000, minimum: int = 30
) -> DataFrame:
    """One row per (entity, aligned index) with all streams present.

    Rows are aligned by their rank from the newest; entities with fewer than
    ``minimum`` complete rows are left out.
    """
    wanted = measurements.filter(F.col("subtopic").isin(list(streams)))
    rows = last_n(wanted, ["entity", "subtopic"], ["ts", "msgid"], maxrows, rank="idx")
    wide = rows.groupBy("entity", "idx").pivot("subtopic", list(streams)).agg(F.max("value")).dropna()
    counted = wide.withColumn("_n", F.count("*").over(Window.partitionBy("entity")))
    return counted.filter(F.col("_n") >= minimum).drop("_n")


# Parts of a tolerance that a key's rows are scanned in.
SEGMENTS = 1024


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, tolerance_seconds: int, out: str,
    tie: str | None = None, segments: int = SEGMENTS,
) -> DataFrame:
    """Latest right value at or before each left row, at most ``tolerance`` old.

    A scan of the last known value, in segments: a key's time is cut into
    segments of a part of the tolerance.  Each reports its last right row, and
    what a segment takes over is the last one reported by those of a tolerance
    before it, ``2 * segments`` small rows at most.  So a key whose rows all lie
    within one tolerance is still spread.  Of right rows with equal stamps the
    one with the largest ``tie`` counts, by default the value itself.
    """
    width = tolerance_seconds * 1_000_000
    part = max(width // segments, 1)
    whole = -(-width // part)  # segments of a tolerance

    lefts = left.withColumns({"_us": micros(F.col(ts)), "_side": F.lit(1)})
    rights = right.select(*keys, micros(F.col(ts)).alias("_us"), F.lit(0).alias("_side"), F.col(value).alias("_rv"), F.col(tie or value).alias("_tie"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_segment", F.floor(F.col("_us") / part))
    known = F.when(F.col("_side") == 0, F.struct(F.col("_us").alias("_rus"), "_rv"))

    reports = both.groupBy(*keys, "_segment").agg(
        F.max_by(known, F.when(F.col("_side") == 0, F.struct("_us", "_tie"))).alias("_known"), F.bool_or(F.col("_side") == 1).alias("_asked"))
    own = F.floor(F.col("_segment") / whole)
    spans = reports.select(*keys, "_segment", "_known", F.explode(F.array(own, own + 1)).alias("_span"), "_asked", own.alias("_own"))
    before = Window.partitionBy(*keys, "_span").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_carry", F.last("_known", ignorenulls=True).over(before)).filter("_asked AND _span = _own")
    carries = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_segment").alias("_ks"), "_carry")

    same = F.col("_segment") == F.col("_ks")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = both.join(carries, same, "left")
    inside = Window.partitionBy(*keys, "_segment").orderBy("_us", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(known, ignorenulls=True).over(inside), F.col("_carry"))
    found = met.withColumn("_last", last).filter(F.col("_side") == 1)
    fresh = F.col("_us") - F.col("_last._rus") <= width
    return found.select(*left.columns, F.when(fresh, F.col("_last._rv")).alias(out))


def simulation_bias(
    simulated: DataFrame, measured: DataFrame, key: str, ts: str, tolerance_seconds: int
) -> DataFrame:
    """Simulated minus latest measured value per vessel within the tolerance."""
    joined = asof_join(simulated, measured, [key], ts, "measured", tolerance_seconds, "measured")
    return joined.withColumn("bias", F.col("simulated") - F.col("measured"))


HEAD_WORDS = 4
# Characters of the longest entity that is compared with the text right behind a place.
LONG_ENTITY = 64


def _quoted(text: str) -> str:
    """A pattern for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def entity_mentions(texts: DataFrame, text: str, entities: DataFrame, entity: str, term: str) -> DataFrame:
    """Texts holding ``term`` with ``--entity--`` replaced by a known entity.

    Entities may hold any characters and mentions may overlap; at an end of
    the term the entity does not go on as a word.  Every place where an entity
    can begin gives its first words, up to ``HEAD_WORDS`` of them, as keys.  An
    entity is looked up by as many whole words as it surely begins with, by its
    first character if there are none, and only such candidates are compared
    in full.  A place travels with the few characters that an entity can still
    cover, not with its text, and only if some entity may have its key.
    Entities beyond ``LONG_ENTITY`` characters are looked up by so many and
    compared with the whole text.  Empty and null entities match nothing.
    """
    before, mark, after = term.partition("--entity--")
    if not mark:
        raise ValueError("the term needs --entity--")
    start = f"(?<={_quoted(before)})" if before else r"(?<!\w)"
    runs = [rf"\W*+\w++(?:\W++\w++){{{n - 1}}}" for n in range(HEAD_WORDS, 0, -1)]

    names = entities.select(F.col(entity).cast("string").alias(entity)).filter(F.col(entity) != "").distinct()
    closed = F.concat(entity, F.lit(after or " "))
    heads = [F.nullif(F.regexp_extract(closed, rf"(?U)^({run})(?=\W)", 1), F.lit("")) for run in runs]
    long = F.length(entity) > LONG_ENTITY
    key = F.when(long, F.substring(entity, 1, LONG_ENTITY)).otherwise(F.coalesce(*heads, F.substring(entity, 1, 1)))
    names = names.select(entity, key.alias("_head"), F.when(long, "long").when(F.coalesce(*heads).isNull(), "character").otherwise("words").alias("_kind"))
    opening = F.regexp_extract(closed, rf"(?U)^({runs[-1]})(?=\W)", 1)
    names = names.withColumn("_key", F.xxhash64("_kind", "_head")).withColumn(
        "_opening", F.when(F.col("_kind") == "words", F.xxhash64(F.lit("opening"), opening)).otherwise(F.col("_key"))).drop("_head")
    names = materialize(names, "entities")
    longs = F.col("_kind") == "long"
    sizes = names.agg(F.count_if(~longs).alias("short"), F.count_if(longs).alias("long")).first()

    def places(size: int) -> Column:
        """The next characters of every place."""
        found = F.regexp_extract_all(F.col(text), F.lit(f"(?sU){start}(?=(.{{1,{size}}}))"), F.lit(1))
        return F.explode(F.array_distinct(found)).alias("_next")

    whole = texts.withColumn("_row", F.monotonically_increasing_id())
    hashes = names.filter(~longs).select(F.explode(F.array("_key", "_opening")).alias("_key")).distinct()
    known = may_hold(hashes, 2 * sizes["short"])
    near = whole.select("*", places(LONG_ENTITY + len(after) + 1))
    # Most places end at their first word: no entity begins with it.
    character = F.xxhash64(F.lit("character"), F.substring("_next", 1, 1))
    near = near.filter(known(F.xxhash64(F.lit("opening"), F.regexp_extract("_next", rf"(?U)^({runs[-1]})", 1))) | known(character))
    begun = [F.nullif(F.regexp_extract("_next", rf"(?U)^({run})", 1), F.lit("")) for run in runs]
    keys = [F.when(h.isNotNull(), F.xxhash64(F.lit("words"), h)) for h in begun] + [character]
    near = near.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*keys))))).filter(known(F.col("_key")))
    near = lookup_join(near, names.filter(~longs).select(entity, "_key"), ["_key"])
    rest = F.substring(F.col("_next"), F.length(entity) + 1, F.lit(1))
    near = near.filter(F.startswith("_next", F.concat(entity, F.lit(after))) & (F.lit(bool(after)) | ~F.rlike(rest, F.lit(r"(?U)^\w"))))
    found = near.select(*texts.columns, "_row", entity)
    if sizes["long"]:
        known = may_hold(names.filter(longs).select("_key"), sizes["long"])
        far = whole.select("*", places(LONG_ENTITY)).withColumn("_key", F.xxhash64(F.lit("long"), "_next")).filter(known(F.col("_key")))
        # A quotation inside the pattern must not end at characters of the entity.
        inner = F.concat(F.lit(r"\Q"), F.replace(entity, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        pattern = F.concat(F.lit(f"(?sU){start}"), inner, F.lit(_quoted(after) if after else r"(?!\w)"))
        far = lookup_join(far, names.filter(longs).select(entity, "_key"), ["_key"]).filter(F.rlike(F.col(text), pattern))
        found = found.unionByName(far.select(*texts.columns, "_row", entity))
    return found.dropDuplicates(["_row", entity]).drop("_row")


def knowledge_match(text: Column, matrix: dict[str, list[str]]) -> Column:
    """Struct (tactic, technique) named in a text, ``na`` when nothing matches.

    Tactics named in the text come with those of their techniques that are
    named too.  Without any tactic, named techniques give their tactics.
    Names are sorted and joined by ``-`` with blanks as ``_``.
    """
    entries = F.array(*[
        F.struct(F.lit(k).alias("tactic"), F.array(*[F.lit(v) for v in vs]).alias("techniques"))
        for k, vs in matrix.items()
    ])

    def named(names: Column) -> Column:
        return F.filter(names, lambda v: F.contains(text, v))

    def joined(names: Column) -> Column:
        return F.replace(F.array_join(F.array_sort(F.array_distinct(names)), "-"), F.lit(" "), F.lit("_"))

    tactics = F.filter(entries, lambda e: F.contains(text, e["tactic"]))
    under = F.flatten(F.transform(tactics, lambda e: named(e["techniques"])))
    by_technique = F.filter(entries, lambda e: F.size(named(e["techniques"])) > 0)
    loose = F.flatten(F.transform(by_technique, lambda e: named(e["techniques"])))
    nothing = F.struct(F.lit("na").alias("tactic"), F.lit("na").alias("technique"))
    return (
        F.when(
            (F.size(tactics) > 0) & (F.size(under) > 0),
            F.struct(joined(F.transform(tactics, lambda e: e["tactic"])).alias("tactic"),
                     joined(under).alias("technique")))
        .when(
            (F.size(tactics) == 0) & (F.size(loose) > 0),
            F.struct(joined(F.transform(by_technique, lambda e: e["tactic"])).alias("tactic"),
                     joined(loose).alias("technique")))
        .otherwise(nothing)
    )


def changed_files(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or have another modification time than recorded."""
    return inventory.join(known.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
