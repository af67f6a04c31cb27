"""Per-key state of streams in Spark's own state store.

Every operator keeps a bounded number of rows per key, reads and writes the state of the keys of a batch only (the
newest rows: of the parts these keys are dealt to), and emits those keys only.  The state lives in RocksDB on the executors and in the query's checkpoint, from which lost
executors and restarted queries take it.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Spark looks at a processor in a Python process of the driver that has no shipped packages: it travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let streaming queries started from now on keep their state in RocksDB, as keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _newest_of_batch(keys: Sequence[str], order: Sequence[str], n: int):
    """The newest ``n`` rows per key of each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.sort_values(list(order), ascending=False, na_position="last")
            yield rows.groupby(list(keys), dropna=False, sort=False).head(n)

    return run


# Parts that the keys of a stream are dealt to by hash; each part's windows are one state.
PARTS = 512
_PART = "_part"


def _newest_of_part(schema: T.StructType, keys: Sequence[str], order: Sequence[str], n: int):
    """The newest ``n`` rows of all keys of a part; windows with a new row are emitted whole."""
    whole = [f.name for f in schema if isinstance(f.dataType, T.IntegralType)]
    names = list(schema.names)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A null among whole numbers must not make decimals of the others.
        new = pd.concat([b[names].astype({c: "Int64" for c in whole}) for b in batches], ignore_index=True).assign(_new=True)
        if state.exists:
            held = pickle.loads(state.get[0])
            new = pd.concat([held.assign(_new=False), new], ignore_index=True)
        rows = new.sort_values(list(order), ascending=False, na_position="last", kind="stable")
        kept = rows.groupby(list(keys), dropna=False, sort=False).head(n)
        changed = kept.groupby(list(keys), dropna=False, sort=False)["_new"].transform("any")
        if changed.any():
            state.update((pickle.dumps(kept[names], protocol=5),))
            yield kept.loc[changed, names]

    return run


def newest_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, parts: int = PARTS) -> DataFrame:
    """Newest ``n`` rows of every key over the whole stream, in update mode: the windows of the keys that changed.

    ``order`` must end in a unique tie-break.  Each task cuts its rows before the shuffle, so a busy key sends ``n``
    rows per Arrow batch at most.  Keys are dealt to ``parts`` parts; the windows of a part are read, merged with a
    batch's rows and written at once, and a part without new rows is not touched.  With many millions of keys, give
    more parts, so that a part's windows stay small.
    """
    use_rocksdb(stream.sparkSession)
    cut = stream.mapInPandas(_newest_of_batch(keys, order, n), stream.schema)
    dealt = cut.withColumn(_PART, F.pmod(F.xxhash64(*keys), F.lit(parts)))
    merge = _newest_of_part(stream.schema, keys, order, n)
    return dealt.groupBy(_PART).applyInPandasWithState(merge, stream.schema, "windows binary", "update", GroupStateTimeout.NoTimeout)


class RememberedWindows(StatefulProcessor):
    """The newest ``n`` windows of an entity with the terms seen in each; its counts are emitted whenever they change."""

    def __init__(self, window: T.DataType, n: int):
        self.schema = T.StructType([T.StructField("window", window), T.StructField("terms", T.ArrayType(T.StringType()))])
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getListState("windows", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {r[0]: set(r[1]) for r in self.windows.get()}
        held = {window: set(terms) for window, terms in before.items()}
        for row in rows:
            held.setdefault(row["window"], set()).update(row["terms"])
            if len(held) > self.n:
                del held[min(held, key=lambda w: (w is not None, w))]
        if held == before:
            return
        order = sorted(held, key=lambda w: (w is not None, w))
        self.windows.put([(w, sorted(held[w])) for w in order])
        seen: set[str] = set()
        again = 0
        for window in order:
            again += bool(held[window] & seen)
            seen |= held[window]
        yield Row(entity=key[0], windows_seen=len(order), attack_windows=sum(bool(held[w]) for w in order), pattern_windows=again)

    def close(self) -> None:
        pass


def remembered_windows(hits: DataFrame, n: int) -> DataFrame:
    """Windows seen, with a hit and with a repeated term, of every entity that changed, in update mode.

    Takes a stream of (entity, window, terms); rows of the same window are one, wherever they arrive.  A window older
    than the ``n`` newest is forgotten.
    """
    use_rocksdb(hits.sparkSession)
    entity = hits.schema["entity"].dataType.simpleString()
    counts = f"entity {entity}, windows_seen long, attack_windows long, pattern_windows long"
    rows = hits.select("entity", "window", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return rows.groupBy("entity").transformWithState(RememberedWindows(hits.schema["window"].dataType, n), counts, "Update", "None")


class AsOf(StatefulProcessor):
    """Left rows of a key wait until the watermark has passed them; then all right rows before them are there.

    Right rows are kept while a left row to come can still need them: those within a tolerance of the watermark.
    """

    def __init__(self, names: Sequence[str], left: T.StructType, value: T.DataType, width: int):
        self.names, self.left, self.width = tuple(names), left, width
        self.right = T.StructType([T.StructField("us", T.LongType()), T.StructField("tie", value), T.StructField("value", value)])
        self.waits = T.StructType([T.StructField("us", T.LongType()), *left.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rights = handle.getListState("rights", self.right)
        self.lefts = handle.getListState("lefts", self.waits)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lefts, rights = [], []
        for row in rows:
            if row["_side"] == 1:
                lefts.append((row["_us"], *(row[c] for c in self.left.names)))
            else:
                rights.append((row["_us"], row["_tie"], row["_rv"]))
        if lefts:
            self.lefts.appendList(lefts)
            for at in {x[0] for x in lefts}:
                self.handle.registerTimer(at // 1000 + 1)
        if rights:
            self.rights.appendList(rights)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        lefts = [tuple(x) for x in self.lefts.get()]
        due = sorted((x for x in lefts if x[0] < passed), key=lambda x: x[0])
        if not due:
            return
        rights = sorted((tuple(x) for x in self.rights.get()), key=lambda x: (x[0], x[1] is not None, x[1]))
        at = -1
        for us, *row in due:
            while at + 1 < len(rights) and rights[at + 1][0] <= us:
                at += 1
            fresh = at >= 0 and us - rights[at][0] <= self.width
            yield Row(**dict(zip(self.names, (*row, rights[at][2] if fresh else None))))
        for state, kept in ((self.lefts, [x for x in lefts if x[0] >= passed]), (self.rights, [x for x in rights if x[0] >= passed - self.width])):
            if kept:
                state.put(kept)
            else:
                state.clear()

    def close(self) -> None:
        pass


def asof_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, tolerance_seconds: int, delay: str, out: str,
    tie: str | None = None,
) -> DataFrame:
    """``joins.asof_join`` of two streams, in append mode: rows may arrive out of order by up to ``delay``.

    ``ts`` is a timestamp of both.  A left row is answered once the watermark has passed it.
    """
    use_rocksdb(left.sparkSession)
    us = F.unix_micros(ts)
    lefts = left.select(*left.columns, us.alias("_us"), F.lit(1).alias("_side"))
    rights = right.select(*keys, ts, us.alias("_us"), F.lit(0).alias("_side"), F.col(tie or value).alias("_tie"), F.col(value).alias("_rv"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withWatermark(ts, delay)
    schema = T.StructType([*left.schema.fields, T.StructField(out, right.schema[value].dataType)])
    processor = AsOf(schema.names, left.schema, right.schema[value].dataType, tolerance_seconds * 1_000_000)
    return both.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each key last emitted, of stored updates that carry their ``batch_id``."""
    last = updates.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*keys, "batch_id")]
    joined = updates.alias("u").join(last.alias("l"), same, "left_semi")
    return joined.drop("batch_id")
