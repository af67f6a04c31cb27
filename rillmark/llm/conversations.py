"""Repair of conversation structure: the cheapest edits that make roles alternate, by search from both ends.

Roles are legal if their initials read ``(s?(ua)+)?``.  A conversation and this pattern span a lattice: a node is a row
and a state of the pattern, an arc an edit.

States: 0 nothing yet, 1 behind the system row, 2 behind a user row, 3 behind an assistant row.  0 and 3 may end.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, prepare

# Rows of a conversation that are searched at once; longer ones are cut, and their parts put together exactly.
SEGMENT = 256

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# The role that must follow a state, and the state behind it.
_NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_ENDS = (0, 3)

_SPACE = r"[\x20\x09-\x0D]"
OK, BLANK, DUPLICATE, CUT, GONE = range(5)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults: ``conv_id``, ``turn``, ``role``, ``text``, ``gone``.

    Null roles and texts become one space, and so do null ids and turns in the key.  ``crc32(conv_id:turn) % 20``
    decides: 0 drops the row (it stays here, marked ``gone``), 1 empties its text, 2 removes its ``.``, ``!`` and ``?``,
    3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("h"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("h") == 0).alias("gone"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_"))
    return rows.drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault but for repetition within a turn: ``fault`` is one of OK, BLANK, DUPLICATE, CUT, GONE.

    A text is found again by two 64-bit hashes.  Where in a conversation a role and text come first is an aggregate per
    (conversation, role, text), combined before the shuffle; a row of a later turn is a duplicate.
    """
    rows = rows.withColumn("k1", F.xxhash64("role", "text")).withColumn("k2", F.xxhash64("text", "role", F.lit(1)))
    order = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = rows.filter("NOT gone").groupBy("conv_id", "k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("conv_id").alias("fc"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    trimmed = F.regexp_replace("text", _SPACE + "+$", "")
    fault = (F.when(F.col("gone"), GONE).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("first") < order, DUPLICATE)
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK))
    return met.select("conv_id", "turn", "role", "text", "k1", "k2", fault.cast("int").alias("fault"))


def _arcs(state: int, row: tuple[str, int] | None, inserting: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a state in front of a row: initial, cost, rows taken, state behind it."""
    behind = _NEXT[state][1]
    if inserting:
        yield "I", INSERT, 0, behind
    if row is None:
        return
    initial, fault = row
    yield "D", DELETE, 1, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    yield "R", REROLE + extra, 1, behind
    if initial == "s" and state == 0:
        yield "K", extra, 1, 1
    elif initial == _NEXT[state][0][0]:
        yield "K", extra, 1, behind


def cheapest(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits from a state in front of the rows to one of some states behind them.

    ``rows`` are (initial of the role, fault); ``tail`` allows rows to be inserted behind the last one.  Two heaps grow
    from both sides.  A node is settled with its least cost and, among equal ones, its least initials: an edit that
    costs nothing takes a row, so the heap orders equal costs by rows taken and every way to a node is known before.
    Wherever the sides meet, the ways are added; the search ends when no pair of open nodes can reach the least sum,
    and of all crossings of that sum the least initials are taken.  Equally cheap edits of the same rows are never one
    the beginning of the other, so the least whole is made of least parts.
    """
    n = len(rows)
    back: dict[tuple[int, int], list[tuple[str, int, tuple[int, int]]]] = {}
    for i in range(n + 1):
        for q in range(4):
            for letter, cost, taken, behind in _arcs(q, rows[i] if i < n else None, i < n or tail):
                back.setdefault((i + taken, behind), []).append((letter, cost, (i, q)))

    def onward(node):
        i, q = node
        for letter, cost, taken, behind in _arcs(q, rows[i] if i < n else None, i < n or tail):
            yield letter, cost, (i + taken, behind)

    open_ = [{(0, start): (0, "")}, {(n, q): (0, "") for q in ends}]
    done: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    heaps = [[(0, 0, (0, start))], [(0, 0, (n, q)) for q in ends]]
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in done[side] or open_[side][node][0] < cost:
            continue
        own = done[side][node] = open_[side][node]
        for letter, more, other in onward(node) if side == 0 else back.get(node, ()):
            way = (cost + more, own[1] + letter if side == 0 else letter + own[1])
            if other in done[1 - side]:
                rest = done[1 - side][other]
                whole = (way[0] + rest[0], way[1] + rest[1] if side == 0 else rest[1] + way[1])
                best = whole if best is None else min(best, whole)
            known = open_[side].get(other)
            if other not in done[side] and (known is None or way < known):
                open_[side][other] = way
                if known is None or way[0] < known[0]:
                    heapq.heappush(heaps[side], (way[0], other[0] if side == 0 else n - other[0], other))
        if node in done[1 - side]:
            rest = done[1 - side][node]
            whole = (own[0] + rest[0], own[1] + rest[1] if side == 0 else rest[1] + own[1])
            best = whole if best is None else min(best, whole)
    return best


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """``role:text`` of all rows after the edits that ``audit`` names, from a state on."""
    out, left = [], iter(rows)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K" and state == 0 and role[:1] == "s":
            state = 1
        else:
            needed, state = _NEXT[state]
            role = role if letter == "K" else needed
        out.append(f"{role}:{text}")
    return out


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


_COUNTS = {name: pa.int64() for name in ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal")}
_WORDS = pa.list_(pa.string())
_PART = pa.schema({
    "conv_id": pa.int64(), "part": pa.int64(), "whole": pa.bool_(), **_COUNTS, "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
    "opening": pa.string(), "closing": pa.string(), "initials": _WORDS, "faults": pa.list_(pa.int32()), "roles": _WORDS, "texts": _WORDS,
    "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32())})
_PART_DDL = ("conv_id long, part long, whole boolean, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, "
             "cost long, audit string, repaired_sha256 string, opening string, closing string, initials array<string>, faults array<int>, "
             "roles array<string>, texts array<string>, costs array<long>, ranks array<int>")


class _Part:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, before: tuple | None = None):
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.counts = dict.fromkeys(_COUNTS, 0) | {"low": None, "high": None}
        self.last = before

    def add(self, row: dict) -> None:
        key, c = (row["turn"], row["k1"], row["k2"]), self.counts
        fault = DUPLICATE if row["fault"] != BLANK and key == self.last else row["fault"]
        if key[0] is not None and key[0] != c["high"]:
            c["turns"] += 1
            c["low"] = key[0] if c["low"] is None else c["low"]
            c["high"] = key[0]
        if fault != OK:
            c[("blank", "duplicate", "truncated")[fault - BLANK]] += 1
        if self.roles:
            c["illegal"] += not _follows(self.roles[-1], row["role"])
        self.last = key
        self.roles.append(row["role"])
        self.texts.append(row["text"])
        self.faults.append(fault)

    def result(self, conv: int | None, number: int, whole: bool) -> dict:
        """A whole conversation's repair; else its rows, and the cost from every state to every state."""
        rows = [(role[:1], fault) for role, fault in zip(self.roles, self.faults)]
        out = {"conv_id": conv, "part": number, "whole": whole, **self.counts}
        if whole:
            cost, audit = cheapest(rows, 0, _ENDS, True)
            lines = repaired(list(zip(self.roles, self.texts)), audit, 0)
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        if rows:
            out |= {"opening": rows[0][0], "closing": rows[-1][0]}
        costs, ranks = [], []
        for start in range(4):
            ways = [cheapest(rows, start, (end,), False) for end in range(4)]
            order = sorted(w[1] for w in ways if w)
            costs += [w and w[0] for w in ways]
            ranks += [w and order.index(w[1]) for w in ways]
        return out | {"initials": [r[0] for r in rows], "faults": self.faults, "roles": self.roles, "texts": self.texts, "costs": costs, "ranks": ranks}


def _follows(one: str, two: str) -> bool:
    return one[:1] + two[:1] in ("su", "ua", "au")


def _parts(segment: int):
    """Conversations that lie within a task, repaired; all others in parts of at most ``segment`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        part, conv, begun, inner, out = _Part(), None, False, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    out.append(part.result(conv, number, inner))
                    part, inner = _Part(), True
                    number += 1
                conv, begun = row["conv_id"], True
                if row["fault"] == GONE:
                    continue
                if len(part.roles) == segment:
                    out.append(part.result(conv, number, False))
                    part, inner = _Part(part.last), False
                    number += 1
                part.add(row)
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, _PART)
                out = []
        if begun:
            out.append(part.result(conv, number, False))
        yield pa.RecordBatch.from_pylist(out, _PART)

    return run


_JOINED = pa.schema({"conv_id": pa.int64(), **_COUNTS, "cost": pa.int64(), "ways": pa.list_(pa.struct({
    "part": pa.int64(), "start": pa.int32(), "end": pa.int32(), "tail": pa.string()}))})
_JOINED_DDL = ("conv_id long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "ways array<struct<part: bigint, start: int, end: int, tail: string>>")


def _joined(table: pa.Table) -> pa.Table:
    """Counts of a conversation in parts, and the states between its parts on the cheapest way.

    From the last part back, the least cost to the end from each of the four states is all that is carried.  Of equal
    costs the part's least initials decide: no part ends with an insertion, so none of its ways begins another.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    counts = {name: sum(r[name] for r in rows) for name in _COUNTS if name not in ("low", "high")}
    lows, highs = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
    counts["turns"] -= sum(a == b for a, b in zip(highs, lows[1:]))
    filled = [r for r in rows if r["opening"] is not None]
    counts["illegal"] += sum(not _follows(a["closing"], b["opening"]) for a, b in zip(filled, filled[1:]))
    behind = [cheapest([], q, _ENDS, True) for q in range(4)]
    tails = [way[1] for way in behind]
    left: list[float] = [way[0] for way in behind]
    choice = []
    for r in reversed(filled):
        best = [min((r["costs"][4 * q + e] + left[e], r["ranks"][4 * q + e], e) for e in range(4) if r["costs"][4 * q + e] is not None) for q in range(4)]
        left = [b[0] for b in best]
        choice.append([b[2] for b in best])
    state, ways = 0, []
    for r, ends in zip(filled, reversed(choice)):
        ways.append({"part": r["part"], "start": state, "end": ends[state], "tail": ""})
        state = ends[state]
    if ways:
        ways[-1]["tail"] = tails[state]
    one = {"conv_id": rows[0]["conv_id"], **counts, "low": min(lows, default=None), "high": max(highs, default=None), "cost": left[0], "ways": ways}
    return pa.Table.from_pylist([one], _JOINED)


_PIECE = pa.schema({"conv_id": pa.int64(), "part": pa.int64(), "audit": pa.string(), "body": pa.string()})
_DONE = pa.schema({"conv_id": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()})


def _pieces(batches):
    """Initials and repaired text of every part."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            _, audit = cheapest(list(zip(r["initials"], r["faults"])), r["start"], (r["end"],), False)
            audit += r["tail"]
            lines = repaired(list(zip(r["roles"], r["texts"])), audit, r["start"])
            out.append({"conv_id": r["conv_id"], "part": r["part"], "audit": audit, "body": "\n".join(lines)})
        yield pa.RecordBatch.from_pylist(out, _PIECE)


def _digests(batches):
    """Audit and hash of every conversation, its parts read one after the other."""
    conv, begun, audit, sha, empty = None, False, [], hashlib.sha256(), True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if begun and r["conv_id"] != conv:
                out.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                audit, sha, empty = [], hashlib.sha256(), True
            conv, begun = r["conv_id"], True
            audit.append(r["audit"])
            if r["body"]:
                sha.update(("" if empty else "\n").encode() + r["body"].encode())
                empty = False
        yield pa.RecordBatch.from_pylist(out, _DONE)
    if begun:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], _DONE)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Cheapest repair of every conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit``, ``repaired_sha256``.

    Takes ``conv_id``, ``turn`` (integers), ``role``, ``text`` (no nulls) and ``gone``; other columns are ignored.  Rows
    marked ``gone`` only name their conversation.  Rows are taken by turn, nulls first, then role and text; a null
    ``conv_id`` is a conversation.  Faults: a blank text, role and text seen earlier, a last character that ends no
    sentence; a row's first one counts.  Edits: Keep costs 0, Rerole 3, Delete 4 and needed for blank and repeated rows,
    Insert a row without text 3, and 3 more for a truncated row that stays.  ``audit`` holds their initials, the least
    in ASCII among the cheapest.  ``gaps`` are turns missing between the first and the last.  An empty table gives an
    empty result.

    Rows are range-sorted by conversation and turn, so a long conversation lies in several tasks.  One within a task is
    repaired there; of others each part of ``segment`` rows gives its least costs from state to state, which are put
    together per conversation as four numbers per part.  Only audit and hash, single values of a conversation by
    definition, are read in order, a part at a time.
    """
    prepare(rows.sparkSession)
    rows = faults(rows.withColumn("conv_id", F.col("conv_id").cast("long")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(rows.mapInArrow(_parts(segment), _PART_DDL), "parts")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = parts.filter("whole").select(*columns)
    cut = parts.filter("NOT whole")
    joined = materialize(cut.drop("initials", "faults", "roles", "texts").groupBy("conv_id").applyInArrow(_joined, _JOINED_DDL), "joined")
    ways = joined.select(F.inline("ways"))
    pieces = cut.select("conv_id", "part", "initials", "faults", "roles", "texts").join(ways, "part").mapInArrow(
        _pieces, "conv_id long, part long, audit string, body string")
    done = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    done = done.withColumnRenamed("conv_id", "id")
    empty = F.lit(hashlib.sha256().hexdigest())
    rest = joined.join(done, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    rest = rest.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
    return whole.unionByName(rest.select(*columns))
