"""Secret scans with one combined deterministic automaton."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.automaton import Rule, Scanner
from rillmark.llm.storage import prepare
from rillmark.llm.words import text_buffer

# Base kinds; a run of hexadecimal digits of 24 or more is the same as a run that is long enough.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Kinds that the method adds: private key headers and tokens with fixed prefixes.
ADDED = (
    Rule("private", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36, True),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, True),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + ADDED

@functools.cache
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The automaton of a worker, which serves all its tasks."""
    return Scanner(rules)


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        scanner = _scanner(rules)
        for batch in batches:
            flat, offsets = text_buffer(batch.column("text"))
            spans = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                data = flat[a:b].tobytes()
                found = scanner.scan(data)
                if found and not data.isascii():  # places in code points
                    points = np.concatenate(([0], np.cumsum((flat[a:b] & 0xC0) != 0x80)))
                    found = [(int(points[s]), k, int(points[e])) for s, k, e in found]
                spans.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every whole text: ``doc_id`` and ``spans``, an array of (kind, start, end).

    Takes integer ``doc_id`` and ``text``; other columns are ignored.  All ``rules`` are scanned in one pass over the
    UTF-8 bytes by a minimised automaton; matches are leftmost and do not overlap within a kind, places are code
    points with the end exclusive, in order of start and rule.  Rows are independent: one pass over the table, no
    shuffle.  Null texts count as empty, repeated rows and null ids are rows like others.
    """
    prepare(docs.sparkSession)
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(_scan(rules), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str | None, spans: list) -> str | None:
    """A text with every span replaced by its kind in brackets; spans inside others go with them."""
    out, done = [], 0
    for span in spans or ():
        if span["start"] >= done:
            out += [text[done : span["start"]], f"[{span['kind']}]"]
        done = max(done, span["end"])
    return text if text is None else "".join(out) + text[done:]


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the checksum of the base spans and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"))
