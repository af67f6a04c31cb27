"""Declarative conditions on records, array elements and entity groups.

``custom:<path>~condition:<cond>[,<cond>..]~toplevelarray:<arr>~returnarray:<fields|_all>``
names the tested path, the conditions and what to return.  Row conditions
become one filter; ``sum``/``avg``/``count``/``timediff`` conditions become one
aggregation with a having clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.jsonpath import json_get
from rillmark.functions.text import contains_all, contains_any
from rillmark.operators.stats import UNIT_MICROS, age, micros

Resolve = Callable[[str], Column]

_OPS = {
    "equal": lambda c, v: c == v,
    "greaterthan": lambda c, v: c > v,
    "lessthan": lambda c, v: c < v,
}
_ROW = {"equal", "greaterthan", "lessthan", "equalor", "equaland", "containsor", "containsand"}
_FIELD = {
    "fieldcontainsor", "fieldcontainsand", "fieldcontainsnot", "fieldequalor", "fieldequaland",
    "fieldlessthanor", "fieldlessthanand", "fieldgreaterthanor", "fieldgreaterthanand",
}
_GROUP = {"sum", "avg", "count", "sumif", "avgif"}
_TIMED = re.compile(r"^(timediff|dataage)(?:_(-?\d+)_(millisecond|second|minute|hour|day))?$")


@dataclass(frozen=True)
class Term:
    """One condition: its name, the operator of a group test, and its values."""

    name: str
    op: str | None
    values: list[str]


@dataclass(frozen=True)
class ConditionSpec:
    """Parsed condition string."""

    path: str
    terms: list[Term]
    array: str = ""
    returned: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    array_fields: list[str] = field(default_factory=list)


def _is_name(token: str) -> bool:
    return token in _ROW or token in _FIELD or token in _GROUP or bool(_TIMED.match(token))


def parse_terms(text: str) -> list[Term]:
    """Split ``sum,greaterthan,0,fieldequalor,f,a`` into its terms."""
    tokens: list[str] = []
    for token in text.split(","):
        head, _, tail = token.strip().partition(" ")
        tokens += [head, tail] if _is_name(head) and tail else [token.strip()]
    terms: list[Term] = []
    i = 0
    while i < len(tokens):
        name = tokens[i]
        if not _is_name(name):
            raise ValueError(f"unknown condition {name!r} in {text!r}")
        grouped = name in _GROUP or bool(_TIMED.match(name))
        op = tokens[i + 1] if grouped else None
        i += 2 if grouped else 1
        values = [tokens[i]] if grouped else []
        i += 1 if grouped else 0
        while not grouped and i < len(tokens) and not _is_name(tokens[i]):
            values.append(tokens[i])
            i += 1
        if (grouped and op not in _OPS) or not values:
            raise ValueError(f"incomplete condition {name!r} in {text!r}")
        terms.append(Term(name, op, values))
    return terms


def parse_condition(spec: str) -> ConditionSpec:
    """Read a full condition string."""
    parts = {}
    for piece in spec.split("~"):
        key, _, value = piece.strip().partition(":")
        parts[key.strip()] = value.strip()
    listed = {
        k: [v.strip() for v in parts.get(k, "").split(",") if v.strip()]
        for k in ("returnarray", "customattrs", "customarray")
    }
    return ConditionSpec(
        parts.get("custom", ""), parse_terms(parts["condition"]), parts.get("toplevelarray", ""),
        listed["returnarray"], listed["customattrs"], listed["customarray"],
    )


def json_fields(payload: Column) -> Resolve:
    """Resolver that reads dotted paths from a JSON payload."""
    return lambda path: json_get(payload, path)


def _array_text(col: Column) -> Column:
    """Array of texts of a JSON array; any other value as a single element."""
    return F.when(
        F.startswith(F.ltrim(col), F.lit("[")), F.from_json(col, T.ArrayType(T.StringType()))
    ).otherwise(F.array(col))


def _compare(col: Column, op: str, values: list[str], how: str) -> Column:
    number = col.try_cast("double")
    tests = [_OPS[op](number, float(v)) for v in values]
    out = tests[0]
    for test in tests[1:]:
        out = (out | test) if how == "or" else (out & test)
    return out


def row_predicate(term: Term, path: str, resolve: Resolve) -> Column:
    """Filter expression of a row or field condition; unknown becomes false."""
    name, values = term.name, term.values
    if name in _FIELD:
        path, values, name = values[0], values[1:], name.removeprefix("field")
    col = resolve(path)
    if name in ("greaterthan", "lessthan"):
        test = _compare(col, name, values, "or")
    elif name.startswith(("greaterthan", "lessthan")):
        op, how = re.match(r"(greaterthan|lessthan)(or|and)", name).groups()
        test = _compare(col, op, values, how)
    elif name == "equal":
        test = col == values[0]
    elif name == "equalor":
        test = col.isin(values)
    elif name == "equaland":
        test = F.forall(F.array(*[F.lit(v) for v in values]), lambda v: F.array_contains(_array_text(col), v))
    elif name == "containsor":
        test = contains_any(col, values)
    elif name == "containsand":
        test = contains_all(col, values)
    elif name == "containsnot":
        test = ~contains_any(col, values)
    else:
        raise ValueError(f"not a row condition: {term.name}")
    return F.coalesce(test, F.lit(False))


def apply_conditions(
    df: DataFrame,
    spec: ConditionSpec,
    resolve: Resolve,
    keys: Sequence[str] = (),
    ts: Column | None = None,
    now: str | None = None,
) -> DataFrame:
    """Rows passing the row conditions, or the groups passing the group conditions.

    A field condition behind ``sumif``/``avgif`` limits what that aggregate
    counts; any other field condition filters the rows themselves.
    """
    having: list[Column] = []
    labels: list[str] = []
    aggregates: list[Column] = []
    row_tests: list[Column] = []
    terms = list(spec.terms)
    while terms:
        term = terms.pop(0)
        timed = _TIMED.match(term.name)
        if timed and timed.group(1) == "dataage":
            if ts is None or now is None:
                raise ValueError("dataage needs a time column and a moment")
            row_tests.append(_OPS[term.op](
                age(ts, now, int(timed.group(2) or 0), timed.group(3) or "second"), float(term.values[0])))
            continue
        if not timed and term.name not in _GROUP:
            row_tests.append(row_predicate(term, spec.path, resolve))
            continue
        number = resolve(spec.path).try_cast("double")
        if timed:
            us = micros(ts)
            unit = UNIT_MICROS[timed.group(3) or "second"]
            value = F.try_divide(F.max(us) - F.min(us), F.count(us) - 1) / unit
        elif term.name in ("sumif", "avgif"):
            only = F.lit(True)
            while terms and terms[0].name in _FIELD:
                only = only & row_predicate(terms.pop(0), spec.path, resolve)
            value = (F.sum if term.name == "sumif" else F.avg)(F.when(only, number))
        else:
            value = {"sum": F.sum(number), "avg": F.avg(number), "count": F.count("*")}[term.name]
        label = f"{'timediff' if timed else term.name}_value"
        if label in labels:  # a further test of the same kind
            label = f"{label}_{len(labels) + 1}"
        labels.append(label)
        aggregates.append(value.alias(label))
        having.append(_OPS[term.op](F.col(label), float(term.values[0])))
    for test in row_tests:
        df = df.filter(test)
    if not having:
        return df
    groups = df.groupBy(*keys).agg(*aggregates)
    for test in having:
        groups = groups.filter(test)
    return groups


def match_array_elements(df: DataFrame, payload: str, spec: ConditionSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Elements of the named array that pass, with the requested fields.

    ``Inspection.0.checklist.0.response`` with array ``Inspection`` tests
    ``checklist.0.response`` of every element of ``Inspection``.
    """
    doc = F.col(payload)
    elements = F.from_json(json_get(doc, spec.array), T.ArrayType(T.StringType()))
    inner = spec.path.removeprefix(spec.array + ".")
    inner = re.sub(r"^\d+\.", "", inner)
    returned = [] if spec.returned == ["_all"] else spec.returned
    rows = df.select(
        *keep,
        *[json_get(doc, p).alias(p) for p in returned],
        *([doc.alias("record")] if spec.returned == ["_all"] else []),
        F.posexplode(elements).alias("element_no", "_element"),
    )
    resolve = json_fields(F.col("_element"))
    for term in spec.terms:
        rows = rows.filter(row_predicate(term, inner, resolve))
    return rows.select(
        *[c for c in rows.columns if c != "_element"],
        *[json_get(F.col("_element"), p).alias(p) for p in [*spec.attributes, *spec.array_fields]],
    )


def check_bounds(
    df: DataFrame, bounds: dict[str, tuple[float, float]]
) -> DataFrame:
    """Add ``out_of_bounds``: the names of the fields outside their range."""
    bad = [
        F.when(~F.col(name).between(float(lo), float(hi)), F.lit(name)) for name, (lo, hi) in sorted(bounds.items())
    ]
    return df.withColumn("out_of_bounds", F.array_compact(F.array(*bad)))


def matches_any(col: Column, wanted: str) -> Column:
    """Case-insensitive "contains any" of a comma list; an empty list passes."""
    terms = [w.lower() for w in wanted.split(",") if w != ""]
    return contains_any(F.lower(col), terms) if terms else F.lit(True)


def select_entities(df: DataFrame, topicid: int | str, column: str = "entity") -> DataFrame:
    """-999 (whole topic) and -1 (every entity) keep all rows, else one entity."""
    if str(topicid) in ("-999", "-1"):
        return df
    return df.filter(F.col(column).cast("string") == str(topicid))
