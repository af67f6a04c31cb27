"""Dotted paths into JSON text, parsed once per record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def json_path(dotted: str) -> str:
    """``component.0.code`` -> ``$.component[0].code``."""
    out = "$"
    for part in dotted.split("."):
        if part.isdigit():
            out += f"[{part}]"
        elif _PLAIN.match(part):
            out += f".{part}"
        else:
            out += f"['{part}']"
    return out


def json_get(col: Column, dotted: str) -> Column:
    """Text at a dotted path, null when absent or when the text is not JSON."""
    return F.get_json_object(col, json_path(dotted))


def _leaf_schema(paths: list[list[str]]) -> T.DataType:
    if any(not p for p in paths):
        return T.StringType()
    heads: dict[str, list[list[str]]] = {}
    for path in paths:
        heads.setdefault(path[0], []).append(path[1:])
    if all(h.isdigit() for h in heads):
        return T.ArrayType(_leaf_schema([rest for group in heads.values() for rest in group]))
    return T.StructType([T.StructField(h, _leaf_schema(g)) for h, g in heads.items()])


def _nested(paths: list[str]) -> bool:
    """True when one path is a prefix of another (a leaf that is also a parent)."""
    parts = sorted({tuple(p.split(".")) for p in paths})
    return any(b[: len(a)] == a for a, b in zip(parts, parts[1:]))


def with_json_paths(df: DataFrame, payload: str, columns: dict[str, str]) -> DataFrame:
    """Add one text column per dotted path, parsing the payload a single time.

    The paths are turned into one read schema; the parsed struct is projected
    before its fields are, so the optimizer keeps one parse for all of them.
    Paths a schema cannot hold (a value that is also a parent, names that
    differ in case only, a top-level array) are read from a variant instead.
    """
    paths = list(columns.values())
    same_name = len({p.lower() for p in paths}) < len(set(paths))
    schema = None if _nested(paths) or same_name else _leaf_schema([p.split(".") for p in paths])
    if not isinstance(schema, T.StructType):
        parsed = df.withColumn("_json", F.try_parse_json(payload))
        found = {n: F.try_variant_get("_json", json_path(p), "string") for n, p in columns.items()}
        return parsed.withColumns(found).drop("_json")
    parsed = df.withColumn("_json", F.from_json(F.col(payload), schema))

    def leaf(dotted: str) -> Column:
        col = F.col("_json")
        for part in dotted.split("."):
            col = F.get(col, F.lit(int(part))) if part.isdigit() else col[part]
        return col

    return parsed.withColumns({n: leaf(p) for n, p in columns.items()}).drop("_json")


_END = "|end|"
_SEP = "\u0001"


def _closed(col: Column) -> Column:
    """The text as first element of a two-element array, so that trailing text breaks the array."""
    return F.try_parse_json(F.concat(F.lit("["), col, F.lit(f',"{_END}"]')))


def is_json(col: Column) -> Column:
    """True for a text that is one JSON value and nothing else."""
    doc = _closed(col)
    rest = [F.try_variant_get(doc, f"$[{i}]", "string") for i in (1, 2)]
    return F.concat_ws(_SEP, *rest) == _END


def is_json_object(col: Column) -> Column:
    """True for text that is a JSON object (not an array, scalar or noise)."""
    doc = _closed(col)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$[0]", "variant"))
    rest = [F.try_variant_get(doc, f"$[{i}]", "string") for i in (1, 2)]
    return F.rlike(F.concat_ws(_SEP, kind, *rest), F.lit(f"^OBJECT[^{_SEP}]*{_SEP}\\|end\\|$"))


def json_elements(col: Column) -> Column:
    """Elements of a JSON array as JSON texts; a single object counts as one."""
    trimmed = F.ltrim(col)
    return F.when(
        F.startswith(trimmed, F.lit("[")), F.from_json(col, T.ArrayType(T.StringType()))
    ).otherwise(F.array(col))
