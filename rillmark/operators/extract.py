"""From nested JSON records to long-form measurements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import json_get, with_json_paths


@dataclass(frozen=True)
class Criteria:
    """Parsed ``uid=..,filter:..~subtopics=..~values=..`` specification."""

    uid: str
    record_filter: tuple[str, str] | None = None
    payload: str | None = None
    subtopics: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    datetime: str = ""
    msgid: list[str] = field(default_factory=list)
    latlong: list[str] = field(default_factory=list)


def _split(text: str, sep: str) -> list[str]:
    return [p.strip() for p in text.split(sep) if p.strip()]


def parse_criteria(spec: str) -> Criteria:
    """Read a criteria string; unknown keys are errors, empty values are allowed."""
    parts = {}
    for piece in spec.split("~"):
        key, _, value = piece.strip().partition("=")
        parts[key.strip()] = value.strip()
    unknown = set(parts) - {"uid", "subtopics", "values", "identifiers", "datetime", "msgid", "latlong"}
    if unknown or "uid" not in parts:
        raise ValueError(f"bad criteria: {spec!r}")
    head = re.split(r",\s*(?=filter:|payload=)", parts["uid"])
    record_filter, payload = None, None
    for option in head[1:]:
        if option.startswith("filter:") and option[7:].strip() != "allrecords":
            path, _, value = option[7:].partition("=")
            record_filter = (path.strip(), value.strip())
        elif option.startswith("payload="):
            payload = option[8:].strip()
    lists = {k: _split(parts.get(k, ""), ",") for k in ("subtopics", "values", "identifiers")}
    if len(lists["subtopics"]) != len(lists["values"]):
        raise ValueError("subtopics and values must have the same length")
    return Criteria(
        uid=head[0].strip(), record_filter=record_filter, payload=payload,
        datetime=parts.get("datetime", ""), msgid=_split(parts.get("msgid", ""), ":"),
        latlong=_split(parts.get("latlong", ""), ":"), **lists,
    )


def parse_attributes(spec: str) -> dict[str, str | None]:
    """``oem=path,lat=n/a,...`` as attribute -> path, ``n/a`` meaning none."""
    out: dict[str, str | None] = {}
    for piece in _split(spec, ","):
        name, _, path = piece.partition("=")
        out[name.strip()] = None if path.strip().lower() in ("", "n/a") else path.strip()
    return out


def unwrap_payload(df: DataFrame, payload: str, path: str) -> DataFrame:
    """Replace a record by the JSON document stored as text at ``path``.

    The path is followed through objects; a part whose value is itself JSON
    text is parsed on the way.
    """
    doc = F.col(payload)
    for part in path.split("."):
        doc = json_get(doc, part)
    return df.withColumn(payload, doc)


def extract(
    df: DataFrame,
    payload: str,
    criteria: Criteria,
    attributes: dict[str, str | None] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Long-form measurements: one row per (record, subtopic) with a value.

    Every path is read from one parse of the record; absent paths give null
    and a missing value gives no row.  A subtopic or identifier written with
    the same path as its value stands for the path itself.
    """
    if criteria.payload:
        df = unwrap_payload(df, payload, criteria.payload)
    paths = [criteria.uid, *criteria.subtopics, *criteria.values, *criteria.identifiers, *criteria.msgid,
             *criteria.latlong]
    paths += [criteria.datetime] if criteria.datetime else []
    paths += [criteria.record_filter[0]] if criteria.record_filter else []
    paths += [p for p in (attributes or {}).values() if p]
    names = {p: f"_p{i}" for i, p in enumerate(dict.fromkeys(paths))}
    rows = with_json_paths(df, payload, {n: p for p, n in names.items()})

    def at(path: str) -> Column:
        return F.col(names[path])

    items = []
    for i, (sub, val) in enumerate(zip(criteria.subtopics, criteria.values)):
        ident = criteria.identifiers[i] if i < len(criteria.identifiers) else None
        items.append(F.struct(
            (F.lit(sub) if sub == val else at(sub)).alias("subtopic"),
            at(val).alias("value_str"),
            (F.lit(None).cast("string") if ident is None else F.lit(ident) if ident == val else at(ident)).alias(
                "identifier"),
        ))
    present = F.filter(F.array(*items), lambda m: m["value_str"].isNotNull())
    if criteria.record_filter:
        # Part of the generator: a filter of its own would be pushed below the
        # parse and read every record twice.
        path, value = criteria.record_filter
        present = F.when(at(path) == value, present)
    empty = F.lit(None).cast("string")
    lat, long = [at(p) for p in criteria.latlong] if len(criteria.latlong) == 2 else (empty, empty)
    extra = [
        F.coalesce(at(p), F.lit("n/a")).alias(name) if p else F.lit("n/a").alias(name)
        for name, p in (attributes or {}).items()
    ]
    out = rows.select(
        *keep,
        at(criteria.uid).alias("entity"),
        (F.try_to_timestamp(at(criteria.datetime)) if criteria.datetime else F.lit(None).cast("timestamp")).alias(
            "event_time"),
        (F.concat_ws(":", *[at(p) for p in criteria.msgid]) if criteria.msgid else empty).alias("msgid"),
        lat.try_cast("double").alias("lat"),
        long.try_cast("double").alias("lon"),
        *extra,
        F.explode(present).alias("_m"),
    )
    return out.select(
        *keep, "entity", F.col("_m.subtopic").alias("subtopic"),
        F.col("_m.value_str").try_cast("double").alias("value_num"),
        F.col("_m.value_str").alias("value_str"), F.col("_m.identifier").alias("identifier"),
        "event_time", "msgid", "lat", "lon", *(attributes or {}),
    )


def walk(col: Column, path: list[str]) -> Column:
    """Value at a list of keys; a non-object on the way gives null."""
    for part in path:
        col = F.get_json_object(col, f"$['{part}']")
    return col


def rename_vessel(vessel_id: Column, names: dict[str, str]) -> Column:
    """Name of a vessel id, ``Vessel_{id}`` when unknown, blanks as ``_``."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair]) if names else None
    fallback = F.concat(F.lit("Vessel_"), vessel_id.cast("string"))
    name = F.coalesce(F.try_element_at(known, vessel_id.cast("string")), fallback) if names else fallback
    return F.replace(name, F.lit(" "), F.lit("_"))


def normalise_prediction(df: DataFrame) -> DataFrame:
    """Score, type, variable and uid of preprocessed and predicted records.

    ``islogistic`` 1 gives a rounded percentage, 0 a rounded value, absent the
    rounded value with the record's own type.  Rounding is half-even.
    """
    value = F.col("hyperprediction").cast("double")
    logistic = F.col("islogistic")
    return df.withColumns({
        "hp": F.when(logistic == "1", F.bround(value * 100, 0)).otherwise(F.bround(value, 0)).cast("long"),
        "pt": F.when(logistic == "1", F.lit("probability prediction"))
        .when(logistic.isNotNull(), F.lit("prediction")).otherwise(F.col("preprocesstype")),
        "pv": F.when(logistic.isNotNull(), F.lit("machine learning")).otherwise(
            F.element_at(F.split("identifier", "~"), 1)),
        "uid": F.split_part(F.element_at(F.split("identifier", "~"), -1), F.lit("="), F.lit(2)),
    })


# Where each kind of record keeps the common fields.
COMMON_FIELDS = {
    "risk": ("Createdon", "Unixtime", "Producedto", "Riskresults.Riskscore", "Kafkakey", "Offset", "Partition",
             "Producerid"),
    "prediction": ("Created", "Unixtime", "Produceto", "Hyperprediction", "kafkakey", "Offset", "Partition",
                   "Producerid"),
    "optimisation": ("UserDetails.CreatedOn", "UserDetails.Unixtime", "AdditionDetails.Produceto",
                     "OptimizedValues.ObjectiveFunctionValue", "AdditionDetails.kafkakey", "Offset", "Partition",
                     "AdditionDetails.Producerid"),
    "preprocessed": ("TimeStamp", "Unixtime", "Topic", "hyperprediction", "kafkakey", "Offset", "Partition",
                     "ProducerId"),
}
COMMON_NAMES = ("created", "unixtime", "topic", "prediction", "kafkakey", "offset", "partition", "producerid")
COMMON_MARKERS = (("risk", "Riskresults"), ("prediction", "Hyperprediction"), ("optimisation", "OptimizedValues"))


def common_shape(df: DataFrame, record: str) -> DataFrame:
    """One shape over risk, prediction, optimisation and preprocessed records.

    The kind is the first marker field present; a record without any spelling
    of the key, or with an empty one, is dropped.  Each record is parsed once.
    """
    keys = ("kafkakey", "AdditionDetails.kafkakey", "Kafkakey")
    paths = dict.fromkeys([*keys, *(m for _, m in COMMON_MARKERS), *(p for f in COMMON_FIELDS.values() for p in f)])
    held = {p: f"_c{i}" for i, p in enumerate(paths)}
    rows = with_json_paths(df, record, {c: p for p, c in held.items()})
    kind = F.lit("preprocessed")
    for name, marker in reversed(COMMON_MARKERS):
        kind = F.when(F.col(held[marker]).isNotNull(), F.lit(name)).otherwise(kind)
    keyed = F.length(F.coalesce(*[F.col(held[k]) for k in keys])) > 0
    # As in ``extract``: dropping rows by a generator keeps the single parse.
    rows = rows.select("*", F.explode(F.when(keyed, F.array(kind))).alias("kind"))
    columns = {}
    for i, out in enumerate(COMMON_NAMES):
        col = F.col(held[COMMON_FIELDS["preprocessed"][i]])
        for name in ("optimisation", "prediction", "risk"):
            col = F.when(F.col("kind") == name, F.col(held[COMMON_FIELDS[name][i]])).otherwise(col)
        columns[out] = col
    return rows.withColumns(columns).drop(*held.values())
