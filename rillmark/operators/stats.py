"""Named window statistics of an entity's subtopic.

A type name such as ``avg``, ``outliers2-5`` or ``anomprob3`` maps to one
Column expression.  All requested types of all entities are computed by one
aggregation over the rollback window.  Where only the name of a statistic is
publicly documented, the formula is this package's own definition (README).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.geo import haversine_km
from rillmark.operators.windows import last_n

KEYS = ("entity", "subtopic")
ORDER = ("ts", "msgid")

# Helper columns of prepared rows: rn (1 = newest), x (value), z, step (x - previous x).


def _newest(col: str) -> Column:
    return F.min_by(col, "rn")


def _oldest(col: str) -> Column:
    return F.max_by(col, "rn")


def _share(hit: Column) -> Column:
    return 100.0 * F.count_if(hit) / F.count(F.col("x"))


def _quartile(p: float) -> Column:
    return F.percentile(F.col("x"), F.lit(p))


def _positive(expr: Column) -> Column:
    return F.when(F.min(F.col("x")) > 0, expr)


def _cv() -> Column:
    return F.try_divide(F.stddev_pop(F.col("x")), F.nullif(F.avg(F.col("x")), F.lit(0.0)))


def _mean_gap_seconds() -> Column:
    # The mean of consecutive gaps telescopes to (last - first) / (n - 1).
    span = F.max("_us") - F.min("_us")
    return F.try_divide(span, F.count("_us") - 1) / 1e6


FIXED = {
    "min": lambda: F.min(F.col("x")),
    "max": lambda: F.max(F.col("x")),
    "sum": lambda: F.sum(F.col("x")),
    "avg": lambda: F.avg(F.col("x")),
    "count": lambda: F.count(F.col("x")).cast("double"),
    "diff": lambda: _newest("x") - _oldest("x"),
    "diffmargin": lambda: 100.0
    * F.try_divide(_newest("x") - _oldest("x"), F.nullif(F.abs(_oldest("x")), F.lit(0.0))),
    "variance": lambda: F.var_pop(F.col("x")),
    "varied": lambda: F.when(F.min(F.col("x")) != F.max(F.col("x")), 1.0).otherwise(0.0),
    "outliers": lambda: F.count_if(F.abs("z") > 3).cast("double"),
    "anomprob": lambda: 100.0 * (1 - F.exp(-F.pow(_newest("z"), 2) / 2)),
    "gm": lambda: _positive(F.exp(F.avg(F.when(F.col("x") > 0, F.ln(F.col("x")))))),
    "hm": lambda: _positive(F.try_divide(F.count(F.col("x")), F.sum(F.when(F.col("x") > 0, F.try_divide(F.lit(1.0), F.col("x")))))),
    "trend": lambda: -F.regr_slope(F.col("x"), F.col("rn").cast("double")),
    "iqr": lambda: _quartile(0.75) - _quartile(0.25),
    "trimean": lambda: (_quartile(0.25) + 2 * _quartile(0.5) + _quartile(0.75)) / 4,
    "spikedetect": lambda: F.count_if(F.abs("step") > 3 * F.col("step_sd")).cast("double"),
    "cv": _cv,
    "skewness": lambda: F.skewness(F.col("x")),
    "kurtosis": lambda: F.kurtosis(F.col("x")),
    "consistency": lambda: 100.0 * F.greatest(F.lit(0.0), 1 - F.abs(_cv())),
    "raw": lambda: _newest("x"),
    "avgtimediff": _mean_gap_seconds,
    "timediff": _mean_gap_seconds,
    "uniquestrcount": lambda: F.size(F.collect_set("value_str")).cast("double"),
    "geodiff": lambda: haversine_km(_oldest("lat"), _oldest("lon"), _newest("lat"), _newest("lon")),
}

_BAND = re.compile(r"^(outliers|anomprob)(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?$")
_CLEAN = re.compile(r"^dataclean(iqr|mad|std)(\d+(?:\.\d+)?)?_(\d+)$")
_AGE = re.compile(r"^dataage_(-?\d+)_(millisecond|second|minute|hour|day)$")

# How a type name is written inside a derived stream name.
TYPE_TITLES = {
    "anomprob": "AnomProb", "iqr": "IQR", "uniquestrcount": "Uniquestrcount", "avgtimediff": "Avgtimediff",
}
UNIT_MICROS = {
    "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def age(ts: Column, now: str, utc_offset: int, unit: str) -> Column:
    """Age of a time stamp against ``now`` after the UTC offset, in ``unit``."""
    moment = micros(F.lit(now).cast("timestamp_ntz"))
    return (moment - (micros(ts) + utc_offset * UNIT_MICROS["hour"])) / UNIT_MICROS[unit]


def statistic(name: str, now: str | None = None) -> Column:
    """Aggregate expression of a type name over prepared window rows."""
    low = name.strip().lower()
    if low in FIXED:
        return FIXED[low]()
    band = _BAND.match(low)
    if band:
        kind, lo, hi = band.group(1), float(band.group(2)), band.group(3)
        z = F.abs("z")
        inside = (z >= lo) & (z <= float(hi)) if hi else z >= lo
        return F.count_if(inside).cast("double") if kind == "outliers" else _share(inside)
    aged = _AGE.match(low)
    if aged:
        if now is None:
            raise ValueError(f"{name} needs the moment to compare with")
        return F.min(age(F.col("ts"), now, int(aged.group(1)), aged.group(2)))
    raise ValueError(f"unknown statistic: {name}")


def prepare(window: DataFrame, types: Sequence[str]) -> DataFrame:
    """Add the helper columns the requested types read.

    Runs on rollback rows, which are already partitioned and sorted by the
    keys, so these windows need no further shuffle.
    """
    low = [t.strip().lower() for t in types]
    rows = window.withColumn("x", F.col("value").cast("double"))
    group = Window.partitionBy(*KEYS)
    if any(t.startswith(("outliers", "anomprob")) for t in low):
        sd = F.stddev_pop("x").over(group)
        z = F.when(sd > 0, (F.col("x") - F.avg("x").over(group)) / sd).otherwise(0.0)
        rows = rows.withColumn("z", z)
    if "spikedetect" in low:
        older = F.lead("x").over(group.orderBy("rn"))
        rows = rows.withColumn("step", F.col("x") - older)
        rows = rows.withColumn("step_sd", F.stddev_pop("step").over(group))
    if "avgtimediff" in low or "timediff" in low:
        rows = rows.withColumn("_us", micros(F.col("ts")))
    return rows


def window_stats(
    measurements: DataFrame, types: Sequence[str], maxrows: int = 800, now: str | None = None
) -> DataFrame:
    """One row per (entity, subtopic) with a column per statistic type."""
    rows = prepare(last_n(measurements, KEYS, ORDER, maxrows), types)
    return rows.groupBy(*KEYS).agg(*[statistic(t, now).alias(t) for t in types])


def preprocess(
    measurements: DataFrame, types: Sequence[str], maxrows: int = 800, now: str | None = None
) -> DataFrame:
    """One preprocessed record per (entity, subtopic, type)."""
    wide = window_stats(measurements, types, maxrows, now)
    return wide.unpivot(list(KEYS), [F.col(f"`{t}`") for t in types], "preprocesstype", "hyperprediction")


def per_stream_stats(measurements: DataFrame, streams: dict[str, str], maxrows: int = 800) -> DataFrame:
    """One statistic type per named stream, one record per entity and stream."""
    types = sorted(set(streams.values()))
    wanted = measurements.filter(F.col("subtopic").isin(list(streams)))
    wide = window_stats(wanted, types, maxrows)
    choice = F.create_map(*[F.lit(v) for pair in streams.items() for v in pair])
    picked = F.coalesce(
        *[F.when(choice[F.col("subtopic")] == t, F.col(f"`{t}`")) for t in types]
    )
    return wide.select(
        *KEYS, choice[F.col("subtopic")].alias("preprocesstype"), picked.alias("hyperprediction")
    )


def pair_streams(streams: Sequence[str], types: Sequence[str]) -> dict[str, str]:
    """Positional pairing of streams and types; the counts must match."""
    if len(streams) != len(types):
        raise ValueError(f"{len(streams)} streams but {len(types)} types")
    return dict(zip(streams, types))


def clean(measurements: DataFrame, kind: str, maxrows: int = 800) -> DataFrame:
    """Rows of the rollback window without outliers, newest N of each group.

    ``kind`` is ``datacleaniqr_N``, ``datacleanstdK_N`` or ``datacleanmad_N``.
    """
    match = _CLEAN.match(kind.strip().lower())
    if not match:
        raise ValueError(f"unknown cleaning type: {kind}")
    method, width, keep = match.group(1), match.group(2), int(match.group(3))
    rows = last_n(measurements, KEYS, ORDER, maxrows).withColumn("x", F.col("value").cast("double"))
    group = Window.partitionBy(*KEYS)
    if method == "iqr":
        rows = rows.withColumn("_q", F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).over(group))
        low, high = F.col("_q")[0], F.col("_q")[1]
        good = F.col("x").between(low - 1.5 * (high - low), high + 1.5 * (high - low))
    elif method == "std":
        sd = F.stddev_pop("x").over(group)
        rows = rows.withColumn("_z", F.when(sd > 0, (F.col("x") - F.avg("x").over(group)) / sd).otherwise(0.0))
        good = F.abs("_z") <= float(width or 3)
    else:
        rows = rows.withColumn("_med", F.median("x").over(group))
        rows = rows.withColumn("_dev", F.abs(F.col("x") - F.col("_med")))
        rows = rows.withColumn("_mad", F.median("_dev").over(group))
        good = F.when(F.col("_mad") == 0, F.col("_dev") == 0).otherwise(
            F.col("_dev") <= 3 * 1.4826 * F.col("_mad")
        )
    kept = rows.filter(good).withColumn("_pos", F.row_number().over(group.orderBy("rn")))
    return kept.filter(F.col("_pos") <= keep).select(
        "entity", "subtopic", F.col("x").alias("hyperprediction"), "ts", "msgid"
    )


def window_metadata(measurements: DataFrame, maxrows: int = 800) -> DataFrame:
    """Start, end, unix times, message count and message ids of each window."""
    rows = last_n(measurements, KEYS, ORDER, maxrows)
    return rows.groupBy(*KEYS).agg(
        F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"),
        F.floor(micros(F.min("ts")) / 1_000_000).alias("window_start_unix"),
        F.floor(micros(F.max("ts")) / 1_000_000).alias("window_end_unix"),
        F.count("*").alias("numberofmessages"),
        F.sort_array(F.collect_list("msgid")).alias("msgiddata"),
    )


def raw_data(measurements: DataFrame, maxrows: int = 800) -> DataFrame:
    """Raw values of each window in time order."""
    rows = last_n(measurements, KEYS, ORDER, maxrows)
    listed = F.sort_array(F.collect_list(F.struct("ts", "msgid", "value")))
    return rows.groupBy(*KEYS).agg(F.transform(listed, lambda e: e["value"]).alias("rawdata"))


def stream_name(topicid: int, subtopic: Column, kind: str) -> Column:
    """Derived stream name ``topicid{n}_{subtopic}_preprocessed_{Type}``."""
    low = kind.strip().lower()
    title = TYPE_TITLES.get(low, low[:1].upper() + low[1:])
    return F.concat(F.lit(f"topicid{topicid}_"), subtopic, F.lit(f"_preprocessed_{title}"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per key."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.bround(F.avg(value), 2).alias("mean"),
        F.bround(F.stddev_samp(value), 2).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def average_verdict(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Rounded mean with a text verdict; reaching the threshold counts as outside."""
    mean = F.bround(F.avg(value), 0)
    text = F.when(
        mean >= threshold, F.lit("outside normal limits because it exceeds: ")
    ).otherwise(F.lit("within normal limits because it does not exceed: "))
    sentence = F.concat(
        F.lit("The average value is "), F.format_string("%.1f", mean), F.lit(", and it is "), text,
        F.lit(f"{float(threshold):.1f}"),
    )
    return df.groupBy(*keys).agg(mean.alias("average"), sentence.alias("verdict"))
