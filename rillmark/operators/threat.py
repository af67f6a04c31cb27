"""Threat scoring of log lines.

line -> element (JSON record, rule hit, or first entity of interest) -> one
element per file and entity -> category drift against a stored baseline ->
pattern score -> raw score -> score normalised within the batch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json_object
from rillmark.functions.text import contains_any, java_regex, pattern_fault, strip
from rillmark.operators.windows import first_by
from rillmark.session import materialize

# Entity patterns, word lists, labels and constants of the scoring rules.
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
FILESYSTEM = (
    r"(?i)(?:[a-zA-Z]:\\(?:[^\\\s<>:\"/|?*]+\\)*[^\\\s<>:\"/|?*]+"
    r"|/(?:bin|etc|var|usr|opt|tmp|root|home|sys|proc|lib|run|mnt)/[^\s<>:\"|?*]+"
    r"|\b[a-zA-Z0-9_\-.]+\.(?:exe|dll|bat|sh|ps1|vbs|py|elf|bin|conf|ini|cfg|log|zip|tar|gz)\b)"
)
DOMAIN = r"\b(?:https?://)?(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,}(?::\d+)?(?:/[^\s]*)?\b"
APPLIANCE = r"(?i)^(Router|Switch|Firewall|Core-SW|Edge|Gateway|LoadBalancer)-\S+\b"
ACCOUNTS = ["root", "administrator", "trustedinstaller", "sshd", "kubelet", "system"]
TOKEN_EDGES = r":,\[\]()\"'\-_"
JSON_ENTITY_KEYS = [
    "src_ip", "client_ip", "source_ip", "username", "user", "process_path", "image", "resource_arn", "device_id",
    "hostname",
]
JSON_EVENT, JSON_TACTIC, JSON_TECHNIQUE = "native_structured_telemetry", "Initial Access", "Valid Accounts"
SUPPRESSED_RULE = "windows_cbs_generic_stream"
UNKNOWN_ENTITY, UNCLASSIFIED = "unknown_entity", "unclassified"
COLD_START_DRIFT = 0.2979
SHARE_FLOOR = 0.0001
DEFAULT_COMPLEXITY, ADDRESS_WEIGHT, DEFAULT_VULNERABILITY = 5.0, 7.5, 4.5

# A cheap superset of the entity patterns.  Every entity but an account name
# holds one of four punctuation marks in a telling place, so the scan passes
# over all other characters at once and tests few tokens of few lines.
_LOOSE = (
    r"[.:/\-](?:(?<=[a-zA-Z0-9_\-.]\.)[a-zA-Z]{2}|(?<=\p{Nd}\.)\p{Nd}"
    r"|(?<=:)\\|(?<=[0-9a-fA-F]:)[0-9a-fA-F]"
    r"|(?<=/)(?i:bin|etc|var|usr|opt|tmp|root|home|sys|proc|lib|run|mnt)/"
    r"|(?<=(?i:Router|Switch|Firewall|Core-SW|Edge|Gateway|LoadBalancer)-))"
)


def _tokens_with(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(rf"(?U)(?<!\S)\S*?(?:{pattern})\S*"), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """A named pattern with its tactic and technique, tested in list order."""

    name: str
    pattern: str
    tactic: str
    technique: str
    validated: bool = False


@dataclass(frozen=True)
class Weights:
    """Keyword weights in declared order, with the values used when none fits."""

    complexity: dict[str, float] = field(default_factory=dict)
    vulnerability: dict[str, float] = field(default_factory=dict)
    default_complexity: float = DEFAULT_COMPLEXITY
    address: float = ADDRESS_WEIGHT
    default_vulnerability: float = DEFAULT_VULNERABILITY

    @classmethod
    def from_profile(cls, profile: dict) -> "Weights":
        low = profile.get("fallbacks", {})
        return cls(
            profile.get("attack_complexity_weights", {}), profile.get("entity_vulnerability_weights", {}),
            low.get("default_a_w", DEFAULT_COMPLEXITY), low.get("network_ip_e_w", ADDRESS_WEIGHT),
            low.get("default_e_w", DEFAULT_VULNERABILITY),
        )


def rules_from(config: dict, matrix: dict[str, list[str]]) -> list[Rule]:
    """Rules of a JSON map, each checked against the tactic matrix."""
    return [
        Rule(name, m["pattern"], m.get("mitre_tactic"), m.get("mitre_technique"),
             m.get("mitre_technique") in matrix.get(m.get("mitre_tactic"), []))
        for name, m in config.items()
    ]


def usable_rules(rules: Sequence[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules whose pattern can be used, and the rejected ones."""
    bad = [r for r in rules if pattern_fault(r.pattern)]
    return [r for r in rules if r not in bad], bad


def rejected_rules(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Table of the rules that are left out: ``name``, ``pattern``, ``reason``."""
    rows = [(r.name, r.pattern, pattern_fault(r.pattern)) for r in usable_rules(rules)[1]]
    return spark.createDataFrame(rows, "name string, pattern string, reason string")


def _unicode(pattern: str) -> Column:
    return F.lit("(?U)" + java_regex(pattern))


def classify_token(token: Column) -> Column:
    """Struct (entity, category) of a token without its edge punctuation, else null."""
    def found(name: str, entity: Column) -> Column:
        return F.struct(entity.alias("entity"), F.lit(name).alias("category"))

    return (
        F.when(F.rlike(token, _unicode(IPV4)), found("network_ip", F.regexp_extract(token, "(?U)" + IPV4, 0)))
        .when(F.rlike(token, _unicode(IPV6)), found("network_ip_v6", F.regexp_extract(token, "(?U)" + IPV6, 0)))
        .when(F.rlike(token, _unicode(FILESYSTEM)), found("filesystem_resource", token))
        .when(F.rlike(token, _unicode(DOMAIN)), found("network_endpoint_domain", token))
        .when(F.rlike(token, _unicode(APPLIANCE)), found("network_appliance", token))
    )


def line_entity(line: Column) -> Column:
    """Struct (entity, category) of the first entity of interest in a stripped line.

    Only tokens that can match are tested, left to right.  Privileged account
    names count when no token holds an address, path, domain or appliance.
    """
    def edges_off(token: Column) -> Column:
        return F.regexp_replace(token, f"^[{TOKEN_EDGES}]+|[{TOKEN_EDGES}]+$", "")

    def privileged(name: Column) -> Column:
        return F.struct(name.alias("entity"), F.lit("privileged_system_context").alias("category"))

    tokens = F.when(F.rlike(line, F.lit(_LOOSE)), _tokens_with(line, _LOOSE))
    hits = F.array_compact(F.transform(F.transform(tokens, edges_off), classify_token))
    words = F.when(contains_any(F.lower(line), ACCOUNTS), _tokens_with(line, f"(?i:{'|'.join(ACCOUNTS)})"))
    names = F.transform(words, edges_off)
    accounts = F.filter(names, lambda a: F.lower(a).isin(ACCOUNTS))
    return F.coalesce(F.get(hits, F.lit(0)), F.get(F.transform(accounts, privileged), F.lit(0)))


_JSON_LINE, _TEXT_LINE = -2, -1


def _json_columns(rows: DataFrame) -> DataFrame:
    """Entity and attributes of JSON object lines: preferred key, else the first key."""
    rows = rows.withColumn("_record", F.when(F.col("_kind") == _JSON_LINE, F.from_json("_line", "map<string,string>")))
    keys = F.map_keys("_record")
    preferred = [F.when(F.array_contains(keys, k), F.lit(k)) for k in JSON_ENTITY_KEYS]
    rows = rows.withColumn("_value", F.try_element_at("_record", F.coalesce(*preferred, F.get(keys, F.lit(0)))))
    empty = F.col("_value").isNull() | F.col("_value").isin("", "0", "0.0", "false", "[]", "{}")
    shown = F.filter(
        F.map_entries("_record"), lambda e: ~e["key"].isin("entity", "entity_alt") & e["value"].isNotNull())
    return rows.withColumns({
        "_json_entity": F.when(F.size("_record") == 0, UNCLASSIFIED).when(empty, UNKNOWN_ENTITY).otherwise(F.col("_value")),
        "_json_attributes": F.transform(shown, lambda e: e["value"]),
    })


def _rule_columns(rule: Rule) -> tuple[Column, Column]:
    """Entity and attributes of a line matched by ``rule``: its named groups."""
    groups = re.compile(rule.pattern).groupindex
    pattern = "(?U)" + java_regex(rule.pattern)

    def group(name: str) -> Column:
        return F.nullif(F.regexp_extract("_line", pattern, groups[name]), F.lit(""))

    named = [group(n) for n in ("entity", "entity_alt") if n in groups]
    rest = [group(n) for n in groups if n not in ("entity", "entity_alt")]
    attributes = F.array_compact(F.array(*rest)) if rest else F.array().cast("array<string>")
    return F.coalesce(*named, F.lit(UNKNOWN_ENTITY)), attributes


def elements(df: DataFrame, line: str, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """Threat elements of log lines; blank and uninteresting lines are dropped.

    A line is a JSON object, else the first matching rule's, else text with an
    entity of interest.  The kind is settled once per line by a generator, so
    no later filter repeats the patterns; the columns of the element are built
    for the few lines left.
    """
    good, _ = usable_rules(rules)
    rows = df.select(*keep, strip(F.col(line)).alias("_line"))
    text = F.col("_line")
    as_json = F.when(text.startswith("{") & text.endswith("}"), is_json_object(text)).otherwise(F.lit(False))
    numbers = [F.when(F.rlike(text, _unicode(r.pattern)), F.lit(i)) for i, r in enumerate(good)]
    rows = rows.withColumn("_rule", F.when(as_json, F.lit(_JSON_LINE)).otherwise(F.coalesce(*numbers, F.lit(_TEXT_LINE))))

    def kind(number: Column, hit: Column) -> Column:
        return F.struct(number.alias("kind"), hit.alias("hit"))

    nothing = F.lit(None).cast("struct<entity:string,category:string>")
    silent = [i for i, r in enumerate(good) if r.name == SUPPRESSED_RULE]
    settled = F.when(F.col("_rule") == _TEXT_LINE, F.transform(
        F.array_compact(F.array(line_entity(text))), lambda h: kind(F.lit(_TEXT_LINE), h)))
    if silent:
        none = F.array().cast("array<struct<kind:int,hit:struct<entity:string,category:string>>>")
        settled = settled.when(F.col("_rule").isin(silent), none)
    settled = settled.otherwise(F.array(kind(F.col("_rule"), nothing)))
    found = rows.select(*keep, "_line", F.explode(settled).alias("_s")).select(
        *keep, "_line", F.col("_s.kind").alias("_kind"), "_s.hit.entity", "_s.hit.category")
    found = _json_columns(found)

    entity = F.when(F.col("_kind") == _JSON_LINE, F.col("_json_entity")).when(
        F.col("_kind") == _TEXT_LINE, F.col("entity"))
    attributes = F.when(F.col("_kind") == _JSON_LINE, F.col("_json_attributes")).when(
        F.col("_kind") == _TEXT_LINE,
        F.concat(F.slice(F.split("_line", r"(?U)\s+"), 1, 8), F.array("category")))
    for i, rule in enumerate(good):
        if i not in silent:
            of_rule = _rule_columns(rule)
            entity = entity.when(F.col("_kind") == i, of_rule[0])
            attributes = attributes.when(F.col("_kind") == i, of_rule[1])

    def per_kind(of_json: Column, of_text: Column, of_rules: list) -> Column:
        listed = F.get(F.array(*[F.lit(v) for v in of_rules]), F.col("_kind")) if of_rules else F.lit(None)
        return F.when(F.col("_kind") == _JSON_LINE, of_json).when(F.col("_kind") == _TEXT_LINE, of_text).otherwise(listed)

    tactic = F.when(F.col("category") == "filesystem_resource", "Defense Evasion").otherwise("Discovery")
    technique = F.concat(F.lit("Targeted Resource Asset Isolation ("), "category", F.lit(")"))
    return found.select(
        *keep,
        per_kind(F.lit(JSON_EVENT), F.concat(F.lit("threat_vector_"), "category"), [r.name for r in good]).alias(
            "event_type"),
        entity.alias("entity"),
        per_kind(F.lit(JSON_TACTIC), tactic, [r.tactic for r in good]).alias("tactic"),
        per_kind(F.lit(JSON_TECHNIQUE), technique, [r.technique for r in good]).alias("technique"),
        per_kind(F.lit(False), F.lit(False), [r.validated for r in good]).alias("validated"),
        attributes.alias("attributes"),
    )


def unique_elements(found: DataFrame, file: str, line_number: str) -> DataFrame:
    """First element of every entity of a file."""
    return first_by(found, [file, "entity"], [line_number])


def numbered_attributes(values: Column) -> Column:
    """Map attr1..attrN of the non-null values."""
    kept = F.filter(values, lambda v: v.isNotNull())
    names = F.transform(kept, lambda v, i: F.concat(F.lit("attr"), (i + 1).cast("string")))
    return F.map_from_arrays(names, kept)


def first_weight(texts: Sequence[Column], weights: dict[str, float]) -> Column:
    """Weight of the first keyword, in declared order, found in one of the texts."""
    tests = []
    for keyword, weight in weights.items():
        hit = F.lit(False)
        for text in texts:
            hit = hit | F.contains(F.lower(text), F.lit(keyword))
        tests.append(F.when(hit, F.lit(float(weight))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("double")


def pattern_score(tactic: Column, technique: Column, entity: Column, weights: Weights) -> Column:
    """``round(10 * sqrt(complexity * vulnerability), 2)``."""
    complexity = F.coalesce(first_weight([tactic, technique], weights.complexity), F.lit(weights.default_complexity))
    address = F.when(F.rlike(entity, _unicode(IPV4)), F.lit(weights.address)).otherwise(
        F.lit(weights.default_vulnerability))
    exposed = F.coalesce(first_weight([entity], weights.vulnerability), address)
    return F.bround(F.sqrt(complexity * exposed) * 10.0, 2)


def distribution(df: DataFrame, category: str) -> DataFrame:
    """Share of every category, rounded to 4 places."""
    counts = df.groupBy(category).agg(F.count("*").alias("_n"))
    # The total reads the same counts, whose shuffle is reused: the rows are
    # made once.
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    return counts.select(category, F.bround(F.col("_n") / total, 4).alias("share"))


def ranked_distribution(df: DataFrame, category: str) -> DataFrame:
    """Shares of all categories, the largest first; equal ones by name.  One row per category is ordered."""
    return distribution(df, category).orderBy(F.col("share").desc(), category)


def stability_index(baseline: DataFrame, current: DataFrame, category: str) -> DataFrame:
    """Drift ``(a - b) ln(a / b)`` per category over the union of categories."""
    old = baseline.select(category, F.col("share").alias("_b"))
    new = current.select(category, F.col("share").alias("_a"))
    a = F.greatest(F.coalesce("_a", F.lit(SHARE_FLOOR)), F.lit(SHARE_FLOOR))
    b = F.greatest(F.coalesce("_b", F.lit(SHARE_FLOOR)), F.lit(SHARE_FLOOR))
    return old.join(new, category, "full_outer").select(
        category, F.bround((a - b) * F.ln(a / b), 4).alias("drift"))


def with_drift(df: DataFrame, drift: DataFrame | None, category: str) -> DataFrame:
    """Drift of each row's category; 0.2979 on a cold start or when unknown."""
    if drift is None:
        return df.withColumn("drift", F.lit(COLD_START_DRIFT))
    joined = df.join(drift, category, "left")
    return joined.withColumn("drift", F.coalesce("drift", F.lit(COLD_START_DRIFT)))


def batch_moments(df: DataFrame, score: str) -> DataFrame:
    """Mean and population deviation of a score over the batch."""
    return df.agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma"))


def normalise(df: DataFrame, exact: str, shown: str, out: str) -> DataFrame:
    """Logistic 0-100 of the batch z-score; 50 when all scores are equal.

    The moments come from the unrounded scores, z from the shown ones.  They
    reach the rows as one scalar, not through a window over everything.
    """
    moments = df.agg(F.struct(F.avg(exact).alias("mu"), F.stddev_pop(exact).alias("sigma")).alias("m")).scalar()
    z = F.try_divide(F.col(shown) - moments["mu"], moments["sigma"])
    return df.withColumn(out, F.when(moments["sigma"] == 0, F.lit(50.0)).otherwise(
        F.bround(100.0 / (1.0 + F.exp(-z)), 2)))


def score_batch(
    found: DataFrame, weights: Weights, baseline: DataFrame | None = None, stored: bool = True
) -> DataFrame:
    """Score one batch of unique elements.

    The elements feed the category counts, the moments and the result, so they
    are written once first (``stored=False`` skips that for a table already
    stored).
    """
    base = materialize(found, "elements") if stored else found
    drift = None if baseline is None else stability_index(baseline, distribution(base, "event_type"), "event_type")
    rows = with_drift(base, drift, "event_type")
    score = pattern_score(F.col("tactic"), F.col("technique"), F.col("entity"), weights)
    rows = rows.withColumn("pattern_score", score)
    rows = rows.withColumn("_exact", F.col("pattern_score") * F.exp("drift"))
    rows = rows.withColumn("raw_score", F.bround("_exact", 2))
    return normalise(rows, "_exact", "raw_score", "normalised_score").drop("_exact")
