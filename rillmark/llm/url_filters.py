"""URL filters: host and path rules, and trust that is propagated over links, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, measured, prepare

# (verdict, host and path from the first slash on)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
# Scores are propagated until what still moves is this part of the seeds.
LEFT = 1e-7
# A host is blocked where distrust exceeds trust by this part of what a host gets whose pages all are blocked.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def parts(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``host`` and ``path`` of every ``url``; both empty for null or without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    df = pages.select(*keep, F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return df.select(*keep, host.alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Per ``host`` the rules that fit it or a domain above it, as an array of (size, verdict, rule, path).

    Every host is looked up under each of its endings, so the cost does not grow with the number of rules.
    """
    table = hosts.sparkSession.createDataFrame(
        [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules], "ending string, start string, rule string, verdict string")
    names = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    found = hosts.select("host", F.explode(endings).alias("ending")).join(measured(table), "ending")
    rule = F.struct(F.length("rule").alias("size"), F.col("verdict"), F.col("rule"), F.col("start"))
    return found.groupBy("host").agg(F.collect_set(rule).alias("rules"))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Pages with ``host``, ``path``, and the longest fitting ``rule`` with its ``verdict`` (null without one)."""
    fitting = materialize(host_rules(pages.select("host").distinct(), rules), "host-rules")
    df = pages.join(measured(fitting), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])))
    return df.withColumn("_best", best).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))


def links(pages: DataFrame) -> DataFrame:
    """Links between different hosts (``source``, ``target``, ``weight``) from the absolute links of ``html``."""
    found = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    found = found.select(F.col("host").alias("source"), F.translate("to", _UPPER, _LOWER).alias("target"))
    return found.filter("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, left: float = LEFT) -> DataFrame:
    """Personalised PageRank (``kind``, ``host``, ``score``) from ``seeds`` (``kind``, ``host``, ``score``).

    Trust follows links, distrust goes from a host to those that link to it; both are the same sum over ``edges``
    turned the right way, computed together.  What a host without links gets stays there and goes no further.  Each
    round moves on what the last one moved, so a score is the sum of all its arrivals, and rounds end when what still
    moves is ``left`` of the seeds, a bound on the error that shrinks by ``damping`` a round at least.  A round joins
    what moves with the links by host and adds up partially before the shuffle; it is written to the shared folder.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("all"))
    into = edges.groupBy("target").agg(F.sum("weight").alias("all"))
    steps = edges.join(out, "source").selectExpr("'trust' AS kind", "source AS host", "target AS to", "weight / all AS part")
    back = edges.join(into, "target").selectExpr("'distrust' AS kind", "target AS host", "source AS to", "weight / all AS part")
    steps = materialize(steps.union(back), "steps")
    moving = seeds.selectExpr("kind", "host", f"{1 - damping!r} * score AS score")
    if steps.isEmpty():  # nothing can move
        return moving
    mass = lambda rows: rows.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    enough, arrived = left * mass(moving), moving
    while True:
        moved = moving.join(steps, ["kind", "host"]).selectExpr("kind", "to AS host", f"{damping!r} * score * part AS score")
        moving = materialize(moved.groupBy("kind", "host").agg(F.sum("score").alias("score")), "moving")
        arrived = materialize(arrived.union(moving).groupBy("kind", "host").agg(F.sum("score").alias("score")), "arrived")
        if mass(moving) <= enough:
            return arrived


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Verdict of every page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    Takes ``page_id``, ``url``, ``html``; other columns are ignored.  The longest rule that fits the host (or a domain
    above it) and the start of the path decides; of equally long ones, the later by text.  Without a rule the host
    decides: its seeds are the shares of its pages that rules allow and block, trust and distrust are propagated over
    links between hosts, and it is blocked where distrust exceeds trust by ``threshold``; ``score`` is the difference.

    Null urls and urls without ``://`` have empty host and path, no rule, and are allowed.  Null html has no links.
    Repeated rows and null ids are pages like others.  An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    base = parts(pages, ["page_id", "html"])
    judged = materialize(ruled(base.select("page_id", "host", "path"), rules), "ruled")
    edges = materialize(links(base), "links")
    shares = judged.filter("host <> ''").groupBy("host").agg(
        F.avg(F.expr("CAST(verdict <=> 'allow' AS int)")).alias("trust"), F.avg(F.expr("CAST(verdict <=> 'block' AS int)")).alias("distrust"))
    seeds = shares.unpivot("host", ["trust", "distrust"], "kind", "score").filter("score > 0").select("kind", "host", "score")
    ranks = propagate(materialize(seeds, "seeds"), edges)
    score = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(-F.col("score"))).alias("score"))
    scores = materialize(score.select("host", F.round(F.col("score") / (1 - DAMPING), 9).alias("score")), "scores")
    found = judged.join(measured(scores), "host", "left")
    own = F.when(F.coalesce("score", F.lit(0.0)) < -threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
