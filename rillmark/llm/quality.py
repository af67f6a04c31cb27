"""Quality rules and robust multivariate outliers of document statistics, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.native import SPACE_CHARS, once, with_windows, words
from rillmark.llm.storage import materialize, prepare

SYMBOLS = "#*$%&|<>"

# Transformed statistics: name, SQL, and the standard deviation below which a difference is never held against a text.
STATISTICS = (
    ("x1", "(word_chars + 150) / (n_words + 30)", 0.25),
    ("x2", "ln(1 + 20 * n_symbols / (n_words + 30))", 0.10),
    ("x3", "sqrt(n_dup_lines / (n_lines + 5))", 0.08),
    ("x4", "sqrt(n_repeat_words / (n_words + 30))", 0.08),
)
P = len(STATISTICS)
X = [s[0] for s in STATISTICS]
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]

# Groups of fewer rows share the estimate of their language, or of all rows that are left.
LEAST_ROWS = 200
# Share of a group whose rows make the estimate: nearly as many others may lie anywhere.
HALF = 0.5
# A start is concentrated until its log-determinant falls by less than this.
STILL = 1e-4
# Distances are sorted in steps of 1/32 octave.
PER_OCTAVE = 32
# Share of clean rows of a normal group that may be rejected.
ALPHA = 1e-9
PARAMETER_ROWS = 50_000


def _chi2_cdf(x: float, dof: int) -> float:
    """Distribution of chi-square with an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(dof // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, dof: int) -> float:
    """Inverse of the chi-square distribution by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < q else (low, mid)
    return low


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``, ``n_repeat_words``
    (words inside runs of five words that occur twice or more in the text).  Null counts as an empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    df = once(docs.select(*keep, text.alias("text")), _lines=lines)
    df = df.select(
        *keep, "text",
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    keep = [*keep, "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    df = with_windows(df, words(F.col("text")), "_h", keep)
    keep = [*keep, "n_words"]
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = once(df, _s=F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    same = F.zip_with("_s", F.slice("_s", F.lit(2), F.greatest(F.size("_s"), F.lit(1))),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    df = once(df.select(*keep, "_s"), _at=at)
    steps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))),
                       lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    return df.select(*keep, F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Add ``g``: language and source, or a wider group where those have too few rows."""
    name = {c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source")}
    sizes = rows.groupBy(name["lang"].alias("l"), name["source"].alias("s")).agg(F.count("*").alias("n"))
    own = F.col("n") >= LEAST_ROWS
    rest = F.sum(F.when(~own, F.col("n"))).over(Window.partitionBy("l"))
    label = F.when(own, F.concat_ws(" ", F.lit("source"), "l", "s")).when(rest >= LEAST_ROWS, F.concat_ws(" ", F.lit("language"), "l"))
    groups = materialize(sizes.select("l", "s", F.coalesce(label, F.lit("all")).alias("g")), "groups")
    small = groups.count() <= PARAMETER_ROWS
    return (
        rows.withColumn("l", name["lang"]).withColumn("s", name["source"])
        .join(F.broadcast(groups) if small else groups, ["l", "s"]).drop("l", "s")
    )


def _square(prefix: str) -> str:
    """SQL of a squared distance: centre ``m``, inverse covariance ``p``."""
    return " + ".join(
        f"{'1' if i == j else '2'} * {prefix}p{i}{j} * ({X[i]} - {prefix}m{i}) * ({X[j]} - {prefix}m{j})" for i, j in CELLS)


def _inverse(moments: DataFrame, keep: list[str]) -> DataFrame:
    """Centre, inverse covariance and log-determinant from ``n``, sums ``t`` and product sums ``t_``.

    Covariances get the squared floors of STATISTICS added, so they never are singular.
    """
    df = moments.selectExpr(*keep, *(f"t{i} / n AS m{i}" for i in range(P)), *(f"t{i}{j} / n AS u{i}{j}" for i, j in CELLS))
    df = df.selectExpr(*keep, *(f"m{i}" for i in range(P)), *(
        f"u{i}{j} - m{i} * m{j}" + (f" + {STATISTICS[i][2] ** 2!r}" if i == j else "") + f" AS c{i}{j}" for i, j in CELLS))
    for i, j in CELLS:  # Cholesky factor, row by row
        inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        df = df.withColumn(f"l{i}{j}", F.expr(f"sqrt(greatest(c{i}{j}{inner}, {STATISTICS[i][2] ** 2 / 100!r}))" if i == j else f"(c{i}{j}{inner}) / l{j}{j}"))
    for i, j in CELLS:  # its inverse
        inner = " + ".join(f"l{i}{k} * v{k}{j}" for k in range(j, i))
        df = df.withColumn(f"v{i}{j}", F.expr(f"1 / l{i}{i}" if i == j else f"-({inner}) / l{i}{i}"))
    cells = (f"{' + '.join(f'v{k}{i} * v{k}{j}' for k in range(i, P))} AS p{i}{j}" for i, j in CELLS)
    return df.selectExpr(*keep, *(f"m{i}" for i in range(P)), *cells, f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(P))}) AS logdet")


def _closest(rows: DataFrame, distance: str) -> DataFrame:
    """Centre and covariance of the closest HALF of every group's rows (and P + 1 halves more), per start.

    Rows are summed per group and step of distance, which partial aggregation does before the shuffle; the steps of a
    group are bounded in number, whatever its size.  The step that crosses the half counts in part, so that no group of
    equal rows comes in whole.
    """
    step = F.floor(F.log2(F.expr(f"least(greatest({distance}, 1e-6), 1e12)")) * PER_OCTAVE).cast("int")
    sums = [F.sum(F.col(X[i])).alias(f"t{i}") for i in range(P)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"t{i}{j}") for i, j in CELLS]
    steps = rows.withColumn("step", step).groupBy("g", "start", "step").agg(F.count("*").alias("n"), *sums)
    by = Window.partitionBy("g", "start")
    inner = F.sum("n").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("inner", F.coalesce(inner, F.lit(0))).withColumn("all", F.sum("n").over(by))
    half = F.least(F.col("all"), HALF * (F.col("all") + P + 1))
    near = steps.filter(F.col("inner") < half).withColumn("part", F.least(F.lit(1.0), (half - F.col("inner")) / F.col("n")))
    names = ["n", *(f"t{i}" for i in range(P)), *(f"t{i}{j}" for i, j in CELLS)]
    return _inverse(near.groupBy("g", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in names)), ["g", "start"])


def _with(rows: DataFrame, parameters: DataFrame, on: list[str]) -> DataFrame:
    small = parameters.count() <= PARAMETER_ROWS
    return rows.join(F.broadcast(parameters) if small else parameters, on)


def covariance(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per group ``g`` of the columns X.

    Two deterministic starts, the median with scales from absolute deviations and the same on squashed values, are
    concentrated on the closest HALF of the rows until the determinant stands still; the smaller determinant counts.
    """
    middle = rows.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(X)))
    middle = materialize(middle, "medians")
    spread = _with(rows, middle, ["g"]).groupBy("g").agg(
        *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i, x in enumerate(X)))
    scales = materialize(middle.join(spread, "g").selectExpr(
        "g", *(f"m{i}" for i in range(P)), *(f"greatest(1.4826 * s{i}, {STATISTICS[i][2]!r}) AS s{i}" for i in range(P))), "scales")
    plain = " + ".join(f"pow(({x} - m{i}) / s{i}, 2)" for i, x in enumerate(X))
    squashed = " + ".join(f"pow(tanh(({x} - m{i}) / s{i} / 2), 2)" for i, x in enumerate(X))
    starts = _with(rows, scales, ["g"]).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    found = materialize(_closest(starts, f"if(start = 0, {plain}, {squashed})"), "estimate")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    settled = None
    while True:
        was = found.selectExpr("g", "start", "logdet AS was")
        found = materialize(_closest(_with(both, found, ["g", "start"]), _square("")).join(was, ["g", "start"]), "estimate")
        still = found.filter(f"logdet >= was - {STILL}")
        settled = still if settled is None else settled.union(still)
        found = found.filter(f"logdet < was - {STILL}").drop("was")
        if found.isEmpty():
            break
    best = settled.drop("was").groupBy("g").agg(F.min_by(F.struct(*found.columns), F.struct("logdet", "start")).alias("e"))
    return materialize(best.select("e.*").drop("start"), "estimate")


def judge(docs: DataFrame, key: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """Counts and verdict of every row of ``docs``, one row each.

    Needs integer ``key``, ``text``, ``lang``, ``source``; other columns are ignored.  A text fails the base rules with
    fewer than 10 words or when more than 20 % of its words repeat (``base_failed``).  The others are transformed
    (STATISTICS), and a text is rejected where its squared Mahalanobis distance from the robust centre of its language
    and source passes the chi-square quantile ``1 - alpha``; ``distance`` is that value, null for failed rows.  Only
    deviations to the bad side count: a statistic below the centre is moved to it, except the word length.

    Null texts have no words and fail.  Null languages and sources are groups like others; groups below LEAST_ROWS
    rows are pooled.  Rows with equal keys are judged one by one.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    base = text_statistics(docs, [key, "lang", "source"])
    base = base.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    base = materialize(base.selectExpr("*", *(f"CAST({sql} AS double) AS {name}" for name, sql, _ in STATISTICS)), "statistics")
    rows = materialize(_grouped(base.filter("NOT base_failed")), "judged")
    estimate = covariance(rows.select("g", *X))
    # Of a normal sample, the closest HALF has a smaller covariance by this factor.
    shrunk = _chi2_cdf(chi2_quantile(HALF, P), P + 2) / HALF
    bad_side = [X[0], *(f"greatest({x}, m{i}) AS {x}" for i, x in enumerate(X) if i)]
    names = [c for c in estimate.columns if c != "g"]
    judged = _with(rows, estimate, ["g"]).selectExpr(*(c for c in base.columns if c not in X), *names, *bad_side)
    judged = judged.withColumn("distance", F.round(F.expr(f"({_square('')}) * {shrunk!r}"), 6))
    failed = base.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    columns = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    cut = chi2_quantile(1 - alpha, P)
    return judged.select(*columns).union(failed.select(*columns)).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))
