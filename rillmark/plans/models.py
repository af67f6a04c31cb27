"""Queries for models, distributions, clusters and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import joins, ml, vectors
from rillmark.plans import inputs
from rillmark.plans.inputs import SHIPMENT_SQL, WINDOW_SQL
from rillmark.plans.registry import query, register
from rillmark.session import materialize

LOGIC = "classification_name=late_prob:A=20000,n:N=-n,80000"
_MATRIX_SQL = f"""WITH r AS (SELECT entity, subtopic, x, row_number() OVER (PARTITION BY entity, subtopic
    ORDER BY ts DESC, msgid DESC) AS idx FROM ({SHIPMENT_SQL.format(n=1000)})),
  w AS (SELECT entity, idx, max(x) FILTER (WHERE subtopic = 'A') AS a, max(x) FILTER (WHERE subtopic = 'N') AS n,
    max(x) FILTER (WHERE subtopic = 'R') AS r FROM r GROUP BY entity, idx),
  mx AS (SELECT *, count(*) OVER (PARTITION BY entity) AS rows FROM w
    WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL QUALIFY rows >= 30)"""


def _matrix(t):
    return joins.training_matrix(inputs.shipments(t), ["A", "N", "R"])


@query(
    "ml_label",
    _MATRIX_SQL + ' SELECT entity, idx, (a >= 20000 AND n <= 80000)::INTEGER AS label FROM mx',
)
def ml_label(t):
    return _matrix(t).select("entity", "idx", ml.label(ml.parse_logic(LOGIC)).alias("label"))


def _logistic(t):
    rows = _matrix(t).withColumn("label", (F.col("R") > 0.5 * (F.col("A") + F.col("N"))).cast("int"))
    return rows, ml.fit_logistic(rows, "entity", "label", ["A", "N"])


@query(
    "ml_logistic_fit",
    _MATRIX_SQL + """ SELECT entity, count(*) AS n, sum((r > 0.5 * (a + n))::INT)::BIGINT AS positives,
      0.0::DOUBLE AS slope_a, 0.0::DOUBLE AS slope_n, 0.0::DOUBLE AS slope_1
      FROM mx GROUP BY entity HAVING min(r > 0.5 * (a + n)) <> max(r > 0.5 * (a + n))""",
)
def ml_logistic_fit(t):
    """One logistic model per entity; the slopes of its penalised likelihood are computed anew from the rows and vanish."""
    rows, models = _logistic(t)
    features = ["A", "N"]
    scored = ml.predict(rows.join(models.select("entity", F.col("n").alias("_n"), "positives", F.col("coefficients").alias("_b")), "entity"),
                        models, ["entity"], features, logistic=True)
    off = F.col("label") - F.col("prediction")
    sums = scored.groupBy("entity").agg(
        F.max("_n").alias("n"), F.max("positives").alias("positives"), F.max("_b").alias("b"), F.sum(off).alias("s1"),
        *[f(F.col(x) if f is not F.sum else F.col(x) * off).alias(f"{x}_{i}") for x in features for i, f in enumerate((F.sum, F.avg, F.stddev_pop))])
    # The fit penalises the coefficients of the standardised features.
    slope = lambda k, x: (F.col(f"{x}_0") - F.col(f"{x}_1") * F.col("s1")) / F.col(f"{x}_2") - 1e-3 * F.col("b")[k] * F.col(f"{x}_2")
    zero = lambda c: F.round(F.abs(c), 4)
    return sums.select("entity", "n", "positives", zero(slope(1, "A")).alias("slope_a"), zero(slope(2, "N")).alias("slope_n"), zero(F.col("s1")).alias("slope_1"))


@query("ml_logistic_predict")
def ml_logistic_predict(t):
    """Probability of the newest 50 rows of every entity."""
    rows, models = _logistic(t)
    newest = rows.filter("idx <= 50")
    out = ml.predict(newest, models, ["entity"], ["A", "N"], logistic=True)
    return out.select("entity", "idx", F.round("prediction", 6).alias("prediction"))


@query(
    "ml_linear_fit",
    """SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
      round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem GROUP BY l_suppkey""",
)
def ml_linear_fit(t):
    models = ml.fit_linear(t.lineitem, ["l_suppkey"], "l_extendedprice", ["l_quantity"])
    return models.select(
        "l_suppkey", F.round(F.col("coefficients")[0], 3).alias("intercept"),
        F.round(F.col("coefficients")[1], 4).alias("slope"), "n")


_TWO_SQL = """WITH s AS (SELECT l_suppkey, covar_pop(l_quantity, l_quantity) AS c11, covar_pop(l_discount, l_discount) AS c22,
    covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS y1,
    covar_pop(l_discount, l_extendedprice) AS y2, avg(l_quantity) AS m1, avg(l_discount) AS m2,
    avg(l_extendedprice) AS my, count(*) AS n FROM lineitem GROUP BY l_suppkey),
  b AS (SELECT *, (y1 * c22 - y2 * c12) / (c11 * c22 - c12 * c12) AS b1,
    (y2 * c11 - y1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM s),
  m AS (SELECT l_suppkey, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b)"""


def _two(t):
    return ml.fit_linear(t.lineitem, ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_discount"])


@query(
    "ml_linear_fit_many",
    _TWO_SQL + " SELECT l_suppkey, n, round(b0, 2) AS b0, round(b1, 3) AS b1, round(b2, 2) AS b2 FROM m",
)
def ml_linear_fit_many(t):
    c = F.col("coefficients")
    return _two(t).select("l_suppkey", "n", F.round(c[0], 2).alias("b0"), F.round(c[1], 3).alias("b1"),
                          F.round(c[2], 2).alias("b2"))


@query(
    "ml_named_coefficients",
    _TWO_SQL + """ SELECT l_suppkey, unnest(['base', 'discount']) AS name, unnest([round(b0, 2), round(b2, 2)]) AS value
    FROM m""",
)
def ml_named_coefficients(t):
    out = ml.named_coefficients(_two(t), ["l_suppkey"], {0: "base", 2: "discount"})
    return out.withColumn("value", F.round("value", 2))


@query(
    "ml_predict_newest",
    _TWO_SQL + """ SELECT l_orderkey, l_linenumber, l_partkey, round(b0 + b1 * l_quantity + b2 * l_discount, 2) AS prediction
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) <= 50)
    JOIN m USING (l_suppkey)""",
)
def ml_predict_newest(t):
    """Predictions for the newest 50 rows of every entity."""
    from rillmark.operators.windows import last_n

    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    newest = last_n(t.lineitem, ["l_suppkey"], order, 50)
    out = ml.predict(newest, _two(t), ["l_suppkey"], ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 2).alias("prediction"))


@query(
    "ml_predict_supplied",
    _TWO_SQL + " SELECT l_suppkey, round(b0 + b1 * 30 + b2 * 0.05, 2) AS prediction FROM m",
)
def ml_predict_supplied(t):
    """One supplied input row scored by every entity's model."""
    models = _two(t)
    rows = models.select("l_suppkey", F.lit(30.0).alias("l_quantity"), F.lit(0.05).alias("l_discount"), "coefficients")
    value = ml.linear_score(F.col("coefficients"), ["l_quantity", "l_discount"])
    return rows.select("l_suppkey", F.round(value, 2).alias("prediction"))


@query(
    "ml_log_transform",
    """SELECT l_suppkey, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 5) AS slope, count(*) AS n
    FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY l_suppkey""",
)
def ml_log_transform(t):
    logged = ml.log_transform(t.lineitem, "l_extendedprice", ["l_quantity"], "log-log")
    models = ml.fit_linear(logged, ["l_suppkey"], "l_extendedprice", ["l_quantity"])
    return models.select("l_suppkey", F.round(F.col("coefficients")[1], 5).alias("slope"), "n")


_FORMS_SQL = """SELECT l_suppkey, unnest(['lin-lin', 'log-lin', 'lin-log', 'log-log']) AS algorithm, unnest([
    regr_r2(l_extendedprice, l_quantity), regr_r2(ln(l_extendedprice), l_quantity),
    regr_r2(l_extendedprice, ln(l_quantity)), regr_r2(ln(l_extendedprice), ln(l_quantity))]) AS fit
  FROM lineitem GROUP BY l_suppkey"""


@query("ml_model_search", f"SELECT l_suppkey, algorithm, round(fit, 6) AS fit FROM ({_FORMS_SQL})")
def ml_model_search(t):
    out = ml.search_models(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")
    return out.select("l_suppkey", "algorithm", F.round("fit", 6).alias("fit"))


@query(
    "srt_best_model",
    f"""SELECT l_suppkey, arg_max(algorithm, (fit, algorithm)) AS algorithm, round(max(fit), 6) AS fit
    FROM ({_FORMS_SQL}) GROUP BY l_suppkey""",
)
def srt_best_model(t):
    models = ml.search_models(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity")
    best = ml.best_models(models, ["l_suppkey"], "fit")
    return best.select("l_suppkey", "algorithm", F.round("fit", 6).alias("fit"))


SEASONS = {"winter": [12, 1, 2], "summer": [6, 7, 8], "shoulder": [3, 4, 5, 9], "none": [-1]}
_SEASON_SQL = """SELECT *, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) IN (6, 7, 8)
  THEN 'summer' WHEN month(l_shipdate) IN (3, 4, 5, 9) THEN 'shoulder' END AS season FROM lineitem"""


def _season_models(t):
    rows = t.lineitem.withColumn("season", ml.season(F.month("l_shipdate"), SEASONS)).filter("season is not null")
    return rows, ml.fit_linear(rows, ["season"], "l_extendedprice", ["l_quantity"])


@query(
    "ml_season_models",
    f"""SELECT season, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM ({_SEASON_SQL})
    WHERE season IS NOT NULL GROUP BY season""",
)
def ml_season_models(t):
    return _season_models(t)[1].select("season", F.round(F.col("coefficients")[1], 4).alias("slope"), "n")


@query(
    "ml_predict_season",
    f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i
      FROM ({_SEASON_SQL}) WHERE season = 'winter')
    SELECT l_suppkey, round(avg(i + s * l_quantity), 3) AS prediction FROM ({_SEASON_SQL}), m WHERE season = 'winter'
    GROUP BY l_suppkey""",
)
def ml_predict_season(t):
    """The deployed winter model applied to the winter rows."""
    rows, models = _season_models(t)
    table = models.withColumns({
        "algorithm": F.lit("linear"), "stage": F.when(F.col("season") == "winter", "deployed").otherwise("candidate")})
    chosen = ml.use_model(table, deployed=True, algorithm="linear", season="winter")
    out = ml.predict(rows, chosen, ["season"], ["l_quantity"])
    return out.groupBy("l_suppkey").agg(F.round(F.avg("prediction"), 3).alias("prediction"))


@query(
    "ml_stage_filter",
    f"""SELECT season, CASE WHEN season = 'winter' THEN 'deployed' ELSE 'candidate' END AS stage FROM ({_SEASON_SQL})
    WHERE season IS NOT NULL AND season <> 'winter' GROUP BY season""",
)
def ml_stage_filter(t):
    models = _season_models(t)[1].withColumn(
        "stage", F.when(F.col("season") == "winter", "deployed").otherwise("candidate"))
    return ml.use_model(models, deployed=False).select("season", "stage")


@query("ml_batch_regression")
def ml_batch_regression(t):
    """Whole-table regression: outliers out, 75 % training, grid search, held-out error."""
    rows = t.lineitem.withColumn("price", F.col("l_extendedprice"))
    _, metric = ml.train_batch(rows, ["l_orderkey", "l_linenumber"], "price", ["l_quantity", "l_discount", "l_tax"])
    return metric


@query("ml_batch_classification")
def ml_batch_classification(t):
    """Document quality from simple text measures."""
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "quality", F.length("text").alias("chars"), F.size(F.split("text", " ")).alias("words"),
        F.length(F.regexp_replace("text", "[A-Za-z ]", "")).alias("marks"))
    _, metric = ml.train_batch(
        rows, ["doc_id"], "quality", ["chars", "words", "marks"], classify=True, remove_outliers=False)
    return metric


_CDF = """CASE WHEN {z} >= 0 THEN 1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * poly({z})
  ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) * poly({z}) END"""


def _cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = (f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * "
            "1.330274429)))))")
    return _CDF.replace("poly({z})", poly).format(z=z)


_FIT_SQL = f"""WITH p AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi,
    avg(ln(value)) FILTER (WHERE value > 0) AS lm, stddev_pop(ln(value)) FILTER (WHERE value > 0) AS ls FROM events),
  c AS (SELECT value AS x, count(*) AS n FROM events GROUP BY value),
  e AS (SELECT x, (sum(n) OVER (ORDER BY x) - n) / (SELECT count(*) FROM events)::DOUBLE AS below,
    sum(n) OVER (ORDER BY x) / (SELECT count(*) FROM events)::DOUBLE AS upto FROM c),
  z AS (SELECT e.*, p.*, (x - m) / s AS z1, (CASE WHEN x > 0 THEN ln(x) END - lm) / ls AS z2 FROM e, p),
  f AS (SELECT below, upto, unnest(['normal', 'lognormal', 'exponential', 'uniform', 'logistic', 'gumbel']) AS family,
    unnest([{_cdf('z1')}, CASE WHEN lo > 0 THEN {_cdf('z2')} END, CASE WHEN lo > 0 THEN 1 - exp(-x / m) END,
      (x - lo) / (hi - lo), 1 / (1 + exp(-(x - m) / (s * sqrt(3) / pi()))),
      exp(-exp(-(x - (m - 0.5772156649015329 * s * sqrt(6) / pi())) / (s * sqrt(6) / pi())))]) AS cdf FROM z)
  SELECT family, round(max(greatest(abs(cdf - below), abs(cdf - upto))), 5) AS distance FROM f WHERE cdf IS NOT NULL
  GROUP BY family ORDER BY distance, family LIMIT 3"""


@query("ml_distribution_fit", _FIT_SQL)
def ml_distribution_fit(t):
    out = ml.fit_distributions(t.events, "value", 3)
    return out.select("family", F.round("distance", 5).alias("distance"))


@query(
    "ml_correlated_factors",
    _MATRIX_SQL + """, c AS (SELECT entity AS subject, count(*) AS n, corr(a, n) AS an, corr(a, r) AS ar, corr(n, r) AS nr
      FROM mx GROUP BY entity),
    l AS (SELECT subject, n, unnest(['A', 'A', 'N']) AS factor_x, unnest(['N', 'R', 'R']) AS factor_y,
      unnest([an, ar, nr]) AS c FROM c)
    SELECT subject, n, factor_x, factor_y, round(c, 6) AS correlation FROM l WHERE abs(c) >= 0.1""",
)
def ml_correlated_factors(t):
    out = ml.correlated_factors(_matrix(t), "entity", ["A", "N", "R"], 0.1)
    return out.select("subject", "n", "factor_x", "factor_y", F.round("correlation", 6).alias("correlation"))


@query(
    "ml_clusters",
    f"""SELECT entity, true AS nearest, 3 AS clusters FROM ({inputs.SHIPMENT_SQL.format(n=800)})
    WHERE subtopic IN ('A', 'N', 'R') GROUP BY entity""",
)
def ml_clusters(t):
    """Entities grouped by their average per stream: each is nearest to the mean of its own cluster."""
    factors = ["A", "N", "R"]
    wide = joins.align_streams(inputs.shipments(t), {f: "avg" for f in factors})
    found = materialize(ml.clusters(wide, "entity", factors, 3, 100), "clusters")
    spread_ = found.agg(*[F.stddev_samp(f).alias(f"s_{f}") for f in factors])
    means = found.groupBy(F.col("cluster").alias("other")).agg(*[F.avg(f).alias(f"m_{f}") for f in factors]).filter("other IS NOT NULL")
    means = means.select(F.struct(*means.columns).alias("mean")).agg(F.collect_list("mean").alias("means"), F.count("*").cast("int").alias("clusters"))
    far = sum((F.pow((F.col(f) - F.col("mean")[f"m_{f}"]) / F.col(f"s_{f}"), 2) for f in factors), F.lit(0.0))
    every = found.withColumns({f"s_{f}": spread_.select(f"s_{f}").scalar() for f in factors}).withColumns(
        {"means": means.select("means").scalar(), "clusters": means.select("clusters").scalar()})
    every = every.select("*", F.explode("means").alias("mean")).withColumn("far", far)
    best = every.groupBy("entity", "clusters").agg(
        F.min("far").alias("least"), F.min(F.when(F.col("mean.other") == F.col("cluster"), F.col("far"))).alias("own"))
    return best.select("entity", (F.col("own") <= F.col("least") + 1e-9).alias("nearest"), "clusters")


@query(
    "ml_peer_anomaly",
    f"""WITH a AS (SELECT entity, subtopic, avg(x) AS own FROM ({WINDOW_SQL}) GROUP BY ALL),
    p AS (SELECT entity, subtopic, own, count(*) OVER o AS peers, avg(own) OVER o AS peer, stddev_pop(own) OVER o AS sd
      FROM a WINDOW o AS (PARTITION BY subtopic ORDER BY entity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING
        EXCLUDE CURRENT ROW))
    SELECT entity, subtopic, round(own + 1e-7, 4) AS own, round(peer + 1e-7, 4) AS peer, peers,
      round(1 - exp(-power((own - peer) / sd, 2) / 2) + 1e-7, 4) AS risk_score,
      1 - exp(-power((own - peer) / sd, 2) / 2) >= 0.8 AS flag FROM p""",
)
def ml_peer_anomaly(t):
    from rillmark.operators.stats import window_stats

    averages = window_stats(inputs.measurements(t), ["avg"])
    out = ml.peer_anomaly(averages, "entity", "subtopic", "avg", 0.8)
    places = [inputs.settle(F.col(c), 4).alias(c) for c in ("own", "peer", "risk_score")]
    return out.select("entity", "subtopic", *places, "peers", "flag")


@query(
    "ml_trend_lines",
    f"""SELECT entity, subtopic, round(regr_slope(x, k - 1) + 1e-7, 4) AS slope,
      round(regr_intercept(x, k - 1) + 1e-7, 4) AS intercept
    FROM (SELECT *, row_number() OVER (PARTITION BY entity, subtopic ORDER BY ts, msgid) AS k
      FROM ({SHIPMENT_SQL.format(n=200)})) GROUP BY entity, subtopic""",
)
def ml_trend_lines(t):
    out = ml.trend_lines(inputs.shipments(t), 200)
    return out.select("entity", "subtopic", inputs.settle(F.col("slope"), 4).alias("slope"),
                      inputs.settle(F.col("intercept"), 4).alias("intercept"))


@query(
    "ml_heat_map",
    f"""SELECT entity, subtopic, floor(x / 10000)::BIGINT AS bin, count(*) AS n FROM ({SHIPMENT_SQL.format(n=60)})
    GROUP BY ALL""",
)
def ml_heat_map(t):
    return ml.heat_map(inputs.shipments(t), 60, 10000.0)


_CENTROID_SQL = """SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(v::DOUBLE) AS m
  FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label"""
_METRIC_SQL = {
    "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], q)",
    "euclid": "list_distance(embedding::DOUBLE[], q)",
    "dot": "list_dot_product(embedding::DOUBLE[], q)",
    "manhattan": "list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: abs(z[1] - z[2])))",
}


def _nearest_query(metric: str, sql: str) -> None:
    def run(t):
        centers = vectors.label_centroids(t.embeddings, "label", "embedding", 64)
        out = vectors.nearest(t.embeddings, "vec_id", "embedding", centers, "label", metric, 3)
        return out.select("query", "vec_id", F.round("distance", 6).alias("distance"), "rank")

    way = "DESC" if metric == "dot" else "ASC"
    register(
        f"ml_nearest_{metric}",
        run,
        f"""SELECT label AS query, vec_id, round(d, 6) AS distance, rn::INTEGER AS rank FROM (
          SELECT c.label, vec_id, d, row_number() OVER (PARTITION BY c.label ORDER BY d {way}, vec_id) AS rn
          FROM (SELECT c.label, vec_id, {sql} AS d FROM embeddings, ({_CENTROID_SQL}) c) c) WHERE rn <= 3""",
    )


for _metric, _sql in _METRIC_SQL.items():
    _nearest_query(_metric, _sql)


def _search_query(metric: str, sql: str) -> None:
    """Every hundredth vector as a query against all vectors."""

    def run(t):
        queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
        out = vectors.nearest(t.embeddings, "vec_id", "embedding", queries, "q_id", metric, 5)
        return out.select("query", "vec_id", F.round("distance", 5).alias("distance"), "rank")

    way = "DESC" if metric == "dot" else "ASC"
    register(
        f"ml_search_{metric}",
        run,
        f"""SELECT query, vec_id, round(d, 5) AS distance, rn::INTEGER AS rank FROM (
          SELECT query, vec_id, d, row_number() OVER (PARTITION BY query ORDER BY d {way}, vec_id) AS rn
          FROM (SELECT c.query, vec_id, {sql} AS d FROM embeddings,
            (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0) c)) WHERE rn <= 5""",
    )


for _metric, _sql in _METRIC_SQL.items():
    _search_query(_metric, _sql)


@query(
    "ml_distance_cut",
    f"""SELECT label AS query, vec_id, rn::INTEGER AS rank FROM (SELECT c.label, vec_id,
      1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d, row_number() OVER (PARTITION BY c.label
        ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id) AS rn
      FROM embeddings, ({_CENTROID_SQL}) c) WHERE rn <= 20 AND d <= 0.8""",
)
def ml_distance_cut(t):
    centers = vectors.label_centroids(t.embeddings, "label", "embedding", 64)
    found = vectors.nearest(t.embeddings, "vec_id", "embedding", centers, "label", "cosine", 20)
    return vectors.within(found, 0.8).select("query", "vec_id", "rank")
