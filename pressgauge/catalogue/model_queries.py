"""Scaling, clustering, lagged regressions, the theme graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.feature_queries import feature_table
from pressgauge.catalogue.indicator_queries import NAMES, SERIES
from pressgauge.catalogue.profile_queries import final
from pressgauge.catalogue.registry import r6, register, rounded
from pressgauge.catalogue.series_queries import MONTHLY_NAMES, REGION, filled_days, panel, zscore_sql
from pressgauge.catalogue.sql import add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.operators import cleaning, clusters, features, graph, regression
from pressgauge.operators import indicators as ind
from pressgauge.operators.lookups import stage_lookup
from pressgauge.plans import runs

USED = ["cv_monthly", "cv_yearly", "inactive_days_rate", "mean_wordcount", "cv_wordcount", "mean_themes_per_art", "ratio_eco"]


def stored_features(t):
    """The feature table as the source run stores it."""
    if "_features" not in t.__dict__:
        t.__dict__["_features"] = stage_lookup(feature_table(t), "features").frame
    return t.__dict__["_features"]


# -- Scaling -----------------------------------------------------------------


@register(
    "ml01_median_fill",
    query(
        f"SELECT Src_ID, {sql6('coalesce(ratio, (SELECT median(ratio) FROM broken))')} AS ratio FROM broken", "features",
        broken="SELECT Src_ID, CASE WHEN Src_ID % 3 = 0 THEN NULL ELSE mean_wordcount END AS ratio FROM features",
    ),
)
def median_fill(t):
    # Infinite and missing values, as a division would leave them.
    broken = F.when(F.col("Src_ID") % 6 == 0, F.lit(float("inf"))).when(F.col("Src_ID") % 3 == 0, F.lit(float("nan")))
    table = stored_features(t).select("Src_ID", broken.otherwise(F.col("mean_wordcount")).alias("ratio"))
    return rounded(clusters.filled_with_median(table, ["ratio"]), "ratio")


def scaled_sql(centre, spread):
    columns = ", ".join(f"{sql6(f'(f.{n} - s.c_{n}) / s.s_{n}')} AS {n}" for n in USED)
    fitted = ", ".join(f"{centre.format(n)} AS c_{n}, coalesce(nullif({spread.format(n)}, 0), 1) AS s_{n}" for n in USED)
    return query(
        f"SELECT Src_ID, is_wiki, {columns} FROM features f, (SELECT {fitted} FROM features WHERE is_wiki = 1) s", "features"
    )


@register("ml02_standard_scale", scaled_sql("avg({0})", "stddev_pop({0})"))
def standard_scale(t):
    table = stored_features(t).select("Src_ID", "is_wiki", *USED)
    scale = clusters.standard_scale(table.filter(F.col("is_wiki") == 1), USED)
    return rounded(clusters.scaled(table, scale), *USED)


@register("ml03_robust_scale", scaled_sql("median({0})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def robust_scale(t):
    table = stored_features(t).select("Src_ID", "is_wiki", *USED)
    scale = clusters.robust_scale(table.filter(F.col("is_wiki") == 1), USED)
    return rounded(clusters.scaled(table, scale), *USED)


# -- K-means (labels are arbitrary, so there is no SQL) ----------------------


def fitted(t, k=3):
    table = clusters.filled_with_median(stored_features(t), USED)
    known = table.filter(F.col("is_wiki") == 1)
    scale = clusters.robust_scale(known, USED)
    return table, scale, clusters.fit_kmeans(clusters.scaled(known, scale), USED, k)


@register("ml04_kmeans_labels")
def kmeans_labels(t):
    table, scale, model = fitted(t)
    known = table.filter(F.col("is_wiki") == 1)
    return clusters.assign(clusters.scaled(known, scale), model).select("Src_ID", "cluster")


@register("ml05_k_sweep")
def k_sweep(t):
    vectors = t.read("embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return clusters.sweep(vectors, vectors.columns, range(1, 6))


@register(
    "ml05_single_cluster_cost",
    f"""SELECT {sql6('sum(v)')} AS inertia FROM (SELECT i, var_pop(x) * count(*) AS v
        FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY i)""",
)
def single_cluster_cost(t):
    vectors = t.read("embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(clusters.total_deviation(vectors, vectors.columns), "inertia")


# K-means from given centres is repeatable, so SQL can follow it round by round.
def nearest_sql(name, table="vectors"):
    return f"""SELECT vec_id, arg_min(label, (d, label)) AS label, min(d) AS d FROM (
      SELECT v.vec_id, c.label, sum((v.x - c.x) * (v.x - c.x)) AS d FROM {table} v JOIN {name} c USING (i) GROUP BY ALL) GROUP BY 1"""


ROUNDS = 2
LLOYD = {"vectors": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings WHERE label IS NOT NULL"}
LLOYD["centres_0"] = "SELECT label, i, avg(x) AS x FROM vectors GROUP BY ALL"
for _round in range(ROUNDS + 1):
    LLOYD[f"near_{_round}"] = nearest_sql(f"centres_{_round}")
    if _round < ROUNDS:
        LLOYD[f"centres_{_round + 1}"] = (
            f"SELECT n.label, i, avg(x) AS x FROM vectors v JOIN near_{_round} n USING (vec_id) GROUP BY ALL"
        )


def labelled_vectors(t):
    vectors = t.read("embeddings").filter("label IS NOT NULL")
    return vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMENSIONS)])


@register(
    "ml04_nearest_centres",
    query(
        f"""SELECT vec_id, CAST(number AS INTEGER) AS cluster, {sql6('d')} AS distance FROM near_{ROUNDS} JOIN (
        SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS number FROM near_{ROUNDS} GROUP BY 1) USING (label)""", **LLOYD,
    ),
)
def nearest_centres(t):
    vectors = labelled_vectors(t)
    refined = clusters.refined(vectors, DIMENSIONS, clusters.centres(vectors, DIMENSIONS, "label"), ROUNDS, "label")
    near = clusters.nearest(vectors.drop("label"), DIMENSIONS, refined, "label").select("vec_id", F.col("label").alias("cluster"), "distance")
    return rounded(clusters.numbered_by_member(near, "vec_id"), "distance")


@register(
    "ml05_cost_by_round",
    query(
        " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS round, {sql6('avg(d)')} AS mean_cost FROM near_{r}" for r in range(ROUNDS + 1)),
        **LLOYD,
    ),
)
def cost_by_round(t):
    vectors = labelled_vectors(t)
    given, rows = clusters.centres(vectors, DIMENSIONS, "label"), None
    for r in range(ROUNDS + 1):
        one = clusters.nearest(vectors.drop("label"), DIMENSIONS, given, "label").agg(F.lit(r).alias("round"), F.avg("distance").alias("mean_cost"))
        rows = one if rows is None else rows.unionByName(one)
        given = clusters.refined(vectors, DIMENSIONS, given, 1, "label") if r < ROUNDS else given
    return rounded(rows, "mean_cost")


@register("ml06_projected_labels")
def projected_labels(t):
    table, scale, model = fitted(t)
    others = table.filter(F.col("is_wiki") == 0)
    return clusters.assign(clusters.scaled(others, scale), model).select("Src_ID", "cluster")


DIMENSIONS = [f"e{i}" for i in range(64)]


@register(
    "ml07_feature_ranking",
    query(
        f"""SELECT 'e' || i AS feature, {sql6('((nmm - nm * nm / n) / (k - 1)) / (within / (n - k))')} AS f_score FROM (
        SELECT i, sum(c) AS n, count(*) AS k, sum(c * m) AS nm, sum(c * m * m) AS nmm, sum(c * v) AS within FROM (
          SELECT i, label, count(*) AS c, avg(x) AS m, var_pop(x) AS v FROM (
            SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY i)""",
    ),
)
def feature_ranking(t):
    vectors = t.read("embeddings").select(
        "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMENSIONS)]
    )
    return rounded(clusters.feature_ranking(vectors, DIMENSIONS, "label"), "f_score")


@register("ml08_word_profile_clusters")
def word_profile_clusters(t):
    names = ["avg_wordcount", "cv_wordcount", "log_volume"]
    rows = features.word_stats(cleaning.with_source(cleaning.dated(t.gkg), t.dictionary))
    table = rows.withColumn("log_volume", F.log10("total_articles"))
    scaled = clusters.scaled(table, clusters.standard_scale(table, names))
    return clusters.assign(scaled, clusters.fit_kmeans(scaled, names, 4)).select("Src_ID", "cluster")


@register("ml09_scaled_centres")
def scaled_centres(t):
    _, scale, model = fitted(t)
    return clusters.scaled_centres(model, USED, scale)


@register(
    "ml09_label_centres",
    query(
        f"SELECT label, count(*) AS n, {', '.join(f'{sql6(f'avg(embedding[{i + 1}])')} AS e{i}' for i in range(64))} FROM embeddings GROUP BY 1"
    ),
)
def label_centres(t):
    names = [f"e{i}" for i in range(64)]
    vectors = t.read("embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(clusters.centres(vectors, names, "label"), *names)


# -- Regressions -------------------------------------------------------------

LAGS = list(range(-6, 7))
MODELS = {"sectors": list(MONTHLY_NAMES)}
TARGET = "macro_yoy"
BY_REGION = "PARTITION BY region_key ORDER BY period"


def shifted(value, lag):
    return f"{'lag' if lag >= 0 else 'lead'}({value}, {abs(lag)}) OVER ({BY_REGION})"


def stored_panel(t):
    """The aligned monthly panel, stored once for the many fits."""
    if "_panel" not in t.__dict__:
        t.__dict__["_panel"] = stage_lookup(panel(t), "panel").frame
    return t.__dict__["_panel"]


DESIGN = [f"{n}||{lag}" for n in MONTHLY_NAMES for lag in (-1, 0, 1, 2)]


@register(
    "rg01_lagged_design",
    query(
        f"SELECT region_key, period, {sql6('macro_yoy')} AS macro_yoy, " + ", ".join(f'{sql6(chr(34) + d + chr(34))} AS "{d}"' for d in DESIGN)
        + " FROM (SELECT region_key, period, macro_yoy, " + ", ".join(
            f'{shifted(n, lag)} AS "{n}||{lag}"' for n in MONTHLY_NAMES for lag in (-1, 0, 1, 2)) + " FROM panel) WHERE "
        + " AND ".join(f'"{d}" IS NOT NULL' for d in DESIGN), "panel",
    ),
)
def lagged_design(t):
    design = regression.lagged_design(stored_panel(t), list(MONTHLY_NAMES), TARGET, REGION, "period", range(-1, 3))
    return design.select("region_key", "period", r6(TARGET).alias(TARGET), *[r6(F.col(f"`{d}`")).alias(d) for d in DESIGN])


def rows_of(t, models=MODELS, lags=LAGS, inertia=True):
    return regression.design_rows(stored_panel(t), models, TARGET, REGION, "period", lags, inertia)


@register("rg02_all_lags_lasso")
def all_lags_lasso(t):
    wide = regression.lagged_design(stored_panel(t), list(MONTHLY_NAMES), TARGET, REGION, "period", range(-6, 7))
    names = [c for c in wide.columns if "||" in c]
    rows = regression.design_rows(wide, {"all_lags": names}, TARGET, REGION, "period", [0], False)
    return regression.lasso_fits(rows, REGION, "period")


@register("rg03_lasso_per_lag")
def lasso_per_lag(t):
    return regression.lasso_fits(rows_of(t, inertia=False), REGION, "period", 15)


# Rows and features follow from the panel; that every fit is the optimum of its penalty is measured from the rows.
@register(
    "rg03_lasso_certificates",
    query(
        " UNION ALL ".join(
            f"""SELECT region_key, CAST({lag} AS INTEGER) AS lag, count(*) AS n_rows, CAST({len(MONTHLY_NAMES)} AS BIGINT) AS n_features, true AS optimal
            FROM (SELECT region_key, {shifted('macro_yoy', lag)} AS past FROM panel WHERE {' AND '.join(f'{n} IS NOT NULL' for n in MONTHLY_NAMES)})
            WHERE past IS NOT NULL GROUP BY 1 HAVING count(*) >= 15"""
            for lag in LAGS
        ),
        "panel",
    ),
)
def lasso_certificates(t):
    rows = rows_of(t, inertia=False)
    proofs = regression.lasso_certificates(rows, regression.lasso_fits(rows, REGION, "period", 15), REGION)
    return proofs.select("region_key", "lag", "n_rows", "n_features", (F.col("breach") < 1e-6).alias("optimal"))


# A model of one series has a closed form: the whole cross-validation and the p-value are plain SQL.
SINGLE_LAGS = [0, 1, 2, 3]
add("single_rows", ("panel",), "SELECT *, row_number() OVER (PARTITION BY region_key, model, lag ORDER BY period) - 1 AS i, "
    "count(*) OVER (PARTITION BY region_key, model, lag) AS n FROM (" + " UNION ALL ".join(
        f"SELECT region_key, period, '{n}' AS model, CAST({lag} AS INTEGER) AS lag, macro_yoy AS y, {shifted(n, lag)} AS x FROM panel WHERE {n} IS NOT NULL"
        for n in MONTHLY_NAMES for lag in SINGLE_LAGS) + ") WHERE x IS NOT NULL")
FIT = "region_key, model, lag"
SUMS = ", ".join(f"sum({v}) AS {a}" for v, a in (("1.0::DOUBLE", "c"), ("x", "sx"), ("y", "sy"), ("x * x", "sxx"), ("x * y", "sxy"), ("y * y", "syy")))


@register(
    "rg03_single_series_lasso",
    query(
        f"""SELECT {FIT}, n AS n_rows, {sql6('alpha')} AS alpha, {sql6('w')} AS coef,
        {sql6('CASE WHEN w = 0 THEN 1.0 ELSE tail END')} AS p_value FROM chosen JOIN tails USING ({FIT})""",
        "single_rows",
        parts=f"""SELECT {FIT}, n, fold, {SUMS} FROM (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
          ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM single_rows WHERE n >= 20) GROUP BY ALL""",
        whole=f"""SELECT *, CASE WHEN d < 1e-12 THEN 1.0 ELSE d END AS s FROM (
          SELECT {FIT}, n, sum(c) AS tc, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy, sum(syy) AS tyy, sum(sx) / sum(c) AS m,
          sqrt(greatest(sum(sxx) / sum(c) - (sum(sx) / sum(c)) ** 2, 0)) AS d FROM parts GROUP BY ALL)""",
        penalties=f"""SELECT {FIT}, k, abs((txy / tc - m * ty / tc) / s) * power(10.0, -3.0 * k / 99) AS alpha
          FROM whole, (SELECT unnest(range(100)) AS k)""",
        without=f"""SELECT {FIT}, fold, c, sx, sy, sxx, sxy, syy, m, s, (tx - sx) / (tc - c) AS ox, (ty - sy) / (tc - c) AS oy,
          ((txx - sxx) / (tc - c) - ((tx - sx) / (tc - c)) ** 2) / (s * s) AS xx,
          ((txy - sxy) / (tc - c) - (tx - sx) / (tc - c) * (ty - sy) / (tc - c)) / s AS xy FROM parts JOIN whole USING ({FIT})""",
        weighted=f"""SELECT *, CASE WHEN xx > 1e-12 THEN sign(xy) * greatest(abs(xy) - alpha, 0) / xx ELSE 0 END / s AS b
          FROM without JOIN penalties USING ({FIT})""",
        errors=f"""SELECT {FIT}, k, alpha, avg((syy - 2 * a * sy - 2 * b * sxy + a * a * c + 2 * a * b * sx + b * b * sxx) / c) AS e
          FROM (SELECT *, oy - b * ox AS a FROM weighted) GROUP BY ALL""",
        chosen=f"""SELECT w.*, alpha, sign(xy) * greatest(abs(xy) - alpha, 0) / greatest(xx, 1e-12) AS w FROM (
            SELECT *, (txy / tc - m * ty / tc) / s AS xy, (txx / tc - m * m) / (s * s) AS xx FROM whole) w
          JOIN (SELECT {FIT}, arg_min(alpha, (round(e, 12), k)) AS alpha FROM errors GROUP BY ALL) USING ({FIT})""",
        # Student's t tail by Simpson's rule over the angle atan(t / sqrt(df)).
        slopes=f"""SELECT {FIT}, n - 2 AS df, atan(abs(b) / sqrt(greatest((tyy - ty * ty / tc) / vx - b * b, 1e-300))) AS low FROM (
            SELECT *, (txy - tx * ty / tc) / (txx - tx * tx / tc) AS b, txx - tx * tx / tc AS vx FROM whole)""",
        tails=f"""SELECT {FIT}, sum(f * (pi() / 2 - low) * cos(low + (pi() / 2 - low) * j / 400) ** (df - 1))
            / sum(f * pi() / 2 * cos(pi() / 2 * j / 400) ** (df - 1)) AS tail
          FROM slopes, (SELECT j, CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS f FROM (SELECT unnest(range(401)) AS j)) GROUP BY ALL""",
    ),
)
def single_series_lasso(t):
    rows = rows_of(t, {n: [n] for n in MONTHLY_NAMES}, SINGLE_LAGS, False)
    fits = regression.lasso_fits(rows, REGION, "period").drop("feature")
    return rounded(fits, "alpha", "coef", "p_value")


@register("rg03_lasso_with_inertia")
def lasso_with_inertia(t):
    return regression.lasso_fits(rows_of(t), REGION, "period")


@register("rg03_coefficient_table")
def coefficient_table(t):
    return regression.coefficient_table(regression.lasso_fits(rows_of(t), REGION, "period"), REGION, LAGS)


def full_panel(t):
    """Sectors and their categories beside the macro change."""
    names = ind.pivot_names(t.taxonomy)
    return runs.monthly_panel(t.regional_indicators, t.macro, "att", names), names


def competing_sets(names):
    return {p: [n for n in names if n.startswith(f"{p}_")] for p in MONTHLY_NAMES}


def stored_full_panel(t):
    if "_full_panel" not in t.__dict__:
        wide, names = full_panel(t)
        t.__dict__["_full_panel"] = stage_lookup(wide, "full-panel").frame, names
    return t.__dict__["_full_panel"]


# Every competing set aligned alone: its rows, and sums of target and shifted features.
SETS = {"sectors": list(MONTHLY_NAMES)} | competing_sets(NAMES)
SET_LAGS = (-2, 0, 3)
add("full_attention", ("geo_indicators",), "SELECT region_key, CAST(date_trunc('month', period) AS DATE) AS month, " + ", ".join(
    f"avg({n}) AS {n}" for n in NAMES) + " FROM (SELECT period, region_key, " + ", ".join(
    f"max(att) FILTER (sector = '{s}' AND granularity = '{c or ind.SECTOR_ROW}') AS {n}" for (s, c), n in zip(SERIES, NAMES, strict=True)
) + " FROM geo_indicators GROUP BY 1, 2) GROUP BY 1, 2")
add("full_panel", ("full_attention", "macro_yoy"), """
    SELECT z.*, macro_yoy FROM (SELECT region_key, period, """ + ", ".join(f"{zscore_sql(n)} AS {n}" for n in NAMES) + """ FROM (
      SELECT region_key, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period
      FROM (SELECT region_key, min(month) AS a, max(month) AS b FROM full_attention GROUP BY 1))
      LEFT JOIN (SELECT * RENAME (month AS period) FROM full_attention) USING (region_key, period)) z
    JOIN macro_yoy USING (region_key, period) WHERE macro_yoy IS NOT NULL""")


@register(
    "rg04_set_alignment",
    query(
        " UNION ALL ".join(
            f"SELECT region_key, '{model}' AS model, CAST({lag} AS INTEGER) AS lag, count(*) AS n_rows, {sql6('sum(macro_yoy)')} AS sum_y, "
            f"{sql6('sum(x)')} AS sum_x FROM (SELECT region_key, macro_yoy, {shifted(' + '.join(features), lag)} AS x FROM full_panel WHERE "
            + " AND ".join(f"{n} IS NOT NULL" for n in features) + ") WHERE x IS NOT NULL GROUP BY 1"
            for model, features in SETS.items() for lag in SET_LAGS
        ),
        "full_panel",
    ),
)
def set_alignment(t):
    stored, names = stored_full_panel(t)
    sets = {"sectors": list(MONTHLY_NAMES)} | competing_sets(names)
    rows = regression.design_rows(stored, sets, TARGET, REGION, "period", list(SET_LAGS), False)
    sums = rows.groupBy(*REGION, "model", "lag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("sum_y"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("sum_x")
    )
    return rounded(sums, "sum_y", "sum_x")


@register("rg04_hierarchical_selection")
def hierarchical_selection(t):
    stored, names = stored_full_panel(t)
    children = competing_sets(names)
    return regression.hierarchical_selection(stored, list(MONTHLY_NAMES), children, TARGET, REGION, "period", LAGS)


@register("rg05_isolated_winners")
def isolated_winners(t):
    return regression.isolated_winners(stored_panel(t), list(MONTHLY_NAMES), TARGET, REGION, "period", LAGS, 2)


add("simple", ("panel",), " UNION ALL ".join(
    f"SELECT region_key, '{n}' AS model, {lag} AS lag, macro_yoy AS y, {shifted(n, lag)} AS x FROM panel"
    for n in MONTHLY_NAMES for lag in (0, 1, 2, 3)))


@register(
    "rg05_single_feature_fits",
    query(
        f"""SELECT region_key, model, lag, count(*) AS n_rows, {sql6('regr_slope(y, x)')} AS slope, {sql6('regr_intercept(y, x)')} AS intercept,
        {sql6('regr_r2(y, x)')} AS r2 FROM simple WHERE x IS NOT NULL GROUP BY 1, 2, 3""", "simple",
    ),
)
def single_feature_fits(t):
    rows = rows_of(t, {n: [n] for n in MONTHLY_NAMES}, [0, 1, 2, 3], False)
    return rounded(regression.simple_fits(rows, REGION), "slope", "intercept", "r2")


@register("rg06_hold_out_errors")
def hold_out_errors(t):
    return regression.hold_out_errors(rows_of(t, lags=[1, 2, 3]), REGION, "period")


# The naive half of the forecast test is one regression, which SQL has.
@register(
    "rg06_naive_forecast_error",
    query(
        f"""SELECT region_key, count(*) FILTER (NOT train) AS n_test,
        {sql6('sqrt(avg((y - b0 - b1 * x) * (y - b0 - b1 * x)) FILTER (NOT train))')} AS rmse_naive
        FROM parts JOIN (SELECT region_key, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM parts WHERE train GROUP BY 1) USING (region_key)
        GROUP BY 1 HAVING count(*) >= 20""", "panel",
        parts=f"""SELECT *, row_number() OVER ({BY_REGION}) <= floor(count(*) OVER (PARTITION BY region_key) * 0.75) AS train
          FROM (SELECT region_key, period, macro_yoy AS y, lag(macro_yoy, 2) OVER ({BY_REGION}) AS x FROM panel) WHERE x IS NOT NULL""",
    ),
)
def naive_forecast_error(t):
    errors = regression.hold_out_errors(rows_of(t, lags=[2]), REGION, "period")
    return rounded(errors.select("region_key", "n_test", "rmse_naive"), "rmse_naive")


@register("rg07_ranked_regions")
def ranked_regions(t):
    return regression.rank_regions(regression.hold_out_errors(rows_of(t, lags=[2]), REGION, "period"))


@register("rg08_rolling_ridge")
def rolling_ridge(t):
    return regression.rolling_ridge(rows_of(t, lags=[1]), len(MONTHLY_NAMES) + 1, REGION, "period")


# With one series the ridge coefficient is a ratio of window sums.
@register(
    "rg08_single_series_ridge",
    query(
        f"""SELECT {FIT}, period, {sql6('(sxy - sx * sy / 48) / s / ((sxx - sx * sx / 48) / (s * s) + 1)')} AS coef FROM (
          SELECT *, CASE WHEN d < 1e-12 THEN 1.0 ELSE d END AS s FROM (
            SELECT *, sqrt(greatest(sxx / 48 - (sx / 48) ** 2, 0)) AS d FROM (
              SELECT {FIT}, period, {SUMS.replace(') AS', ') OVER w AS')}, lead(y) OVER (PARTITION BY {FIT} ORDER BY period) AS later
              FROM single_rows WHERE lag = 1 WINDOW w AS (PARTITION BY {FIT} ORDER BY period ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
            WHERE c = 48 AND later IS NOT NULL))""",
        "single_rows",
    ),
)
def single_series_ridge(t):
    rows = rows_of(t, {n: [n] for n in MONTHLY_NAMES}, [1], False)
    return rounded(regression.rolling_ridge(rows, 1, REGION, "period").drop("feature"), "coef")


@register("ts06_partial_autocorrelation")
def partial_autocorrelation(t):
    return regression.partial_autocorrelation(filled_days(t), "y", [], "day")


# Order 1 and 2 follow in closed form from ordinary regressions.
@register(
    "ts06_first_order",
    query(f"SELECT {sql6('regr_slope(y, x)')} AS pacf FROM (SELECT y, lag(y) OVER (ORDER BY day) AS x FROM filled_days)", "filled_days"),
)
def first_order(t):
    values = regression.partial_autocorrelation(filled_days(t), "y", [], "day", 3)
    return rounded(values.filter(F.col("lag") == 1).select("pacf"), "pacf")


# -- Graph -------------------------------------------------------------------

THRESHOLD = 5
add("all_edges", ("final",), """
    SELECT a.year, a.theme AS src, b.theme AS dst, CAST(sum(a.n * b.n) AS BIGINT) AS weight
    FROM (SELECT GKGRECORDID, substr(DATE, 1, 4) AS year, split_part(trim(p), ',', 1) AS theme, count(*) AS n
          FROM (SELECT GKGRECORDID, DATE, unnest(string_split(EnhancedThemes, ';')) AS p FROM final) GROUP BY 1, 2, 3) a
    JOIN (SELECT GKGRECORDID, split_part(trim(p), ',', 1) AS theme, count(*) AS n
          FROM (SELECT GKGRECORDID, unnest(string_split(EnhancedThemes, ';')) AS p FROM final) GROUP BY 1, 2) b
      ON a.GKGRECORDID = b.GKGRECORDID AND a.theme < b.theme
    GROUP BY 1, 2, 3""")
add("edges", ("all_edges",), f"SELECT * FROM all_edges WHERE weight > {THRESHOLD}")


@register("gr01_cooccurrence", query("SELECT * FROM edges", "edges"))
def cooccurrence(t):
    return graph.cooccurrence(final(t), THRESHOLD)


@register("jn10_theme_pairs", query("SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM all_edges GROUP BY 1, 2", "all_edges"))
def theme_pairs(t):
    edges = graph.cooccurrence(final(t), 0)
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@register(
    "gr01_strongest_edges",
    query(
        "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY weight DESC, src, dst) AS r FROM edges) WHERE r <= 25",
        "edges",
    ),
)
def strongest_edges(t):
    return graph.strongest_edges(graph.cooccurrence(final(t), THRESHOLD))


# Communities of all edges above a threshold high enough that there is more than one.
STRONG = 60


@register(
    "gr02_components",
    query(
        "SELECT node, min(label) AS component FROM reach GROUP BY 1", "all_edges",
        links=f"SELECT src, dst FROM all_edges WHERE weight > {STRONG} UNION SELECT dst, src FROM all_edges WHERE weight > {STRONG}",
        reach="SELECT src AS node, src AS label FROM links UNION SELECT l.dst, r.label FROM reach r JOIN links l ON l.src = r.node",
    ),
)
def components(t):
    return graph.components(graph.cooccurrence(final(t), STRONG))
