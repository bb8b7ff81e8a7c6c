"""Scaling and clustering of feature tables with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.functions.columns import safe_ratio
from pressgauge.operators import profiling
from pressgauge.operators.lookups import Lookup
from pressgauge.operators.profiling import with_source_name
from pressgauge.operators.topk import draw_per_group, first_per_group
from pressgauge.session import stage


@dataclass(frozen=True)
class Scale:
    """Centre and spread per feature, as fitted on one population."""

    centre: dict[str, float]
    spread: dict[str, float]


def finite(value: Column) -> Column:
    """NULL for NaN and for infinite values."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(F.isnan(value) | infinite, None).otherwise(value)


def medians(features: DataFrame, names: list[str]) -> DataFrame:
    """One row with the exact median of every feature, stored."""
    values = features.select(*[finite(F.col(n).cast("double")).alias(n) for n in names])
    return stage(profiling.medians_by(values, names, []), "medians")


def filled_with_median(features: DataFrame, names: list[str]) -> DataFrame:
    """Infinite or missing values replaced by the feature's median."""
    middle = medians(features, names)
    return features.withColumns(
        {n: F.coalesce(finite(F.col(n).cast("double")), middle.select(n).scalar()) for n in names}
    )


def standard_scale(features: DataFrame, names: list[str]) -> Scale:
    """Mean and population deviation; a constant feature keeps spread 1."""
    row = features.agg(
        *[F.avg(n).alias(f"c_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    ).first()
    return _scale(row, names)


def robust_scale(features: DataFrame, names: list[str]) -> Scale:
    """Median and interquartile range."""
    summary = profiling.six_numbers(features, names)
    # One row per feature.
    row = {}
    for r in summary.select("measure", "median", (F.col("q3") - F.col("q1")).alias("width")).collect():
        row |= {f"c_{r['measure']}": r["median"], f"s_{r['measure']}": r["width"]}
    return _scale({f"{x}_{n}": row.get(f"{x}_{n}") for n in names for x in "cs"}, names)


def _scale(row, names: list[str]) -> Scale:
    return Scale({n: row[f"c_{n}"] or 0.0 for n in names}, {n: row[f"s_{n}"] or 1.0 for n in names})


def scaled(features: DataFrame, scale: Scale, suffix: str = "") -> DataFrame:
    """Apply a fitted scale to any population."""
    return features.withColumns(
        {n + suffix: (F.col(n) - F.lit(scale.centre[n])) / F.lit(scale.spread[n]) for n in scale.centre}
    )


def fit_kmeans(features: DataFrame, names: list[str], k: int, seed: int = 42) -> PipelineModel:
    """K-means on already scaled features."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(names), outputCol="_features"),
            KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed),
        ]
    ).fit(features)


def assign(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Label rows, of the fitted population or another, with their cluster."""
    return model.transform(features).drop("_features")


def total_deviation(features: DataFrame, names: list[str]) -> DataFrame:
    """Squared deviation from the mean: the cost of a single cluster."""
    return features.agg(sum((F.var_pop(n) for n in names), F.lit(0.0)).alias("_v"), F.count(F.lit(1)).alias("_n")).select(
        (F.col("_v") * F.col("_n")).alias("inertia")
    )


def nearest(features: DataFrame, names: list[str], given: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows with their nearest given centre and the squared ``distance`` to it.

    ``given`` has a row per centre: its label and ``names``. Equal distances go
    to the smaller label. The centres, as many as clusters, are one array in
    the plan; the rows are only mapped.
    """
    place = F.struct(F.col(cluster).alias("label"), F.array(*[F.col(n).cast("double") for n in names]).alias("at"))
    centres = given.agg(F.array_sort(F.collect_list(place))).scalar()
    point = F.array(*[F.col(n).cast("double") for n in names])

    def squared(at: Column) -> Column:
        return F.aggregate(F.zip_with("_point", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)

    found = F.array_min(F.transform("_centres", lambda x: F.struct(squared(x["at"]).alias("distance"), x["label"].alias("label"))))
    return (
        features.withColumns({"_point": point, "_centres": centres})
        .withColumn("_found", found)
        .withColumns({cluster: F.col("_found.label"), "distance": F.col("_found.distance")})
        .drop("_point", "_centres", "_found")
    )


def numbered_by_member(labelled: DataFrame, member: str, cluster: str = "cluster") -> DataFrame:
    """Labels 0, 1, ... in the order of each cluster's smallest ``member``, whatever they were before."""
    first = labelled.groupBy(cluster).agg(F.min(member).alias("_first"))
    # One row per cluster.
    order = first.select(F.col(cluster), (F.row_number().over(Window.orderBy("_first")) - 1).alias("_number"))
    joined = labelled.join(order, labelled[cluster].eqNullSafe(order[cluster])).drop(order[cluster])
    return joined.withColumn(cluster, F.col("_number")).drop("_number")


def refined(features: DataFrame, names: list[str], given: DataFrame, rounds: int, cluster: str = "cluster") -> DataFrame:
    """Centres after ``rounds`` rounds of K-means from the given ones: (cluster, n, names).

    Repeatable, unlike a drawn start. Centres of a round are stored, so a plan
    never holds more than one round; a centre without rows is dropped.
    """
    for _ in range(rounds):
        given = stage(centres(nearest(features.drop(cluster), names, given, cluster), names, cluster), "centres")
    return given


def sweep(features: DataFrame, names: list[str], ks: range) -> DataFrame:
    """Cost, gain over one cluster and silhouette for each k.

    The loop runs over model sizes; each fit is a distributed job on the
    cached features.
    """
    spark = features.sparkSession
    cached = features.select(*names).persist()
    single = total_deviation(cached, names).first()["inertia"]
    rows = [(1, float(single), 0.0, None)] if 1 in ks else []
    for k in (k for k in ks if k > 1):
        model = fit_kmeans(cached, names, k)
        cost = float(model.stages[-1].summary.trainingCost)
        labelled = model.transform(cached)
        score = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(labelled)
        rows.append((k, cost, (1 - cost / single) * 100 if single else 0.0, float(score)))
    cached.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, pct_gain double, silhouette double")


def best_k(scores: DataFrame) -> int:
    return scores.filter(F.col("silhouette").isNotNull()).orderBy(F.desc("silhouette"), "k").first()["k"]


def feature_ranking(labelled: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """ANOVA F of every feature against the cluster, best first.

    Sums per cluster are enough: between = sum n_c (m_c - m)^2 and
    within = sum (n_c - 1) var_c.
    """
    tall = labelled.select(
        F.col(cluster).alias("_c"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("_v")) for n in names])),
    )
    groups = tall.groupBy("feature", "_c").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v")
    )
    n, m = F.col("n"), F.col("m")
    sums = groups.groupBy("feature").agg(
        F.sum(n).alias("N"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * m).alias("nm"),
        F.sum(n * m * m).alias("nmm"),
        F.sum(n * F.col("v")).alias("within"),
    )
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("N")
    score = safe_ratio(safe_ratio(between, F.col("k") - 1), safe_ratio(F.col("within"), F.col("N") - F.col("k")))
    return sums.select("feature", score.alias("f_score")).orderBy(F.desc("f_score"), "feature")


def centres(labelled: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """Cluster centres in the units of the given columns."""
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names])


def scaled_centres(model: PipelineModel, names: list[str], scale: Scale) -> DataFrame:
    """Centres of the fitted model, scaled and back in original units."""
    rows = [
        (i, n, float(x), float(x) * scale.spread[n] + scale.centre[n])
        for i, centre in enumerate(model.stages[-1].clusterCenters())
        for n, x in zip(names, centre)
    ]
    return SparkSession.active().createDataFrame(rows, "cluster int, feature string, scaled double, original double")


def profile(labelled: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """Size and exact median of every feature per cluster."""
    sizes = labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_sources"))
    return sizes.join(profiling.medians_by(labelled, names, [cluster]), cluster, "left")


# The thresholds of the retention rule.
@dataclass(frozen=True)
class RetentionRules:
    min_years_active: float = 10.0
    max_inactive_days: float = 0.25
    max_cv_monthly: float = 1.0
    min_log_volume: float = 7.0
    min_h_themes: float = 0.5
    min_themes_per_article: float = 18.0
    min_ratio_eco: float = 0.10
    min_h_eco: float = 0.5


# The reasons of the retention rule.
IRREGULAR = "rejected: regularity or volume"
GENERALIST = "kept: regular generalist press"
ECONOMIC = "kept: specialised economic press"
POOR = "rejected: poor or off-topic themes"


def retention(profiles: DataFrame, rules: RetentionRules = RetentionRules()) -> DataFrame:
    """Decide per cluster profile, with the reason."""
    regular = (
        (F.col("years_active") >= rules.min_years_active)
        & (F.col("inactive_days_rate") <= rules.max_inactive_days)
        & (F.col("cv_monthly") <= rules.max_cv_monthly)
        & (F.col("log_articles_per_year") >= rules.min_log_volume)
    )
    generalist = (F.col("h_norm_themes") >= rules.min_h_themes) & (
        F.col("mean_themes_per_art") >= rules.min_themes_per_article
    )
    economic = (F.col("ratio_eco") >= rules.min_ratio_eco) & (F.col("h_norm_eco_themes") >= rules.min_h_eco)
    reason = F.when(~regular, IRREGULAR).when(generalist, GENERALIST).when(economic, ECONOMIC).otherwise(POOR)
    return profiles.withColumn("reason", reason).withColumn("kept", F.col("reason").startswith("kept"))


def split_by_clusters(
    labelled: DataFrame, kept: list[int], cluster: str = "cluster"
) -> tuple[DataFrame, DataFrame]:
    inside = F.col(cluster).isin(kept)
    return labelled.filter(inside), labelled.filter(~inside)


def cluster_report(
    labelled: DataFrame, dictionary: Lookup, measures: list[str], names: int = 20, cluster: str = "cluster"
) -> DataFrame:
    """Sources, articles, mean measures, shares and the biggest names."""
    named = with_source_name(labelled, dictionary, "inner")
    stats = named.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("total_articles").alias("articles"),
        *[F.avg(m).alias(m) for m in measures],
    )
    sources, articles = (stats.agg(F.sum(x)).scalar() for x in ("sources", "articles"))
    biggest = first_per_group(named, [cluster], [F.desc("total_articles"), F.col("SourceCommonName")], names)
    listed = biggest.groupBy(cluster).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("total_articles")).alias("o"), "SourceCommonName"))),
                lambda x: x["SourceCommonName"],
            ),
            ", ",
        ).alias("examples")
    )
    return (
        stats.join(listed, cluster)
        .withColumn("pct_sources", safe_ratio(F.col("sources"), sources) * 100)
        .withColumn("pct_articles", safe_ratio(F.col("articles"), articles) * 100)
    )


def drawn_sources(labelled: DataFrame, n: int = 30, seed: int | None = None, cluster: str = "cluster") -> DataFrame:
    """Up to ``n`` sources per (cluster, registry flag)."""
    return draw_per_group(labelled, [cluster, "is_wiki"], n, "Src_ID", seed)


def measure_percentiles(features: DataFrame, names: list[str], levels: tuple[float, ...]) -> DataFrame:
    tall = features.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("v")) for n in names]))
    )
    return profiling.selected_quantiles(profiling.value_ranges(tall, "v", ["measure"]), "v", levels, ["measure"])

