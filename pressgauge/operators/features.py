"""Feature table per news source.

All article-level work is two aggregations: one to (source, day) and one to
(source, theme). Everything else is derived from those small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.session import stage

FEATURES = (
    "years_active",
    "log_articles_per_year",
    "cv_monthly",
    "cv_yearly",
    "inactive_days_rate",
    "mean_wordcount",
    "cv_wordcount",
    "mean_themes_per_art",
    "ratio_eco",
    "h_norm_themes",
    "h_norm_eco_themes",
)


def _distinct_themes() -> Column:
    themes = F.col("EnhancedThemes")
    keys = F.array_distinct(F.transform(c.pieces(themes), c.raw_theme_key))
    return F.when(themes.isNull() | (themes == ""), 0).otherwise(F.size(keys))


def daily_activity(articles: DataFrame, keys: tuple[str, ...] = ("Src_ID",)) -> DataFrame:
    """Sums per source and day that every article-level feature rolls up from."""
    words = F.col("WordCount").cast("long")
    return articles.groupBy(*keys, c.day_of(F.col("DATE")).alias("period")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("WordCount").alias("n_words"),
        F.sum(words).alias("words"),
        F.sum(words * words).alias("words2"),
        F.sum(_distinct_themes()).alias("themes"),
    )


def daily_counts(articles: DataFrame, keys: tuple[str, ...] = ("Src_ID",)) -> DataFrame:
    return articles.groupBy(*keys, c.day_of(F.col("DATE")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def coefficient(deviation: Column, mean: Column) -> Column:
    """Deviation / mean, 0 where the mean is not positive."""
    return F.when(mean > 0, deviation / F.nullif(mean, F.lit(0.0))).otherwise(F.lit(0.0))


def _sample_deviation(n: Column, total: Column, squares: Column) -> Column:
    spread = squares.cast("double") - c.safe_ratio(total.cast("double") * total.cast("double"), n)
    return F.when(n > 1, F.sqrt(F.greatest(c.safe_ratio(spread, n - 1), F.lit(0.0))))


def _lifespan_stats(total: Column, squares: Column, span: Column) -> tuple[Column, Column]:
    """(mean, deviation) over a lifespan in which silent periods count as 0."""
    mean = c.safe_ratio(total, span)
    return mean, F.sqrt(F.greatest(c.safe_ratio(squares, span) - mean * mean, F.lit(0.0)))


def base_stats(daily: DataFrame, keys: tuple[str, ...] = ("Src_ID",)) -> DataFrame:
    """Articles, word-count mean and CV, distinct themes per article."""
    # Squares fit a long per day, but not over the years of a large source.
    squares = F.sum(F.col("words2").cast("decimal(38,0)")).cast("double").alias("words2")
    sums = daily.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("n", "n_words", "words", "themes")], squares)
    mean = c.safe_ratio(F.col("words"), F.col("n_words"))
    deviation = _sample_deviation(F.col("n_words"), F.col("words"), F.col("words2"))
    return sums.select(
        *keys,
        F.col("n").alias("total_articles"),
        mean.alias("mean_wordcount"),
        coefficient(deviation, mean).alias("cv_wordcount"),
        c.safe_ratio(F.col("themes"), F.col("n")).alias("mean_themes_per_art"),
    )


def word_stats(articles: DataFrame, more_than: int = 50) -> DataFrame:
    """Word-count profile with the population deviation, larger sources only."""
    words = F.col("WordCount").cast("double")
    return (
        articles.filter(F.col("WordCount").isNotNull())
        .groupBy("Src_ID")
        .agg(
            F.count(F.lit(1)).alias("total_articles"),
            F.avg(words).alias("avg_wordcount"),
            F.stddev_pop(words).alias("stddev_wordcount"),
        )
        .filter(F.col("total_articles") > more_than)
        .withColumn("cv_wordcount", coefficient(F.col("stddev_wordcount"), F.col("avg_wordcount")))
    )


def temporal_stats(daily: DataFrame, keys: tuple[str, ...] = ("Src_ID",)) -> DataFrame:
    """Dispersion of output at day, month and year grain over the lifespan.

    Days roll up to months, months to years, years to the source. The rows are
    placed by source once (at most one row per source and day), so the three
    roll-ups move nothing further.
    """
    n = F.col("n")
    square = n.cast("double") * n.cast("double")
    placed = daily.select(*keys, "period", "n").repartition(*[F.col(k) for k in keys])
    months = placed.groupBy(*keys, F.trunc("period", "MM").alias("month")).agg(
        F.sum("n").alias("n"),
        F.sum(square).alias("day_squares"),
        F.count(F.lit(1)).alias("days"),
        F.min("period").alias("first_seen"),
        F.max("period").alias("last_seen"),
    )
    years = months.groupBy(*keys, F.year("month").alias("year")).agg(
        F.sum("n").alias("n"),
        F.sum(square).alias("month_squares"),
        F.sum("day_squares").alias("day_squares"),
        F.sum("days").alias("days"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    source = years.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(square).alias("year_squares"),
        F.sum("month_squares").alias("month_squares"),
        F.sum("day_squares").alias("day_squares"),
        F.sum("days").alias("active_days"),
        F.count(F.lit(1)).alias("years_active"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    first, last = F.col("first_seen"), F.col("last_seen")
    span_days = F.datediff(last, first) + 1
    span_months = F.months_between(F.trunc(last, "MM"), F.trunc(first, "MM")).cast("int") + 1
    span_years = F.year(last) - F.year(first) + 1
    stats = {
        "daily": _lifespan_stats(n, F.col("day_squares"), span_days),
        "monthly": _lifespan_stats(n, F.col("month_squares"), span_months),
        "yearly": _lifespan_stats(n, F.col("year_squares"), span_years),
    }
    return source.select(
        *keys,
        n.alias("total_articles"),
        "years_active",
        span_days.alias("lifespan_days"),
        span_months.alias("lifespan_months"),
        span_years.alias("lifespan_years"),
        (1.0 - c.safe_ratio(F.col("active_days"), span_days)).alias("inactive_days_rate"),
        *[
            x
            for grain, (mean, deviation) in stats.items()
            for x in (
                mean.alias(f"avg_{grain}"),
                deviation.alias(f"stddev_{grain}"),
                coefficient(deviation, mean).alias(f"cv_{grain}"),
            )
        ],
    )


def theme_frequencies(articles: DataFrame, keys: tuple[str, ...] = ("Src_ID",)) -> DataFrame:
    """Mentions per source and theme, with the economic flag."""
    present = articles.filter(F.col("EnhancedThemes").isNotNull() & (F.col("EnhancedThemes") != ""))
    return (
        present.select(*keys, F.explode(c.pieces(F.col("EnhancedThemes"))).alias("_p"))
        .filter(F.col("_p") != "")
        .groupBy(*keys, c.raw_theme_key(F.col("_p")).alias("theme"))
        .agg(F.count(F.lit(1)).alias("freq"))
        .withColumn("is_eco", F.when(c.is_economic(F.col("theme")), 1).otherwise(0))
    )


def theme_entropy(frequencies: DataFrame, population: str | None = None) -> DataFrame:
    """Share and normalised entropy of (economic) themes per source.

    With f the frequencies and T their sum, the entropy is
    ``ln T - sum(f ln f) / T``: one pass, no join with the totals. It is
    divided by the log of the number of distinct themes in the population.
    """
    group = ["Src_ID"] if population is None else ["Src_ID", population]
    freq, eco = F.col("freq").cast("double"), F.col("is_eco") == 1
    plain = freq * F.ln(freq)
    sums = frequencies.groupBy(*group).agg(
        F.sum("freq").alias("total"),
        F.sum(plain).alias("f_ln_f"),
        F.sum(F.when(eco, F.col("freq")).otherwise(0)).alias("eco_total"),
        F.sum(F.when(eco, plain).otherwise(0.0)).alias("eco_f_ln_f"),
    )
    # Distinct themes first, per population: at most two rows are broadcast.
    distinct = frequencies.select(*group[1:], "theme", "is_eco").distinct()
    sizes = distinct.groupBy(*group[1:]).agg(
        F.count(F.lit(1)).alias("themes"), F.sum("is_eco").alias("eco_themes")
    )
    if population is None:
        joined = sums.withColumns({x: sizes.select(x).scalar() for x in ("themes", "eco_themes")})
    else:
        joined = sums.join(F.broadcast(sizes), population)

    def entropy(total: str, f_ln_f: str, size: str) -> Column:
        raw = F.ln(F.nullif(F.col(total).cast("double"), F.lit(0.0))) - c.safe_ratio(F.col(f_ln_f), F.col(total))
        return c.safe_ratio(raw, F.ln(F.nullif(F.col(size).cast("double"), F.lit(1.0))))

    return joined.select(
        *group,
        c.safe_ratio(F.col("eco_total"), F.col("total")).alias("ratio_eco"),
        entropy("total", "f_ln_f", "themes").alias("h_norm_themes"),
        F.coalesce(entropy("eco_total", "eco_f_ln_f", "eco_themes"), F.lit(0.0)).alias("h_norm_eco_themes"),
    )


def economic_share(articles: DataFrame, wide: bool = False) -> DataFrame:
    """Share of economic theme mentions per source, narrow or wide rule."""
    test = c.is_economic_wide if wide else c.is_economic
    frequencies = theme_frequencies(articles)
    eco = F.sum(F.when(test(F.col("theme")), F.col("freq")).otherwise(0))
    return frequencies.groupBy("Src_ID").agg(
        F.sum("freq").alias("total_themes"),
        eco.alias("eco_themes"),
        c.safe_ratio(eco, F.sum("freq")).alias("ratio_eco"),
    )


def source_features(articles: DataFrame, population: str = "is_wiki") -> DataFrame:
    """The feature table; ``population`` (0/1) is a column of the articles.

    Both aggregations of the articles are stored, because each is read twice
    with other columns: the articles are scanned once for each of them.
    """
    keys = ("Src_ID", population)
    daily = stage(daily_activity(articles, keys), "source-days")
    base = base_stats(daily, keys)
    temporal = temporal_stats(daily, keys).drop("total_articles")
    entropy = theme_entropy(stage(theme_frequencies(articles, keys), "source-themes"), population)
    filled = {x: F.coalesce(x, F.lit(0.0)) for x in ("ratio_eco", "h_norm_themes", "h_norm_eco_themes")}
    joined = base.join(temporal, list(keys)).join(entropy, list(keys), "left").withColumns(filled)
    return joined.withColumn(
        "log_articles_per_year", log_volume(F.col("total_articles"), F.col("years_active"))
    ).select("Src_ID", population, "total_articles", *FEATURES)


def log_volume(articles: Column, years: Column) -> Column:
    return F.log1p(c.safe_ratio(articles, years))


def with_feature(features: DataFrame, extra: DataFrame, name: str, fill: float = 0.0) -> DataFrame:
    """Replace or add one feature column by source; missing sources get ``fill``."""
    added = features.drop(name).join(extra.select("Src_ID", name), "Src_ID", "left")
    return added.withColumn(name, F.coalesce(name, F.lit(fill)))


def upgrade_feature_names(features: DataFrame) -> DataFrame:
    """Bring a stored table to the current column set, whatever its age."""
    older = features
    if "log_total_articles" in older.columns:
        articles = F.round(F.expm1("log_total_articles"))
        per_year = F.coalesce(log_volume(articles, F.col("years_active")), F.lit(0.0))
        older = older.withColumn("log_total_articles_year", per_year)
    return older.drop("log_total_articles").withColumnRenamed("zero_inflation_rate", "inactive_days_rate")
