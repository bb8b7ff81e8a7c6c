"""The single-sector study: indicators by substring match, in one scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions.columns import day_of, safe_ratio, theme_keys


def names_any(themes: Column, names: list[str]) -> Column:
    """Whether the text names any theme as a substring ``NAME,``.

    This also hits longer theme names that end in ``NAME``.
    """
    return themes.rlike("(" + "|".join(re.escape(n.upper()) for n in names) + "),")


def tone_value(mode: str = "continuous") -> Column:
    tone = F.expr("try_cast(split_part(cast(Tone AS string), ',', 1) AS double)")
    return F.signum(tone) if mode == "binary" else tone


def daily_category_sums(articles: DataFrame, categories: dict[str, list[str]], mode: str = "continuous") -> DataFrame:
    """Per day: ``total_news``, ``N_<cat>`` and ``SW_<cat>``.

    Articles are tested once; days without any match are left out.
    """
    present = articles.filter(F.col("EnhancedThemes").isNotNull() & (F.col("EnhancedThemes") != ""))
    flags = present.select(
        day_of(F.col("DATE")).alias("period"),
        tone_value(mode).alias("_tone"),
        *[names_any(F.col("EnhancedThemes"), names).alias(f"_f_{cat}") for cat, names in categories.items()],
    )
    sums = flags.groupBy("period").agg(
        F.count(F.lit(1)).alias("total_news"),
        *[F.sum(F.when(F.col(f"_f_{cat}"), 1.0).otherwise(0.0)).alias(f"N_{cat}") for cat in categories],
        *[F.sum(F.when(F.col(f"_f_{cat}"), F.col("_tone")).otherwise(0.0)).alias(f"SW_{cat}") for cat in categories],
    )
    matched = sum((F.col(f"N_{cat}") for cat in categories), F.lit(0.0))
    return sums.filter(matched > 0)


def category_indicators(sums: DataFrame, sector: str, categories: list[str]) -> DataFrame:
    """Volume, attention and sentiment per category; gaps of the first two are 0."""
    columns = []
    for cat in categories:
        n = F.col(f"N_{cat}")
        columns += [
            F.coalesce(n, F.lit(0.0)).alias(f"volume_{sector}_{cat}"),
            F.coalesce(safe_ratio(n, F.col("total_news")), F.lit(0.0)).alias(f"attention_{sector}_{cat}"),
            safe_ratio(F.col(f"SW_{cat}"), n).alias(f"sentiment_{sector}_{cat}"),
        ]
    return sums.select("period", "total_news", *columns)


def sector_rollup(indicators: DataFrame, sector: str, categories: list[str]) -> DataFrame:
    """Sector attention in % and volume-weighted sentiment."""
    zero = F.lit(0.0)
    volumes = [F.coalesce(f"volume_{sector}_{cat}", zero) for cat in categories]
    volume = sum(volumes, zero)
    mass = sum(
        (F.coalesce(f"sentiment_{sector}_{cat}", zero) * v for cat, v in zip(categories, volumes)), zero
    )
    return indicators.select(
        "period",
        (safe_ratio(volume, F.col("total_news")) * 100).alias("attention"),
        safe_ratio(mass, F.nullif(volume, zero)).alias("sentiment"),
    )


def category_statistics(indicators: DataFrame, sector: str, categories: list[str]) -> DataFrame:
    """Mean, maximum and deviation of attention; sentiment and % positive days."""
    measures = []
    for cat in categories:
        attention = F.col(f"attention_{sector}_{cat}") * 100
        sentiment = F.col(f"sentiment_{sector}_{cat}")
        positive = F.avg(F.when(sentiment > 0, 1.0).when(sentiment.isNotNull(), 0.0)) * 100
        measures.append(
            F.struct(
                F.lit(cat).alias("category"),
                F.avg(attention).alias("attention_mean"),
                F.max(attention).alias("attention_max"),
                F.stddev_samp(attention).alias("attention_sd"),
                F.avg(sentiment).alias("sentiment_mean"),
                F.stddev_samp(sentiment).alias("sentiment_sd"),
                positive.alias("pct_positive"),
            )
        )
    return indicators.agg(F.array(*measures).alias("_m")).select(F.inline("_m"))


def article_weights(articles: DataFrame, categories: dict[str, list[str]], mode: str = "fractional") -> DataFrame:
    """Weight of each article per category: 1 if named at all, or its share."""
    keys = F.filter(theme_keys(F.col("EnhancedThemes")), lambda t: t != "")
    rows = articles.filter(F.col("EnhancedThemes").isNotNull() & (F.col("EnhancedThemes") != "")).select(
        "GKGRECORDID", day_of(F.col("DATE")).alias("period"), keys.alias("_k")
    )
    entries = []
    for cat, names in categories.items():
        wanted = [n.upper() for n in names]
        hits = F.size(F.filter("_k", lambda t: t.isin(wanted)))
        weight = F.when(hits > 0, 1.0).otherwise(0.0) if mode == "binary" else safe_ratio(hits, F.size("_k"))
        entries.append(F.struct(F.lit(cat).alias("cat_key"), weight.alias("w")))
    return rows.select("GKGRECORDID", "period", F.inline(F.array(*entries))).filter(F.col("w") > 0)
