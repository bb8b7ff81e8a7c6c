"""From raw article records to clean articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.operators.lookups import Lookup, lookup_join, stage_lookup
from pressgauge.settings import BROADCAST_ROWS, CleaningRules

DEFAULT_RULES = CleaningRules()


def dated(articles: DataFrame, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    """Rows with a 14-digit date and not on the list of bad records."""
    return articles.filter(c.has_valid_date(F.col("DATE")) & ~F.col("GKGRECORDID").isin(*rules.bad_record_ids))


def themed(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("EnhancedThemes").isNotNull() & (F.col("EnhancedThemes") != ""))


def sized(articles: DataFrame, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    return articles.filter(F.col("WordCount").between(rules.min_words, rules.max_words))


def with_enough_themes(articles: DataFrame, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    return articles.filter(c.theme_count_or_zero(F.col("EnhancedThemes")) >= rules.min_themes)


def with_source(articles: DataFrame, dictionary: Lookup, keep_unknown: bool = False) -> DataFrame:
    """Repair missing source ids through the article's host.

    ``dictionary`` has (``SourceCommonName_ID``, ``SourceCommonName``). Only
    rows without an id carry a join key; beside a dictionary too large to
    broadcast, the others do not move at all.
    """
    known = F.nullif(F.col("SourceCommonName_ID"), F.lit(0))
    if dictionary.rows > BROADCAST_ROWS:
        named = articles.filter(known.isNotNull()).withColumn("Src_ID", known).drop("SourceCommonName_ID")
        nameless = articles.filter(known.isNull())
        return named.unionByName(_repaired(nameless, dictionary, known, keep_unknown))
    return _repaired(articles, dictionary, known, keep_unknown)


def _repaired(articles: DataFrame, dictionary: Lookup, known: Column, keep_unknown: bool) -> DataFrame:
    keyed = articles.withColumn("_host", F.when(known.isNull(), c.host_of(F.col("DocumentIdentifier"))))
    names = Lookup(
        dictionary.frame.select(
            F.col("SourceCommonName").alias("_host"), F.col("SourceCommonName_ID").alias("_mapped")
        ),
        dictionary.rows,
    )
    joined = lookup_join(keyed, names, ["_host"], "left", spread_by="GKGRECORDID")
    repaired = joined.withColumn("Src_ID", F.coalesce(known, F.col("_mapped"))).drop(
        "_host", "_mapped", "SourceCommonName_ID"
    )
    return repaired if keep_unknown else repaired.filter(F.col("Src_ID").isNotNull())


def source_years(articles: DataFrame) -> DataFrame:
    """Articles per source and year; the pre-aggregate behind every source rule."""
    return articles.groupBy("Src_ID", c.year_text(F.col("DATE")).alias("pub_year")).agg(
        F.count(F.lit(1)).alias("n")
    )


def source_activity(articles: DataFrame) -> DataFrame:
    """Articles and distinct active years per source."""
    return (
        source_years(articles)
        .groupBy("Src_ID")
        .agg(F.sum("n").alias("articles"), F.count(F.lit(1)).alias("years"))
    )


def whitelist(articles: DataFrame, min_articles: int = 30, min_years: int = 2) -> DataFrame:
    """Sources with enough articles and enough distinct years."""
    return (
        source_activity(articles.filter(F.col("Src_ID").isNotNull()))
        .filter((F.col("articles") >= min_articles) & (F.col("years") >= min_years))
        .select("Src_ID")
    )


def global_whitelist(
    articles: DataFrame, dictionary: Lookup, rules: CleaningRules = DEFAULT_RULES
) -> DataFrame:
    """Whitelist counted on all dated rows, whatever their themes or length."""
    narrow = articles.select("GKGRECORDID", "DATE", "SourceCommonName_ID", "DocumentIdentifier")
    return whitelist(with_source(dated(narrow, rules), dictionary), rules.min_articles, rules.min_years)


def from_sources(articles: DataFrame, sources: Lookup) -> DataFrame:
    """Articles whose source is in the list."""
    return lookup_join(articles, sources, ["Src_ID"], "left_semi", spread_by="GKGRECORDID")


def base_articles(
    articles: DataFrame, dictionary: Lookup, rules: CleaningRules = DEFAULT_RULES
) -> DataFrame:
    """Dated, themed articles of acceptable length with a repaired source."""
    return with_source(sized(themed(dated(articles, rules)), rules), dictionary)


def to_clean(articles: DataFrame) -> DataFrame:
    """The clean article columns every indicator is built from."""
    tone = F.col("Tone").cast("double")
    return articles.select(
        "GKGRECORDID",
        c.day_of(F.col("DATE")).alias("period"),
        tone.alias("tone"),
        F.signum(tone).cast("tinyint").alias("tone_bin"),
        c.theme_count(F.col("EnhancedThemes")).alias("total_themes_count"),
        c.theme_keys(F.col("EnhancedThemes")).alias("themes_list"),
        c.country_codes(F.col("EnhancedLocations")).alias("countries_list"),
    )


def clean_articles(
    articles: DataFrame,
    dictionary: Lookup,
    sources: Lookup | None = None,
    rules: CleaningRules = DEFAULT_RULES,
) -> DataFrame:
    """Clean articles of whitelisted sources.

    Without ``sources`` the whitelist is counted on the filtered articles
    themselves. It is then stored first, so that it is computed once and its
    size is known before it is broadcast.
    """
    base = base_articles(articles, dictionary, rules)
    if sources is None:
        sources = stage_lookup(whitelist(base, rules.min_articles, rules.min_years), "whitelist")
    return to_clean(with_enough_themes(from_sources(base, sources), rules))


STEPS = ("raw", "dated", "base", "final")


def passed_steps(
    articles: DataFrame, dictionary: Lookup, sources: Lookup, rules: CleaningRules = DEFAULT_RULES
) -> DataFrame:
    """All articles with their source, as stored and repaired, and a flag for each step that they pass."""
    rows = articles.select(
        "GKGRECORDID", "DATE", "EnhancedThemes", "WordCount", "SourceCommonName_ID", "DocumentIdentifier",
        F.col("SourceCommonName_ID").alias("raw_source"),
    )
    rows = with_source(rows, dictionary, keep_unknown=True)
    listed = Lookup(sources.frame.select("Src_ID").distinct().withColumn("_listed", F.lit(True)), sources.rows)
    rows = lookup_join(rows, listed, ["Src_ID"], "left", spread_by="GKGRECORDID")
    themes = F.col("EnhancedThemes")
    dated = c.has_valid_date(F.col("DATE")) & ~F.col("GKGRECORDID").isin(*rules.bad_record_ids) & F.col("Src_ID").isNotNull()
    base = dated & (themes != "") & F.col("WordCount").between(rules.min_words, rules.max_words)
    final = base & F.col("_listed") & (c.theme_count_or_zero(themes) >= rules.min_themes)
    flags = {"dated": dated, "base": base, "final": final}
    return rows.select("raw_source", "Src_ID", *[F.coalesce(flags[s], F.lit(False)).alias(s) for s in STEPS[1:]])


def pure_sources(articles: DataFrame, more_than: int = 1000, min_years: int = 2) -> DataFrame:
    """Long-standing sources: more than ``more_than`` articles over the years."""
    return (
        source_activity(articles)
        .filter((F.col("articles") > more_than) & (F.col("years") >= min_years))
        .select("Src_ID")
    )
