"""Complete runs: sector and regional indicators, source features, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators import cleaning, features, registry, regression, series
from pressgauge.operators import indicators as ind
from pressgauge.operators.lookups import Lookup, stage_lookup
from pressgauge.sinks import tables as sinks
from pressgauge.settings import CleaningRules
from pressgauge.sources import lookups as lookup_source


def _chosen(taxonomy: Lookup, sectors: list[str] | None) -> Lookup:
    if not sectors:
        return taxonomy
    return Lookup(taxonomy.frame.filter(F.col("sector").isin(sectors)), taxonomy.rows)


def sector_run(
    articles: DataFrame,
    dictionary: Lookup,
    taxonomy: Lookup,
    sectors: list[str] | None = None,
    rules: CleaningRules = CleaningRules(),
    whitelist: Lookup | None = None,
) -> DataFrame:
    """Daily indicators of the chosen sectors, all years and sectors at once."""
    sources = whitelist or stage_lookup(cleaning.global_whitelist(articles, dictionary, rules), "whitelist")
    clean = cleaning.clean_articles(articles, dictionary, sources, rules)
    return ind.long_indicators(clean, _chosen(taxonomy, sectors))


def geo_run(
    articles: DataFrame,
    dictionary: Lookup,
    taxonomy: Lookup,
    regions: Lookup,
    sectors: list[str] | None = None,
    rules: CleaningRules = CleaningRules(),
    whitelist: Lookup | None = None,
    unique_ids: bool = True,
) -> DataFrame:
    """The same per region. Tables with repeated ids need ``unique_ids=False``."""
    sources = whitelist or stage_lookup(cleaning.global_whitelist(articles, dictionary, rules), "whitelist")
    clean = cleaning.clean_articles(articles, dictionary, sources, rules)
    return ind.regional_indicators(clean, _chosen(taxonomy, sectors), regions, unique_ids)


def source_run(
    articles: DataFrame, dictionary: Lookup, domains: DataFrame, min_years: int = 2
) -> DataFrame:
    """Feature table of all long-lived sources, with the registry flag."""
    inter = cleaning.with_source(cleaning.themed(cleaning.dated(articles)), dictionary)
    lasting = stage_lookup(cleaning.whitelist(inter, 1, min_years), "lasting")
    registered = stage_lookup(registry.one_per_source(domains), "registered")
    flagged = registry.with_registry_flag(cleaning.from_sources(inter, lasting), registered)
    return features.source_features(flagged)


@dataclass(frozen=True)
class OutputPaths:
    """Where complete runs store their tables, below one root."""

    root: str

    def _of(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def sectors(self) -> str:
        return self._of("sector-indicators")

    @property
    def regions(self) -> str:
        return self._of("regional-indicators")

    @property
    def features(self) -> str:
        return self._of("source-features")

    @property
    def domains(self) -> str:
        return self._of("domains")


def stored_indicators(
    articles: DataFrame,
    dictionary: Lookup,
    taxonomy: Lookup,
    output: OutputPaths,
    regions: Lookup | None = None,
    sectors: list[str] | None = None,
    rules: CleaningRules = CleaningRules(),
    unique_ids: bool = True,
) -> None:
    """Run and store indicators of the chosen sectors, and per region where regions are given.

    One whitelist serves both. Tables have one folder per sector and year; a
    later run replaces the folders it writes and leaves all others, so sectors
    and years can be run one by one or again.
    """
    sources = stage_lookup(cleaning.global_whitelist(articles, dictionary, rules), "whitelist")
    sinks.write_indicators(sector_run(articles, dictionary, taxonomy, sectors, rules, sources), output.sectors)
    if regions is not None:
        long = geo_run(articles, dictionary, taxonomy, regions, sectors, rules, sources, unique_ids)
        sinks.write_indicators(long, output.regions)


def stored_features(
    articles: DataFrame, dictionary: Lookup, output: OutputPaths, min_years: int = 2
) -> DataFrame:
    """Store the feature table of all sources, flagged by the stored domains; returns it as stored."""
    spark = articles.sparkSession
    source_run(articles, dictionary, spark.read.parquet(output.domains), min_years).write.mode("overwrite").parquet(
        output.features
    )
    return spark.read.parquet(output.features)


def registry_run(
    spark: SparkSession, paths: list[str], dictionary: Lookup, suffixes: Lookup, output: OutputPaths
) -> DataFrame:
    """From registry CSV files to stored domains, one folder per region; returns the coverage per region.

    Of several rows for one host, or several hosts of one domain, the first in
    file order stays. Both results read the files themselves, once each.
    """
    entries = lookup_source.registry_files(spark, paths)
    sinks.write_domains(registry.matched_domains(entries, dictionary, suffixes, ["file", "line_no"]), output.domains)
    return registry.match_coverage(entries, dictionary, suffixes)


def monthly_panel(
    long: DataFrame, macro: DataFrame, metric: str, names: list[str], window: int = 12
) -> DataFrame:
    """Monthly panel per region: z-scores of the series and macro change.

    ``long`` has regional indicators, ``macro`` (region_key, period, value);
    ``names`` are the wide series names without the metric. A month stays if
    the macro change is known; a series without a full window is NULL in it,
    and the regressions align each set of series alone.
    """
    keys = ["region_key"]
    wide = ind.wide_geo_indicators(long, names, (metric,))
    columns = [f"{metric}_{n}" for n in names]
    means = wide.groupBy("region_key", F.trunc("period", "MM").alias("period")).agg(
        *[F.avg(F.col(f"`{c}`")).alias(c) for c in columns]
    )
    dense = series.on_calendar(means, keys, "period", "interval 1 month")
    scores = dense.select(
        *keys,
        "period",
        *[series.moving_zscore(F.col(f"`{c}`"), keys, "period", window).alias(n) for c, n in zip(columns, names)],
    )
    change = macro.select(
        *keys, "period", series.change_percent(F.col("value"), keys, "period").alias("macro_yoy")
    )
    return scores.join(change.filter(F.col("macro_yoy").isNotNull()), [*keys, "period"])


def regional_report(panel: DataFrame, names: list[str], max_lag: int = 6, min_rows: int = 20) -> dict[str, DataFrame]:
    """Best leading series, regression table and forecast test per region."""
    keys, lags = ["region_key"], list(range(-max_lag, max_lag + 1))
    tall = panel.select(
        "region_key",
        "period",
        "macro_yoy",
        F.inline(F.array(*[F.struct(F.lit(n).alias("series"), F.col(f"`{n}`").alias("x")) for n in names])),
    )
    tall = tall.filter(F.col("x").isNotNull())
    leads = series.lag_correlations(tall, "x", "macro_yoy", ["region_key", "series"], "period", range(1, max_lag + 1))
    best = series.best_predictor(leads, keys, "series")
    rows = regression.design_rows(panel, {"all": names}, "macro_yoy", keys, "period", lags)
    fits = regression.lasso_fits(rows, keys, "period", min_rows)
    # One (region, lag) per region decides which forecast is tested.
    at_best = rows.join(best.select("region_key", "lag"), ["region_key", "lag"], "left_semi")
    return {
        "best": best,
        "fits": fits,
        "table": regression.coefficient_table(fits, keys, lags),
        "forecast": regression.hold_out_errors(at_best, keys, "period", min_rows=min_rows),
    }
