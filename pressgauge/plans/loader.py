"""Entry point to clean articles, lazily or stored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pressgauge.operators import cleaning, profiling, topk
from pressgauge.operators.lookups import Lookup, measure
from pressgauge.session import stage
from pressgauge.settings import CleaningRules
from pressgauge.sinks.tables import kept_or_computed
from pressgauge.sources.articles import article_years


@dataclass
class ArticleLoader:
    """Clean articles from a stored article table.

    ``as_view`` counts the whitelist on the chosen, filtered articles and
    stays lazy beyond it; ``as_table`` uses the stored whitelist of the whole
    table and writes the result once, for repeated reads.
    """

    spark: SparkSession
    articles_path: str
    dictionary: Lookup
    whitelist_path: str
    rules: CleaningRules = field(default_factory=CleaningRules)

    def articles(self, *years: int) -> DataFrame:
        return article_years(self.spark, self.articles_path, list(years))

    def ensure_whitelist(self, force: bool = False) -> Lookup:
        """Whitelist over all years; computed once, then read from its path."""
        compute = lambda: cleaning.global_whitelist(self.articles(), self.dictionary, self.rules)
        return measure(kept_or_computed(self.spark, self.whitelist_path, compute, force))

    def as_view(self, *years: int) -> DataFrame:
        return cleaning.clean_articles(self.articles(*years), self.dictionary, None, self.rules)

    def as_table(self, *years: int) -> DataFrame:
        sources = self.ensure_whitelist()
        return stage(cleaning.clean_articles(self.articles(*years), self.dictionary, sources, self.rules), "clean")

    def info(self, clean: DataFrame) -> DataFrame:
        return profiling.loader_info(clean)

    def daily_counts(self, clean: DataFrame) -> DataFrame:
        return profiling.daily_counts(clean).orderBy("period")

    def sample(self, clean: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
        return topk.sample_rows(clean, n, "GKGRECORDID", seed)
