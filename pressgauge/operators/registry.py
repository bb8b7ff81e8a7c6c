"""Media registry: filter, match to known sources, split the articles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.operators.lookups import Lookup, lookup_join
from pressgauge.operators.topk import first_per_group

# Words that exclude a registry entry.
EXCLUDED_WORDS = (
    "music", "high school", "baptist", "student", ".edu", "university", "college", "school", "christian", "celebrit",
    "sports", "fake news", "sports news", "tabloid", "video games", "gaming", "gamer", "movie", "cinema", "film",
    "entertainment", "pop culture", "municipal newsletter", "church", "religion", "catholic", "lgbt", "gay", "jewish",
    "jew", "children's newspaper", "local newspaper",
)


def not_excluded(registry: DataFrame, words: tuple[str, ...] = EXCLUDED_WORDS) -> DataFrame:
    """Entries whose label and type contain none of the words, in any case."""
    text = F.concat_ws(
        " ", F.coalesce("medialabel", F.lit("")), F.coalesce("typelabel", F.lit(""))
    )
    pattern = "(?i)" + "|".join(re.escape(w) for w in words)
    return registry.filter(~text.rlike(pattern))


def with_host(registry: DataFrame) -> DataFrame:
    """Entries with a web address, plus its ``host``."""
    return registry.filter(F.col("website").isNotNull()).withColumn("host", c.registry_host(F.col("website")))


def registrable(hosts: DataFrame, suffixes: Lookup) -> DataFrame:
    """(host, ``registrable``): the label before the longest public suffix.

    A host yields one candidate per label, so the lookup is an equi join.
    """
    labels = F.split("host", r"\.")
    candidates = hosts.select("host", labels.alias("_l")).select(
        "host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: _tail(F.col("_l"), i))).alias("_i", "suffix"), "_l"
    )
    matched = lookup_join(candidates.filter(F.col("suffix") != F.col("host")), suffixes, ["suffix"], "left_semi")
    return matched.groupBy("host").agg(
        F.min_by(F.concat_ws(".", F.get("_l", F.col("_i") - 1), F.col("suffix")), F.col("_i")).alias("registrable")
    )


def _tail(labels: Column, start: Column) -> Column:
    return F.array_join(F.slice(labels, start, F.size(labels)), ".")


def match_hosts(hosts: DataFrame, dictionary: Lookup, suffixes: Lookup) -> DataFrame:
    """Known source of each host: exact, registrable domain, or last two labels.

    The three candidate names of a host are tried together; the best rank
    wins. Hosts are distinct before anything is joined.
    """
    distinct = hosts.select("host").filter(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    two = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))
    candidates = distinct.join(registrable(distinct, suffixes), "host", "left").select(
        "host",
        F.posexplode(F.array(F.col("host"), F.col("registrable"), two)).alias("rank", "SourceCommonName"),
    )
    found = lookup_join(
        candidates.filter(F.col("SourceCommonName").isNotNull()), dictionary, ["SourceCommonName"], spread_by="host"
    )
    best = F.struct("rank", F.col("SourceCommonName_ID").alias("id"), F.col("SourceCommonName").alias("domain"))
    return found.groupBy("host").agg(F.min(best).alias("_b")).select("host", "_b.id", "_b.domain")


def matched_domains(
    registry: DataFrame, dictionary: Lookup, suffixes: Lookup, order: list[str]
) -> DataFrame:
    """One enriched row per (region, domain), all columns text.

    ``registry`` has ``region`` and the registry columns; ``order`` names the
    columns that decide which row of several is the first.
    """
    entries = with_host(not_excluded(registry))
    per_host = first_per_group(entries, ["region", "host"], [F.col(x) for x in order])
    matched = lookup_join_hosts(per_host, match_hosts(per_host, dictionary, suffixes))
    per_domain = first_per_group(matched, ["region", "domain"], [F.col(x) for x in order])
    return as_text(per_domain.select("region", "id", "domain", "medialabel", "typelabel", "countrylabel", "inception"))


def lookup_join_hosts(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach matches; both sides hold one row per host (and region)."""
    return entries.join(matches, "host")


def as_text(table: DataFrame) -> DataFrame:
    """Every column as text, missing values as ''."""
    return table.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in table.columns])


def match_coverage(registry: DataFrame, dictionary: Lookup, suffixes: Lookup) -> DataFrame:
    """Hosts, matched domains and rate per region, best first."""
    hosts = with_host(not_excluded(registry)).select("region", "host").distinct()
    matched = hosts.join(match_hosts(hosts, dictionary, suffixes), "host", "left")
    # One row per region and domain first; distinct counts become counts.
    found = matched.groupBy("region", "domain").agg(F.count(F.lit(1)).alias("hosts"))
    totals = found.groupBy("region").agg(F.sum("hosts").alias("hosts"), F.count("domain").alias("matches"))
    rate = c.safe_ratio(F.col("matches"), F.col("hosts")) * 100
    return totals.withColumn("rate", rate).orderBy(F.desc("rate"), "region")


def one_per_source(domains: DataFrame) -> DataFrame:
    """One registry row per source id: the earliest inception, '' first."""
    typed = domains.withColumn("Src_ID", F.expr("try_cast(id AS INT)"))
    order = [F.col("inception"), F.col("countrylabel"), F.col("medialabel")]
    return first_per_group(typed, ["Src_ID"], order).select(
        "Src_ID", "medialabel", "typelabel", "countrylabel", "inception"
    )


def in_registry(articles: DataFrame, registered: Lookup) -> DataFrame:
    """Articles of registered sources with the registry columns."""
    return lookup_join(articles, registered, ["Src_ID"], spread_by="GKGRECORDID")


def not_in_registry(articles: DataFrame, registered: Lookup) -> DataFrame:
    """Articles of other sources; the registry columns are NULL."""
    ids = Lookup(registered.frame.select("Src_ID"), registered.rows)
    others = lookup_join(articles, ids, ["Src_ID"], "left_anti", spread_by="GKGRECORDID")
    return others.withColumns(
        {x: F.lit(None).cast("string") for x in ("medialabel", "typelabel", "countrylabel", "inception")}
    )


def with_registry_flag(articles: DataFrame, registered: Lookup) -> DataFrame:
    """All articles with ``is_wiki``: 1 for registered sources, else 0."""
    flags = Lookup(registered.frame.select("Src_ID", F.lit(1).alias("is_wiki")), registered.rows)
    flagged = lookup_join(articles, flags, ["Src_ID"], "left", spread_by="GKGRECORDID")
    return flagged.withColumn("is_wiki", F.coalesce("is_wiki", F.lit(0)))
