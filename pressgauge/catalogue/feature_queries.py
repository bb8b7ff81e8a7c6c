"""Source features, media registry, feature tables and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pressgauge.catalogue.registry import register, rounded
from pressgauge.catalogue.sql import DAY, add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.functions import columns as c
from pressgauge.operators import cleaning, clusters, features, profiling, registry, topk
from pressgauge.operators.ingest import grown_dictionary
from pressgauge.operators.lookups import stage_lookup
from pressgauge.plans import runs

ID = "GKGRECORDID"

add("lasting", ("inter",), "SELECT Src_ID FROM inter GROUP BY 1 HAVING count(DISTINCT substr(DATE, 1, 4)) >= 2")
add("year_rows", ("inter", "lasting"), "SELECT inter.* FROM inter JOIN lasting USING (Src_ID)")
add("registered", ("domains",), """
    SELECT CAST(id AS INTEGER) AS Src_ID, medialabel, typelabel, countrylabel, inception FROM domains
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY inception, countrylabel, medialabel) = 1""")
add("flagged", ("year_rows", "registered"), """
    SELECT y.*, CASE WHEN r.Src_ID IS NULL THEN 0 ELSE 1 END AS is_wiki
    FROM year_rows y LEFT JOIN registered r ON y.Src_ID = r.Src_ID""")
add("source_days", ("flagged",), f"SELECT is_wiki, Src_ID, {DAY} AS period, count(*) AS n FROM flagged GROUP BY 1, 2, 3")
add("base_features", ("flagged",), """
    SELECT is_wiki, Src_ID, count(*) AS total_articles, avg(WordCount) AS mean_wordcount,
           CASE WHEN avg(WordCount) > 0 THEN stddev_samp(WordCount) / avg(WordCount) ELSE 0 END AS cv_wordcount,
           avg(len(list_distinct(list_transform(string_split(EnhancedThemes, ';'), lambda x: split_part(x, ',', 1)))))
             AS mean_themes_per_art
    FROM flagged GROUP BY 1, 2""")


def grain(unit, source):
    return f"""SELECT Src_ID, min(p) AS first_p, max(p) AS last_p, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS s2, count(*) AS k
        FROM (SELECT Src_ID, date_trunc('{unit}', period) AS p, sum(n) AS n FROM {source} GROUP BY 1, 2) GROUP BY 1"""


def dispersion(unit, name):
    return f"""SELECT *, s / span AS avg_{name}, sqrt(greatest(s2 / span - (s / span) * (s / span), 0)) AS stddev_{name}
        FROM (SELECT *, date_diff('{unit}', first_p, last_p) + 1 AS span FROM ({grain(unit, 'source_days')}))"""


add("temporal", ("source_days",), f"""
    SELECT d.Src_ID, CAST(d.s AS BIGINT) AS total_articles, y.k AS years_active, d.span AS lifespan_days, m.span AS lifespan_months,
           y.span AS lifespan_years, 1.0 - d.k::DOUBLE / d.span AS inactive_days_rate,
           avg_daily, stddev_daily, stddev_daily / avg_daily AS cv_daily,
           avg_monthly, stddev_monthly, stddev_monthly / avg_monthly AS cv_monthly,
           avg_yearly, stddev_yearly, stddev_yearly / avg_yearly AS cv_yearly
    FROM ({dispersion('day', 'daily')}) d JOIN ({dispersion('month', 'monthly')}) m USING (Src_ID)
         JOIN ({dispersion('year', 'yearly')}) y USING (Src_ID)""")
add("theme_freq", ("flagged",), """
    SELECT is_wiki, Src_ID, split_part(p, ',', 1) AS theme, count(*) AS freq,
           CASE WHEN split_part(p, ',', 1) LIKE '%ECON%' THEN 1 ELSE 0 END AS is_eco
    FROM (SELECT is_wiki, Src_ID, unnest(string_split(EnhancedThemes, ';')) AS p FROM flagged) WHERE p <> '' GROUP BY 1, 2, 3""")
add("theme_totals", ("theme_freq",), """
    SELECT Src_ID, sum(freq)::DOUBLE AS total, sum(CASE WHEN is_eco = 1 THEN freq ELSE 0 END)::DOUBLE AS eco_total
    FROM theme_freq GROUP BY 1""")
add("theme_sizes", ("theme_freq",), """
    SELECT is_wiki, count(DISTINCT theme) AS t, count(DISTINCT CASE WHEN is_eco = 1 THEN theme END) AS t_eco
    FROM theme_freq GROUP BY 1""")
add("entropy", ("theme_freq", "theme_totals", "theme_sizes"), """
    SELECT f.Src_ID, f.is_wiki, s.eco_total / nullif(s.total, 0) AS ratio_eco,
           sum(-(freq / s.total) * ln(freq / s.total)) / ln(nullif(any_value(t), 1)) AS h_norm_themes,
           coalesce(sum(CASE WHEN is_eco = 1 AND s.eco_total > 0 THEN -(freq / s.eco_total) * ln(freq / s.eco_total) ELSE 0 END)
             / nullif(ln(nullif(any_value(t_eco), 1)), 0), 0.0) AS h_norm_eco_themes
    FROM theme_freq f JOIN theme_totals s USING (Src_ID) JOIN theme_sizes z ON f.is_wiki = z.is_wiki
    GROUP BY f.Src_ID, f.is_wiki, s.total, s.eco_total""")
add("features", ("base_features", "temporal", "entropy"), """
    SELECT b.Src_ID, b.is_wiki, b.total_articles, t.years_active, ln(1.0 + b.total_articles::DOUBLE / t.years_active) AS log_articles_per_year,
           cv_monthly, cv_yearly, inactive_days_rate, mean_wordcount, cv_wordcount, mean_themes_per_art,
           coalesce(ratio_eco, 0.0) AS ratio_eco, coalesce(h_norm_themes, 0.0) AS h_norm_themes,
           coalesce(h_norm_eco_themes, 0.0) AS h_norm_eco_themes
    FROM base_features b JOIN temporal t USING (Src_ID) LEFT JOIN entropy e USING (Src_ID)""")
# A fixed partition stands in for fitted clusters wherever SQL must agree.
add("labelled", ("features",), "SELECT *, CAST(Src_ID % 4 AS INTEGER) AS cluster FROM features")

REAL = [f for f in features.FEATURES if f != "years_active"]


def inter(t):
    return cleaning.with_source(cleaning.themed(cleaning.dated(t.gkg)), t.dictionary)


def year_rows(t):
    return cleaning.from_sources(inter(t), t.lasting)


def flagged(t):
    return registry.with_registry_flag(year_rows(t), t.registered)


def feature_table(t):
    return features.source_features(flagged(t))


def labelled(t):
    return feature_table(t).withColumn("cluster", (F.col("Src_ID") % 4).cast("int"))


def sql_rounded(names, *plain):
    return ", ".join([*plain, *[f"{sql6(n)} AS {n}" for n in names]])


# -- Feature steps -----------------------------------------------------------

BASE = ["mean_wordcount", "cv_wordcount", "mean_themes_per_art"]


@register("ag24_base_stats", query(f"SELECT {sql_rounded(BASE, 'Src_ID', 'is_wiki', 'total_articles')} FROM base_features", "base_features"))
def base_stats(t):
    keys = ("Src_ID", "is_wiki")
    return rounded(features.base_stats(features.daily_activity(flagged(t), keys), keys), *BASE)


@register(
    "ag25_word_stats",
    query(
        f"""SELECT Src_ID, total_articles, {sql6('a')} AS avg_wordcount, {sql6('s')} AS stddev_wordcount,
        {sql6('CASE WHEN a > 0 THEN s / a ELSE 0 END')} AS cv_wordcount
        FROM (SELECT Src_ID, count(*) AS total_articles, avg(WordCount) AS a, stddev_pop(WordCount) AS s
              FROM sourced WHERE WordCount IS NOT NULL GROUP BY 1) WHERE total_articles > 50""", "sourced",
    ),
)
def word_stats(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    return rounded(features.word_stats(rows), "avg_wordcount", "stddev_wordcount", "cv_wordcount")


@register(
    "flt14_large_regular_sources",
    query(
        f"""SELECT Src_ID, total_articles, {sql6('a')} AS avg_wordcount FROM (SELECT Src_ID, count(*) AS total_articles,
            avg(WordCount) AS a, stddev_pop(WordCount) AS s FROM sourced WHERE WordCount IS NOT NULL GROUP BY 1)
        WHERE total_articles > 50 AND a < 5000 AND s / a < 3""", "sourced",
    ),
)
def large_regular_sources(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    kept = features.word_stats(rows).filter((F.col("avg_wordcount") < 5000) & (F.col("cv_wordcount") < 3))
    return rounded(kept.select("Src_ID", "total_articles", "avg_wordcount"), "avg_wordcount")


@register("ag26_daily_counts", query("SELECT Src_ID, period, n FROM source_days", "source_days"))
def daily_counts(t):
    return features.daily_counts(year_rows(t))


TEMPORAL = ["inactive_days_rate", *[f"{m}_{g}" for g in ("daily", "monthly", "yearly") for m in ("avg", "stddev", "cv")]]
SPANS = ["total_articles", "years_active", "lifespan_days", "lifespan_months", "lifespan_years"]


@register("ag27_temporal_dispersion", query(f"SELECT Src_ID, {', '.join(f'CAST({s} AS BIGINT) AS {s}' for s in SPANS)}, {sql_rounded(TEMPORAL)} FROM temporal", "temporal"))
def temporal_dispersion(t):
    stats = features.temporal_stats(features.daily_counts(year_rows(t)))
    return rounded(stats.withColumns({s: F.col(s).cast("long") for s in SPANS}), *TEMPORAL)


@register("ag28_inactive_days", query(f"SELECT Src_ID, {sql6('inactive_days_rate')} AS inactive_days_rate FROM temporal", "temporal"))
def inactive_days(t):
    stats = features.temporal_stats(features.daily_counts(year_rows(t)))
    return rounded(stats.select("Src_ID", "inactive_days_rate"), "inactive_days_rate")


@register("jn11_joined_dispersion", query(f"SELECT Src_ID, SourceCommonName, {sql_rounded(['cv_daily', 'cv_monthly', 'cv_yearly'])} FROM temporal JOIN src_map m ON Src_ID = m.SourceCommonName_ID", "temporal", "src_map"))
def joined_dispersion(t):
    stats = features.temporal_stats(features.daily_counts(year_rows(t)))
    named = profiling.with_source_name(stats, t.dictionary, "inner")
    names = ["cv_daily", "cv_monthly", "cv_yearly"]
    return rounded(named.select("Src_ID", "SourceCommonName", *names), *names)


@register("ag29_theme_frequencies", query("SELECT Src_ID, theme, freq, is_eco FROM theme_freq", "theme_freq"))
def theme_frequencies(t):
    return features.theme_frequencies(year_rows(t))


@register("ag30_theme_entropy", query(f"SELECT Src_ID, is_wiki, {sql6('h_norm_themes')} AS h_norm_themes FROM entropy", "entropy"))
def theme_entropy(t):
    frequencies = features.theme_frequencies(flagged(t), ("Src_ID", "is_wiki"))
    return rounded(features.theme_entropy(frequencies, "is_wiki").select("Src_ID", "is_wiki", "h_norm_themes"), "h_norm_themes")


# Two kinds of themes are economic here besides the single ECONOMY, so that the entropy is not 0.
@register(
    "ag31_economic_entropy",
    query(
        f"""SELECT Src_ID, {sql6('sum(-(freq / total) * ln(freq / total)) / ln(nullif((SELECT count(DISTINCT theme) FROM eco), 1))')} AS h_norm_eco_themes
        FROM eco JOIN (SELECT Src_ID, sum(freq)::DOUBLE AS total FROM eco GROUP BY 1) USING (Src_ID) GROUP BY 1""", "flagged",
        eco="""SELECT Src_ID, theme, count(*) AS freq FROM (SELECT Src_ID, split_part(unnest(string_split(
               replace(EnhancedThemes, '_WIDGET', '_ECON_WIDGET'), ';')), ',', 1) AS theme FROM flagged)
               WHERE theme LIKE '%ECON%' GROUP BY 1, 2""",
    ),
)
def economic_entropy(t):
    rows = year_rows(t).withColumn("EnhancedThemes", F.replace("EnhancedThemes", F.lit("_WIDGET"), F.lit("_ECON_WIDGET")))
    # Articles without the word are not split at all.
    frequencies = features.theme_frequencies(rows.filter(c.is_economic(F.col("EnhancedThemes")))).filter("is_eco = 1")
    result = features.theme_entropy(frequencies).select("Src_ID", "h_norm_eco_themes")
    return rounded(result, "h_norm_eco_themes")


def share_sql(test):
    return query(
        f"""SELECT Src_ID, sum(freq)::BIGINT AS total_themes, sum(CASE WHEN {test} THEN freq ELSE 0 END)::BIGINT AS eco_themes,
        {sql6(f'sum(CASE WHEN {test} THEN freq ELSE 0 END)::DOUBLE / sum(freq)')} AS ratio_eco FROM theme_freq GROUP BY 1""",
        "theme_freq",
    )


@register("ag32_economic_share", share_sql("theme LIKE '%ECON%'"))
def economic_share(t):
    return rounded(features.economic_share(year_rows(t)), "ratio_eco")


@register(
    "ag32_economic_share_wide",
    share_sql("theme LIKE 'ECON%' OR " + " OR ".join(f"theme LIKE '%{w}%'" for w in c.WIDE_ECONOMIC_WORDS)),
)
def economic_share_wide(t):
    return rounded(features.economic_share(year_rows(t), wide=True), "ratio_eco")


FEATURE_SQL = sql_rounded(REAL, "Src_ID", "is_wiki", "total_articles", "years_active")


@register("ag33_source_features", query(f"SELECT {FEATURE_SQL} FROM features", "features"))
def source_features(t):
    return rounded(runs.source_run(t.gkg, t.dictionary, t.domains), *REAL)


@register("jn12_feature_assembly", query(f"SELECT Src_ID, total_articles, {sql_rounded(['ratio_eco', 'cv_monthly'])} FROM features", "features"))
def feature_assembly(t):
    table = feature_table(t).select("Src_ID", "total_articles", "ratio_eco", "cv_monthly")
    return rounded(table, "ratio_eco", "cv_monthly")


@register(
    "jn19_added_feature",
    query(
        f"""SELECT Src_ID, {sql6('cv_monthly')} AS cv_monthly, {sql6('coalesce(r.ratio_eco, 0.0)')} AS ratio_eco
        FROM temporal LEFT JOIN (SELECT Src_ID, sum(CASE WHEN theme LIKE '%ECON%' THEN freq ELSE 0 END)::DOUBLE / sum(freq) AS ratio_eco
                                 FROM theme_freq WHERE Src_ID > 5 GROUP BY 1) r USING (Src_ID)""", "temporal", "theme_freq",
    ),
)
def added_feature(t):
    stats = features.temporal_stats(features.daily_counts(year_rows(t))).select("Src_ID", "cv_monthly")
    # Some sources lack the new feature and get the fill value.
    extra = features.economic_share(year_rows(t)).filter(F.col("Src_ID") > 5)
    return rounded(features.with_feature(stats, extra, "ratio_eco"), "cv_monthly", "ratio_eco")


@register(
    "prj19_upgraded_names",
    query(
        f"""SELECT Src_ID, years_active, {sql6('inactive_days_rate')} AS inactive_days_rate,
        {sql6('ln(1 + total_articles::DOUBLE / years_active)')} AS log_total_articles_year FROM features""", "features",
    ),
)
def upgraded_names(t):
    older = feature_table(t).select(
        "Src_ID", "years_active", F.log1p("total_articles").alias("log_total_articles"),
        F.col("inactive_days_rate").alias("zero_inflation_rate"),
    )
    return rounded(features.upgrade_feature_names(older), "inactive_days_rate", "log_total_articles_year")


# -- Registry ----------------------------------------------------------------


@register("w01_first_per_id", query("SELECT * FROM registered", "registered"))
def first_per_id(t):
    return registry.one_per_source(t.domains)


@register("jn08_registered_articles", query(f"SELECT {ID}, y.Src_ID, medialabel, countrylabel, inception FROM year_rows y JOIN registered USING (Src_ID)", "year_rows", "registered"))
def registered_articles(t):
    rows = registry.in_registry(year_rows(t), t.registered)
    return rows.select(ID, "Src_ID", "medialabel", "countrylabel", "inception")


UNREGISTERED = query(
    f"SELECT {ID}, Src_ID, CAST(NULL AS VARCHAR) AS medialabel FROM year_rows WHERE Src_ID NOT IN (SELECT Src_ID FROM registered)",
    "year_rows", "registered",
)


@register("jn07_unregistered_articles", UNREGISTERED)
def unregistered_articles(t):
    return registry.not_in_registry(year_rows(t), t.registered).select(ID, "Src_ID", "medialabel")


@register("prj12_aligned_views", query(
    f"""SELECT {ID}, medialabel, countrylabel FROM year_rows JOIN registered USING (Src_ID) UNION ALL
    SELECT {ID}, NULL, NULL FROM year_rows WHERE Src_ID NOT IN (SELECT Src_ID FROM registered)""", "year_rows", "registered"))
def aligned_views(t):
    rows, known = year_rows(t), t.registered
    both = registry.in_registry(rows, known).unionByName(registry.not_in_registry(rows, known))
    return both.select(ID, "medialabel", "countrylabel")


@register("set02_flagged_union", query(f"SELECT {ID}, is_wiki FROM flagged", "flagged"))
def flagged_union(t):
    rows, known = year_rows(t), t.registered
    inside = registry.in_registry(rows, known).withColumn("is_wiki", F.lit(1))
    return inside.unionByName(registry.not_in_registry(rows, known).withColumn("is_wiki", F.lit(0))).select(ID, "is_wiki")


NOT_EXCLUDED = "NOT (" + " OR ".join(
    "contains(lower(medialabel || ' ' || typelabel), '" + w.replace("'", "''") + "')" for w in registry.EXCLUDED_WORDS
) + ")"
add("kept_hosts", ("registry",), f"""
    SELECT * EXCLUDE (host, h), lower(CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE h END) AS host FROM (
      SELECT *, split_part(regexp_extract(CASE WHEN regexp_matches(trim(website), '^https?://') THEN trim(website)
        ELSE 'http://' || trim(website) END, '^https?://([^/?#]*)', 1), ':', 1) AS h
      FROM registry WHERE {NOT_EXCLUDED})""")
add("suffixes", (), "SELECT unnest(['com', 'net', 'org', 'example.com', 'example.net', 'example.org', 'co.uk']) AS suffix")


def matches_sql(hosts):
    """Exact host, else registrable domain, else last two labels."""
    return f"""
    SELECT host, coalesce(a.SourceCommonName_ID, b.SourceCommonName_ID, d.SourceCommonName_ID) AS id,
           coalesce(a.SourceCommonName, b.SourceCommonName, d.SourceCommonName) AS domain
    FROM (SELECT h.host, r.registrable, CASE WHEN len(string_split(h.host, '.')) > 2
                 THEN array_to_string(string_split(h.host, '.')[-2:], '.') END AS two
          FROM (SELECT DISTINCT host FROM {hosts}) h LEFT JOIN (
            SELECT host, string_split(left(host, len(host) - len(suffix) - 1), '.')[-1] || '.' || suffix AS registrable
            FROM (SELECT host, suffix, row_number() OVER (PARTITION BY host ORDER BY len(suffix) DESC) AS r
                  FROM (SELECT DISTINCT host FROM {hosts}) JOIN suffixes ON ends_with(host, '.' || suffix)) WHERE r = 1) r
          ON h.host = r.host) x
    LEFT JOIN {{map}} a ON x.host = a.SourceCommonName LEFT JOIN {{map}} b ON registrable = b.SourceCommonName
    LEFT JOIN {{map}} d ON two = d.SourceCommonName"""


add("host_matches", ("kept_hosts", "suffixes", "src_map"), matches_sql("kept_hosts").format(map="src_map"))
add("matched_domains", ("kept_hosts", "host_matches"), """
    SELECT region, CAST(id AS VARCHAR) AS id, domain, medialabel, typelabel, countrylabel, coalesce(inception, '') AS inception
    FROM (SELECT *, row_number() OVER (PARTITION BY region, domain ORDER BY medialabel) AS r2 FROM (
            SELECT *, row_number() OVER (PARTITION BY region, host ORDER BY medialabel) AS r FROM kept_hosts) k
          JOIN host_matches m ON k.host = m.host WHERE r = 1 AND domain IS NOT NULL) WHERE r2 = 1""")


@register("jn13_cascade_match", query("SELECT host, id, domain FROM host_matches WHERE domain IS NOT NULL", "host_matches"))
def cascade_match(t):
    return registry.match_hosts(registry.with_host(registry.not_excluded(t.registry)), t.dictionary, t.suffixes)


@register(
    "jn13_page_domains",
    query(
        "SELECT host, id, domain FROM matches WHERE domain IS NOT NULL", "suffixes",
        page_hosts=r"SELECT DISTINCT rtrim(regexp_extract(url, 'https?://(?:www\.)?([^/?:]+)', 1), '.') AS host FROM pages",
        known="SELECT CAST(row_number() OVER (ORDER BY SourceCommonName) AS INTEGER) AS SourceCommonName_ID, SourceCommonName FROM "
              "(SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS SourceCommonName FROM page_hosts)",
        matches=matches_sql("page_hosts").format(map="known"),
    ),
)
def page_domains(t):
    hosts = t.read("pages").select(c.host_of(F.col("url")).alias("host")).distinct()
    labels = F.split("host", r"\.")
    names = hosts.select(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(3)), 3), ".").alias("SourceCommonName"))
    none = t.spark.createDataFrame([], "SourceCommonName_ID int, SourceCommonName string")
    return registry.match_hosts(hosts, grown_dictionary(none, names), t.suffixes)


@register("ag46_matched_domains", query("SELECT * FROM matched_domains", "matched_domains"))
def matched_domains(t):
    return registry.matched_domains(t.registry, t.dictionary, t.suffixes, ["medialabel"])


@register(
    "ag45_match_coverage",
    query(
        f"""SELECT region, count(DISTINCT k.host) AS hosts, count(DISTINCT domain) AS matches,
        {sql6('count(DISTINCT domain) * 100.0 / count(DISTINCT k.host)')} AS rate
        FROM kept_hosts k LEFT JOIN host_matches m ON k.host = m.host GROUP BY 1""", "kept_hosts", "host_matches",
    ),
)
def match_coverage(t):
    return rounded(registry.match_coverage(t.registry, t.dictionary, t.suffixes), "rate")


@register("set04_region_hosts", query("SELECT DISTINCT region, host FROM kept_hosts", "kept_hosts"))
def region_hosts(t):
    kept = registry.with_host(registry.not_excluded(t.registry))
    files = [kept.filter(F.col("region") == r).select("region", "host") for r in ("EU", "US", "AS")]
    return reduce(lambda a, b: a.unionByName(b), files).distinct()


@register("set05_one_per_key", query("SELECT Src_ID, round(ratio_eco + 1e-9, 6) AS ratio_eco FROM features", "features"))
def one_per_key(t):
    table = feature_table(t)
    return rounded(topk.one_per_key(table.unionByName(table), ["Src_ID", "ratio_eco"], "Src_ID"), "ratio_eco")


# -- Clusters ----------------------------------------------------------------

REPORT = ["cv_monthly", "cv_yearly"]


@register(
    "ag47_cluster_report",
    query(
        f"""SELECT s.*, examples FROM (SELECT cluster, count(*) AS sources, sum(total_articles)::BIGINT AS articles, {', '.join(f'{sql6(f"avg({m})")} AS {m}' for m in REPORT)},
          {sql6('count(*) * 100.0 / (SELECT count(*) FROM labelled)')} AS pct_sources,
          {sql6('sum(total_articles) * 100.0 / (SELECT sum(total_articles) FROM labelled)')} AS pct_articles FROM labelled GROUP BY 1) s
        JOIN (SELECT cluster, string_agg(SourceCommonName, ', ' ORDER BY total_articles DESC, SourceCommonName) AS examples
              FROM (SELECT cluster, total_articles, SourceCommonName, row_number() OVER (PARTITION BY cluster ORDER BY total_articles DESC, SourceCommonName) AS r
                    FROM labelled JOIN src_map m ON Src_ID = m.SourceCommonName_ID) WHERE r <= 5 GROUP BY 1) USING (cluster)""",
        "labelled", "src_map",
    ),
)
def cluster_report(t):
    report = clusters.cluster_report(labelled(t), t.dictionary, REPORT, 5)
    return rounded(report, *REPORT, "pct_sources", "pct_articles")


MEDIANS = ", ".join(f"{sql6(f'median({f})')} AS {f}" for f in features.FEATURES)


@register("ag48_cluster_medians", query(f"SELECT cluster, count(*) AS n_sources, {MEDIANS} FROM labelled GROUP BY 1", "labelled"))
def cluster_medians(t):
    return rounded(clusters.profile(labelled(t), list(features.FEATURES)), *features.FEATURES)


LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)
CVS = ["cv_monthly", "cv_yearly"]


@register(
    "ag52_cv_percentiles",
    query(
        "SELECT measure, level, round(v + 1e-9, 6) AS value FROM (" + " UNION ALL ".join(
            f"SELECT '{m}' AS measure, unnest({list(LEVELS)})::DOUBLE AS level, unnest(quantile_cont({m}, {list(LEVELS)})) AS v FROM features"
            for m in CVS
        ) + ")", "features",
    ),
)
def cv_percentiles(t):
    return rounded(clusters.measure_percentiles(feature_table(t), CVS, LEVELS), "value")


BOX = ["cv_monthly", "mean_wordcount", "ratio_eco"]


@register(
    "ag53_box_summary",
    query(
        f"""SELECT cluster, is_wiki, measure, n, {sql6('q1')} AS q1, {sql6('m')} AS median, {sql6('q3')} AS q3,
        {sql6('min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS low,
        {sql6('max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS high
        FROM tall JOIN (SELECT cluster, is_wiki, measure, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS m,
                               quantile_cont(v, 0.75) AS q3 FROM tall GROUP BY 1, 2, 3) USING (cluster, is_wiki, measure)
        GROUP BY cluster, is_wiki, measure, n, q1, m, q3""", "labelled",
        tall=" UNION ALL ".join(f"SELECT cluster, is_wiki, '{m}' AS measure, {m} AS v FROM labelled" for m in BOX),
    ),
)
def box_summary(t):
    # Ties at the whisker limit need equal last digits, so the table is stored once.
    table = stage_lookup(labelled(t), "labelled").frame
    return rounded(profiling.box_summary(table, BOX, ["cluster", "is_wiki"]), "q1", "median", "q3", "low", "high")


RULES = clusters.RetentionRules(
    min_years_active=5.0, max_inactive_days=0.95, max_cv_monthly=1.0, min_log_volume=3.0, min_h_themes=0.5,
    min_themes_per_article=9.0, min_ratio_eco=0.05, min_h_eco=0.0,
)
RETENTION_CASE = f"""CASE WHEN NOT (years_active >= {RULES.min_years_active} AND inactive_days_rate <= {RULES.max_inactive_days}
    AND cv_monthly <= {RULES.max_cv_monthly} AND log_articles_per_year >= {RULES.min_log_volume}) THEN '{clusters.IRREGULAR}'
    WHEN h_norm_themes >= {RULES.min_h_themes} AND mean_themes_per_art >= {RULES.min_themes_per_article} THEN '{clusters.GENERALIST}'
    WHEN ratio_eco >= {RULES.min_ratio_eco} AND h_norm_eco_themes >= {RULES.min_h_eco} THEN '{clusters.ECONOMIC}'
    ELSE '{clusters.POOR}' END"""
PROFILES = "SELECT cluster, " + ", ".join(f"median({f}) AS {f}" for f in features.FEATURES) + " FROM labelled GROUP BY 1"


@register("flt15_cluster_retention", query(f"SELECT cluster, reason, reason LIKE 'kept%' AS kept FROM (SELECT cluster, {RETENTION_CASE} AS reason FROM profiles)", "labelled", profiles=PROFILES))
def cluster_retention(t):
    profiles = clusters.profile(labelled(t), list(features.FEATURES))
    return clusters.retention(profiles, RULES).select("cluster", "reason", "kept")


@register("flt16_kept_and_rejected", query("SELECT Src_ID, cluster IN (1, 3) AS kept FROM labelled", "labelled"))
def kept_and_rejected(t):
    kept, rejected = clusters.split_by_clusters(labelled(t), [1, 3])
    both = kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))
    return both.select("Src_ID", "kept")


@register(
    "tk04_drawn_sources",
    query(
        """SELECT Src_ID, cluster, is_wiki FROM (SELECT *, row_number() OVER (PARTITION BY cluster, is_wiki
           ORDER BY ('0x' || substr(md5(CAST(Src_ID AS VARCHAR)), 1, 8))::UBIGINT, Src_ID) AS r FROM labelled) WHERE r <= 3""",
        "labelled",
    ),
)
def drawn_sources(t):
    return clusters.drawn_sources(labelled(t), 3).select("Src_ID", "cluster", "is_wiki")
