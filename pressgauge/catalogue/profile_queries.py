"""Descriptive reports, top lists, buckets, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.cleaning_queries import (
    ACTIVITY, LONGEVITY_CASE, SHORT_WORD_CASE, VOLUME_CASE, WORD_CASE,
)
from pressgauge.catalogue.registry import register, rounded
from pressgauge.catalogue.sql import DAY, add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.operators import cleaning, profiling, topk
from pressgauge.session import stage

ID = "GKGRECORDID"
DRAW = "('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::UBIGINT"

add("activity", ("final",), ACTIVITY.format("final"))
add("skewed_activity", ("skewed_dated",), ACTIVITY.format("skewed_dated"))


def final(t):
    """Articles after all filters, text columns kept."""
    return cleaning.with_enough_themes(cleaning.from_sources(t.base, t.whitelist))


def activity(t):
    return cleaning.source_activity(final(t))


STEPS = (("raw", "gkg", "SourceCommonName_ID"), ("dated", "sourced", "Src_ID"), ("base", "base", "Src_ID"),
         ("final", "final", "Src_ID"))


@register(
    "ag20_cleaning_funnel",
    query(
        "SELECT *, (SELECT rows FROM steps WHERE step_no = 1) - rows AS removed FROM steps", "gkg", "sourced", "base", "final",
        steps=" UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS step_no, '{n}' AS step, count(*) AS rows, count(DISTINCT {s}) AS sources FROM {v}"
            for i, (n, v, s) in enumerate(STEPS, start=1)
        ),
    ),
)
def cleaning_funnel(t):
    return profiling.funnel(cleaning.passed_steps(t.gkg, t.dictionary, t.whitelist), cleaning.STEPS)


@register(
    "ag21_view_dashboard",
    query(
        """SELECT category, indicator, value FROM (
          SELECT 'volume' AS category, unnest(['articles', 'sources', 'mean articles of a source']) AS indicator,
            unnest([CAST(sum(n) AS VARCHAR), CAST(count(DISTINCT Src_ID) AS VARCHAR),
              printf('%.1f', round(sum(n)::DOUBLE / count(DISTINCT Src_ID) + 1e-9, 1))]) AS value FROM per_year
          UNION ALL SELECT 'years', unnest(['mean articles of a source and year', 'mean sources of a year']),
            unnest([printf('%.1f', round(avg(n) + 1e-9, 1)), printf('%.1f', round(count(*)::DOUBLE / count(DISTINCT year) + 1e-9, 1))])
            FROM per_year
          UNION ALL SELECT 'longevity', 'sources by active years', string_agg(years || ': ' || k, '; ' ORDER BY years)
            FROM (SELECT years, count(*) AS k FROM (SELECT count(*) AS years FROM per_year GROUP BY Src_ID) GROUP BY years))""",
        "final", per_year="SELECT Src_ID, substr(DATE, 1, 4) AS year, count(*) AS n FROM final GROUP BY 1, 2",
    ),
)
def view_dashboard(t):
    return profiling.dashboard(final(t))


def blank(name):
    return f"({name} IS NULL OR {name} = '')"


PERCENT = "100 * (count(*) FILTER ({0}))::DOUBLE / count(*)"
AUDIT = [
    ("1. volume", "articles", "count(*)::DOUBLE", None),
    ("1. volume", "repeated ids", f"(count(*) - count(DISTINCT {ID}))::DOUBLE", "value = 0"),
    ("2. format", "urls without http",
     "(count(*) FILTER (SourceCollectionIdentifier = 1 AND DocumentIdentifier NOT ILIKE 'http%'))::DOUBLE", "value = 0"),
    ("2. format", "translation flag outside 0/1", "(count(*) FILTER (IsTranslingual NOT IN (0, 1)))::DOUBLE", "value = 0"),
    ("3. completeness", "id, date or url blank (%)",
     PERCENT.format(f"{ID} IS NULL OR DATE IS NULL OR {blank('DocumentIdentifier')}"), "value = 0"),
    *[("3. completeness", f"{n} blank (%)", PERCENT.format(blank(n)), None)
      for n in ("EnhancedThemes", "EnhancedLocations", "Persons", "Organizations")],
    ("4. numbers", "tone minimum", "min(Tone)", "value >= -100"),
    ("4. numbers", "tone maximum", "max(Tone)", "value <= 100"),
    ("4. numbers", "word count minimum", "min(WordCount)::DOUBLE", "value >= 0"),
]


@register(
    "ag22_quality_audit",
    query(
        f"SELECT category, indicator, status, {sql6('value')} AS value FROM (" + " UNION ALL ".join(
            f"SELECT '{cat}' AS category, '{ind}' AS indicator, value, "
            + (f"CASE WHEN {test} THEN 'ok' ELSE 'warn' END" if test else "'info'")
            + f" AS status FROM (SELECT {value} AS value FROM gkg)"
            for cat, ind, value, test in AUDIT
        ) + ")",
        "gkg",
    ),
)
def quality_audit(t):
    return rounded(profiling.quality_audit(t.gkg), "value")


LISTED = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ';')) END"


def six(value, source, group=""):
    return (
        f"count(v) AS n, min(v) AS minimum, {sql6('quantile_cont(v, 0.25)')} AS q1, {sql6('median(v)')} AS median, "
        f"{sql6('avg(v)')} AS mean, {sql6('quantile_cont(v, 0.75)')} AS q3, max(v) AS maximum "
        f"FROM (SELECT {group} ({value})::DOUBLE AS v FROM {source})"
    )


@register(
    "ag22_entity_summaries",
    query(
        " UNION ALL ".join(
            f"SELECT '{m}' AS measure, {six(v, 'gkg')}"
            for m, v in (("tone", "Tone"), ("words", "WordCount"), ("themes", LISTED.format("EnhancedThemes")),
                         ("persons", LISTED.format("Persons")), ("organizations", LISTED.format("Organizations")))
        ),
        "gkg",
    ),
)
def entity_summaries(t):
    return rounded(profiling.entity_summaries(t.gkg), "q1", "median", "mean", "q3")


def quantiles_sql(value, source, levels):
    listed = ", ".join(f"{x}" for x in levels)
    return (
        f"SELECT level::DOUBLE AS level, round(q + 1e-9, 6) AS value FROM (SELECT unnest([{listed}]) AS level, "
        f"unnest(quantile_cont({value}::DOUBLE, [{listed}])) AS q FROM {source} WHERE {value} IS NOT NULL)"
    )


@register("ag23_word_quantiles", query(quantiles_sql("WordCount", "sourced", profiling.WORD_LEVELS), "sourced"))
def word_quantiles(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    return rounded(profiling.word_quantiles(rows), "value")


@register(
    "ag23_source_volume_quantiles",
    query(quantiles_sql("articles", "activity", profiling.SOURCE_LEVELS), "activity"),
)
def source_volume_quantiles(t):
    return rounded(profiling.source_volume_quantiles(activity(t)), "value")


@register(
    "ag23_source_year_quantiles", query(quantiles_sql("years", "activity", profiling.YEAR_LEVELS), "activity")
)
def source_year_quantiles(t):
    return rounded(profiling.source_year_quantiles(activity(t)), "value")


@register(
    "ag23_theme_count_quantiles",
    query(
        quantiles_sql("themes", "counts", profiling.THEME_LEVELS), "sourced",
        counts="SELECT CASE WHEN EnhancedThemes IS NULL OR EnhancedThemes = '' THEN 0 "
               "ELSE len(string_split(EnhancedThemes, ';')) END AS themes FROM sourced",
    ),
)
def theme_count_quantiles(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    return rounded(profiling.theme_count_quantiles(rows), "value")


# -- Top lists ---------------------------------------------------------------


def top_sql(field, name, k=50):
    return f"""SELECT name, count(*) AS citations FROM (SELECT {name} AS name FROM
        (SELECT trim(unnest(string_split({field}, ';'))) AS p FROM final WHERE {field} IS NOT NULL AND {field} <> '')
        WHERE p <> '') WHERE name <> '' GROUP BY 1 ORDER BY citations DESC, name LIMIT {k}"""


@register("ag34_top_themes", query(top_sql("EnhancedThemes", "split_part(p, ',', 1)"), "final"))
def top_themes(t):
    return profiling.top_themes(final(t))


@register("ag34_top_persons", query(top_sql("Persons", "p"), "final"))
def top_persons(t):
    return profiling.top_persons(final(t))


@register("ag34_top_organizations", query(top_sql("Organizations", "p"), "final"))
def top_organizations(t):
    return profiling.top_organizations(final(t))


@register("ag34_top_places", query(top_sql("EnhancedLocations", "split_part(p, '#', 2)"), "final"))
def top_places(t):
    return profiling.top_places(final(t))


@register(
    "ag34_top_sources",
    query(
        "SELECT Src_ID, SourceCommonName, articles FROM activity JOIN src_map m ON Src_ID = m.SourceCommonName_ID "
        "ORDER BY articles DESC, SourceCommonName LIMIT 50", "activity", "src_map",
    ),
)
def top_sources(t):
    return profiling.top_sources(final(t), t.dictionary)


@register(
    "ag35_theme_shares",
    query(
        f"""SELECT month, theme, {sql6('votes * 100.0::DOUBLE / total')} AS pct_articles
        FROM (SELECT month, theme, count(*) AS votes FROM votes
              WHERE theme IN (SELECT theme FROM (SELECT theme, count(*) AS n FROM votes GROUP BY 1 ORDER BY n DESC, theme LIMIT 20))
              GROUP BY 1, 2)
        JOIN (SELECT substr(DATE, 1, 4) || '-' || substr(DATE, 5, 2) AS month, count(*) AS total FROM final GROUP BY 1) USING (month)""",
        "final",
        votes=f"""SELECT DISTINCT {ID}, month, split_part(trim(p), ',', 1) AS theme FROM (
            SELECT {ID}, substr(DATE, 1, 4) || '-' || substr(DATE, 5, 2) AS month,
                   unnest(string_split(EnhancedThemes, ';')) AS p FROM final) WHERE p <> ''""",
    ),
)
def theme_shares(t):
    return rounded(profiling.theme_shares(final(t)), "pct_articles")


DAYS = f"SELECT {DAY} AS day, count(*) AS n_articles FROM final GROUP BY 1"


@register("ag36_articles_per_day", query("SELECT * FROM days", "final", days=DAYS))
def articles_per_day(t):
    return profiling.articles_per_day(final(t))


@register(
    "ag36_missing_days",
    query(
        "SELECT d AS day FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS d FROM days) "
        "WHERE d NOT IN (SELECT day FROM days)", "final", days=DAYS,
    ),
)
def missing_days(t):
    return profiling.missing_days(profiling.articles_per_day(final(t)))


@register(
    "ag37_series_summary",
    query(
        f"SELECT count(n_articles) AS n, sum(n_articles)::BIGINT AS total, {sql6('avg(n_articles)')} AS mean, "
        f"{sql6('median(n_articles)')} AS median, {sql6('stddev_samp(n_articles)')} AS sd, min(n_articles) AS minimum, "
        "max(n_articles) AS maximum FROM days", "final", days=DAYS,
    ),
)
def series_summary(t):
    return rounded(profiling.series_summary(profiling.articles_per_day(final(t)), "n_articles"), "mean", "median", "sd")


@register(
    "ag38_weekday_means",
    query(
        f"SELECT CAST(isodow(day) AS INTEGER) AS weekday_no, dayname(day) AS weekday, {sql6('avg(n_articles)')} AS mean "
        "FROM days GROUP BY 1, 2", "final", days=DAYS,
    ),
)
def weekday_means(t):
    return rounded(profiling.weekday_means(profiling.articles_per_day(final(t)), "n_articles"), "mean")


@register(
    "ag39_tone_histogram",
    query(
        "SELECT CAST(least(floor((Tone - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n "
        "FROM final, (SELECT min(Tone) AS lo, max(Tone) AS hi FROM final) GROUP BY 1", "final",
    ),
)
def tone_histogram(t):
    return profiling.tone_histogram(final(t))


@register(
    "ag39_tone_describe",
    query(f"SELECT 'Tone' AS measure, {six('Tone', 'final')}", "final"),
)
def tone_describe(t):
    return rounded(profiling.six_numbers(final(t), ["Tone"]), "q1", "median", "mean", "q3")


@register(
    "ag40_monthly_tone",
    query(
        f"SELECT CAST(date_trunc('month', {DAY}) AS DATE) AS month, {sql6('avg(Tone)')} AS avg_tone, count(*) AS n "
        "FROM final GROUP BY 1", "final",
    ),
)
def monthly_tone(t):
    return rounded(profiling.monthly_tone(final(t)), "avg_tone")


# -- Buckets -----------------------------------------------------------------


@register(
    "ag41_volume_buckets",
    query(
        f"SELECT {VOLUME_CASE} AS bucket, count(*) AS sources, sum(articles)::BIGINT AS articles_sum, min(articles) AS smallest, "
        f"{sql6('sum(articles) * 100.0 / (SELECT sum(articles) FROM activity)')} AS pct_volume FROM activity GROUP BY 1",
        "activity",
    ).replace("articles_sum", "articles"),
)
def volume_buckets(t):
    return rounded(profiling.volume_buckets(activity(t)), "pct_volume")


@register(
    "ag42_longevity_buckets",
    query(
        f"""SELECT bucket, count(*) AS sources, sum(articles)::BIGINT AS articles, min(years) AS sort_order,
        {sql6('sum(articles) * 100.0 / (SELECT sum(articles) FROM activity)')} AS pct_volume,
        string_agg(SourceCommonName, ', ' ORDER BY SourceCommonName) FILTER (draw <= 10) AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {DRAW.format('SourceCommonName')}, SourceCommonName) AS draw
              FROM (SELECT a.*, SourceCommonName, {LONGEVITY_CASE} AS bucket FROM activity a
                    LEFT JOIN src_map m ON Src_ID = m.SourceCommonName_ID)) GROUP BY bucket""",
        "activity", "src_map",
    ),
)
def longevity_buckets(t):
    return rounded(profiling.longevity_buckets(activity(t), t.dictionary), "pct_volume")


def skewed_activity(t):
    """Activity of outlets of very different volume, stored: three results read it."""
    return stage(cleaning.source_activity(cleaning.with_source(cleaning.dated(t.skewed), t.outlets)), "skewed-activity")


@register(
    "ag41_skewed_volume_buckets",
    query(
        f"SELECT {VOLUME_CASE} AS bucket, count(*) AS sources, sum(articles)::BIGINT AS articles_sum, min(articles) AS smallest, "
        f"{sql6('sum(articles) * 100.0 / (SELECT sum(articles) FROM skewed_activity)')} AS pct_volume FROM skewed_activity GROUP BY 1",
        "skewed_activity",
    ).replace("articles_sum", "articles"),
)
def skewed_volume_buckets(t):
    return rounded(profiling.volume_buckets(skewed_activity(t)), "pct_volume")


@register(
    "ag42_skewed_longevity_buckets",
    query(
        f"""SELECT bucket, count(*) AS sources, sum(articles)::BIGINT AS articles, min(years) AS sort_order,
        {sql6('sum(articles) * 100.0 / (SELECT sum(articles) FROM skewed_activity)')} AS pct_volume,
        string_agg(name, ', ' ORDER BY name) FILTER (draw <= 10) AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {DRAW.format('name')}, name) AS draw
              FROM (SELECT *, 'outlet' || Src_ID || '.example.com' AS name, {LONGEVITY_CASE} AS bucket FROM skewed_activity))
        WHERE bucket IS NOT NULL GROUP BY bucket""",  # more than 12 years: in no bucket, as the inner join on it says
        "skewed_activity",
    ),
)
def skewed_longevity_buckets(t):
    return rounded(profiling.longevity_buckets(skewed_activity(t), t.outlets), "pct_volume")


@register(
    "ag01_skewed_whitelist",
    query(
        "SELECT Src_ID FROM skewed_dated GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT substr(DATE, 1, 4)) >= 2",
        "skewed_dated",
    ),
)
def skewed_whitelist(t):
    return cleaning.global_whitelist(t.skewed, t.outlets)


@register(
    "ag43_word_buckets",
    query(
        f"SELECT {WORD_CASE} AS bucket, count(*) AS articles, count(DISTINCT Src_ID) AS sources, "
        f"{sql6('count(*) * 100.0 / (SELECT count(*) FROM sourced)')} AS pct_articles, "
        f"{sql6('count(DISTINCT Src_ID) * 100.0 / (SELECT count(DISTINCT Src_ID) FROM sourced)')} AS pct_sources "
        "FROM sourced WHERE WordCount IS NOT NULL GROUP BY 1", "sourced",
    ),
)
def word_buckets(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    return rounded(profiling.word_buckets(rows), "pct_articles", "pct_sources")


@register(
    "ag44_themes_by_length",
    query(
        f"""SELECT bucket, count(*) AS articles, {sql6('avg(themes)')} AS avg_themes,
        string_agg(url, ' | ' ORDER BY url) FILTER (draw <= 3) AS examples
        FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {DRAW.format('url')}, url) AS draw
              FROM (SELECT {SHORT_WORD_CASE} AS bucket, DocumentIdentifier AS url,
                           len(string_split(EnhancedThemes, ';')) AS themes FROM sourced WHERE WordCount IS NOT NULL))
        GROUP BY bucket""",
        "sourced",
    ),
)
def themes_by_length(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    return rounded(profiling.themes_by_length(rows), "avg_themes")


@register(
    "jn09_totals_share",
    query(
        f"SELECT {WORD_CASE} AS bucket, {sql6('count(*) * 100.0 / (SELECT count(*) FROM base)')} AS pct_articles FROM base GROUP BY 1",
        "base",
    ),
)
def totals_share(t):
    return rounded(profiling.word_buckets(t.base).select("bucket", "pct_articles"), "pct_articles")


@register(
    "ag49_top_locations",
    query(
        """SELECT CASE loc_type WHEN '1' THEN 'Pays' WHEN '2' THEN 'État US' WHEN '3' THEN 'Ville US'
           WHEN '4' THEN 'Ville Monde' WHEN '5' THEN 'Région Monde' ELSE 'Inconnu' END AS type_name,
           country_code, loc_name, mentions
        FROM (SELECT split_part(p, '#', 1) AS loc_type, split_part(p, '#', 2) AS loc_name, split_part(p, '#', 3) AS country_code,
                     count(*) AS mentions
              FROM (SELECT unnest(string_split(EnhancedLocations, ';')) AS p FROM gkg
                    WHERE EnhancedLocations IS NOT NULL AND EnhancedLocations <> '') WHERE p <> '' GROUP BY ALL)
        WHERE country_code <> '' ORDER BY mentions DESC, loc_type, country_code, loc_name LIMIT 20""",
        "gkg",
    ),
)
def top_locations(t):
    return profiling.top_locations(t.gkg)


@register(
    "ag50_loader_info",
    query(
        f"""SELECT min(period) AS date_min, max(period) AS date_max, count(*) AS n_articles, count(DISTINCT period) AS n_days,
        {sql6('count(*)::DOUBLE / count(DISTINCT period)')} AS articles_per_day, {sql6('avg(tone)')} AS mean_tone,
        {sql6('avg(tone_bin)')} AS mean_tone_bin, {sql6('avg(total_themes_count)')} AS mean_themes FROM clean""",
        "clean",
    ),
)
def loader_info(t):
    return rounded(profiling.loader_info(t.clean), "articles_per_day", "mean_tone", "mean_tone_bin", "mean_themes")


@register(
    "ag50_daily_counts",
    query(f"SELECT period, count(*) AS n_articles, {sql6('avg(tone)')} AS mean_tone FROM clean GROUP BY 1", "clean"),
)
def daily_counts(t):
    return rounded(profiling.daily_counts(t.clean), "mean_tone")


# -- Windows, limits, set operations -----------------------------------------


@register(
    "w02_draw_per_group",
    query(
        f"""SELECT Src_ID, {ID} FROM (SELECT Src_ID, {ID}, row_number() OVER (PARTITION BY Src_ID
            ORDER BY {DRAW.format(ID)}, {ID}) AS draw FROM sourced) WHERE draw <= 10""", "sourced",
    ),
)
def draw_per_group(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary).select("Src_ID", ID)
    return topk.draw_per_group(rows, ["Src_ID"], 10, ID)


@register(
    "w03_top_per_group",
    query(
        f"""SELECT Src_ID, {ID}, WordCount FROM (SELECT *, row_number() OVER (PARTITION BY Src_ID ORDER BY WordCount DESC, {ID}) AS r
            FROM base) WHERE r <= 5""", "base",
    ),
)
def top_per_group(t):
    return topk.first_per_group(
        t.base.select("Src_ID", ID, "WordCount"), ["Src_ID"], [F.desc("WordCount"), F.col(ID)], 5
    )


@register(
    "tk01_top_counts",
    query("SELECT Src_ID, count(*) AS n FROM base GROUP BY 1 ORDER BY n DESC, Src_ID LIMIT 25", "base"),
)
def top_counts(t):
    return topk.top_counts(t.base, ["Src_ID"], 25)


@register(
    "tk02_ordered_output",
    query("SELECT Src_ID, substr(DATE, 1, 4) AS pub_year, count(*) AS n FROM base GROUP BY 1, 2 ORDER BY 2, 3 DESC, 1", "base"),
)
def ordered_output(t):
    return cleaning.source_years(t.base).orderBy("pub_year", F.desc("n"), "Src_ID")


@register(
    "tk03_sample_rows",
    query(f"SELECT {ID}, tone FROM clean ORDER BY {DRAW.format(ID)}, {ID} LIMIT 100", "clean"),
)
def sample_rows(t):
    return topk.sample_rows(t.clean.select(ID, "tone"), 100, ID)


@register("tk05_first_rows", query(f"SELECT {ID}, period, tone FROM clean ORDER BY {ID} LIMIT 10", "clean"))
def first_rows(t):
    return t.clean.select(ID, "period", "tone").orderBy(ID).limit(10)


@register(
    "set03_distinct_rows",
    query("SELECT DISTINCT period, code AS country_code FROM (SELECT period, unnest(countries_list) AS code FROM clean)", "clean"),
)
def distinct_rows(t):
    return t.clean.select("period", F.explode("countries_list").alias("country_code")).distinct()
