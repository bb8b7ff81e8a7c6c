"""Sector and regional indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.registry import r6, register, rounded
from pressgauge.catalogue.sql import DAY, THEMED, add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.operators import cleaning, substring
from pressgauge.operators import indicators as ind

MEASURES = (*ind.SUMS[:2], *ind.SUMS[3:], *ind.METRICS)
SQL_MEASURES = ", ".join(f"{sql6(m)} AS {m}" for m in MEASURES)
GEO = ("region_key",)


def long_rows(df, *keys):
    return df.select("period", *keys, "sector", "granularity", "N", "sum_t_bin", "total_news", *[r6(m).alias(m) for m in MEASURES])


@register(
    "ag06_daily_totals",
    query("SELECT period, total_news FROM total_news", "total_news"),
)
def daily_totals(t):
    return ind.daily_totals(t.clean)


@register(
    "ag07_regional_totals",
    query("SELECT period, region_key, total_news FROM total_region", "total_region"),
)
def regional_totals(t):
    return ind.daily_totals(ind.regional_articles(t.clean, t.regions), GEO)


@register(
    "ag08_theme_hits",
    query("SELECT GKGRECORDID, period, sector, cat_key, total_themes_count, theme_hits FROM hits", "hits"),
)
def theme_hits(t):
    return ind.theme_hits(t.clean, t.taxonomy).select(
        "GKGRECORDID", "period", "sector", "cat_key", "total_themes_count", "theme_hits"
    )


SUM_SQL = ", ".join(f"{sql6(m)} AS {m}" for m in ("sum_w", "sum_t_cont", "sum_t_cont_w", "sum_t_bin_w"))


@register(
    "ag09_category_sums",
    query(f"SELECT period, sector, granularity, N, sum_t_bin, {SUM_SQL} FROM cat_sums", "cat_sums"),
)
def category_sums(t):
    sums = ind.category_sums(ind.theme_hits(t.clean, t.taxonomy))
    return rounded(sums, "sum_w", "sum_t_cont", "sum_t_cont_w", "sum_t_bin_w")


@register(
    "ag10_sector_sums",
    query(f"SELECT period, sector, granularity, N, sum_t_bin, {SUM_SQL} FROM sec_sums", "sec_sums"),
)
def sector_sums(t):
    sums = ind.sector_sums(ind.theme_hits(t.clean, t.taxonomy))
    return rounded(sums, "sum_w", "sum_t_cont", "sum_t_cont_w", "sum_t_bin_w")


@register(
    "ag11_ten_indicators",
    query(
        f"SELECT period, sector, granularity, N, sum_t_bin, total_news, {SQL_MEASURES} FROM indicators", "indicators"
    ),
)
def ten_indicators(t):
    return long_rows(ind.long_indicators(t.clean, t.taxonomy))


@register(
    "ag12_regional_indicators",
    query(
        f"SELECT period, region_key, sector, granularity, N, sum_t_bin, total_news, {SQL_MEASURES} FROM geo_indicators",
        "geo_indicators",
    ),
)
def regional_indicators(t):
    return long_rows(ind.regional_indicators(t.clean, t.taxonomy, t.regions), *GEO)


# -- Regions -----------------------------------------------------------------


@register("jn04_article_regions", query("SELECT GKGRECORDID, period, region_key FROM art_regions", "art_regions"))
def article_regions(t):
    return ind.article_regions(t.clean, t.regions)


@register(
    "jn05_articles_by_region",
    query(
        "SELECT c.GKGRECORDID, c.period, region_key, total_themes_count FROM clean c JOIN art_regions a "
        "ON c.GKGRECORDID = a.GKGRECORDID", "clean", "art_regions",
    ),
)
def articles_by_region(t):
    return ind.regional_articles_by_id(t.clean, t.regions).select(
        "GKGRECORDID", "period", "region_key", "total_themes_count"
    )


@register(
    "jn06_with_daily_totals",
    query("SELECT period, sector, granularity, N, total_news FROM indicators", "indicators"),
)
def with_daily_totals(t):
    return ind.long_indicators(t.clean, t.taxonomy).select("period", "sector", "granularity", "N", "total_news")


@register(
    "set01_all_granularities",
    query(
        "SELECT period, sector, granularity, N FROM cat_sums UNION ALL SELECT period, sector, granularity, N FROM sec_sums",
        "cat_sums", "sec_sums",
    ),
)
def all_granularities(t):
    hits = ind.theme_hits(t.clean, t.taxonomy)
    both = ind.category_sums(hits).unionByName(ind.sector_sums(hits))
    return both.select("period", "sector", "granularity", "N")


# -- Wide tables -------------------------------------------------------------

SERIES = (("colour", None), ("colour", "blue"), ("colour", "econ"), ("colour", "red"), ("goods", None), ("goods", "bolt"),
          ("goods", "gear"), ("goods", "ring"), ("goods", "rod"), ("scale", None), ("scale", "econ"), ("scale", "size"))
NAMES = [s if cat is None else f"{s}_{cat}" for s, cat in SERIES]


def pivot_sql(metrics):
    return ", ".join(
        f"{sql6(f'max({m}) FILTER (sector = {chr(39)}{s}{chr(39)} AND granularity = {chr(39)}{cat or ind.SECTOR_ROW}{chr(39)})')} AS {m}_{n}"
        for (s, cat), n in zip(SERIES, NAMES)
        for m in metrics
    )


def names_of(metrics):
    return [f"{m}_{n}" for n in NAMES for m in metrics]


def wide_sql(metrics):
    return (
        f"SELECT period, {', '.join(names_of(metrics))} FROM total_news "
        f"LEFT JOIN (SELECT period, {pivot_sql(metrics)} FROM indicators GROUP BY period) USING (period)"
    )


@register("ag13_wide_table", query(wide_sql(ind.METRICS), "indicators", "total_news"))
def wide_table(t):
    long = ind.long_indicators(t.clean, t.taxonomy, totals=True)
    wide = ind.wide_indicators(long, ind.pivot_names(t.taxonomy))
    return rounded(wide, *names_of(ind.METRICS))


TWO = ("att", "sent_cont")


@register(
    "ag14_wide_regional_table",
    query(f"SELECT period, region_key, {pivot_sql(TWO)} FROM geo_indicators GROUP BY 1, 2", "geo_indicators"),
)
def wide_regional_table(t):
    long = ind.regional_indicators(t.clean, t.taxonomy, t.regions)
    return rounded(ind.wide_geo_indicators(long, ind.pivot_names(t.taxonomy), TWO), *names_of(TWO))


@register("prj13_wide_names", query(wide_sql(("att",)), "indicators", "total_news"))
def wide_names(t):
    long = ind.long_indicators(t.clean, t.taxonomy, totals=True)
    wide = ind.wide_indicators(long, ind.pivot_names(t.taxonomy), ("att",))
    return rounded(wide, *names_of(("att",)))


MERGED = [f"att_{n}" for n in NAMES]


@register(
    "ag15_merged_tables",
    query(
        f"SELECT period, {pivot_sql(('att',))} FROM indicators GROUP BY 1", "indicators",
    ),
)
def merged_tables(t):
    # Partial tables as separate runs leave them: per sector, and one of them twice.
    long = ind.long_indicators(t.clean, t.taxonomy)
    parts = [
        ind.widen(long.filter(F.col("sector") == s), ["period"], [n for (x, _), n in zip(SERIES, NAMES) if x == s], ("att",))
        for s in ("colour", "goods", "scale", "goods")
    ]
    return rounded(ind.merge_partial_tables(parts, ["period"]), *MERGED)


@register(
    "prj18_picked_series",
    query(
        f"""SELECT 'several' AS choice, period, 'att_' || sector AS series, {sql6('att')} AS value FROM indicators
        WHERE sector IN ('goods', 'scale') AND granularity = '__sector__'
        UNION ALL SELECT 'one', period, 'att_' || sector || '_' || granularity, {sql6('att')} FROM indicators
        WHERE sector = 'colour' AND granularity <> '__sector__'
        UNION ALL SELECT 'all', period, 'att_' || sector || CASE WHEN granularity = '__sector__' THEN '' ELSE '_' || granularity END,
        {sql6('att')} FROM indicators""", "indicators",
    ),
)
def picked_series(t):
    long = ind.long_indicators(t.clean, t.taxonomy)
    parts = [
        ind.pick_series(long, "att", sectors).withColumn("choice", F.lit(choice))
        for choice, sectors in (("several", ["goods", "scale"]), ("one", ["colour"]), ("all", None))
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


# -- The single-sector study -------------------------------------------------

# 'WIDGET' hits every theme that ends in it; 'RED_RING' is a whole theme.
CATEGORIES = {"tools": ["WIDGET", "GEAR"], "rings": ["RED_RING", "BLUE_RING"], "econ": ["ECONOMY"]}


def contains_sql(names):
    return "(" + " OR ".join(f"contains(EnhancedThemes, '{n},')" for n in names) + ")"


ANY = " OR ".join(contains_sql(n) for n in CATEGORIES.values())
add("study_days", ("sourced",), f"""
    SELECT {DAY} AS period, count(*) AS total_news, {', '.join(
        f"sum(CASE WHEN {contains_sql(n)} THEN 1.0::DOUBLE ELSE 0 END) AS N_{cat}, "
        f"sum(CASE WHEN {contains_sql(n)} THEN Tone ELSE 0 END) AS SW_{cat}" for cat, n in CATEGORIES.items())}
    FROM sourced WHERE {THEMED} GROUP BY 1 HAVING sum(CASE WHEN {ANY} THEN 1 ELSE 0 END) > 0""")
add("study", ("study_days",), "SELECT period, total_news, " + ", ".join(
    f"coalesce(N_{cat}, 0) AS volume_s_{cat}, coalesce(N_{cat} / total_news, 0) AS attention_s_{cat}, "
    f"SW_{cat} / nullif(N_{cat}, 0) AS sentiment_s_{cat}" for cat in CATEGORIES) + " FROM study_days")
VOLUME = " + ".join(f"volume_s_{cat}" for cat in CATEGORIES)
MASS = " + ".join(f"coalesce(sentiment_s_{cat}, 0) * volume_s_{cat}" for cat in CATEGORIES)
add("study_sector", ("study",), f"""
    SELECT period, ({VOLUME}) / total_news * 100 AS attention, ({MASS}) / nullif({VOLUME}, 0) AS sentiment FROM study""")


def study_articles(t):
    return cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)


def study(t):
    sums = substring.daily_category_sums(study_articles(t), CATEGORIES)
    return substring.category_indicators(sums, "s", list(CATEGORIES))


def study_sector(t):
    return substring.sector_rollup(study(t), "s", list(CATEGORIES))


@register(
    "flt12_category_flags",
    query(
        f"SELECT GKGRECORDID, {', '.join(f'{contains_sql(n)} AS f_{cat}' for cat, n in CATEGORIES.items())} FROM gkg WHERE {THEMED}",
        "gkg",
    ),
)
def category_flags(t):
    rows = cleaning.themed(t.gkg)
    flags = [substring.names_any(F.col("EnhancedThemes"), n).alias(f"f_{cat}") for cat, n in CATEGORIES.items()]
    return rows.select("GKGRECORDID", *flags)


STUDY_SUMS = [f"SW_{cat}" for cat in CATEGORIES]


@register(
    "ag16_one_pass_sums",
    query(
        f"SELECT period, total_news, {', '.join(f'N_{cat}' for cat in CATEGORIES)}, "
        f"{', '.join(f'{sql6(s)} AS {s}' for s in STUDY_SUMS)} FROM study_days", "study_days",
    ),
)
def one_pass_sums(t):
    return rounded(substring.daily_category_sums(study_articles(t), CATEGORIES), *STUDY_SUMS)


STUDY_COLUMNS = [f"{m}_s_{cat}" for cat in CATEGORIES for m in ("volume", "attention", "sentiment")]


@register(
    "ag17_category_indicators",
    query(f"SELECT period, total_news, {', '.join(f'{sql6(s)} AS {s}' for s in STUDY_COLUMNS)} FROM study", "study"),
)
def category_indicators(t):
    return rounded(study(t), *STUDY_COLUMNS)


@register(
    "ag18_sector_rollup",
    query(f"SELECT period, {sql6('attention')} AS attention, {sql6('sentiment')} AS sentiment FROM study_sector", "study_sector"),
)
def sector_rollup(t):
    return rounded(study_sector(t), "attention", "sentiment")


WEIGHTS = """SELECT GKGRECORDID, period, cat_key, {0} AS w FROM (
    SELECT GKGRECORDID, {1} AS period, list_filter(list_transform(string_split(EnhancedThemes, ';'),
           lambda x: upper(trim(split_part(trim(x), ',', 1)))), lambda k: k <> '') AS keys FROM sourced WHERE {2}),
    (VALUES ('rings', ['RED_RING', 'BLUE_RING']), ('econ', ['ECONOMY'])) v(cat_key, names)
    WHERE len(list_filter(keys, lambda k: list_contains(names, k))) > 0"""
EXACT = {"rings": ["RED_RING", "BLUE_RING"], "econ": ["ECONOMY"]}


@register(
    "ag19_article_weights",
    query(
        "SELECT 'fractional' AS mode, * FROM ("
        + WEIGHTS.format("round(len(list_filter(keys, lambda k: list_contains(names, k)))::DOUBLE / len(keys) + 1e-9, 6)", DAY, THEMED)
        + ") UNION ALL SELECT 'binary', * FROM (" + WEIGHTS.format("round(1.0::DOUBLE + 1e-9, 6)", DAY, THEMED) + ")",
        "sourced",
    ),
)
def article_weights(t):
    parts = [
        substring.article_weights(study_articles(t), EXACT, m).withColumn("mode", F.lit(m)) for m in ("fractional", "binary")
    ]
    return rounded(parts[0].unionByName(parts[1]), "w")


STATISTICS = ["attention_mean", "attention_max", "attention_sd", "sentiment_mean", "sentiment_sd", "pct_positive"]


@register(
    "ag51_category_statistics",
    query(
        " UNION ALL ".join(
            f"""SELECT '{cat}' AS category, {sql6('avg(a)')} AS attention_mean, {sql6('max(a)')} AS attention_max,
            {sql6('stddev_samp(a)')} AS attention_sd, {sql6('avg(s)')} AS sentiment_mean, {sql6('stddev_samp(s)')} AS sentiment_sd,
            {sql6('avg(CASE WHEN s > 0 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) * 100')} AS pct_positive
            FROM (SELECT attention_s_{cat} * 100 AS a, round(sentiment_s_{cat} + 1e-9, 9) AS s FROM study)"""
            for cat in CATEGORIES
        ),
        "study",
    ),
)
def category_statistics(t):
    # Sums of tones that cancel must count as 0 in both engines.
    calm = study(t).withColumns({f"sentiment_s_{cat}": F.round(F.col(f"sentiment_s_{cat}") + 1e-9, 9) for cat in CATEGORIES})
    return rounded(substring.category_statistics(calm, "s", list(CATEGORIES)), *STATISTICS)
