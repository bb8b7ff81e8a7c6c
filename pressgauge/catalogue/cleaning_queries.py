"""Filters, derived columns, source repair and whitelists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.registry import r6, register
from pressgauge.catalogue.sql import DAY, HOST, THEMED, VALID, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.functions import columns as c
from pressgauge.functions import labels
from pressgauge.operators import cleaning, profiling, registry, topk, vocabulary
from pressgauge.operators.features import log_volume as volume
from pressgauge.operators.lookups import lookup_join, stage_lookup
from pressgauge.settings import CleaningRules

ID = "GKGRECORDID"

# -- Filters -----------------------------------------------------------------


@register("flt01_valid_date", query(rf"SELECT {ID}, DATE FROM gkg WHERE regexp_matches(DATE, '^\d{{14}}$')", "gkg"))
def valid_date(t):
    return t.gkg.filter(c.has_valid_date(F.col("DATE"))).select(ID, "DATE")


# A record id of the given data takes the place of the known bad one.
@register(
    "flt02_bad_records",
    query(f"SELECT {ID} FROM gkg WHERE {VALID} AND {ID} <> (SELECT min({ID}) FROM gkg)", "gkg"),
)
def bad_records(t):
    first = t.gkg.agg(F.min(ID)).first()[0]
    rules = CleaningRules(bad_record_ids=(*CleaningRules().bad_record_ids, first))
    return cleaning.dated(t.gkg, rules).select(ID)


@register("flt03_with_themes", query(f"SELECT {ID}, EnhancedThemes FROM gkg WHERE {THEMED}", "gkg"))
def with_themes(t):
    return cleaning.themed(t.gkg).select(ID, "EnhancedThemes")


@register("flt04_word_bounds", query(f"SELECT {ID}, WordCount FROM gkg WHERE WordCount BETWEEN 15 AND 6500", "gkg"))
def word_bounds(t):
    return cleaning.sized(t.gkg).select(ID, "WordCount")


@register(
    "flt05_min_themes",
    query(f"SELECT {ID}, len(string_split(EnhancedThemes, ';')) AS themes FROM gkg WHERE {THEMED} "
          "AND len(string_split(EnhancedThemes, ';')) >= 6", "gkg"),
)
def min_themes(t):
    kept = cleaning.with_enough_themes(t.gkg, CleaningRules(min_themes=6))
    return kept.select(ID, c.theme_count(F.col("EnhancedThemes")).alias("themes"))


@register("flt06_known_source", query(f"SELECT {ID}, Src_ID FROM sourced", "sourced"))
def known_source(t):
    return cleaning.with_source(cleaning.dated(t.gkg), t.dictionary).select(ID, "Src_ID")


@register("flt07_year_prefix", query(f"SELECT {ID}, DATE FROM gkg WHERE DATE LIKE '1998%'", "gkg"))
def year_prefix(t):
    return t.gkg.filter(F.col("DATE").startswith("1998")).select(ID, "DATE")


@register(
    "flt08_sample",
    query(f"SELECT {ID} FROM gkg WHERE ('0x' || substr(md5({ID}), 1, 8))::UBIGINT % 100 < 5", "gkg"),
)
def sample(t):
    return t.gkg.filter(c.in_portable_sample(F.col(ID), 5)).select(ID)


WORDS_SQL = " OR ".join(
    "contains(lower(coalesce(medialabel, '') || ' ' || coalesce(typelabel, '')), '" + w.replace("'", "''") + "')"
    for w in registry.EXCLUDED_WORDS
)


@register("flt09_registry_exclusion", query(f"SELECT medialabel, typelabel FROM registry WHERE NOT ({WORDS_SQL})", "registry"))
def registry_exclusion(t):
    return registry.not_excluded(t.registry).select("medialabel", "typelabel")


VOCABULARY_SQL = """
SELECT theme FROM (
  SELECT regexp_replace(trim(value), '(?:\\s*_\\s*|\\s*)\\d+$', '') AS theme FROM vocab
  WHERE NOT regexp_matches(upper(trim(value)), 'ANVIL|OLD_')
    AND (regexp_matches(upper(trim(value)), '\\b(RED_RING|BLUE)\\b') OR regexp_matches(upper(trim(value)), 'WIDGET|GIZ')))
WHERE theme <> ''"""


@register(
    "flt10_theme_vocabulary",
    query(VOCABULARY_SQL, vocab="SELECT upper(replace(p_name, ' ', '_')) || ' ' || count(*) AS value FROM part GROUP BY p_name"),
)
def theme_vocabulary(t):
    names = t.read("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    lines = names.select(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(" "), "n").alias("value"))
    return vocabulary.pick_themes(lines, ["red_ring", "blue"], ["widget", "giz"], ["anvil", "old_"])


THEME_ROWS = f"""SELECT {ID}, split_part(p, ',', 1) AS theme
    FROM (SELECT {ID}, unnest(string_split(EnhancedThemes, ';')) AS p FROM gkg WHERE {THEMED}) WHERE p <> ''"""
WIDE_SQL = "theme LIKE 'ECON%' OR " + " OR ".join(f"theme LIKE '%{w}%'" for w in c.WIDE_ECONOMIC_WORDS)


@register(
    "flt11_economic_themes",
    query(
        f"SELECT theme, count(*) AS n, count(*) FILTER (theme LIKE '%ECON%') AS narrow, "
        f"count(*) FILTER ({WIDE_SQL}) AS wide FROM theme_rows GROUP BY theme",
        "gkg", theme_rows=THEME_ROWS,
    ),
)
def economic_themes(t):
    rows = profiling.mentions(t.gkg, "EnhancedThemes", c.raw_theme_key).withColumnRenamed("name", "theme")
    return rows.groupBy("theme").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(c.is_economic(F.col("theme")), 1)).alias("narrow"),
        F.count(F.when(c.is_economic_wide(F.col("theme")), 1)).alias("wide"),
    )


@register(
    "flt13_anchor_sources",
    query(
        f"SELECT {ID}, SourceCommonName FROM sourced JOIN src_map m ON Src_ID = m.SourceCommonName_ID "
        "WHERE lower(SourceCommonName) IN ('src1.example.com', 'src7.example.com', 'src49.example.com')",
        "sourced",
    ),
)
def anchor_sources(t):
    anchors = ["src1.example.com", "src7.example.com", "src49.example.com"]
    named = profiling.with_source_name(cleaning.with_source(cleaning.dated(t.gkg), t.dictionary), t.dictionary, "inner")
    return named.filter(F.lower("SourceCommonName").isin(anchors)).select(ID, "SourceCommonName")


# -- Derived columns ---------------------------------------------------------


@register(
    "prj01_replaced_column",
    query("SELECT * EXCLUDE (SourceCommonName_ID, EnhancedThemes, EnhancedLocations) FROM sourced", "sourced"),
)
def replaced_column(t):
    return cleaning.with_source(cleaning.dated(t.gkg), t.dictionary).drop("EnhancedThemes", "EnhancedLocations")


@register("prj02_day", query(f"SELECT {ID}, {DAY} AS period FROM dated", "dated"))
def day(t):
    return cleaning.dated(t.gkg).select(ID, c.day_of(F.col("DATE")).alias("period"))


@register("prj03_tone_sign", query(f"SELECT {ID}, tone, tone_bin FROM clean", "clean"))
def tone_sign(t):
    return t.clean.select(ID, "tone", "tone_bin")


@register("prj04_theme_count", query(f"SELECT {ID}, total_themes_count FROM clean", "clean"))
def theme_count(t):
    return t.clean.select(ID, "total_themes_count")


@register(
    "prj05_theme_list",
    query(f"SELECT {ID}, array_to_string(themes_list, '|') AS themes FROM clean", "clean"),
)
def theme_list(t):
    return t.clean.select(ID, F.array_join("themes_list", "|").alias("themes"))


@register(
    "prj06_country_list",
    query(f"SELECT {ID}, array_to_string(list_sort(countries_list), '|') AS countries FROM clean", "clean"),
)
def country_list(t):
    return t.clean.select(ID, F.array_join(F.array_sort("countries_list"), "|").alias("countries"))


@register("prj07_url_host", f"SELECT page_id, {HOST.format('url')} AS host FROM pages")
def url_host(t):
    return t.read("pages").select("page_id", c.host_of(F.col("url")).alias("host"))


REGISTRY_HOST = (
    "lower(CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE h END)"
)
REGISTRY_HOSTS = f"""SELECT *, {REGISTRY_HOST} AS host FROM (
    SELECT *, split_part(regexp_extract(CASE WHEN regexp_matches(trim(website), '^https?://') THEN trim(website)
      ELSE 'http://' || trim(website) END, '^https?://([^/?#]*)', 1), ':', 1) AS h FROM {{0}})"""


@register(
    "prj08_registry_host",
    query("SELECT medialabel, website, host FROM hosts", "registry", hosts=REGISTRY_HOSTS.format("(SELECT * EXCLUDE (host) FROM registry)")),
)
def registry_host(t):
    return registry.with_host(t.registry).select("medialabel", "website", "host")


@register(
    "prj09_source_repair",
    query(
        f"SELECT {ID}, CASE WHEN coalesce(SourceCommonName_ID, 0) = 0 THEN Src_ID ELSE SourceCommonName_ID END AS Src_ID "
        "FROM repaired", "repaired",
    ),
)
def source_repair(t):
    return cleaning.with_source(cleaning.dated(t.gkg), t.dictionary, keep_unknown=True).select(ID, "Src_ID")


@register(
    "prj10_locations",
    query(
        """SELECT loc_name, country_code, CASE loc_type WHEN '1' THEN 'Pays' WHEN '2' THEN 'État US' WHEN '3' THEN 'Ville US'
           WHEN '4' THEN 'Ville Monde' WHEN '5' THEN 'Région Monde' ELSE 'Inconnu' END AS type_name, count(*) AS n
           FROM (SELECT split_part(p, '#', 1) AS loc_type, split_part(p, '#', 2) AS loc_name,
                        split_part(p, '#', 3) AS country_code
                 FROM (SELECT unnest(string_split(EnhancedLocations, ';')) AS p FROM gkg)) GROUP BY ALL""",
        "gkg",
    ),
)
def locations(t):
    rows = t.gkg.select(F.explode(c.pieces(F.col("EnhancedLocations"))).alias("p")).select(*c.location_fields(F.col("p")))
    named = rows.select(c.location_type_name(F.col("loc_type")).alias("type_name"), "loc_name", "country_code")
    return named.groupBy("type_name", "loc_name", "country_code").agg(F.count(F.lit(1)).alias("n"))


def case_below(value, buckets, rest):
    return "CASE " + " ".join(f"WHEN {value} < {b} THEN '{n}'" for n, b in buckets) + f" ELSE '{rest}' END"


def case_between(value, buckets, rest):
    tail = f" ELSE '{rest}'" if rest else ""
    return "CASE " + " ".join(f"WHEN {value} BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in buckets) + tail + " END"


WORD_CASE = case_below("WordCount", labels.WORD_BUCKETS, labels.WORD_REST)
SHORT_WORD_CASE = case_below("WordCount", labels.SHORT_WORD_BUCKETS, labels.SHORT_WORD_REST)
VOLUME_CASE = case_between("articles", labels.VOLUME_BUCKETS, labels.VOLUME_REST)
LONGEVITY_CASE = case_between("years", labels.LONGEVITY_BUCKETS, None)
ACTIVITY = "SELECT Src_ID, count(*) AS articles, count(DISTINCT substr(DATE, 1, 4)) AS years FROM {0} GROUP BY 1"


@register(
    "prj11_bucket_labels",
    query(
        f"SELECT {ID}, {WORD_CASE} AS word_bucket, {SHORT_WORD_CASE} AS short_bucket, {VOLUME_CASE} AS volume_bucket, "
        f"{LONGEVITY_CASE} AS longevity_bucket FROM base JOIN activity USING (Src_ID)",
        "base", activity=ACTIVITY.format("base"),
    ),
)
def bucket_labels(t):
    activity = stage_lookup(cleaning.source_activity(t.base), "activity")
    rows = lookup_join(t.base, activity, ["Src_ID"], spread_by=ID)
    return rows.select(
        ID,
        labels.word_label(F.col("WordCount")).alias("word_bucket"),
        labels.short_word_label(F.col("WordCount")).alias("short_bucket"),
        labels.volume_label(F.col("articles")).alias("volume_bucket"),
        labels.longevity_label(F.col("years")).alias("longevity_bucket"),
    )


@register(
    "prj14_month_key",
    query(f"SELECT {ID}, substr(DATE, 1, 4) || '-' || substr(DATE, 5, 2) AS month FROM dated", "dated"),
)
def month_key(t):
    return cleaning.dated(t.gkg).select(ID, c.month_text(F.col("DATE")).alias("month"))


STARS = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE ' (ns)' END"


@register(
    "prj15_significance_text",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN coef = 0 THEN '0.00'
        ELSE printf('%+.2f', coef) || {STARS} END AS label
        FROM (SELECT *, l_quantity - 25 AS coef, l_discount AS p FROM lineitem)""",
)
def significance(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        labels.significance_text(F.col("l_quantity") - 25, F.col("l_discount")).alias("label"),
    )


@register(
    "prj16_log_volume",
    query(
        f"SELECT Src_ID, {sql6('ln(1 + articles::DOUBLE / years)')} AS log_volume, {sql6('log10(articles)')} AS log10_volume "
        "FROM activity", "base", activity=ACTIVITY.format("base"),
    ),
)
def log_volume(t):
    activity = cleaning.source_activity(t.base)
    return activity.select(
        "Src_ID",
        r6(volume(F.col("articles"), F.col("years"))).alias("log_volume"),
        r6(F.log10("articles")).alias("log10_volume"),
    )


# -- Source joins and lists --------------------------------------------------


@register(
    "jn01_dictionary_join",
    query("SELECT Src_ID, count(*) AS repaired FROM sourced WHERE coalesce(SourceCommonName_ID, 0) = 0 GROUP BY 1", "sourced"),
)
def dictionary_join(t):
    zero = cleaning.dated(t.gkg).filter(F.coalesce("SourceCommonName_ID", F.lit(0)) == 0)
    repaired = cleaning.with_source(zero, t.dictionary)
    return repaired.groupBy("Src_ID").agg(F.count(F.lit(1)).alias("repaired"))


@register("jn02_whitelist_join", query(f"SELECT {ID}, Src_ID FROM base JOIN valid_sources USING (Src_ID)", "base", "valid_sources"))
def whitelist_join(t):
    return cleaning.from_sources(t.base, t.whitelist).select(ID, "Src_ID")


@register(
    "jn03_taxonomy_join",
    query(
        "SELECT sector, cat_key, theme, count(*) AS n FROM (SELECT unnest(themes_list) AS theme FROM clean) "
        "JOIN taxonomy USING (theme) GROUP BY ALL", "clean", "taxonomy",
    ),
)
def taxonomy_join(t):
    mentions = t.clean.select(F.explode("themes_list").alias("theme"))
    joined = lookup_join(mentions, t.taxonomy, ["theme"])
    return joined.groupBy("sector", "cat_key", "theme").agg(F.count(F.lit(1)).alias("n"))


@register(
    "jn14_top_membership",
    query(
        f"""SELECT {ID}, theme FROM theme_rows WHERE theme IN (
            SELECT theme FROM (SELECT theme, count(*) AS n FROM theme_rows GROUP BY 1 ORDER BY n DESC, theme LIMIT 20))""",
        "gkg", theme_rows=THEME_ROWS,
    ),
)
def top_membership(t):
    rows = (
        cleaning.themed(t.gkg).select(ID, F.explode(c.pieces(F.col("EnhancedThemes"))).alias("p"))
        .filter(F.col("p") != "").select(ID, c.raw_theme_key(F.col("p")).alias("theme"))
    )
    top = topk.top_counts(rows, ["theme"], 20).select("theme")
    return rows.join(F.broadcast(top), "theme", "left_semi")


@register(
    "jn18_source_names",
    query(
        f"SELECT {ID}, coalesce(SourceCommonName, 'Nom_inconnu') AS SourceCommonName FROM dated d "
        "LEFT JOIN src_map m ON d.SourceCommonName_ID = m.SourceCommonName_ID", "dated", "src_map",
    ).replace("SELECT GKGRECORDID, coalesce(SourceCommonName", "SELECT GKGRECORDID, coalesce(m.SourceCommonName"),
)
def source_names(t):
    rows = cleaning.dated(t.gkg).select(ID, F.col("SourceCommonName_ID").alias("Src_ID"))
    return profiling.with_source_name(rows, t.dictionary, unknown="Nom_inconnu").select(ID, "SourceCommonName")


@register(
    "ag01_global_whitelist",
    query(
        "SELECT Src_ID FROM sourced GROUP BY 1 HAVING count(*) >= 60 AND count(DISTINCT substr(DATE, 1, 4)) >= 2", "sourced"
    ),
)
def global_whitelist(t):
    return cleaning.global_whitelist(t.gkg, t.dictionary, CleaningRules(min_articles=60))


@register(
    "ag02_years_whitelist",
    query("SELECT Src_ID FROM sourced GROUP BY 1 HAVING count(DISTINCT substr(DATE, 1, 4)) >= 5", "sourced"),
)
def years_whitelist(t):
    return cleaning.global_whitelist(t.gkg, t.dictionary, CleaningRules(min_articles=1, min_years=5))


@register("ag03_view_whitelist", query(f"SELECT {ID}, period, total_themes_count FROM clean", "clean"))
def view_whitelist(t):
    return cleaning.clean_articles(t.gkg, t.dictionary).select(ID, "period", "total_themes_count")


@register(
    "ag04_stepwise_filters",
    query(
        f"SELECT {ID}, Src_ID FROM sources JOIN lasting USING (Src_ID)", "base",
        many="SELECT Src_ID FROM base GROUP BY 1 HAVING count(*) >= 30",
        sources="SELECT base.* FROM base JOIN many USING (Src_ID)",
        lasting="SELECT Src_ID FROM sources GROUP BY 1 HAVING count(DISTINCT substr(DATE, 1, 4)) >= 2",
    ),
)
def stepwise_filters(t):
    many = cleaning.from_sources(t.base, stage_lookup(cleaning.whitelist(t.base, 30, 1), "many"))
    lasting = stage_lookup(cleaning.whitelist(many, 1, 2), "lasting")
    return cleaning.from_sources(many, lasting).select(ID, "Src_ID")


@register(
    "ag05_pure_sources",
    query(
        "SELECT Src_ID, count(*) AS n FROM sourced JOIN pure USING (Src_ID) GROUP BY 1", "sourced",
        pure="SELECT Src_ID FROM sourced GROUP BY 1 HAVING count(*) > 300 "
             "AND count(DISTINCT substr(DATE, 1, 4)) >= 2",
    ),
)
def pure_sources(t):
    rows = cleaning.with_source(cleaning.dated(t.gkg), t.dictionary)
    pure = stage_lookup(cleaning.pure_sources(rows, 300), "pure")
    return cleaning.from_sources(rows, pure).groupBy("Src_ID").agg(F.count(F.lit(1)).alias("n"))
