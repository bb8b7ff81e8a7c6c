"""Sources, ingest steps, sinks and streaming jobs.

Raw files, dictionaries and stored tables are first written by Spark from
the given tables, then read through the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgauge.catalogue.feature_queries import REAL, feature_table
from pressgauge.catalogue.model_queries import stored_panel
from pressgauge.catalogue.registry import ORACLES, r6, register, rounded
from pressgauge.catalogue.series_queries import MONTHLY_NAMES
from pressgauge.catalogue.sql import HOST, add, query
from pressgauge.catalogue.sql import r6 as sql6
from pressgauge.functions import columns as c
from pressgauge.operators import cleaning, clusters, ingest, registry
from pressgauge.operators import indicators as ind
from pressgauge.operators.lookups import lookup_join, measure
from pressgauge.plans import runs
from pressgauge.plans.loader import ArticleLoader
from pressgauge.session import fresh_path, stage
from pressgauge.sinks import tables as sinks
from pressgauge.sources import articles as article_source
from pressgauge.sources import lookups as lookup_source
from pressgauge.sources import raw
from pressgauge.streaming import jobs

ID = "GKGRECORDID"


def once(t, name, build):
    """Build a stored input once per session and scale."""
    key = f"_once_{name}"
    if key not in t.__dict__:
        t.__dict__[key] = build()
    return t.__dict__[key]


# -- Raw records -------------------------------------------------------------


def raw_folder(t):
    """Raw record text: two streams, repeated records, some broken lines."""

    def build():
        path = fresh_path(t.spark, "raw")
        fields = [F.lit("")] * raw.RAW_FIELDS
        # The tone field is short now and then, and the collection unreadable.
        tone = F.when(F.col("WordCount") % 10 == 0, F.col("Tone").cast("string")).otherwise(
            F.concat_ws(",", F.col("Tone").cast("string"), F.lit("1,2,3,4,5"), F.coalesce("WordCount", F.lit(0)).cast("string"))
        )
        values = {
            "SourceCollectionIdentifier": F.when(F.col("WordCount") % 9 == 0, "?").otherwise(
                F.col("SourceCollectionIdentifier").cast("string")
            ),
            "SourceCommonName": F.when(F.col("SourceCommonName_ID") == 0, "").otherwise(c.host_of(F.col("DocumentIdentifier"))),
            "Tone_Raw": F.coalesce(tone, F.lit("")),
        }
        for name, place in raw.KEPT_FIELDS.items():
            fields[place] = values[name] if name in values else F.coalesce(F.col(name), F.lit(""))
        line = F.array_join(F.array(*fields), "\t")
        rows = t.gkg
        repeated = rows.filter(F.col("DATE").startswith("1998"))
        broken = rows.filter(F.col("DATE") == "bad").select("IsTranslingual", ID, F.concat_ws("\t", ID, F.lit("cut")).alias("value"))
        lines = rows.unionByName(repeated).select("IsTranslingual", ID, line.alias("value")).unionByName(broken)
        for flag, name in ((0, "all.gkg.csv"), (1, "all.translation.gkg.csv")):
            # Repeats of an id lie in one file, as the rule about them needs. Packed, as such files arrive.
            chosen = lines.filter(F.col("IsTranslingual") == flag).repartition(ID).select("value")
            chosen.write.option("compression", "gzip").text(f"{path}/{name}")
        return path

    return once(t, "raw", build)


def records(t):
    return raw.raw_records(raw.text_lines(t.spark, raw_folder(t)))


add("raw_rows", ("gkg",), "SELECT * FROM gkg UNION ALL SELECT * FROM gkg WHERE DATE LIKE '1998%'")
RAW_NAME = f"CASE WHEN SourceCommonName_ID = 0 THEN '' ELSE {HOST.format('DocumentIdentifier')} END"
WORDS = "CAST(CASE WHEN WordCount IS NULL OR WordCount % 10 = 0 THEN 0 ELSE WordCount END AS INTEGER)"
COLLECTION = "CAST(CASE WHEN WordCount % 9 = 0 THEN 0 ELSE SourceCollectionIdentifier END AS TINYINT)"
TONE = "CAST(Tone AS FLOAT)"


@register(
    "src01_raw_scan",
    query(f"SELECT {ID}, DATE, {RAW_NAME} AS SourceCommonName, DocumentIdentifier, Persons, Organizations, TranslationInfo FROM raw_rows", "raw_rows"),
)
def raw_scan(t):
    return records(t).select(
        ID, "DATE", "SourceCommonName", "DocumentIdentifier", "Persons", "Organizations", "TranslationInfo"
    )


@register("ing01_tone_fields", query(f"SELECT {ID}, {TONE} AS Tone, {WORDS} AS WordCount FROM raw_rows", "raw_rows"))
def tone_fields(t):
    return ingest.typed_records(records(t)).select(ID, "Tone", "WordCount")


@register("ing02_collection", query(f"SELECT {ID}, {COLLECTION} AS SourceCollectionIdentifier FROM raw_rows", "raw_rows"))
def collection(t):
    return ingest.typed_records(records(t)).select(ID, "SourceCollectionIdentifier")


@register("ing03_translated_flag", query(f"SELECT {ID}, IsTranslingual FROM raw_rows", "raw_rows"))
def translated_flag(t):
    return ingest.typed_records(records(t)).select(ID, "IsTranslingual")


@register(
    "ing04_blank_text",
    query("SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ingest.TEXT_COLUMNS) + " FROM raw_rows", "raw_rows"),
)
def blank_text(t):
    return ingest.typed_records(records(t)).select(*ingest.TEXT_COLUMNS)


@register("ing05_first_in_file", query(f"SELECT {ID}, IsTranslingual FROM gkg", "gkg"))
def first_in_file(t):
    return ingest.first_in_file(ingest.typed_records(records(t))).select(ID, "IsTranslingual")


add("known_names", ("src_map",), "SELECT * FROM src_map WHERE SourceCommonName_ID <= 30")
add("grown", ("gkg", "known_names"), f"""
    SELECT * FROM known_names UNION ALL
    SELECT CAST((SELECT max(SourceCommonName_ID) FROM known_names) + row_number() OVER (ORDER BY name) AS INTEGER), name
    FROM (SELECT DISTINCT {RAW_NAME} AS name FROM gkg) WHERE name <> '' AND name NOT IN (SELECT SourceCommonName FROM known_names)""")


def known_names(t):
    return t.dictionary.frame.filter(F.col("SourceCommonName_ID") <= 30)


@register("ing06_grown_dictionary", query("SELECT * FROM grown", "grown"))
def grown_dictionary(t):
    return ingest.grown_dictionary(known_names(t), records(t)).frame


@register(
    "ing06_encoded_articles",
    query(
        f"SELECT {ID}, coalesce(g.SourceCommonName_ID, 0) AS SourceCommonName_ID, year, month FROM (SELECT {ID}, {RAW_NAME} AS name, "
        "coalesce(TRY_CAST(substr(DATE, 1, 4) AS INTEGER), 0) AS year, coalesce(TRY_CAST(substr(DATE, 5, 2) AS INTEGER), 0) AS month "
        "FROM gkg) LEFT JOIN grown g ON name = g.SourceCommonName", "gkg", "grown",
    ),
)
def encoded_articles(t):
    articles, _ = ingest.ingest(records(t), known_names(t))
    return articles.select(ID, "SourceCommonName_ID", "year", "month")


MONTHS = "SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders"


@register(
    "ing07_open_months",
    query(
        "SELECT strftime(m, '%Y%m') AS month FROM (SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders) "
        f"WHERE strftime(m, '%Y%m') IN ({MONTHS}) AND strftime(m, '%Y%m') NOT IN (SELECT DISTINCT strftime(l_shipdate, '%Y%m') FROM lineitem WHERE l_shipdate < '1998-01-01')",
    ),
)
def open_months(t):
    files = t.read("orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"))
    stored = t.read("lineitem").filter(F.col("l_shipdate") < "1998-01-01").select(F.date_format("l_shipdate", "yyyyMM").alias("month"))
    return ingest.open_months(month_list(t), files, stored)


@register(
    "ing08_month_list",
    "SELECT strftime(unnest(generate_series(min(date_trunc('month', o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)), '%Y%m') AS month FROM orders",
)
def month_list(t):
    span = t.read("orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select(F.explode(ingest.months_between(F.col("a"), F.col("b"))).alias("month"))


# -- Stored article table ----------------------------------------------------


def article_table(t):
    """The article table in its monthly layout."""

    def build():
        path = fresh_path(t.spark, "monthly-articles")
        sinks.write_articles(ingest.with_month(t.gkg), path)
        return path

    return once(t, "articles", build)


YEAR = "coalesce(TRY_CAST(substr(DATE, 1, 4) AS INTEGER), 0)"
MONTH = "coalesce(TRY_CAST(substr(DATE, 5, 2) AS INTEGER), 0)"


@register(
    "snk01_monthly_articles",
    query(f"SELECT {YEAR} AS year, {MONTH} AS month, count(*) AS n, sum(WordCount)::BIGINT AS words FROM gkg GROUP BY 1, 2", "gkg"),
)
def monthly_articles(t):
    stored = article_source.article_scan(t.spark, article_table(t))
    return stored.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("WordCount").alias("words"))


@register("src02_article_scan", query(f"SELECT {ID}, WordCount, Tone FROM gkg", "gkg"))
def article_scan(t):
    return article_source.article_scan(t.spark, article_table(t)).select(ID, "WordCount", "Tone")


@register("src03_chosen_years", query(f"SELECT {ID}, WordCount FROM gkg WHERE {YEAR} IN (1997, 1999)", "gkg"))
def chosen_years(t):
    return article_source.article_years(t.spark, article_table(t), [1997, 1999]).select(ID, "WordCount")


# -- Lookup files ------------------------------------------------------------


def write_document(t, name, value):
    path = fresh_path(t.spark, name)
    value.coalesce(1).write.text(path)
    return path


@register("src04_source_dictionary", query("SELECT * FROM src_map", "src_map"))
def source_dictionary(t):
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("SourceCommonName_ID").cast("string").alias("k"), F.col("SourceCommonName").alias("v"))))
    document = t.dictionary.frame.agg(F.to_json(F.struct(pairs.alias("id_to_source"))).alias("value"))
    return lookup_source.source_dictionary(t.spark, write_document(t, "dictionary-json", document)).frame


@register("src05_taxonomy", query("SELECT sector, cat_key, theme FROM taxonomy", "taxonomy"))
def taxonomy(t):
    categories = t.taxonomy.frame.groupBy("sector", "cat_key").agg(F.collect_list(F.lower("theme")).alias("themes"))
    sectors = categories.groupBy("sector").agg(
        F.map_from_entries(F.collect_list(F.struct("cat_key", F.struct(F.col("cat_key").alias("label"), "themes")))).alias("categories")
    )
    whole = F.map_from_entries(F.collect_list(F.struct("sector", F.struct(F.col("sector").alias("label"), "categories"))))
    document = sectors.agg(F.to_json(F.struct(whole.alias("sectors"))).alias("value"))
    return lookup_source.taxonomy(t.spark, write_document(t, "taxonomy-json", document)).frame


@register(
    "src06_region_map",
    query("SELECT region_key, country_code, count(*) AS suppliers FROM regions JOIN supplier ON country_code = 'N' || s_nationkey GROUP BY 1, 2", "regions"),
)
def region_map(t):
    rows = t.regions.frame.groupBy("region_key").agg(F.collect_list("country_code").alias("codes")).collect()
    regions = lookup_source.region_map(t.spark, {r["region_key"]: tuple(r["codes"]) for r in rows})
    suppliers = t.read("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("country_code"))
    return suppliers.join(F.broadcast(regions.frame), "country_code").groupBy("region_key", "country_code").agg(
        F.count(F.lit(1)).alias("suppliers")
    )


def registry_csv(t):
    def build():
        folder = fresh_path(t.spark, "registry")
        paths = []
        for region in ("EU", "US", "AS"):
            path = f"{folder}/{region.lower()}_newspapers.csv"
            rows = t.registry.filter(F.col("region") == region).select(
                F.col("medialabel").alias("mediaLabel"), F.col("typelabel").alias("typeLabel"), "countrylabel", "inception",
                F.col("website").alias("Website"),
            )
            rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
            paths.append(path)
        return paths

    return once(t, "registry", build)


@register("src07_registry_files", query("SELECT region, medialabel, typelabel, countrylabel, inception, website FROM registry", "registry"))
def registry_files(t):
    return lookup_source.registry_files(t.spark, registry_csv(t)).drop("file", "line_no")


@register(
    "src08_differing_columns",
    query("SELECT period, sum(N)::BIGINT AS n, count(sum_w) AS with_weight FROM (SELECT period, N, sum_w FROM cat_sums UNION ALL SELECT period, N, NULL FROM sec_sums) GROUP BY 1", "cat_sums", "sec_sums"),
)
def differing_columns(t):
    hits = ind.theme_hits(t.clean, t.taxonomy)
    paths = [fresh_path(t.spark, "part") for _ in range(2)]
    ind.category_sums(hits).select("period", "N", "sum_w").write.parquet(paths[0])
    ind.sector_sums(hits).select("period", "N").write.parquet(paths[1])
    united = article_source.united_tables(t.spark, paths)
    return united.groupBy("period").agg(F.sum("N").alias("n"), F.count("sum_w").alias("with_weight"))


@register("src09_macro_series", query("SELECT region_key, period, round(value + 1e-9, 4) AS value FROM macro", "macro"))
def macro_series(t):
    path = fresh_path(t.spark, "macro")
    t.macro.withColumnRenamed("region_key", "ticker").withColumn("ticker", F.concat(F.lit("V_"), "ticker")).write.parquet(path)
    tickers = {r["r_name"]: f"V_{r['r_name']}" for r in t.read("region").select("r_name").collect()}
    stored = t.spark.read.parquet(path)
    return article_source.macro_by_ticker(stored, tickers).withColumn("value", F.round(F.col("value") + 1e-9, 4))


@register(
    "src10_file_list",
    """SELECT strftime(o_orderdate, '%Y%m') AS month, count(DISTINCT CAST(o_orderdate AS DATE)) AS files FROM orders GROUP BY 1""",
)
def file_list(t):
    days = t.read("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("d")).distinct()
    lines = days.select(
        F.explode(
            F.array(*[F.concat(F.lit("123 abc http://files.example.org/v2/"), "d", F.lit(f"000000.{kind}.zip")) for kind in ("gkg.csv", "export.CSV")])
        ).alias("value")
    )
    path = fresh_path(t.spark, "file-list")
    lines.write.text(path)
    return lookup_source.files_per_month(lookup_source.file_list(t.spark.read.text(path)))


@register("src11_vocabulary", "SELECT upper(replace(p_name, ' ', '_')) || ' ' || count(*) AS value FROM part GROUP BY p_name")
def vocabulary(t):
    names = t.read("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(" "), "n", F.lit(" "))
    path = fresh_path(t.spark, "vocabulary")
    names.select(line.alias("value")).write.text(path)
    return lookup_source.vocabulary(t.spark, path)


# -- Sinks -------------------------------------------------------------------


@register(
    "snk02_indicator_partitions",
    query(f"SELECT sector, CAST(year(period) AS INTEGER) AS year, count(*) AS n, {sql6('sum(att)')} AS att FROM indicators GROUP BY 1, 2", "indicators"),
)
def indicator_partitions(t):
    path = fresh_path(t.spark, "indicators")
    long = ind.long_indicators(t.clean, t.taxonomy)
    sinks.write_indicators(long, path)
    # A second run of one sector replaces its own folders only.
    sinks.write_indicators(long.filter(F.col("sector") == "goods"), path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("sector", "year").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("att")).alias("att"))


@register("snk03_kept_whitelist", query("SELECT Src_ID FROM valid_sources", "valid_sources"))
def kept_whitelist(t):
    path = fresh_path(t.spark, "whitelist")
    sinks.kept_or_computed(t.spark, path, lambda: cleaning.whitelist(t.base))
    # The second call must read, not compute.
    return sinks.kept_or_computed(t.spark, path, lambda: t.spark.createDataFrame([], "Src_ID int"))


@register("snk04_staged_subset", query("SELECT Src_ID, count(*) AS n, sum(WordCount)::BIGINT AS words FROM inter GROUP BY 1", "inter"))
def staged_subset(t):
    rows = cleaning.with_source(cleaning.themed(cleaning.dated(t.gkg)), t.dictionary)
    subset = stage(rows.select("Src_ID", "WordCount", "EnhancedThemes", c.day_of(F.col("DATE")).alias("period")), "subset")
    return subset.groupBy("Src_ID").agg(F.count(F.lit(1)).alias("n"), F.sum("WordCount").alias("words"))


@register("snk05_domain_tables", query("SELECT * FROM matched_domains", "matched_domains"))
def domain_tables(t):
    path = fresh_path(t.spark, "domains")
    sinks.write_domains(registry.matched_domains(t.registry, t.dictionary, t.suffixes, ["medialabel"]), path)
    return t.spark.read.parquet(path)


@register("snk06_csv_export", query("SELECT id, domain, medialabel FROM domains", "domains"))
def csv_export(t):
    path = fresh_path(t.spark, "csv")
    sinks.write_csv(t.domains.select("id", "domain", "medialabel"), path)
    return t.spark.read.option("sep", ";").option("header", "true").csv(path)


@register("snk07_dictionary_file", query("SELECT * FROM src_map", "src_map"))
def dictionary_file(t):
    path = fresh_path(t.spark, "dictionary-lines")
    sinks.write_dictionary(t.dictionary.frame, path)
    return lookup_source.source_dictionary(t.spark, path).frame


@register("snk08_kept_export", query("SELECT Src_ID, is_wiki, total_articles FROM labelled WHERE cluster IN (1, 3)", "labelled"))
def kept_export(t):
    table = feature_table(t).select("Src_ID", "is_wiki", "total_articles", (F.col("Src_ID") % 4).cast("int").alias("cluster"))
    kept, _ = clusters.split_by_clusters(table, [1, 3])
    path = fresh_path(t.spark, "kept")
    sinks.write_kept(kept, path, ("cluster",))
    return t.spark.read.parquet(path)


# -- Streaming ---------------------------------------------------------------


def run(t, stream, mode="append"):
    return jobs.run_available(stream, fresh_path(t.spark, "stream"), fresh_path(t.spark, "checkpoint"), mode)


@register(
    "st01_stream_ingest",
    query(
        f"SELECT {ID}, {TONE} AS Tone, {WORDS} AS WordCount, IsTranslingual, {RAW_NAME} AS SourceCommonName FROM raw_rows", "raw_rows"
    ),
)
def stream_ingest(t):
    # Only some names are known at first; the others are numbered as they arrive, and decode to themselves.
    articles, names = jobs.ingest_available(
        jobs.raw_stream(t.spark, raw_folder(t)), known_names(t), fresh_path(t.spark, "stream"), fresh_path(t.spark, "checkpoint")
    )
    decoded = lookup_join(articles, measure(names), ["SourceCommonName_ID"], "left", spread_by=ID)
    return decoded.select(ID, "Tone", "WordCount", "IsTranslingual", F.coalesce("SourceCommonName", F.lit("")).alias("SourceCommonName"))


def events(t):
    """A stream over the events file."""
    schema = t.read("events").schema
    stream = jobs.event_stream(t.spark, t.sf_dir, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@register("st02_stream_without_repeats", "SELECT event_id, event_type FROM events")
def stream_without_repeats(t):
    def build():
        path = fresh_path(t.spark, "repeated-events")
        rows = t.read("events")
        rows.unionByName(rows.filter(F.col("event_type") == "click")).write.parquet(path)
        return path

    path = once(t, "repeated", build)
    stream = t.spark.readStream.schema(t.read("events").schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return run(t, jobs.without_repeats(stream, "event_id").select("event_id", "event_type"))


# Only closed days leave the stream: their end lies a day behind the last event.
CLOSED = "CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@register(
    "st03_stream_daily_tone",
    f"SELECT CAST(ts AS DATE) AS period, count(*) AS n_articles, {sql6('avg(value)')} AS mean_tone FROM events WHERE {CLOSED} GROUP BY 1",
)
def stream_daily_tone(t):
    return rounded(run(t, jobs.daily_tone(events(t))), "mean_tone")


@register(
    "st04_stream_moving_volume",
    """SELECT d AS period, sum(n)::BIGINT AS volume FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
       (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE day BETWEEN d - 29 AND d
       AND d + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1""",
)
def stream_moving_volume(t):
    return run(t, jobs.moving_volume(events(t)))


add("event_taxonomy", (), "SELECT DISTINCT 'web' AS sector, event_type AS cat_key, event_type AS theme FROM events WHERE event_type <> 'error'")


@register(
    "st05_stream_category_sums",
    query(
        f"""SELECT CAST(ts AS DATE) AS period, sector, cat_key, count(*) AS N, {sql6('sum(value)')} AS sum_t_cont,
        CAST(sum(sign(value)) AS BIGINT) AS sum_t_bin, {sql6('avg(value)')} AS sent_cont
        FROM events JOIN event_taxonomy ON event_type = theme WHERE {CLOSED} GROUP BY 1, 2, 3""".replace(
            "FROM events)", "FROM events e2 JOIN event_taxonomy ON e2.event_type = theme)"), "event_taxonomy",
    ),
)
def stream_category_sums(t):
    kinds = t.read("events").select("event_type").distinct().filter(F.col("event_type") != "error")
    known = measure(kinds.select(F.lit("web").alias("sector"), F.col("event_type").alias("cat_key"), F.col("event_type").alias("theme")))
    stream = events(t).withColumnsRenamed({"event_type": "theme", "value": "tone"})
    return rounded(run(t, jobs.daily_category_sums(stream, known)), "sum_t_cont", "sent_cont")


# -- Entry points ------------------------------------------------------------


def loader(t):
    return once(t, "loader", lambda: ArticleLoader(t.spark, article_table(t), t.dictionary, fresh_path(t.spark, "whitelist")))


@register("api01_loader_view", query(f"SELECT {ID}, period, tone FROM clean", "clean"))
def loader_view(t):
    return loader(t).as_view().select(ID, "period", "tone")


@register(
    "api01_loader_table",
    query(
        f"""SELECT {ID}, Tone AS tone FROM base WHERE {YEAR} IN (1996, 1997) AND len(string_split(EnhancedThemes, ';')) >= 2
        AND Src_ID IN (SELECT Src_ID FROM sourced GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT substr(DATE, 1, 4)) >= 2)""",
        "base", "sourced",
    ),
)
def loader_table(t):
    return loader(t).as_table(1996, 1997).select(ID, "tone")


@register(
    "api02_sector_run",
    query(f"SELECT period, granularity, N, {sql6('att')} AS att, {sql6('sent_cont')} AS sent_cont FROM indicators WHERE sector = 'goods'", "indicators"),
)
def sector_run(t):
    result = runs.sector_run(t.gkg, t.dictionary, t.taxonomy, ["goods"])
    return rounded(result.select("period", "granularity", "N", "att", "sent_cont"), "att", "sent_cont")


@register(
    "api03_geo_run",
    query(f"SELECT period, region_key, sector, granularity, N, {sql6('att')} AS att FROM geo_indicators WHERE sector = 'scale'", "geo_indicators"),
)
def geo_run(t):
    result = runs.geo_run(t.gkg, t.dictionary, t.taxonomy, t.regions, ["scale"], unique_ids=False)
    return rounded(result.select("period", "region_key", "sector", "granularity", "N", "att"), "att")


@register("api04_regional_report")
def regional_report(t):
    report = runs.regional_report(stored_panel(t), list(MONTHLY_NAMES))
    return report["best"].join(report["forecast"].drop("lag"), "region_key")


# -- Runs that store their tables --------------------------------------------


def output_paths(t):
    return runs.OutputPaths(fresh_path(t.spark, "output"))


@register(
    "api02_stored_sector_run",
    query(f"SELECT sector, CAST(year(period) AS INTEGER) AS year, period, granularity, N, {sql6('att')} AS att FROM indicators "
          "WHERE sector IN ('goods', 'scale')", "indicators"),
)
def stored_sector_run(t):
    output = output_paths(t)
    for sector in ("goods", "scale"):
        runs.stored_indicators(t.gkg, t.dictionary, t.taxonomy, output, sectors=[sector])
    table = t.spark.read.parquet(output.sectors)
    return rounded(table.select("sector", "year", "period", "granularity", "N", "att"), "att")


@register(
    "api03_stored_geo_run",
    query(f"SELECT sector, CAST(year(period) AS INTEGER) AS year, period, region_key, granularity, N, {sql6('att')} AS att "
          "FROM geo_indicators WHERE sector = 'scale'", "geo_indicators"),
)
def stored_geo_run(t):
    output = output_paths(t)
    runs.stored_indicators(t.gkg, t.dictionary, t.taxonomy, output, t.regions, ["scale"], unique_ids=False)
    table = t.spark.read.parquet(output.regions)
    return rounded(table.select("sector", "year", "period", "region_key", "granularity", "N", "att"), "att")


@register("api05_registry_coverage", ORACLES["ag45_match_coverage"])
def registry_coverage(t):
    return rounded(runs.registry_run(t.spark, registry_csv(t), t.dictionary, t.suffixes, output_paths(t)), "rate")


@register("api05_registry_domains", query("SELECT * FROM matched_domains", "matched_domains"))
def registry_domains(t):
    output = output_paths(t)
    runs.registry_run(t.spark, registry_csv(t), t.dictionary, t.suffixes, output)
    return t.spark.read.parquet(output.domains)


@register("api06_stored_features", ORACLES["ag33_source_features"])
def stored_features(t):
    output = output_paths(t)
    sinks.write_domains(t.domains.withColumn("region", F.lit("EU")), output.domains)
    return rounded(runs.stored_features(t.gkg, t.dictionary, output), *REAL)
