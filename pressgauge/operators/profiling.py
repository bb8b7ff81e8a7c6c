"""Descriptive reports on article tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.functions import labels
from pressgauge.operators import topk
from pressgauge.operators.lookups import Lookup, lookup_join
from pressgauge.session import stage

# The probability levels of the quantile reports.
WORD_LEVELS = (0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.10, 0.15, 0.20, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98, 0.99,
               0.995, 0.999)
SOURCE_LEVELS = (0.001, 0.005, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.995, 0.999)
YEAR_LEVELS = (0.001, 0.005, 0.01, 0.05, 0.10, 0.25, 0.50, 0.60, 0.65, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99)
THEME_LEVELS = (0.01, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.75)


# -- Counts per step ---------------------------------------------------------

def funnel(passed: DataFrame, steps: tuple[str, ...], raw_source: str = "raw_source", source: str = "Src_ID") -> DataFrame:
    """Rows, sources and removed rows for each cleaning step, from one scan.

    ``passed`` has a flag for each step after the first, which all rows pass;
    rows are counted by sources and flags, and only those counts go on.
    """
    counted = passed.groupBy(raw_source, source, *steps[1:]).agg(F.count(F.lit(1)).alias("n"))
    rows = [
        F.struct(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"), (F.lit(True) if i == 1 else F.col(name)).alias("in"),
            F.col(raw_source if i == 1 else source).alias("source"), "n",
        )
        for i, name in enumerate(steps, start=1)
    ]
    per_source = (
        counted.select(F.inline(F.array(*rows)))
        .groupBy("step_no", "step", "source")
        .agg(F.sum(F.when(F.col("in"), F.col("n"))).alias("n"))
    )
    united = per_source.groupBy("step_no", "step").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.when(F.col("n").isNotNull(), F.col("source"))).alias("sources")
    )
    # A handful of rows, one per step.
    first = F.max(F.when(F.col("step_no") == 1, F.col("rows"))).over(Window.partitionBy(F.lit(1)))
    return united.withColumn("removed", first - F.col("rows"))


def dashboard(articles: DataFrame, source: str = "Src_ID", date: str = "DATE") -> DataFrame:
    """Volume, yearly activity and longevity of a view as label/value rows."""
    per_year = articles.groupBy(source, c.year_text(F.col(date)).alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    volume = per_year.agg(F.sum("n").alias("rows"), F.countDistinct(source).alias("sources"), F.avg("n").alias("per_pair"))
    volume_rows = volume.select(
        F.inline(
            F.array(
                _entry("volume", "articles", F.col("rows").cast("string")),
                _entry("volume", "sources", F.col("sources").cast("string")),
                _entry(
                    "volume",
                    "mean articles of a source",
                    F.format_string("%.1f", F.round(c.safe_ratio(F.col("rows"), F.col("sources")) + 1e-9, 1)),
                ),
                _entry(
                    "years",
                    "mean articles of a source and year",
                    F.format_string("%.1f", F.round(F.col("per_pair") + 1e-9, 1)),
                ),
            )
        )
    )
    yearly = (
        per_year.groupBy("yr")
        .agg(F.count(F.lit(1)).alias("n_src"))
        .agg(F.avg("n_src").alias("a"))
        .select(
            F.inline(
                F.array(
                    _entry(
                        "years",
                        "mean sources of a year",
                        F.format_string("%.1f", F.round(F.col("a") + 1e-9, 1)),
                    )
                )
            )
        )
    )
    spread = (
        per_year.groupBy(source)
        .agg(F.count(F.lit(1)).alias("years"))
        .groupBy("years")
        .agg(F.count(F.lit(1)).alias("n_src"))
        .agg(
            # One entry per number of years: a list as long as the feed is old.
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("years", "n_src"))),
                    lambda x: F.concat(x["years"], F.lit(": "), x["n_src"]),
                ),
                "; ",
            ).alias("text")
        )
        .select(
            F.inline(
                F.array(
                    _entry("longevity", "sources by active years", F.col("text"))
                )
            )
        )
    )
    return volume_rows.unionByName(yearly).unionByName(spread).orderBy("category", "indicator")


def _entry(category: str, indicator: str, value: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(indicator).alias("indicator"), value.alias("value")
    )


def quality_audit(articles: DataFrame) -> DataFrame:
    """Data-quality checks as (category, indicator, value, status) rows."""
    rows = F.count(F.lit(1))
    url = F.col("DocumentIdentifier")

    def share(test: Column) -> Column:
        return c.safe_ratio(F.sum(F.when(test, 1).otherwise(0)), rows) * 100

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    # Repeats are counted from ids already grouped, one row per distinct id.
    per_id = articles.groupBy("GKGRECORDID").agg(F.count(F.lit(1)).alias("n"))
    repeats = per_id.agg((F.sum("n") - F.count("GKGRECORDID")).cast("double").alias("value"))
    facts = articles.agg(
        rows.cast("double").alias("rows"),
        F.sum(F.when((F.col("SourceCollectionIdentifier") == 1) & ~F.lower(url).startswith("http"), 1).otherwise(0))
        .cast("double")
        .alias("bad_urls"),
        F.sum(F.when(~F.col("IsTranslingual").isin(0, 1), 1).otherwise(0)).cast("double").alias("bad_flags"),
        share(F.col("GKGRECORDID").isNull() | F.col("DATE").isNull() | blank("DocumentIdentifier")).alias("critical"),
        *[share(blank(n)).alias(n) for n in ("EnhancedThemes", "EnhancedLocations", "Persons", "Organizations")],
        F.min("Tone").alias("tone_min"),
        F.max("Tone").alias("tone_max"),
        F.min("WordCount").cast("double").alias("words_min"),
    )
    value = F.col

    def check(passes: Column) -> Column:
        return F.when(passes, "ok").otherwise("warn")

    info = F.lit("info")
    entries = [
        ("1. volume", "articles", value("rows"), info),
        ("2. format", "urls without http", value("bad_urls"), check(value("bad_urls") == 0)),
        ("2. format", "translation flag outside 0/1", value("bad_flags"), check(value("bad_flags") == 0)),
        ("3. completeness", "id, date or url blank (%)", value("critical"), check(value("critical") == 0)),
        *[
            ("3. completeness", f"{n} blank (%)", value(n), info)
            for n in ("EnhancedThemes", "EnhancedLocations", "Persons", "Organizations")
        ],
        ("4. numbers", "tone minimum", value("tone_min"), check(value("tone_min") >= -100)),
        ("4. numbers", "tone maximum", value("tone_max"), check(value("tone_max") <= 100)),
        ("4. numbers", "word count minimum", value("words_min"), check(value("words_min") >= 0)),
    ]
    table = facts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(cat).alias("category"), F.lit(ind).alias("indicator"), v.alias("value"), s.alias("status")
                    )
                    for cat, ind, v, s in entries
                ]
            )
        )
    )
    return table.unionByName(
        repeats.select(
            F.lit("1. volume").alias("category"),
            F.lit("repeated ids").alias("indicator"),
            "value",
            check(F.col("value") == 0).alias("status"),
        )
    )


def entity_summaries(articles: DataFrame) -> DataFrame:
    """Six-number summaries of tone, words, themes, persons, organizations."""

    def listed(name: str) -> Column:
        return F.when(F.col(name) == "", 0).otherwise(F.size(c.pieces(F.col(name)))).cast("double")

    values = articles.select(
        F.col("Tone").cast("double").alias("tone"),
        F.col("WordCount").cast("double").alias("words"),
        listed("EnhancedThemes").alias("themes"),
        listed("Persons").alias("persons"),
        listed("Organizations").alias("organizations"),
    )
    return six_numbers(values, values.columns)


# -- Quantiles ---------------------------------------------------------------

def exact_quantiles(values: DataFrame, value: str, levels: tuple[float, ...], group: list[str] = []) -> DataFrame:
    """Interpolated quantiles as (group, level, value) rows.

    Equal values are counted first, so the final state holds each distinct
    value once with its frequency.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    quantiles = counted.groupBy(*group).agg(
        F.percentile(F.col(value), F.array(*[F.lit(x) for x in levels]), F.col("_n")).alias("_q")
    )
    return quantiles.select(
        *group,
        F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("_q").alias("value"))),
    )


def value_ranges(values: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Distinct values with their frequency ``_n``, stored in ranges ``_part`` of (group, value)."""
    counted = values.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.repartitionByRange(*[F.col(g) for g in group], F.col(value))
    return stage(ranged.withColumn("_part", F.spark_partition_id()), "value-ranges")


def selected_quantiles(ranges: DataFrame, value: str, levels: tuple[float, ...], group: list[str]) -> DataFrame:
    """The rows of ``exact_quantiles`` for continuous values, from ``value_ranges``.

    The frequencies of the ranges say in which of them a wanted rank lies. Only
    those are sorted, each by itself, so no task holds more values than one
    range, whatever the size of a group.
    """
    parts = ranges.groupBy(*group, "_part").agg(F.sum("_n").alias("_m"), F.min(value).alias("_low"))
    # One row per group and range.
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = whole.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group, "_part", "_m", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("_all")
    )
    wanted = F.array(*[
        F.struct(F.lit(x).alias("level"), (F.lit(x) * (F.col("_all") - 1)).alias("at")) for x in levels
    ])

    def holds(w: Column, first: Column, n: Column) -> Column:
        return (F.ceil(w["at"]) >= first) & (F.floor(w["at"]) < first + n)

    parts = parts.withColumn("_wanted", F.filter(wanted, lambda w: holds(w, F.col("_before"), F.col("_m"))))
    inside = ranges.join(parts.filter(F.size("_wanted") > 0), [*group, "_part"])
    upto = Window.partitionBy(*group, "_part").orderBy(value)
    placed = inside.withColumn("_first", F.col("_before") + F.sum("_n").over(upto) - F.col("_n"))
    mine = F.filter("_wanted", lambda w: holds(w, F.col("_first"), F.col("_n")))
    picked = placed.select(*group, F.col(value).alias("_v"), "_first", (F.col("_first") + F.col("_n")).alias("_end"), F.inline(mine))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_end")), F.col("_v").cast("double")))

    low, high = F.floor("at"), F.ceil("at")
    ends = picked.groupBy(*group, "level", "at").agg(at_rank(low).alias("_a"), at_rank(high).alias("_b"))
    between = F.when(low == high, F.col("_a")).otherwise(
        (high - F.col("at")) * F.col("_a") + (F.col("at") - low) * F.col("_b")
    )
    return ends.select(*group, "level", between.alias("value"))


def level_columns(quantiles: DataFrame, named: dict[str, float], group: list[str]) -> DataFrame:
    """Quantile rows as one row per group, a column per level."""
    return quantiles.groupBy(*group).agg(*[F.max(F.when(F.col("level") == x, F.col("value"))).alias(n) for n, x in named.items()])


def medians_by(values: DataFrame, names: list[str], group: list[str]) -> DataFrame:
    """Exact medians of continuous columns, one row per group."""
    keys = [*group, "measure"]
    middle = selected_quantiles(value_ranges(_tall(values, names, group), "_v", keys), "_v", (0.5,), keys)
    return middle.groupBy(*group).agg(*[F.max(F.when(F.col("measure") == n, F.col("value"))).alias(n) for n in names])


def _tall(values: DataFrame, names: list[str], group: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("_v")) for n in names]
    return values.select(*group, F.inline(F.array(*entries))).filter(F.col("_v").isNotNull())


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def six_numbers(values: DataFrame, names: list[str], group: list[str] = []) -> DataFrame:
    """count, min, quartiles, mean and max of several columns, one row each."""
    keys = [*group, "measure"]
    ranges = value_ranges(_tall(values, names, group), "_v", keys)
    sums = ranges.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.min("_v").alias("minimum"),
        c.safe_ratio(F.sum(F.col("_v") * F.col("_n")), F.sum("_n")).alias("mean"),
        F.max("_v").alias("maximum"),
    )
    quartiles = selected_quantiles(ranges, "_v", tuple(QUARTILES.values()), keys)
    return sums.join(level_columns(quartiles, QUARTILES, keys), keys).select(
        *keys, "n", "minimum", "q1", "median", "mean", "q3", "maximum"
    )


def box_summary(values: DataFrame, names: list[str], group: list[str]) -> DataFrame:
    """Quartiles per group and measure; whiskers at the last value within 1.5 IQR."""
    boxes = six_numbers(values, names, group).select(*group, "measure", "n", "q1", "median", "q3")
    tall = _tall(values, names, group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        tall.join(boxes, [*group, "measure"])
        .groupBy(*group, "measure", "n", "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"))
    )


def word_quantiles(articles: DataFrame) -> DataFrame:
    return exact_quantiles(articles, "WordCount", WORD_LEVELS)


def source_volume_quantiles(activity: DataFrame) -> DataFrame:
    return exact_quantiles(activity, "articles", SOURCE_LEVELS)


def source_year_quantiles(activity: DataFrame) -> DataFrame:
    return exact_quantiles(activity, "years", YEAR_LEVELS)


def theme_count_quantiles(articles: DataFrame) -> DataFrame:
    counts = articles.select(c.theme_count_or_zero(F.col("EnhancedThemes")).alias("themes"))
    return exact_quantiles(counts, "themes", THEME_LEVELS)


# -- Top lists ---------------------------------------------------------------

def mentions(articles: DataFrame, field: str, name: Callable[[Column], Column]) -> DataFrame:
    """One row per non-empty name in a ``;``-separated field."""
    piece = F.trim(F.col("_piece"))
    present = articles.filter(F.col(field).isNotNull() & (F.col(field) != ""))
    return (
        present.select(F.explode(c.pieces(F.col(field))).alias("_piece"))
        .filter(piece != "")
        .select(name(piece).alias("name"))
        .filter(F.col("name") != "")
    )


def top_themes(articles: DataFrame, k: int = 50) -> DataFrame:
    return topk.top_counts(mentions(articles, "EnhancedThemes", c.raw_theme_key), ["name"], k, "citations")


def top_persons(articles: DataFrame, k: int = 50) -> DataFrame:
    return topk.top_counts(mentions(articles, "Persons", lambda p: p), ["name"], k, "citations")


def top_organizations(articles: DataFrame, k: int = 50) -> DataFrame:
    return topk.top_counts(mentions(articles, "Organizations", lambda p: p), ["name"], k, "citations")


def top_places(articles: DataFrame, k: int = 50) -> DataFrame:
    place = lambda p: F.split_part(p, F.lit("#"), F.lit(2))
    return topk.top_counts(mentions(articles, "EnhancedLocations", place), ["name"], k, "citations")


def top_sources(articles: DataFrame, dictionary: Lookup, k: int = 50) -> DataFrame:
    """Counted by id first; only the counts meet the dictionary."""
    counts = articles.groupBy("Src_ID").agg(F.count(F.lit(1)).alias("articles"))
    named = with_source_name(counts, dictionary, "inner")
    return named.orderBy(F.desc("articles"), "SourceCommonName").limit(k)


def with_source_name(df: DataFrame, dictionary: Lookup, how: str = "left", unknown: str | None = None) -> DataFrame:
    """Attach source names to a table keyed by ``Src_ID``."""
    names = Lookup(
        dictionary.frame.select(F.col("SourceCommonName_ID").alias("Src_ID"), "SourceCommonName"), dictionary.rows
    )
    joined = lookup_join(df, names, ["Src_ID"], how)
    if unknown is None:
        return joined
    return joined.withColumn("SourceCommonName", F.coalesce("SourceCommonName", F.lit(unknown)))


def top_locations(articles: DataFrame, k: int = 20) -> DataFrame:
    """Most mentioned (type, country, place) with a readable type."""
    present = articles.filter(F.col("EnhancedLocations").isNotNull() & (F.col("EnhancedLocations") != ""))
    rows = present.select(F.explode(c.pieces(F.col("EnhancedLocations"))).alias("_p")).filter(F.col("_p") != "")
    triples = rows.select(*c.location_fields(F.col("_p"))).filter(F.col("country_code") != "")
    top = topk.top_counts(triples, ["loc_type", "country_code", "loc_name"], k, "mentions")
    return top.select(c.location_type_name(F.col("loc_type")).alias("type_name"), "country_code", "loc_name", "mentions")


# -- Time --------------------------------------------------------------------

def articles_per_day(articles: DataFrame) -> DataFrame:
    return articles.groupBy(c.day_of(F.col("DATE")).alias("day")).agg(F.count(F.lit(1)).alias("n_articles"))


def missing_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Calendar days between first and last day without any article."""
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return calendar.join(days.select(day).distinct(), day, "left_anti")


def series_summary(series: DataFrame, value: str) -> DataFrame:
    return series.agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )


def weekday_means(series: DataFrame, value: str, day: str = "day") -> DataFrame:
    """Mean per weekday, Monday first."""
    return (
        series.groupBy((F.weekday(day) + 1).alias("weekday_no"), F.date_format(day, "EEEE").alias("weekday"))
        .agg(F.avg(value).alias("mean"))
        .orderBy("weekday_no")
    )


def tone_histogram(articles: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width histogram between the smallest and the largest tone."""
    tone = F.col("tone")
    tones = articles.select(F.col("Tone").cast("double").alias("tone")).filter(tone.isNotNull())
    low, high = (tones.agg(f("tone")).scalar() for f in (F.min, F.max))
    # Like numpy, the last bin includes its upper edge.
    place = F.least(F.floor((tone - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1))
    return tones.groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def monthly_tone(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.trunc(c.day_of(F.col("DATE")), "MM").alias("month")).agg(
        F.avg("Tone").alias("avg_tone"), F.count(F.lit(1)).alias("n")
    )


def theme_shares(articles: DataFrame, k: int = 20) -> DataFrame:
    """Monthly share of articles naming each of the ``k`` biggest themes.

    An article votes once per theme. The votes are counted per month and
    theme, in one scan that opens the themes once; the articles of a month
    are counted in it as one more theme, which none can have because themes
    are split at it. These counts, a row per month and theme, are stored: the
    ranking and the shares follow from them.
    """
    month = c.month_text(F.col("DATE")).alias("month")
    whole = F.lit(";")
    named = F.filter(c.pieces(F.col("EnhancedThemes")), lambda p: p != "")
    themes = F.array_distinct(F.transform(named, lambda p: c.raw_theme_key(F.trim(p))))
    themes = F.concat(F.coalesce(themes, F.array().cast("array<string>")), F.array(whole))
    votes = (
        # Repeats go inside the row; the shuffle only meets copies of an id.
        articles.select("GKGRECORDID", month, F.explode(themes).alias("theme"))
        .groupBy("GKGRECORDID", "month", "theme")
        .agg(F.count("GKGRECORDID").alias("copies"))
        .groupBy("month", "theme")
        .agg(F.count(F.lit(1)).alias("votes"), F.sum("copies").alias("articles"))
    )
    votes = stage(votes, "theme-votes")
    is_theme = F.col("theme") != whole
    ranking = votes.filter(is_theme).groupBy("theme").agg(F.sum("votes").alias("all_votes"))
    top = ranking.orderBy(F.desc("all_votes"), "theme").limit(k).select("theme")
    # Only months that are dates: at most 120,000 rows.
    months = votes.filter(~is_theme & F.col("month").rlike("^[0-9]{4}-[0-9]{2}$")).select("month", F.col("articles").alias("total"))
    # k themes.
    return (
        votes.filter(is_theme)
        .join(F.broadcast(top), "theme", "left_semi")
        .join(months, "month")
        .select("month", "theme", (c.safe_ratio(F.col("votes"), F.col("total")) * 100).alias("pct_articles"))
    )


# -- Buckets -----------------------------------------------------------------

def _percent_of(total: Column, part: Column) -> Column:
    return c.safe_ratio(part, total) * 100


def volume_buckets(activity: DataFrame) -> DataFrame:
    """Sources by number of articles, with their share of all articles."""
    total = activity.agg(F.sum("articles")).scalar()
    return (
        activity.groupBy(labels.volume_label(F.col("articles")).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.sum("articles").alias("articles"),
            F.min("articles").alias("smallest"),
        )
        .withColumn("pct_volume", _percent_of(total, F.col("articles")))
        .orderBy("smallest")
    )


def longevity_buckets(activity: DataFrame, dictionary: Lookup, names: int = 10, seed: int | None = None) -> DataFrame:
    """Sources by active years, with a draw of source names per bucket."""
    bucketed = with_source_name(activity, dictionary).withColumn("bucket", labels.longevity_label(F.col("years")))
    total = activity.agg(F.sum("articles")).scalar()
    stats = (
        bucketed.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("sources"), F.sum("articles").alias("articles"), F.min("years").alias("sort_order")
        )
        .withColumn("pct_volume", _percent_of(total, F.col("articles")))
    )
    known = bucketed.filter(F.col("SourceCommonName").isNotNull()).select("bucket", "SourceCommonName")
    drawn = topk.draw_per_group(known, ["bucket"], names, "SourceCommonName", seed)
    return stats.join(topk.joined_names(drawn, ["bucket"], "SourceCommonName", "examples"), "bucket").orderBy(
        "sort_order"
    )


def word_buckets(articles: DataFrame, label: Callable[[Column], Column] = labels.word_label) -> DataFrame:
    """Articles and distinct sources per word-count bucket, with shares.

    Counted per (bucket, source) first; distinct sources are then a count.
    """
    present = articles.filter(F.col("WordCount").isNotNull())
    pairs = present.groupBy(label(F.col("WordCount")).alias("bucket"), "Src_ID").agg(F.count(F.lit(1)).alias("n"))
    per_source = articles.groupBy("Src_ID").agg(F.count(F.lit(1)).alias("n"))
    all_articles, all_sources = (per_source.agg(x).scalar() for x in (F.sum("n"), F.count("Src_ID")))
    return (
        pairs.groupBy("bucket")
        .agg(F.sum("n").alias("articles"), F.count("Src_ID").alias("sources"))
        .withColumn("pct_articles", _percent_of(all_articles, F.col("articles")))
        .withColumn("pct_sources", _percent_of(all_sources, F.col("sources")))
        .orderBy("bucket")
    )


def themes_by_length(articles: DataFrame, examples: int = 3, seed: int | None = None) -> DataFrame:
    """Mean number of themes per word bucket, with a few article addresses."""
    bucketed = articles.filter(F.col("WordCount").isNotNull()).select(
        labels.short_word_label(F.col("WordCount")).alias("bucket"),
        "DocumentIdentifier",
        F.size(c.pieces(F.col("EnhancedThemes"))).alias("_themes"),
    )
    stats = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("articles"), F.avg("_themes").alias("avg_themes"))
    drawn = topk.draw_per_group(
        bucketed.select("bucket", "DocumentIdentifier"), ["bucket"], examples, "DocumentIdentifier", seed
    )
    return stats.join(topk.joined_names(drawn, ["bucket"], "DocumentIdentifier", "examples", " | "), "bucket")


# -- Loader summaries --------------------------------------------------------

def loader_info(clean: DataFrame) -> DataFrame:
    days = F.countDistinct("period")
    return clean.agg(
        F.min("period").alias("date_min"),
        F.max("period").alias("date_max"),
        F.count(F.lit(1)).alias("n_articles"),
        days.alias("n_days"),
        c.safe_ratio(F.count(F.lit(1)), days).alias("articles_per_day"),
        F.avg("tone").alias("mean_tone"),
        F.avg("tone_bin").alias("mean_tone_bin"),
        F.avg("total_themes_count").alias("mean_themes"),
    )


def daily_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("period").agg(F.count(F.lit(1)).alias("n_articles"), F.avg("tone").alias("mean_tone"))
