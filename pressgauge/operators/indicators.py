"""Daily attention and sentiment per sector, category and (optionally) region.

Every function takes the grouping keys beside the day, so the national and
the regional indicators are one plan with one more key.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.columns import safe_ratio
from pressgauge.operators.lookups import Lookup, lookup_join

SECTOR_ROW = "__sector__"
TOTAL_ROW = "__total__"
NO_THEME = ";"  # themes are split at it, so that none can be it
ROW_THEMES = 10_000  # largest taxonomy that is tested inside an article row
SUMS = ("sum_w", "sum_t_cont", "sum_t_bin", "sum_t_cont_w", "sum_t_bin_w")
METRICS = (
    "att",
    "att_weight",
    "sent_cont",
    "sent_bin",
    "sent_cont_weight",
    "sent_bin_weight",
    "axs_cont",
    "axs_cont_weight",
    "axs_bin",
    "axs_bin_weight",
)


def region_table(regions: Lookup) -> Column:
    """The region map as one array value, for tests inside an article row.

    The map is a configuration of a few hundred codes; it is read once, as a
    scalar subquery.
    """
    per_region = regions.frame.groupBy("region_key").agg(F.collect_set("country_code").alias("codes"))
    return per_region.agg(F.collect_list(F.struct("region_key", "codes"))).scalar()


def regional_articles(clean: DataFrame, regions: Lookup) -> DataFrame:
    """Clean articles repeated once per region they touch; nothing is shuffled.

    An article row already carries its countries, so its regions are found in
    place. This equals the join on ids as long as ids are unique;
    ``regional_articles_by_id`` keeps the join for tables with repeated ids.
    """
    return (
        with_region_keys(clean, regions).withColumn("region_key", F.explode("region_keys")).drop("region_keys", "countries_list")
    )


def with_region_keys(clean: DataFrame, regions: Lookup) -> DataFrame:
    """Clean articles with the list of regions that they touch."""
    keyed = clean.withColumn("_regions", region_table(regions))

    def touched(countries: Column) -> Column:
        return F.filter("_regions", lambda r: F.arrays_overlap(r["codes"], countries))

    # Bound by an outer lambda, the countries are read from the text once and not once per region.
    found = F.element_at(F.transform(F.array("countries_list"), touched), 1)
    return keyed.withColumn("region_keys", F.transform(found, lambda r: r["region_key"])).drop("_regions")


def article_regions(clean: DataFrame, regions: Lookup) -> DataFrame:
    """Distinct (article, day, region) for every region an article touches."""
    exploded = clean.select("GKGRECORDID", "period", F.explode("countries_list").alias("country_code"))
    return (
        lookup_join(exploded, regions, ["country_code"], spread_by="GKGRECORDID")
        .select("GKGRECORDID", "period", "region_key")
        .distinct()
    )


def regional_articles_by_id(clean: DataFrame, regions: Lookup) -> DataFrame:
    """Articles joined to the regions of their id (all copies of it).

    Both sides are large; adaptive skew-join handling splits an id that is
    stored very often.
    """
    pairs = article_regions(clean, regions).select("GKGRECORDID", "region_key")
    return clean.drop("countries_list").join(pairs.hint("merge"), "GKGRECORDID")


def daily_totals(clean: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct articles per day (and region)."""
    return (
        clean.select("period", *keys, "GKGRECORDID")
        .distinct()
        .groupBy("period", *keys)
        .agg(F.count(F.lit(1)).alias("total_news"))
    )


def theme_hits(clean: DataFrame, taxonomy: Lookup, keys: tuple[str, ...] = ()) -> DataFrame:
    """Theme mentions per article, sector and category.

    The join keeps only themes of the taxonomy, and mentions are summed before
    they are shuffled: what moves is one row per article and category.
    """
    mentions = clean.select(
        "GKGRECORDID",
        "period",
        *keys,
        "tone",
        "tone_bin",
        "total_themes_count",
        F.explode("themes_list").alias("theme"),
    )
    return (
        lookup_join(mentions, taxonomy, ["theme"], spread_by="GKGRECORDID")
        .groupBy("GKGRECORDID", "period", *keys, "tone", "tone_bin", "total_themes_count", "sector", "cat_key")
        .agg(F.count(F.lit(1)).alias("theme_hits"))
    )


def _weighted_sums(weight: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("N"),
        F.sum(weight).alias("sum_w"),
        F.sum("tone").alias("sum_t_cont"),
        F.sum("tone_bin").alias("sum_t_bin"),
        F.sum(F.col("tone") * weight).alias("sum_t_cont_w"),
        F.sum(F.col("tone_bin") * weight).alias("sum_t_bin_w"),
    ]


def category_sums(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily sums per category."""
    weighted = hits.withColumn("w", safe_ratio(F.col("theme_hits"), F.col("total_themes_count")))
    return weighted.groupBy("period", *keys, "sector", F.col("cat_key").alias("granularity")).agg(
        *_weighted_sums(F.col("w"))
    )


def article_sector_weights(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per article and sector, with the mentions of all categories."""
    return (
        hits.groupBy("GKGRECORDID", "period", *keys, "sector")
        .agg(
            F.any_value("tone", True).alias("tone"),
            F.any_value("tone_bin", True).alias("tone_bin"),
            F.sum("theme_hits").alias("theme_hits"),
            F.any_value("total_themes_count", True).alias("total_themes_count"),
        )
        .withColumn("w", safe_ratio(F.col("theme_hits"), F.col("total_themes_count")))
        .drop("theme_hits", "total_themes_count")
    )


def sector_sums(hits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily sums per sector, built from article-level sector weights."""
    return article_sector_weights(hits, keys).groupBy(
        "period", *keys, "sector", F.lit(SECTOR_ROW).alias("granularity")
    ).agg(*_weighted_sums(F.col("w")))


def with_metrics(sums: DataFrame) -> DataFrame:
    """The ten indicators from daily sums and the daily total."""
    n, total = F.col("N"), F.col("total_news")
    return (
        sums.withColumn("att", safe_ratio(n, total))
        .withColumn("att_weight", safe_ratio(F.col("sum_w"), total))
        .withColumn("sent_cont", safe_ratio(F.col("sum_t_cont"), n))
        .withColumn("sent_bin", safe_ratio(F.col("sum_t_bin"), n))
        .withColumn("sent_cont_weight", F.when(F.col("sum_w") > 0, F.col("sum_t_cont_w") / F.nullif("sum_w", F.lit(0.0))))
        .withColumn("sent_bin_weight", F.when(F.col("sum_w") > 0, F.col("sum_t_bin_w") / F.nullif("sum_w", F.lit(0.0))))
        .withColumn("axs_cont", F.col("att") * F.col("sent_cont"))
        .withColumn("axs_cont_weight", F.col("att_weight") * F.col("sent_cont_weight"))
        .withColumn("axs_bin", F.col("att") * F.col("sent_bin"))
        .withColumn("axs_bin_weight", F.col("att_weight") * F.col("sent_bin_weight"))
    )


def article_weights(
    clean: DataFrame,
    taxonomy: Lookup,
    keys: tuple[str, ...] = (),
    regions: Lookup | None = None,
    unique_ids: bool = True,
    row_themes: int = ROW_THEMES,
) -> DataFrame:
    """Weight of each article per category, per sector and in total, from one shuffle of the articles.

    Hits are counted inside the article row, which then moves once, with a
    number per category in place of its themes. Category rows are kept apart by
    the article's attributes, the others only by its id, so copies of an id that
    differ behave as in ``category_sums``, ``sector_sums`` and ``daily_totals``;
    those share no work, this does. Copies are merged by windows over sorted
    rows, so that a task holds no table of its articles.

    With ``regions`` the regions of an article are opened after that, so its
    hits are not multiplied by them. Without ``unique_ids`` every copy counts in
    the regions of all copies, as in ``regional_articles_by_id``. A taxonomy of
    more than ``row_themes`` rows is joined in place of tested.
    """
    place = [*keys, *(["region_key"] if regions is not None else [])]
    if taxonomy.rows > row_themes:
        if regions is not None and not unique_ids:
            return _joined_weights(regional_articles_by_id(clean, regions), taxonomy, tuple(place))
        return _joined_weights(clean, taxonomy, keys, regions)
    weights, names = _numbered_weights(clean, taxonomy, keys, regions, unique_ids)
    return _named(weights, names).select("period", *place, "sector", "granularity", "tone", "tone_bin", "w")


def _named(rows: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """``sector`` and ``granularity`` in place of the row number ``_row`` of ``names``."""
    listed = [F.array(*[F.lit(name[k]) for name in names]) for k in (0, 1)]
    return rows.withColumns(
        {c: F.get(x, F.col("_row")) for c, x in zip(("sector", "granularity"), listed)}
    ).drop("_row")


def _numbered_weights(
    clean: DataFrame, taxonomy: Lookup, keys: tuple[str, ...], regions: Lookup | None, unique_ids: bool
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``article_weights`` with a number in place of sector and granularity, and the names of the numbers.

    An article has a row for each name that it hits, so these rows hold numbers only.
    """
    themes: dict[tuple[str, str], list[str]] = {}
    for row in taxonomy.frame.select("sector", "cat_key", "theme").filter(F.col("theme").isNotNull()).collect():
        themes.setdefault((row["sector"], row["cat_key"]), []).append(row["theme"])
    categories = list(themes)
    hits = [f"_h{i}" for i in range(len(categories))]
    attributes = ["tone", "tone_bin", "total_themes_count"]
    rows = clean
    if regions is not None:
        rows = with_region_keys(clean if unique_ids else clean.filter(F.col("GKGRECORDID").isNotNull()), regions)
    place = [*keys, *(["region_keys"] if regions is not None else [])]
    known = F.filter("themes_list", lambda t: t.isin(sorted({x for listed in themes.values() for x in listed})))
    rows = rows.select("GKGRECORDID", "period", *place, *attributes, known.alias("_known")).select(
        "GKGRECORDID", "period", *place, *attributes, F.col("_known").isNotNull().cast("long").alias("_copies"),
        *[_listed(themes[c]).alias(h) for c, h in zip(categories, hits)],
    )
    if regions is not None and not unique_ids:
        rows = _with_regions_of_copies(rows.repartition("GKGRECORDID"))
    else:
        rows = rows.repartition("GKGRECORDID", "period")

    apart = ["GKGRECORDID", "period", *place]
    same, alike = Window.partitionBy(*apart).orderBy(*attributes), Window.partitionBy(*apart, *attributes).orderBy("tone")
    # One sort and two passes: number and sums of the same copies share a window.
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    copies = {h: F.sum(h).over(alike.rowsBetween(*every)) for h in ["_copies", *hits]}
    rows = rows.withColumns({"_nth": F.row_number().over(alike)} | copies).filter(F.col("_nth") == 1)
    groups = {TOTAL_ROW: F.col("_copies")}
    for sector in dict.fromkeys(sector for sector, _ in categories):
        groups[sector] = reduce(lambda x, y: x + y, [F.col(h) for (s, _), h in zip(categories, hits) if s == sector])
    merged = {"_first": F.row_number().over(same)}
    for i, own in enumerate(groups.values()):
        merged[f"_g{i}"] = F.sum(own).over(same.rowsBetween(*every))
        for a in attributes:
            merged[f"_g{i}_{a}"] = F.first(F.when(own > 0, F.col(a)), ignorenulls=True).over(same.rowsBetween(*every))
    rows = rows.withColumns(merged)

    def entry(n: int, hit: Column, tone: Column, tone_bin: Column, total: Column) -> Column:
        return F.struct(
            F.lit(n).alias("_row"), hit.alias("hit"), tone.alias("tone"), tone_bin.alias("tone_bin"), total.alias("total")
        )

    names = [*categories, *[(s, TOTAL_ROW if s == TOTAL_ROW else SECTOR_ROW) for s in groups]]
    entries = [F.when(F.col(h) > 0, entry(n, F.col(h), *[F.col(a) for a in attributes])) for n, h in enumerate(hits)]
    for i in range(len(groups)):
        found = entry(len(hits) + i, F.col(f"_g{i}"), *[F.col(f"_g{i}_{a}") for a in attributes])
        entries.append(F.when((F.col("_first") == 1) & (F.col(f"_g{i}") > 0), found))
    # Opened first and filtered then, which is compiled; a filter inside the array is not.
    opened = rows.select("period", *place, F.explode(F.array(*entries)).alias("_e")).filter(F.col("_e").isNotNull())
    weights = opened.select("period", *place, "_e.*").withColumn("w", safe_ratio(F.col("hit"), F.col("total")))
    if regions is not None:
        if unique_ids:
            weights = weights.withColumn("region_key", F.explode("region_keys"))
        else:
            each = weights.withColumn("_r", F.explode("region_keys"))
            weights = each.withColumn("region_key", F.col("_r.region_key")).withColumn("w", F.col("w") * F.col("_r.times"))
        keys = (*keys, "region_key")
    return weights.select("period", *keys, "_row", "tone", "tone_bin", "w"), names


def _listed(themes: list[str]) -> Column:
    """How many of the row's known themes are in the list; a theme listed twice counts twice."""
    times = Counter(themes)

    def count(listed: list[str]) -> Column:
        return F.size(F.filter("_known", lambda t: t.isin(listed)))

    counts = [count([x for x, n in times.items() if n >= at]) for at in range(1, max(times.values()) + 1)]
    return F.when(F.col("_known").isNotNull(), reduce(lambda x, y: x + y, counts)).otherwise(0).cast("long")


def _with_regions_of_copies(rows: DataFrame) -> DataFrame:
    """``region_keys`` of all copies of an id, as (region_key, times): once for each day on which one touches it."""
    days = F.collect_set(F.struct("period", "region_keys")).over(Window.partitionBy("GKGRECORDID"))
    touched = F.array_distinct(
        F.flatten(F.transform(days, lambda d: F.transform(d["region_keys"], lambda r: F.struct(d["period"].alias("d"), r.alias("r")))))
    )
    found = rows.withColumn("_touched", touched)
    names = F.array_sort(F.array_distinct(F.transform("_touched", lambda x: x["r"])))
    times = F.transform(
        names, lambda r: F.struct(r.alias("region_key"), F.size(F.filter("_touched", lambda x: x["r"] == r)).alias("times"))
    )
    return found.withColumn("region_keys", times).drop("_touched")


def _joined_weights(
    clean: DataFrame, taxonomy: Lookup, keys: tuple[str, ...] = (), regions: Lookup | None = None
) -> DataFrame:
    """``article_weights`` by a join, for a taxonomy too large to test inside a row.

    The taxonomy lists every theme for its category and once more for its
    sector, and every article has one more theme that stands for the total.
    """
    both = taxonomy.frame.select(
        "theme", "sector", F.explode(F.array("cat_key", F.lit(SECTOR_ROW))).alias("granularity")
    )
    total = clean.sparkSession.range(1).select(
        F.lit(NO_THEME).alias("theme"), F.lit(TOTAL_ROW).alias("sector"), F.lit(TOTAL_ROW).alias("granularity")
    )
    listed = Lookup(both.unionByName(total), taxonomy.rows * 2 + 1)
    attributes = ("tone", "tone_bin", "total_themes_count")
    held = ("region_keys",) if regions is not None else ()
    rows = clean if regions is None else with_region_keys(clean, regions)
    themes = F.explode(F.concat("themes_list", F.array(F.lit(NO_THEME)))).alias("theme")
    mentions = rows.select("GKGRECORDID", "period", *keys, *held, *attributes, themes)
    by_category = ~F.col("granularity").isin(SECTOR_ROW, TOTAL_ROW)
    weights = (
        lookup_join(mentions, listed, ["theme"], spread_by="GKGRECORDID")
        .withColumns({f"_{a}": F.when(by_category, F.col(a)) for a in attributes})
        .groupBy("GKGRECORDID", "period", *keys, *held, "sector", "granularity", *[f"_{a}" for a in attributes])
        .agg(F.count(F.lit(1)).alias("theme_hits"), *[F.any_value(a, True).alias(a) for a in attributes])
        .withColumn("w", safe_ratio(F.col("theme_hits"), F.col("total_themes_count")))
    )
    if regions is not None:
        weights = weights.withColumn("region_key", F.explode("region_keys"))
        keys = (*keys, "region_key")
    return weights.select("period", *keys, "sector", "granularity", "tone", "tone_bin", "w")


def long_indicators(
    clean: DataFrame,
    taxonomy: Lookup,
    keys: tuple[str, ...] = (),
    regions: Lookup | None = None,
    totals: bool = False,
    unique_ids: bool = True,
) -> DataFrame:
    """Category and sector rows with all sums and indicators, from one scan of the articles.

    The total of a day (and region) is one more row of the same aggregation; it
    is handed to the others of its day, a row per category. ``totals`` keeps it.
    """
    if taxonomy.rows > ROW_THEMES:
        weights, names = article_weights(clean, taxonomy, keys, regions, unique_ids), None
    else:
        weights, names = _numbered_weights(clean, taxonomy, keys, regions, unique_ids)
    keys = ("period", *keys, *(("region_key",) if regions is not None else ()))
    sums = weights.groupBy(*keys, *(["_row"] if names else ["sector", "granularity"])).agg(*_weighted_sums(F.col("w")))
    if names:
        sums = _named(sums, names).select(*keys, "sector", "granularity", "N", *SUMS)
    is_total = F.col("sector") == TOTAL_ROW
    total = F.max(F.when(is_total, F.col("N"))).over(Window.partitionBy(*keys))
    # Articles without a calendar day have no daily total.
    found = with_metrics(sums.withColumn("total_news", F.when(F.col("period").isNotNull(), total)))
    return found if totals else found.filter(~is_total)


def regional_indicators(clean: DataFrame, taxonomy: Lookup, regions: Lookup, unique_ids: bool = True) -> DataFrame:
    """Long indicators per region; ``unique_ids=False`` gives every copy of an id the regions of all copies."""
    return long_indicators(clean, taxonomy, regions=regions, unique_ids=unique_ids)


def pivot_names(taxonomy: Lookup) -> list[str]:
    """Column suffixes ``sector`` and ``sector_category``, in order.

    Read from the taxonomy, which is a configuration; giving the pivot its
    values saves a pass over the data.
    """
    rows = taxonomy.frame.select("sector", "cat_key").distinct().orderBy("sector", "cat_key").collect()
    sectors = dict.fromkeys(r["sector"] for r in rows)
    return [n for s in sectors for n in [s, *(f"{s}_{r['cat_key']}" for r in rows if r["sector"] == s)]]


def widen(long: DataFrame, keys: list[str], names: list[str], metrics: tuple[str, ...]) -> DataFrame:
    series = F.when(F.col("granularity") == SECTOR_ROW, F.col("sector")).otherwise(
        F.concat_ws("_", "sector", "granularity")
    )
    named = long.withColumn("_series", series)
    if len(metrics) == 1:
        # Spark names the columns of a single-aggregate pivot by value alone.
        pivoted = named.groupBy(*keys).pivot("_series", names).agg(F.max(metrics[0]))
        return pivoted.select(*keys, *[F.col(f"`{n}`").alias(f"{metrics[0]}_{n}") for n in names])
    pivoted = named.groupBy(*keys).pivot("_series", names).agg(*[F.max(m).alias(m) for m in metrics])
    return pivoted.select(*keys, *[F.col(f"`{n}_{m}`").alias(f"{m}_{n}") for n in names for m in metrics])


def wide_indicators(long: DataFrame, names: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row for every day with articles, matched or not.

    ``long`` has its totals: they are the days, so the articles are not read again.
    """
    placed = long.withColumns({m: F.when(F.col("period").isNotNull(), F.col(m)) for m in metrics})
    return widen(placed, ["period"], names, metrics)


def wide_geo_indicators(long: DataFrame, names: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per day and region where something matched."""
    return widen(long, ["period", "region_key"], names, metrics)


def merge_partial_tables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Unite wide tables with differing columns; one row per key, by maximum."""
    united = tables[0]
    for table in tables[1:]:
        united = united.unionByName(table, allowMissingColumns=True)
    values = [c for c in united.columns if c not in keys]
    return united.groupBy(*keys).agg(*[F.max(F.col(c)).alias(c) for c in values])


def pick_series(
    long: DataFrame, metric: str, sectors: list[str] | None = None
) -> DataFrame:
    """Series of one metric, as (keys, ``series``, ``value``).

    One sector gives only its categories (or itself if it has none), several
    give the sector rows, none gives everything.
    """
    chosen = long
    if sectors and len(sectors) > 1:
        chosen = long.filter(F.col("sector").isin(sectors) & (F.col("granularity") == SECTOR_ROW))
    elif sectors:
        only = long.filter(F.col("sector") == sectors[0])
        is_category = F.col("granularity") != SECTOR_ROW
        has_categories = only.agg(F.coalesce(F.max(is_category), F.lit(False))).scalar()
        chosen = only.filter(is_category == has_categories)
    name = F.when(F.col("granularity") == SECTOR_ROW, F.concat_ws("_", F.lit(metric), "sector")).otherwise(
        F.concat_ws("_", F.lit(metric), "sector", "granularity")
    )
    keys = [c for c in ("period", "region_key") if c in long.columns]
    return chosen.select(*keys, name.alias("series"), F.col(metric).alias("value"))
