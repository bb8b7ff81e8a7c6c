"""Literal rows for the field, cleaning and indicator rules."""

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.functions import labels
from pressgauge.operators import cleaning, features, graph, profiling
from pressgauge.operators import indicators as ind
from pressgauge.operators import substring
from pressgauge.operators.lookups import lookup_join, measure
from pressgauge.session import enough_partitions
from pressgauge.settings import CleaningRules

SCHEMA = ("GKGRECORDID string, DATE string, SourceCommonName_ID int, DocumentIdentifier string, "
          "EnhancedThemes string, EnhancedLocations string, WordCount int, Tone double")


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def articles(spark, *rows):
    base = ("id1", "20200101120000", 1, "https://a.com/x", "A,1;B,2", "1#X#US#a", 100, 1.5)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**dict(zip(names, base)), **r}[n] for n in names) for r in rows], SCHEMA)


def dictionary(spark):
    return measure(spark.createDataFrame([(7, "a.com"), (8, "b.org")], "SourceCommonName_ID int, SourceCommonName string"))


@pytest.mark.parametrize("url, host", [
    ("https://www.a.com:80/x", "a.com"), ("http://a.com./x", "a.com"), ("10.0.0.1/x", ""), ("https://b.org?x=1", "b.org"),
])
def test_host(spark, url, host):
    assert one(spark, url, c.host_of) == host


@pytest.mark.parametrize("url, host", [
    ("www.a.com:8080/p", "a.com"), ("http://WWW.A.com", "www.a.com"), (" a.com/p ", "a.com"), ("https://www.A.com/", "a.com"),
])
def test_registry_host(spark, url, host):
    assert one(spark, url, c.registry_host) == host


def test_themes_keep_the_trailing_empty_piece(spark):
    assert one(spark, "ECON_A,1;econ_b,2;", c.theme_count) == 3
    assert one(spark, "ECON_A,1; econ_b ,2;", c.theme_keys) == ["ECON_A", "ECON_B", ""]


def test_countries(spark):
    assert one(spark, "1#X#US#a;4#Y#FR#b;3#Z#US#c;5##", c.country_codes) == ["US", "FR"]


def test_digits_that_are_no_date(spark):
    assert one(spark, "20211399000000", c.has_valid_date) is True
    assert one(spark, "20211399000000", c.day_of) is None


def test_significance_text(spark):
    rows = [(0.0, 0.001), (1.234, 0.009), (-0.5, 0.04), (0.2, 0.09), (0.2, 0.5)]
    df = spark.createDataFrame(rows, "b double, p double")
    got = [r[0] for r in df.select(labels.significance_text(F.col("b"), F.col("p"))).collect()]
    assert got == ["0.00", "+1.23***", "-0.50**", "+0.20*", "+0.20 (ns)"]


def test_filters_drop_bad_rows(spark):
    rows = articles(
        spark, {}, {"DATE": "2021"}, {"DATE": "abc"}, {"DATE": "2020010112000"}, {"EnhancedThemes": ""},
        {"EnhancedThemes": None}, {"WordCount": 14}, {"WordCount": 6501}, {"GKGRECORDID": "20210925181500-T1111"},
    )
    kept = cleaning.sized(cleaning.themed(cleaning.dated(rows)))
    assert kept.count() == 1


def test_source_repair(spark):
    rows = articles(
        spark, {"GKGRECORDID": "known"}, {"GKGRECORDID": "zero", "SourceCommonName_ID": 0},
        {"GKGRECORDID": "null", "SourceCommonName_ID": None, "DocumentIdentifier": "http://www.b.org/y"},
        {"GKGRECORDID": "lost", "SourceCommonName_ID": 0, "DocumentIdentifier": "10.0.0.1/x"},
    )
    got = {r["GKGRECORDID"]: r["Src_ID"] for r in cleaning.with_source(rows, dictionary(spark)).collect()}
    assert got == {"known": 1, "zero": 7, "null": 8}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = measure(spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")))
    small = lookup_join(facts, lookup, ["k"], how)
    large = lookup_join(facts, lookup, ["k"], how, spread_by="id", broadcast_rows=5, salts=7)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()


def clean_rows(spark, *rows):
    return cleaning.to_clean(articles(spark, *rows))


def taxonomy(spark):
    rows = [("s", "c", "A"), ("s", "d", "B"), ("t", "c", "A")]
    return measure(spark.createDataFrame(rows, "sector string, cat_key string, theme string"))


def test_repeated_theme_counts_each_time(spark):
    clean = clean_rows(spark, {"EnhancedThemes": "A,1;A,9;B,3"})
    long = {(r["sector"], r["granularity"]): r for r in ind.long_indicators(clean, taxonomy(spark)).collect()}
    assert long["s", "c"]["sum_w"] == pytest.approx(2 / 3)
    assert long["s", ind.SECTOR_ROW]["sum_w"] == pytest.approx(1.0)
    assert long["t", "c"]["att"] == 1.0


def test_duplicate_ids_merge_their_hits(spark):
    clean = clean_rows(spark, {}, {})
    row = ind.long_indicators(clean, taxonomy(spark)).filter("sector = 's' AND granularity = 'c'").first()
    assert (row["N"], row["sum_w"], row["total_news"]) == (1, 1.0, 1)


def test_regions_in_place_equal_the_join_when_ids_are_unique(spark):
    regions = measure(spark.createDataFrame(
        [("France", "FR"), ("EU", "FR"), ("EU", "GM"), ("US", "US")], "region_key string, country_code string"))
    unique = clean_rows(
        spark, {"EnhancedLocations": "1#a#FR;1#b#GM"}, {"GKGRECORDID": "id2", "EnhancedLocations": "1#a#US;1#z#ZZ"},
        {"GKGRECORDID": "id3", "EnhancedLocations": None},
    )
    columns = ["GKGRECORDID", "region_key"]
    a = sorted(map(tuple, ind.regional_articles(unique, regions).select(columns).collect()))
    b = sorted(map(tuple, ind.regional_articles_by_id(unique, regions).select(columns).collect()))
    assert a == b == [("id1", "EU"), ("id1", "France"), ("id2", "US")]
    # An id stored twice meets the regions of both copies in the join only.
    twice = clean_rows(spark, {"EnhancedLocations": "1#a#FR"}, {"EnhancedLocations": "1#b#US"})
    assert ind.regional_articles(twice, regions).count() == 3
    assert ind.regional_articles_by_id(twice, regions).count() == 6


def test_weights_move_one_row_per_article(spark):
    """Hits are counted in the row: the first shuffle takes articles, not themes, and nothing is hashed before it."""
    clean = clean_rows(spark, *[{"GKGRECORDID": f"i{n}", "EnhancedThemes": "A,1;B,2;A,3;Z,4"} for n in range(50)])
    weights = ind.article_weights(clean, taxonomy(spark))
    weights.collect()
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):]
    assert "Generate" not in below and "Join" not in below and "Aggregate" not in plan
    # 50 articles: two categories of s, one of t, both sectors, the total.
    assert weights.count() == 50 * 6


MIXED = [
    {}, {}, {"Tone": -2.0}, {"GKGRECORDID": "id2", "EnhancedThemes": "A,1;C,5;A,9"}, {"GKGRECORDID": None}, {"GKGRECORDID": None, "Tone": None},
    {"GKGRECORDID": "id3", "DATE": "20200102120000", "EnhancedThemes": "C,1;Z,2"}, {"DATE": "20200102120000", "EnhancedLocations": "1#b#GM"},
]


@pytest.mark.parametrize("regional, unique_ids", [(False, True), (True, True), (True, False)])
def test_weights_in_the_row_equal_the_join(spark, regional, unique_ids):
    """Copies that differ, missing ids and a theme listed twice; a sector's tone is any copy's, so its weights are compared."""
    listed = [("s", "c", "A"), ("s", "d", "B"), ("t", "c", "A"), ("t", "c", "C"), ("t", "c", "C")]
    known = measure(spark.createDataFrame(listed, "sector string, cat_key string, theme string"))
    regions = measure(spark.createDataFrame(
        [("France", "FR"), ("EU", "FR"), ("EU", "GM"), ("US", "US")], "region_key string, country_code string")) if regional else None
    clean = clean_rows(spark, *MIXED, {"GKGRECORDID": "id4", "EnhancedLocations": "1#a#FR;1#b#GM"})

    def found(row_themes):
        rows = ind.article_weights(clean, known, (), regions, unique_ids, row_themes).collect()
        names = ["period", *(["region_key"] if regional else []), "sector", "granularity"]
        apart = lambda r: r["granularity"] in "cd"
        return sorted(str([r[n] for n in names] + [round(r["w"], 9)] + ([r["tone"], r["tone_bin"]] if apart(r) else [])) for r in rows)

    assert found(100) == found(0) != []


def test_regions_by_id_need_no_join(spark):
    """Every copy counts in the regions of all copies, found beside it; the articles are neither joined nor repeated."""
    regions = measure(spark.createDataFrame([("EU", "FR"), ("US", "US")], "region_key string, country_code string"))
    clean = clean_rows(spark, {"EnhancedLocations": "1#a#FR"}, {"DATE": "20200102120000", "EnhancedLocations": "1#b#US"})
    long = ind.regional_indicators(clean, taxonomy(spark), regions, unique_ids=False)
    assert "Join" not in long._jdf.queryExecution().optimizedPlan().toString()
    got = {(str(r["period"]), r["region_key"]): r["sum_w"] for r in long.filter("sector = 's' AND granularity = 'c'").collect()}
    assert got == {(d, r): 0.5 for d in ("2020-01-01", "2020-01-02") for r in ("EU", "US")}


def test_countries_are_read_once_per_article(spark):
    regions = measure(spark.createDataFrame([("EU", "FR"), ("US", "US")], "region_key string, country_code string"))
    keyed = ind.with_region_keys(clean_rows(spark, {"EnhancedLocations": "1#a#FR"}, {"GKGRECORDID": "id2", "EnhancedLocations": None}), regions)
    plan = keyed.select("GKGRECORDID", "region_keys")._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap(lambda" in plan and "array_distinct" not in plan[plan.index("arrays_overlap"):].split(")")[0]
    assert {r["GKGRECORDID"]: r["region_keys"] for r in keyed.collect()} == {"id1": ["EU"], "id2": []}


def test_wide_table_keeps_days_without_match(spark):
    clean = clean_rows(spark, {}, {"GKGRECORDID": "id2", "DATE": "20200102120000", "EnhancedThemes": "Z,1;Y,2"})
    long = ind.long_indicators(clean, taxonomy(spark), totals=True)
    wide = ind.wide_indicators(long, ind.pivot_names(taxonomy(spark)))
    rows = {str(r["period"]): r for r in wide.collect()}
    assert rows["2020-01-01"]["att_s_c"] == 1.0 and rows["2020-01-02"]["att_s_c"] is None


def test_merge_ignores_missing_values(spark):
    a = spark.createDataFrame([("d1", 1.0)], "period string, x double")
    b = spark.createDataFrame([("d1", None, 2.0), ("d2", 3.0, None)], "period string, x double, y double")
    got = {r["period"]: (r["x"], r["y"]) for r in ind.merge_partial_tables([a, b], ["period"]).collect()}
    assert got == {"d1": (1.0, 2.0), "d2": (3.0, None)}


def test_substring_match_also_hits_suffixes(spark):
    df = spark.createDataFrame([("WB_X,5",), ("XY,5",)], "t string")
    assert [r[0] for r in df.select(substring.names_any(F.col("t"), ["x"])).collect()] == [True, False]


def test_local_whitelist_needs_years_and_articles(spark):
    rows = [{"GKGRECORDID": f"i{y}{n}", "DATE": f"{y}0101000000"} for y in (2020, 2021) for n in range(2)]
    rules = CleaningRules(min_articles=4, min_years=2)
    both = articles(spark, *rows)
    assert cleaning.clean_articles(both, dictionary(spark), None, rules).count() == 4
    one_year = both.filter(F.col("DATE").startswith("2020"))
    assert cleaning.clean_articles(one_year, dictionary(spark), None, rules).count() == 0


def test_cooccurrence_multiplies_repeats(spark):
    rows = articles(spark, {"EnhancedThemes": "A,1;A,2;B,3;C,4"}, {"EnhancedThemes": "A,1;B,3"})
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.cooccurrence(rows, 0).collect()}
    assert got == {("A", "B"): 3, ("A", "C"): 2, ("B", "C"): 1}


def scans(df):
    """Scans of the final plan, and its text."""
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.split("+- ")[-1].split(":- ")[-1].strip().startswith("Relation") for line in text.splitlines()), text


def stored(spark, tmp_path):
    rows = [{"GKGRECORDID": f"i{n}", "EnhancedThemes": "A,1;B,2;A,3", "EnhancedLocations": "1#A#FR"} for n in range(4)]
    articles(spark, *rows).write.parquet(str(tmp_path / "a"))
    return spark.read.parquet(str(tmp_path / "a"))


def test_cooccurrence_sorts_no_themes_in_the_scan(spark, tmp_path):
    read, plan = scans(graph.cooccurrence(stored(spark, tmp_path), 0))
    assert read == 1
    assert not any("array_sort" in line for line in plan.splitlines() if "Filter" in line)


def test_indicators_read_the_articles_once(spark, tmp_path):
    clean = cleaning.to_clean(stored(spark, tmp_path).withColumn("Src_ID", F.lit(1)))
    regions = measure(spark.createDataFrame([("eu", "FR"), ("eu", "DE"), ("us", "US")], "region_key string, country_code string"))
    long = ind.long_indicators(clean, taxonomy(spark), totals=True)
    assert scans(long)[0] == 1
    assert scans(ind.wide_indicators(long, ["s", "s_c"]))[0] == 1
    assert scans(ind.regional_indicators(clean, taxonomy(spark), regions))[0] == 1
    got = ind.regional_indicators(clean, taxonomy(spark), regions).collect()
    assert {(r["region_key"], r["total_news"]) for r in got} == {("eu", 4)}


def test_funnel_reads_the_articles_once(spark, tmp_path):
    kept = measure(spark.createDataFrame([(1,)], "Src_ID int"))
    steps = cleaning.passed_steps(stored(spark, tmp_path), dictionary(spark), kept)
    assert scans(profiling.funnel(steps, cleaning.STEPS))[0] == 1


def test_source_features_read_the_articles_twice(spark, tmp_path):
    """Once for the days, once for the themes; what follows reads only stored sums."""
    table = stored(spark, tmp_path).withColumns({"Src_ID": F.lit(1), "is_wiki": F.lit(0)})
    result = features.source_features(table)
    assert str(tmp_path) not in scans(result)[1] and not any(str(tmp_path) in f for f in result.inputFiles())
    assert [(r["total_articles"], r["mean_themes_per_art"]) for r in result.collect()] == [(4, 2.0)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_selected_quantiles_equal_the_plain_ones(spark, partitions):
    """One group holds most rows and one value most of these; groups of one and of equal values, and nulls."""
    rows = [("big", float(n * n % 501) / 7) for n in range(3000)] + [("big", 1.5)] * 4000
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    values = spark.createDataFrame(rows, "g string, v double")
    levels = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ranges = profiling.value_ranges(values, "v", ["g"])
        got = profiling.selected_quantiles(ranges, "v", levels, ["g"]).collect()
        alone = profiling.selected_quantiles(profiling.value_ranges(values, "v", []), "v", (0.5,), []).collect()
        assert ranges.filter("g = 'big'").select("_part").distinct().count() == min(int(partitions), 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = profiling.exact_quantiles(values, "v", levels, ["g"]).collect()
    key = lambda r: (r["g"], r["level"])
    assert {key(r): pytest.approx(r["value"]) for r in want} == {key(r): r["value"] for r in got}
    assert len(got) == len(want) == 28 and alone[0]["value"] == 1.5


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z")]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "src string, dst string")).collect()}
    assert set(got.values()) == {"n000", "x"} and got["n040"] == "n000" and got["z"] == "x"


def test_category_rows_are_numbers_from_two_windows(spark):
    """An article's category rows hold numbers and no names until they are summed; copies are merged in two passes."""
    clean = clean_rows(spark, {}, {"Tone": -2.0}, {"GKGRECORDID": "id2", "EnhancedThemes": "B,1;C,2"})
    long = ind.long_indicators(clean, taxonomy(spark))
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("\n", plan.index("Aggregate")):]
    assert ind.SECTOR_ROW not in below and below.count("Window [") == 2
    assert "filter(array(" not in below
    assert {(r["sector"], r["granularity"]) for r in long.collect()} >= {("s", "c"), ("s", ind.SECTOR_ROW)}


def test_shuffle_partitions_follow_the_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with enough_partitions(spark, 101, 10) as n:
        plan = spark.range(101).selectExpr("id % 7 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert n == 11 and "hashpartitioning(k#" in plan and ", 11)" in plan
    with enough_partitions(spark, 1) as n:
        assert n == int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_lines_do_not_move_for_their_suppliers(spark, tmp_path):
    """Suppliers are counted and broadcast, whatever Spark takes their size to be."""
    from pressgauge.catalogue.tables import Tables

    given = {
        "lineitem": "SELECT 1L AS l_orderkey, id AS l_suppkey, timestamp'1997-01-02' AS l_shipdate, 2.0D AS l_extendedprice FROM range(4)",
        "supplier": "SELECT id AS s_suppkey, 3 AS s_nationkey FROM range(2)",
        "nation": "SELECT 3 AS n_nationkey, 5 AS n_regionkey",
        "region": "SELECT 5 AS r_regionkey, 'R' AS r_name",
    }
    for name, text in given.items():
        spark.sql(text).write.parquet(str(tmp_path / f"{name}.parquet"))
    macro = Tables(spark, str(tmp_path)).macro
    optimized = macro._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in optimized
    assert [(r["region_key"], r["value"]) for r in macro.collect()] == [("R", 4.0)]
