"""Features per source, the media registry, raw files, streams."""

import gzip
import math
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pressgauge.operators import features, ingest, registry, topk, vocabulary
from pressgauge.operators.lookups import measure
from pressgauge.plans import runs
from pressgauge.session import fresh_path, stage, staging
from pressgauge.sources import lookups as lookup_source
from pressgauge.sources import raw
from pressgauge.streaming import jobs


def rows(spark, *days, words=100, themes="A,1;B,2"):
    return spark.createDataFrame(
        [(1, f"{d}000000", words, themes) for d in days], "Src_ID int, DATE string, WordCount int, EnhancedThemes string"
    )


def test_silent_months_count_as_zero(spark):
    days = ["20200105"] * 4 + ["20200310"] * 4
    row = features.temporal_stats(features.daily_counts(rows(spark, *days))).first()
    mean, squares = 8 / 3, (16 + 16) / 3
    assert row["lifespan_months"] == 3 and row["avg_monthly"] == pytest.approx(mean)
    assert row["cv_monthly"] == pytest.approx(math.sqrt(squares - mean**2) / mean)


def test_one_article(spark):
    base = features.base_stats(features.daily_activity(rows(spark, "20200105"))).first()
    assert base["cv_wordcount"] is None and base["mean_themes_per_art"] == 2
    wide = features.word_stats(rows(spark, "20200105"), more_than=0).first()
    assert wide["cv_wordcount"] == 0.0


def test_entropy_bounds(spark):
    even = features.theme_entropy(features.theme_frequencies(rows(spark, "20200105", themes="A,1;B,2;C,3"))).first()
    assert even["h_norm_themes"] == pytest.approx(1.0)
    single = features.theme_entropy(features.theme_frequencies(rows(spark, "20200105", themes="A,1;A,2"))).first()
    assert single["h_norm_themes"] is None and single["h_norm_eco_themes"] == 0.0


def test_blank_inception_wins(spark):
    domains = spark.createDataFrame(
        [("1", "d", "old", "t", "FR", "1990"), ("1", "d", "blank", "t", "FR", "")],
        "id string, domain string, medialabel string, typelabel string, countrylabel string, inception string",
    )
    assert registry.one_per_source(domains).first()["medialabel"] == "blank"


def test_cascade_match(spark):
    hosts = spark.createDataFrame(
        [("a.com",), ("news.a.com",), ("x.paper.co.uk",), ("b.org",), ("deep.er.c.net",)], "host string")
    known = measure(spark.createDataFrame(
        [(1, "a.com"), (2, "paper.co.uk"), (3, "c.net")], "SourceCommonName_ID int, SourceCommonName string"))
    suffixes = measure(spark.createDataFrame([("com",), ("co.uk",), ("uk",)], "suffix string"))
    got = {r["host"]: r["id"] for r in registry.match_hosts(hosts, known, suffixes).collect()}
    assert got == {"a.com": 1, "news.a.com": 1, "x.paper.co.uk": 2, "deep.er.c.net": 3}


def test_vocabulary_word_bounds(spark):
    lines = spark.createDataFrame([("WB_SOIL 5",), ("SOIL",), ("FARM_12",), ("TAX_FARM 3",), ("OTHER",)], "value string")
    got = {r["theme"] for r in vocabulary.pick_themes(lines, ["soil"], ["farm"], ["tax_"]).collect()}
    assert got == {"SOIL", "FARM"}


def test_hot_group_is_limited_before_the_shuffle(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), "id")
    first = topk.first_per_group(df, ["g"], [F.col("id")], 2)
    assert first.filter("g = 0").count() == 2
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def record(number, tone="-2.5,1,2,3,4,5,120", name="a.com", **more):
    fields = [""] * raw.RAW_FIELDS
    fields[0], fields[1], fields[2], fields[3], fields[4], fields[8], fields[15] = (
        f"r{number}", "20200101000000", "1", name, f"http://{name}/{number}", "A,1;B,2", tone)
    return "\t".join(fields)


@pytest.fixture
def raw_files(tmp_path):
    (tmp_path / "zip").mkdir()
    (tmp_path / "txt").mkdir()
    plain = "\n".join([record(1), record(1, "9,,"), record(2, "-2.5,1,2", "b.org"), "broken\tline", record(3, "?", "")])
    with zipfile.ZipFile(tmp_path / "zip" / "20200101.gkg.csv.zip", "w") as z:
        z.writestr("20200101.gkg.csv", plain)
    with zipfile.ZipFile(tmp_path / "zip" / "20200101.translation.gkg.csv.zip", "w") as z:
        z.writestr("20200101.gkg.csv", record(1) + "\n")
    with gzip.open(tmp_path / "txt" / "20200101.translation.gkg.csv.gz", "wt") as f:
        f.write(plain)
    return tmp_path


def test_raw_zip_ingest(spark, raw_files):
    records = raw.raw_records(raw.zip_lines(spark, str(raw_files / "zip")))
    assert records.count() == 5
    known = spark.createDataFrame([(4, "b.org")], "SourceCommonName_ID int, SourceCommonName string")
    articles, grown = ingest.ingest(records, known)
    got = {(r["GKGRECORDID"], r["IsTranslingual"]): r for r in articles.collect()}
    assert set(got) == {("r1", 0), ("r2", 0), ("r3", 0), ("r1", 1)}
    first = got["r1", 0]
    assert (first["Tone"], first["WordCount"], first["year"], first["month"]) == (-2.5, 120, 2020, 1)
    assert (got["r2", 0]["Tone"], got["r2", 0]["WordCount"]) == (-2.5, 0)
    assert (got["r3", 0]["Tone"], got["r3", 0]["SourceCommonName_ID"]) == (0.0, 0)
    assert {r["SourceCommonName"]: r["SourceCommonName_ID"] for r in grown.frame.collect()} == {"b.org": 4, "a.com": 5}


def test_raw_gz_keeps_the_first_row(spark, raw_files):
    records = raw.raw_records(raw.text_lines(spark, str(raw_files / "txt")))
    got = {r["GKGRECORDID"]: r["Tone"] for r in ingest.first_in_file(ingest.typed_records(records)).collect()}
    assert got == {"r1": -2.5, "r2": -2.5, "r3": 0.0}


def test_registry_files_any_header_case(spark, tmp_path):
    (tmp_path / "fr_news.csv").write_text("mediaLabel,typeLabel,countryLabel,inception,website\nLe A,daily,France,,a.com\n")
    (tmp_path / "DE1.csv").write_text("WEBSITE,medialabel\nb.org,B\n")
    got = lookup_source.registry_files(spark, [str(tmp_path / "fr_news.csv"), str(tmp_path / "DE1.csv")])
    assert {(r["region"], r["medialabel"], r["website"]) for r in got.collect()} == {("FR", "Le A", "a.com"), ("DE", "B", "b.org")}


def test_stream_resumes_and_drops_late_rows(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "event_id long, ts timestamp, value double"

    def add(*events):
        df = spark.createDataFrame([(i, t, v) for i, t, v in events], "event_id long, ts string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.run_available(jobs.daily_tone(stream), out, mark)

    add((1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-01 12:00:00", 3.0), (3, "2024-01-04 00:00:00", 5.0))
    assert [(str(r["period"]), r["n_articles"], r["mean_tone"]) for r in run().collect()] == [("2024-01-01", 2, 2.0)]
    add((4, "2024-01-01 23:00:00", 100.0), (5, "2024-01-09 00:00:00", 1.0))
    got = {str(r["period"]): r["n_articles"] for r in run().collect()}
    assert got == {"2024-01-01": 2, "2024-01-04": 1}
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_stream_grows_its_dictionary(spark, tmp_path):
    from pressgauge.streaming import jobs

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.csv").write_text("\n".join([record(1), record(2, name="new.org"), record(3, name="")]))
    known = spark.createDataFrame([(7, "a.com")], "SourceCommonName_ID int, SourceCommonName string")
    run = lambda: jobs.ingest_available(
        jobs.raw_stream(spark, str(tmp_path / "raw")), known, str(tmp_path / "out"), str(tmp_path / "checkpoint")
    )
    articles, names = run()
    assert {(r["GKGRECORDID"], r["SourceCommonName_ID"]) for r in articles.collect()} == {("r1", 7), ("r2", 8), ("r3", 0)}
    (tmp_path / "raw" / "2.csv").write_text("\n".join([record(4, name="new.org"), record(5, name="other.net")]))
    articles, names = run()
    assert {(r["GKGRECORDID"], r["SourceCommonName_ID"]) for r in articles.collect()} >= {("r4", 8), ("r5", 9)}
    assert {tuple(r) for r in names.collect()} == {(7, "a.com"), (8, "new.org"), (9, "other.net")} and articles.count() == 5


def test_zip_stream(spark, tmp_path):
    import zipfile

    from pressgauge.streaming import jobs

    (tmp_path / "raw").mkdir()
    with zipfile.ZipFile(tmp_path / "raw" / "1.csv.zip", "w") as archive:
        archive.writestr("1.csv", "\n".join([record(1), record(2)]))
    none = spark.createDataFrame([], "SourceCommonName_ID int, SourceCommonName string")
    articles, names = jobs.ingest_available(
        jobs.zip_stream(spark, str(tmp_path / "raw")), none, str(tmp_path / "out"), str(tmp_path / "checkpoint")
    )
    assert articles.count() == 2 and names.count() == 1


def test_ingest_run_takes_a_file_once(spark, tmp_path):
    from pressgauge.plans.ingest import ingest_run, ingested

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.csv").write_text("\n".join([record(1), record(1), record(2, name="b.org")]))
    places = [str(tmp_path / p) for p in ("raw", "articles", "dictionary")]
    assert ingested(spark, places[1]) is None
    assert ingest_run(spark, *places).count() == 2
    assert ingest_run(spark, *places).count() == 0
    stored = ingested(spark, places[1])
    assert stored.count() == 2 and {(r["year"], r["month"]) for r in stored.collect()} == {(2020, 1)}


def test_ingest_run_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    """Bad dates and a stored month in every run, a zip file, and a run killed before its end."""
    from pressgauge.plans import ingest as plan

    (tmp_path / "raw").mkdir()
    places = [str(tmp_path / p) for p in ("raw", "articles", "dictionary")]

    def give(name, *ids):
        rows = [record(i, name=f"n{i}.org") for i in ids] + [record(100 + ids[0]).replace("2020010", "bad", 1)]
        if name.endswith(".zip"):
            with zipfile.ZipFile(tmp_path / "raw" / name, "w") as archive:
                archive.writestr("x.csv", "\n".join(rows))
        else:
            (tmp_path / "raw" / name).write_text("\n".join(rows))

    def ids():
        return sorted(r["GKGRECORDID"] for r in plan.ingested(spark, places[1]).collect())

    give("1.csv", 1, 2)
    plan.ingest_run(spark, *places)
    first = ids()
    assert len(first) == 3
    give("2.csv", 3)
    give("3.zip", 4, 5)
    with monkeypatch.context() as broken:  # killed after the articles, before the ledger
        broken.setattr(plan, "ledger_of", lambda path: (_ for _ in ()).throw(RuntimeError()) if sys._getframe(1).f_code.co_name == "ingest_run" else path.rstrip("/") + ".files")
        with pytest.raises(RuntimeError):
            plan.ingest_run(spark, *places)
    assert ids() == first
    plan.ingest_run(spark, *places)
    assert len(ids()) == 8 and len(set(ids())) == 8
    names = spark.read.parquet(places[2])
    assert names.count() == names.select("SourceCommonName_ID").distinct().count() == names.select("SourceCommonName").distinct().count()
    months = {(r["year"], r["month"]) for r in plan.ingested(spark, places[1]).select("year", "month").distinct().collect()}
    assert len(months) > 1


def test_large_dictionary_moves_only_nameless_articles(spark, monkeypatch):
    from pressgauge.operators import cleaning
    from pressgauge.operators.lookups import Lookup

    articles = spark.createDataFrame(
        [("r1", 3, "http://a.com/1"), ("r2", 0, "http://a.com/2"), ("r3", None, "http://none.com/3")],
        "GKGRECORDID string, SourceCommonName_ID int, DocumentIdentifier string",
    )
    names = spark.createDataFrame([(9, "a.com")], "SourceCommonName_ID int, SourceCommonName string")
    small = {tuple(r) for r in cleaning.with_source(articles, Lookup(names, 1), True).collect()}
    large = {tuple(r) for r in cleaning.with_source(articles, Lookup(names, 10**9), True).select(
        "GKGRECORDID", "DocumentIdentifier", "Src_ID").collect()}
    assert small == large and ("r2", "http://a.com/2", 9) in large


def test_staged_tables_end_with_their_block(spark, tmp_path):
    table = spark.range(10)
    with staging(spark) as outer:
        kept = stage(table, "a")
        with pytest.raises(ValueError):
            with staging(spark) as inner:
                assert stage(table, "b").count() == 10 and inner.startswith(outer)
                raise ValueError
        assert not Path(inner.removeprefix("file:")).exists()
        assert kept.count() == 10
        kept.write.parquet(f"{tmp_path}/out")
    assert not Path(outer.removeprefix("file:")).exists()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    assert "scope-" not in fresh_path(spark, "later")


def test_registry_run_takes_the_first_row_in_file_order(spark, tmp_path):
    header = "mediaLabel,typeLabel,countryLabel,inception,website\n"
    (tmp_path / "eu.csv").write_text(
        header + "Zeta,daily,A,1900,https://www.a.com/x\nAlpha,daily,B,1901,http://a.com\nSports X,daily,C,,http://b.com\n"
        "None,daily,D,,\n"
    )
    (tmp_path / "us.csv").write_text(header + "Gamma,,E,,news.a.com\nDelta,weekly,F,,unknown.net\n")
    names = measure(spark.createDataFrame([(1, "a.com"), (2, "b.com")], "SourceCommonName_ID int, SourceCommonName string"))
    suffixes = measure(spark.createDataFrame([("com",), ("net",)], "suffix string"))
    output = runs.OutputPaths(f"{tmp_path}/out")
    coverage = runs.registry_run(spark, [f"{tmp_path}/eu.csv", f"{tmp_path}/us.csv"], names, suffixes, output)
    assert [(r["region"], r["hosts"], r["matches"], r["rate"]) for r in coverage.collect()] == [
        ("EU", 1, 1, 100.0), ("US", 2, 1, 50.0)
    ]
    stored = spark.read.parquet(output.domains).orderBy("region").collect()
    assert [(r["region"], r["id"], r["medialabel"], r["typelabel"], r["inception"]) for r in stored] == [
        ("EU", "1", "Zeta", "daily", "1900"), ("US", "1", "Gamma", "", "")
    ]


def test_every_bucket_has_outlets(spark):
    from pressgauge.catalogue import load

    made = load().QUERIES
    volume = made["ag41_skewed_volume_buckets"](spark, "/root/testdata/sf0.01").collect()
    longevity = made["ag42_skewed_longevity_buckets"](spark, "/root/testdata/sf0.01").collect()
    assert len(volume) == 5 and len(longevity) == 6
    assert max(r["pct_volume"] for r in volume) > 30


def test_raw_input_is_packed_and_keeps_repeats_together(spark):
    from types import SimpleNamespace

    from pressgauge.catalogue import ingest_queries

    rows = [
        (f"i{n % 40}", "19980101000000" if n % 2 else "bad", 1, n % 3, f"https://a{n % 3}.com/x", "A,1", "1#X#US", "p", "o", 1.5, 11, "", n % 2)
        for n in range(80)
    ]
    schema = ("GKGRECORDID string, DATE string, SourceCollectionIdentifier tinyint, SourceCommonName_ID int, DocumentIdentifier string, "
              "EnhancedThemes string, EnhancedLocations string, Persons string, Organizations string, Tone double, WordCount int, "
              "TranslationInfo string, IsTranslingual tinyint")
    t = SimpleNamespace(spark=spark, gkg=spark.createDataFrame(rows, schema).repartition(5))
    records = ingest_queries.records(t)
    files = {r["file"] for r in records.select("file").distinct().collect()}
    assert files and all(f.endswith(".gz") for f in files)
    # 40 rows of 1998 come twice, 40 others once; of each id and file one stays.
    assert records.count() == 120
    assert ingest_queries.first_in_file(t).count() == 40


def test_articles_are_joined_as_text(spark, tmp_path):
    """The rows that the join of orders and lines sorts hold two texts and no lists of records."""
    from pressgauge.catalogue.tables import Tables

    given = {
        "lineitem": "SELECT 1L AS l_orderkey, id + 1 AS l_linenumber, id AS l_partkey, 1L AS l_suppkey, 4.0D AS l_quantity FROM range(2)",
        "part": "SELECT id AS p_partkey, 'red bolt' AS p_name, 'LARGE' AS p_type FROM range(2)",
        "supplier": "SELECT 1L AS s_suppkey, 3 AS s_nationkey",
        "nation": "SELECT 3 AS n_nationkey, 'X' AS n_name",
        "orders": "SELECT id + 1 AS o_orderkey, 2L AS o_custkey, timestamp'1997-01-02' AS o_orderdate, 'a' AS o_orderpriority, "
                  "'b' AS o_orderstatus, 1.0D AS o_totalprice FROM range(2)",
    }
    for name, text in given.items():
        spark.sql(text).write.parquet(str(tmp_path / f"{name}.parquet"))
    plan = Tables(spark, str(tmp_path)).articles_plan()
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in optimized[:optimized.index("Join LeftOuter")] and "array_join" in optimized
    got = {r["GKGRECORDID"][-1]: (r["EnhancedThemes"], r["EnhancedLocations"], r["WordCount"]) for r in plan.collect()}
    assert got == {"1": ("RED_BOLT,0;LARGE,1;RED_BOLT,1;LARGE,1", "1#X#N3;1#X#N3", 8), "2": (None, None, None)}
