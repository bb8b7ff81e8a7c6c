"""The article model expressed on the given star-schema tables.

One order is one article: its line items give themes and locations, the
customer gives the source. Every table is computed from the given data, so
it grows with it. The article table is stored once per session and scale,
as the ingest would have stored it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators import cleaning, registry
from pressgauge.operators import indicators as ind
from pressgauge.operators.lookups import Lookup, lookup_join, stage_lookup
from pressgauge.session import enough_partitions, stage

_OPEN: dict[tuple[str, str], "Tables"] = {}


def tables(spark: SparkSession, sf_dir: str) -> "Tables":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def supplied(self, suppliers: DataFrame) -> DataFrame:
        """Lines beside columns of their supplier; the lines move only beside more suppliers than can be broadcast."""
        listed = suppliers.withColumnRenamed("s_suppkey", "l_suppkey")
        return lookup_join(self.read("lineitem"), listed, ["l_suppkey"], spread_by="l_orderkey")

    def articles_plan(self) -> DataFrame:
        """The article table, computed."""
        places = self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        lines = (
            self.supplied(places.select("s_suppkey", "s_nationkey", "n_name"))
            .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "l_orderkey",
                "l_quantity",
                F.struct(
                    "l_linenumber",
                    "l_partkey",
                    "l_suppkey",
                    F.concat(
                        F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(","), F.col("l_partkey"),
                        F.lit(";"), F.col("p_type"), F.lit(","), F.col("l_suppkey"),
                    ).alias("themes"),
                    F.concat(F.lit("1#"), "n_name", F.lit("#N"), "s_nationkey").alias("place"),
                ).alias("line"),
            )
        )
        texts = lines.groupBy("l_orderkey").agg(
            F.array_sort(F.collect_list("line")).alias("lines"), F.sum("l_quantity").cast("int").alias("WordCount")
        )
        # Joined as text first: the rows that the next join sorts hold no lists of records.
        texts = texts.select(
            "l_orderkey",
            F.array_join(F.transform("lines", lambda x: x["themes"]), ";").alias("EnhancedThemes"),
            F.array_join(F.transform("lines", lambda x: x["place"]), ";").alias("EnhancedLocations"),
            "WordCount",
        )
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        digits = F.date_format("o_orderdate", "yyyyMMddHHmmss")
        return (
            self.read("orders")
            .join(texts, key == F.col("l_orderkey"), "left")
            .select(
                F.concat(digits, F.lit("-"), key).alias("GKGRECORDID"),
                F.when(key % 97 == 0, "bad").otherwise(digits).alias("DATE"),
                F.when(key % 7 == 0, 2).otherwise(1).cast("tinyint").alias("SourceCollectionIdentifier"),
                F.when(key % 20 == 0, F.lit(0)).otherwise(customer % 50 + 1).cast("int").alias("SourceCommonName_ID"),
                F.concat(F.lit("https://www.src"), customer % 53, F.lit(".example.com/a/"), key).alias(
                    "DocumentIdentifier"
                ),
                "EnhancedThemes",
                "EnhancedLocations",
                F.when(key % 11 == 0, "")
                .otherwise(F.concat(F.lit("Person "), customer % 100, F.lit("; Person "), customer % 7))
                .alias("Persons"),
                F.when(key % 13 == 0, "")
                .otherwise(F.concat("o_orderpriority", F.lit(";"), "o_orderstatus"))
                .alias("Organizations"),
                F.when(key % 3 == 0, "srclc:fra").otherwise("").alias("TranslationInfo"),
                F.when(key % 3 == 0, 1).otherwise(0).cast("tinyint").alias("IsTranslingual"),
                ((F.round(F.col("o_totalprice") * 100).cast("long") % 2001 - 1000) / 100.0)
                .cast("double")
                .alias("Tone"),
                "WordCount",
            )
        )

    @cached_property
    def gkg(self) -> DataFrame:
        with enough_partitions(self.spark, self.read("lineitem").count()):
            return stage(self.articles_plan(), "articles")

    @cached_property
    def skewed(self) -> DataFrame:
        """Articles of outlets whose volume falls like 1 / rank; the first outlet has a third of all rows.

        The number of outlets grows with ``customer``. Every second article is six years younger.
        """
        key = F.col("o_orderkey")
        level = F.floor(key / 3) % 12
        outlet = F.when(key % 3 == 0, F.lit(1)).otherwise(2 + F.floor(F.col("o_custkey") / F.pow(F.lit(2.0), level)))
        moved = F.add_months("o_orderdate", (key % 2 * 72).cast("int"))
        digits = F.date_format(moved, "yyyyMMddHHmmss")
        return stage(
            self.read("orders").select(
                F.concat(digits, F.lit("-"), key).alias("GKGRECORDID"),
                F.when(key % 97 == 0, "bad").otherwise(digits).alias("DATE"),
                F.when(key % 20 == 0, F.lit(0)).otherwise(outlet).cast("int").alias("SourceCommonName_ID"),
                F.concat(F.lit("https://www.outlet"), outlet, F.lit(".example.com/a/"), key).alias("DocumentIdentifier"),
            ),
            "skewed-articles",
        )

    @cached_property
    def outlets(self) -> Lookup:
        """Names of the outlets of ``skewed``."""
        levels = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("level")
        ids = self.read("customer").select("c_custkey", levels).select(
            (2 + F.floor(F.col("c_custkey") / F.pow(F.lit(2.0), F.col("level")))).cast("int").alias("id")
        )
        ids = ids.unionByName(self.read("customer").select(F.lit(1).alias("id"))).distinct()
        name = F.concat(F.lit("outlet"), "id", F.lit(".example.com"))
        return stage_lookup(ids.select(F.col("id").alias("SourceCommonName_ID"), name.alias("SourceCommonName")), "outlets")

    @cached_property
    def dictionary(self) -> Lookup:
        k = F.col("c_custkey") % 50
        names = self.read("customer").select(
            (k + 1).cast("int").alias("SourceCommonName_ID"),
            F.concat(F.lit("src"), k, F.lit(".example.com")).alias("SourceCommonName"),
        )
        return stage_lookup(names.distinct().coalesce(1), "dictionary")

    @cached_property
    def taxonomy(self) -> Lookup:
        first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
        theme = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
        part = self.read("part").select("p_name", "p_type").distinct()

        def rows(sector, category, theme, keep):
            return part.filter(keep).select(
                F.lit(sector).alias("sector"), category.alias("cat_key"), theme.alias("theme")
            )

        kind = F.col("p_type")
        entries = (
            rows("goods", second, theme, second.isin("bolt", "gear", "ring", "rod"))
            .unionByName(rows("colour", first, theme, first.isin("red", "blue")))
            .unionByName(rows("colour", F.lit("econ"), kind, kind == "ECONOMY"))
            .unionByName(
                rows(
                    "scale",
                    F.when(kind == "ECONOMY", "econ").otherwise("size"),
                    kind,
                    kind.isin("ECONOMY", "LARGE", "SMALL"),
                )
            )
        )
        return stage_lookup(entries.distinct().coalesce(1), "taxonomy")

    @cached_property
    def regions(self) -> Lookup:
        codes = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        code = F.concat(F.lit("N"), "n_nationkey").alias("country_code")
        extra = codes.filter(F.col("n_nationkey") % 3 == 0).select(F.lit("THIRD").alias("region_key"), code)
        return stage_lookup(
            codes.select(F.col("r_name").alias("region_key"), code).unionByName(extra).coalesce(1), "regions"
        )

    @cached_property
    def whitelist(self) -> Lookup:
        """Sources that pass the rules on the filtered articles."""
        base = cleaning.base_articles(self.gkg, self.dictionary)
        return stage_lookup(cleaning.whitelist(base), "whitelist")

    @cached_property
    def lasting(self) -> Lookup:
        """Sources active in at least two years, counted on themed articles."""
        inter = cleaning.with_source(cleaning.themed(cleaning.dated(self.gkg)), self.dictionary)
        return stage_lookup(cleaning.whitelist(inter, 1, 2), "lasting")

    @cached_property
    def registered(self) -> Lookup:
        return stage_lookup(registry.one_per_source(self.domains), "registered")

    @cached_property
    def regional_indicators(self) -> DataFrame:
        """Long regional indicators, stored as the regional run leaves them."""
        with enough_partitions(self.spark, self.gkg.count()):
            return stage(ind.regional_indicators(self.clean, self.taxonomy, self.regions), "regional-indicators")

    @property
    def base(self) -> DataFrame:
        return cleaning.base_articles(self.gkg, self.dictionary)

    @property
    def clean(self) -> DataFrame:
        return cleaning.clean_articles(self.gkg, self.dictionary, self.whitelist)

    @property
    def domains(self) -> DataFrame:
        """Media registry rows per source id, several for most ids; all text."""
        k = F.col("c_custkey")
        return self.read("customer").select(
            (k % 30 + 1).cast("string").alias("id"),
            F.concat(F.lit("src"), k % 30, F.lit(".example.com")).alias("domain"),
            F.col("c_name").alias("medialabel"),
            F.col("c_mktsegment").alias("typelabel"),
            F.concat(F.lit("NATION_"), "c_nationkey").alias("countrylabel"),
            F.when(k % 4 == 0, "").otherwise((k + 1900).cast("string")).alias("inception"),
        )

    @property
    def registry(self) -> DataFrame:
        """Registry rows as collected, web addresses in several spellings."""
        k = F.col("c_custkey")
        host = F.concat(F.when(k % 5 == 0, "news.").otherwise(""), F.lit("src"), k % 70, F.lit(".example.com"))
        return self.read("customer").select(
            F.element_at(F.array(F.lit("EU"), F.lit("US"), F.lit("AS")), (F.col("c_nationkey") % 3 + 1)).alias("region"),
            F.concat("c_name", F.when(k % 10 == 3, " University").when(k % 10 == 7, " Daily SPORTS").otherwise("")).alias(
                "medialabel"
            ),
            F.col("c_mktsegment").alias("typelabel"),
            F.concat(F.lit("NATION_"), "c_nationkey").alias("countrylabel"),
            F.when(k % 4 == 0, None).otherwise((k + 1900).cast("string")).alias("inception"),
            F.when(k % 4 == 0, F.concat(F.lit("https://www."), host, F.lit("/")))
            .when(k % 4 == 1, F.concat(F.lit(" "), host, F.lit("/p")))
            .when(k % 4 == 2, F.concat(F.lit("www."), host, F.lit(":8080/p")))
            .otherwise(F.concat(F.lit("http://WWW."), host))
            .alias("website"),
        )

    @cached_property
    def suffixes(self) -> Lookup:
        rows = [("com",), ("net",), ("org",), ("example.com",), ("example.net",), ("example.org",), ("co.uk",)]
        return Lookup(self.spark.createDataFrame(rows, "suffix string"), len(rows))

    @property
    def daily(self) -> DataFrame:
        """Orders per day with their mean tone: (day, n_articles, tone)."""
        tone = (F.round(F.col("o_totalprice") * 100).cast("long") % 2001 - 1000) / 100.0
        return (
            self.read("orders")
            .groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.count(F.lit(1)).alias("n_articles"), F.avg(tone).alias("tone"))
        )

    @property
    def macro(self) -> DataFrame:
        """Monthly value per supplier region: (region_key, period, value)."""
        named = (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        return (
            self.supplied(named.select("s_suppkey", "r_name"))
            .groupBy(F.col("r_name").alias("region_key"), F.trunc("l_shipdate", "MM").alias("period"))
            .agg(F.sum("l_extendedprice").alias("value"))
        )

    @property
    def market(self) -> DataFrame:
        """Trading days with a price: (day, price)."""
        return (
            self.read("orders")
            .filter(F.weekday("o_orderdate") < 5)
            .groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.avg("o_totalprice").alias("price"))
        )
