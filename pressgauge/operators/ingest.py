"""From raw record text to the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.operators.lookups import Lookup, lookup_join, stage_lookup
from pressgauge.operators.topk import first_per_group

# The marker of the translated stream and the text columns.
TRANSLATED = ".translation."
TEXT_COLUMNS = (
    "GKGRECORDID", "DATE", "DocumentIdentifier", "EnhancedThemes", "EnhancedLocations", "Persons", "Organizations",
    "TranslationInfo",
)


def tone_of(raw: Column) -> Column:
    """First part of the tone field; 0 when it is no number."""
    part = F.trim(F.get(F.split(raw, ","), F.lit(0)))
    return F.coalesce(part.try_cast("float"), F.lit(0.0).cast("float"))


def word_count_of(raw: Column) -> Column:
    """Seventh part of the tone field; 0 when missing or no number."""
    part = F.trim(F.get(F.split(raw, ","), F.lit(6)))
    return F.coalesce(part.try_cast("double").try_cast("int"), F.lit(0))


def collection_of(raw: Column) -> Column:
    return F.coalesce(F.trim(raw).try_cast("double").try_cast("tinyint"), F.lit(0).cast("tinyint"))


def is_translated(file: Column) -> Column:
    """1 for the translated stream, told by the file name (or its folder)."""
    return F.when(F.contains(file, F.lit(TRANSLATED)), 1).otherwise(0).cast("tinyint")


def typed_records(records: DataFrame) -> DataFrame:
    """Typed columns, missing text as ''."""
    typed = records.withColumns(
        {
            "Tone": tone_of(F.col("Tone_Raw")),
            "WordCount": word_count_of(F.col("Tone_Raw")),
            "SourceCollectionIdentifier": collection_of(F.col("SourceCollectionIdentifier")),
            "IsTranslingual": is_translated(F.col("file")),
        }
    ).drop("Tone_Raw")
    return typed.na.fill("", list(TEXT_COLUMNS))


def first_in_file(records: DataFrame) -> DataFrame:
    """First row of every id inside one file."""
    return first_per_group(records, ["file", "GKGRECORDID"], [F.col("line_no")])


def grown_dictionary(dictionary: DataFrame, names: DataFrame) -> Lookup:
    """Dictionary plus the new non-blank names, ids continuing from the largest.

    ``names`` has ``SourceCommonName``. Only names not yet known are numbered:
    they are sorted by range over many tasks, and a task's first id follows
    from the counts of the tasks before it. Known ids never change.
    """
    known = dictionary.select("SourceCommonName_ID", "SourceCommonName")
    fresh = (
        names.select("SourceCommonName")
        .filter(F.col("SourceCommonName").isNotNull() & (F.col("SourceCommonName") != ""))
        .distinct()
        .join(known.select("SourceCommonName"), "SourceCommonName", "left_anti")
    )
    # Stored first: both the counts and the numbering read the same split.
    placed = stage_lookup(
        fresh.repartitionByRange(F.col("SourceCommonName")).withColumn("_task", F.spark_partition_id()), "new-names"
    ).frame
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    # One row per task: a bounded window.
    before = counts.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_task", "_before")
    last = known.agg(F.coalesce(F.max("SourceCommonName_ID"), F.lit(0))).scalar()
    within = F.row_number().over(Window.partitionBy("_task").orderBy("SourceCommonName"))
    numbered = (
        placed.withColumn("_within", within)
        .join(F.broadcast(before), "_task")
        .select((last + F.col("_before") + F.col("_within")).cast("int").alias("SourceCommonName_ID"), "SourceCommonName")
    )
    return stage_lookup(known.unionByName(numbered), "dictionary")


def encoded(records: DataFrame, dictionary: Lookup) -> DataFrame:
    """Replace source names by their id; blank or unknown names give 0."""
    joined = lookup_join(records, dictionary, ["SourceCommonName"], "left", spread_by="GKGRECORDID")
    return joined.withColumn("SourceCommonName_ID", F.coalesce("SourceCommonName_ID", F.lit(0))).drop(
        "SourceCommonName"
    )


def with_month(articles: DataFrame) -> DataFrame:
    """Partition columns ``year`` and ``month`` from the record date; 0 if bad."""
    number = lambda start, length: F.coalesce(
        F.substring("DATE", start, length).try_cast("int"), F.lit(0)
    )
    return articles.withColumn("year", number(1, 4)).withColumn("month", number(5, 2))


def months_between(first: Column, last: Column) -> Column:
    """Month keys ``YYYYMM`` from one date to another."""
    days = F.sequence(F.trunc(first, "MM"), last, F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyyMM"))


def open_months(wanted: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Months still to do: with files, and not stored yet (all by ``month``)."""
    return wanted.join(files.select("month").distinct(), "month", "left_semi").join(
        stored.select("month").distinct(), "month", "left_anti"
    )


def ingest(records: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, Lookup]:
    """Raw records to articles, with the grown dictionary."""
    typed = first_in_file(typed_records(records))
    grown = grown_dictionary(dictionary, records.select("SourceCommonName"))
    return with_month(encoded(typed, grown)).drop("file", "line_no"), grown
