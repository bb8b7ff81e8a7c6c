"""Structured Streaming jobs.

Each takes a streaming frame and returns one, so that source, sink and
trigger stay with the caller. ``run_available`` processes what has arrived
and stops; its checkpoint makes the next run continue from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions.columns import safe_ratio
from pressgauge.operators.ingest import encoded, grown_dictionary, typed_records, with_month
from pressgauge.operators.lookups import Lookup, lookup_join
from pressgauge.sinks.tables import stored
from pressgauge.sources.raw import raw_records, unpacked


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Process everything available, write Parquet, return the stored table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New raw text files as typed records, file by file."""
    lines = (
        spark.readStream.format("text")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    return typed_records(raw_records(lines))


def zip_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New zip archives as typed records; each is read line by line."""
    archives = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return typed_records(raw_records(unpacked(archives).drop("line_no")))


def dictionary_versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All names of a grown dictionary, or those known before a batch."""
    found = stored(spark, path)
    if found is None:
        return spark.createDataFrame([], "SourceCommonName_ID int, SourceCommonName string")
    kept = found if before is None else found.filter(F.col("batch") < before)
    return kept.select("SourceCommonName_ID", "SourceCommonName")


def ingest_available(
    records: DataFrame, dictionary: DataFrame, folder: str, checkpoint: str
) -> tuple[DataFrame, DataFrame]:
    """Ingest what has arrived, growing the dictionary: (articles, dictionary).

    Each micro-batch first stores its new names under its own number, then its
    articles with their ids. A batch that is repeated after a failure sees the
    names known before it and replaces both, so no name and no row is lost or
    doubled. ``dictionary`` holds the names known before the first batch.
    """
    names, articles = f"{folder}/dictionary", f"{folder}/articles"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = dictionary.select("SourceCommonName_ID", "SourceCommonName").unionByName(
            dictionary_versions(spark, names, number)
        )
        grown = grown_dictionary(known, batch)
        new = grown.frame.join(known.select("SourceCommonName_ID"), "SourceCommonName_ID", "left_anti")
        new.write.mode("overwrite").parquet(f"{names}/batch={number}")
        done = with_month(encoded(batch, grown)).drop("file")
        done.write.mode("overwrite").parquet(f"{articles}/batch={number}")

    query = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    spark = records.sparkSession
    known = dictionary.select("SourceCommonName_ID", "SourceCommonName").unionByName(dictionary_versions(spark, names))
    return spark.read.parquet(articles).drop("batch"), known


def event_stream(spark: SparkSession, folder: str, schema, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def without_repeats(stream: DataFrame, key: str, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First arrival of every id; ids are forgotten once the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_tone(stream: DataFrame, value: str = "value", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Count and mean per day, emitted once the day is closed."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_articles"), F.avg(value).alias("mean_tone"))
        .select(F.col("w.start").cast("date").alias("period"), "n_articles", "mean_tone")
    )


def moving_volume(stream: DataFrame, days: int = 30, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Mean daily volume of the last ``days`` days, for every day.

    A row belongs to ``days`` windows, so rows are first counted per day and
    only the day counts are spread over the windows.
    """
    per_day = (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.window_time("d").alias("day_time"), "n")
    )
    return (
        per_day.groupBy(F.window("day_time", f"{days} days", "1 day").alias("w"))
        .agg(F.sum("n").alias("volume"))
        .select(F.date_sub(F.col("w.end").cast("date"), 1).alias("period"), "volume")
    )


def daily_category_sums(
    stream: DataFrame,
    taxonomy: Lookup,
    theme: str = "theme",
    value: str = "tone",
    time: str = "ts",
    delay: str = "1 day",
) -> DataFrame:
    """Daily sums per sector and category, static taxonomy joined to the stream."""
    marked = stream.withWatermark(time, delay)
    matched = lookup_join(marked.withColumnRenamed(theme, "theme") if theme != "theme" else marked, taxonomy, ["theme"])
    return (
        matched.groupBy(F.window(time, "1 day").alias("w"), "sector", "cat_key")
        .agg(
            F.count(F.lit(1)).alias("N"),
            F.sum(value).alias("sum_t_cont"),
            F.sum(F.signum(value).cast("int")).alias("sum_t_bin"),
        )
        .select(
            F.col("w.start").cast("date").alias("period"),
            "sector",
            "cat_key",
            "N",
            "sum_t_cont",
            "sum_t_bin",
            safe_ratio(F.col("sum_t_cont"), F.col("N")).alias("sent_cont"),
        )
    )
