"""Writers of article, indicator, lookup and export tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 500_000


def write_articles(articles: DataFrame, path: str, mode: str = "append", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Monthly Parquet folders, zstd, bounded files.

    Adaptive execution splits a large month among as many tasks as its size
    asks for and leaves a small one to one task.
    """
    (
        articles.hint("rebalance", "year", "month")
        .write.mode(mode)
        .partitionBy("year", "month")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def write_indicators(indicators: DataFrame, path: str) -> None:
    """One folder per sector and year; only the written ones are replaced."""
    (
        indicators.withColumn("year", F.year("period"))
        .repartition("sector", "year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sector", "year")
        .parquet(path)
    )


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def kept_or_computed(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """Reuse a stored table; compute and store it when missing or forced."""
    found = None if force else stored(spark, path)
    if found is None:
        compute().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def write_domains(domains: DataFrame, path: str) -> None:
    """Matched domains, one folder per region."""
    domains.write.mode("overwrite").partitionBy("region").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("sep", ";").option("header", "true").csv(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """JSON lines of (id, name): one table in place of two mirrored maps."""
    dictionary.select(F.col("SourceCommonName_ID").alias("id"), F.col("SourceCommonName").alias("name")).write.mode(
        "overwrite"
    ).json(path)


def write_kept(table: DataFrame, path: str, helpers: tuple[str, ...] = ()) -> None:
    """Export without helper columns."""
    table.drop(*helpers).write.mode("overwrite").parquet(path)
