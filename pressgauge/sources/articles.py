"""Scans of the stored article table and of stored indicator tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def article_scan(spark: SparkSession, path: str) -> DataFrame:
    """All months of the article table."""
    return spark.read.parquet(path)


def article_years(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """Only the chosen years, by partition pruning; an error if there are none."""
    chosen = spark.read.parquet(path)
    if years:
        chosen = chosen.filter(F.col("year").isin([int(y) for y in years]))
    if chosen.isEmpty():
        raise ValueError(f"no articles for {years or 'any year'} in {path}")
    return chosen


def united_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored tables with differing columns as one; missing columns are NULL."""
    frames = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def macro_series(spark: SparkSession, path: str) -> DataFrame:
    """Monthly series (``period``, ``region_key``, ``value``) from Parquet."""
    return spark.read.parquet(path).select(
        F.to_date("period").alias("period"), "region_key", F.col("value").cast("double").alias("value")
    )


def macro_by_ticker(series: DataFrame, tickers: dict[str, str]) -> DataFrame:
    """Series stored by ``ticker`` as one series per region.

    Several regions may share a ticker; the map is a small configuration.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(t).alias("t")) for r, t in tickers.items()]))
    return (
        series.withColumn("_p", pairs)
        .filter(F.col("_p.t") == F.col("ticker"))
        .select("period", F.col("_p.r").alias("region_key"), "value")
    )


# The macro ticker of every region.
MACRO_TICKERS = {
    "US": "CPIAUCSL",
    "European Union": "CP0000EZ19M086NEST",
    "France": "CP0000FRM086NEST",
    "China": "CHNCPIALLMINMEI",
    "Japan": "CPALCY01JPM661N",
    "India": "INDCPIALLMINMEI",
    "Africa": "ZAFCPIALLMINMEI",
    "Russia": "RUSCPIALLMINMEI",
    "Middle East": "ISRCPIALLMINMEI",
    "North America": "CANCPALTT01IXOBSAM",
    "South America": "BRACPIALLMINMEI",
    "South East Asia": "IDNCPIALLMINMEI",
}
