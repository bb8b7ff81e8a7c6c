"""Limits, top-k, draws per group and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions import columns as c


def top_counts(values: DataFrame, by: list[str], k: int, count_name: str = "n") -> DataFrame:
    """The ``k`` most frequent values; ties broken by the value itself."""
    counts = values.groupBy(*by).agg(F.count(F.lit(1)).alias(count_name))
    return counts.orderBy(F.desc(count_name), *by).limit(k)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per group.

    Spark limits every task's rows to ``n`` per group before the shuffle, so a
    group holding a third of all rows sends only ``n`` rows per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def draw_per_group(df: DataFrame, group: list[str], n: int, key: str, seed: int | None = None) -> DataFrame:
    """``n`` random rows per group: by ``seed``, or repeatably by md5 of ``key``."""
    order = F.rand(seed) if seed is not None else c.portable_draw(F.col(key))
    return first_per_group(df.withColumn("_draw", order), group, [F.col("_draw"), F.col(key)], n).drop("_draw")


def sample_rows(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """``n`` random rows of the whole table."""
    order = F.rand(seed) if seed is not None else c.portable_draw(F.col(key))
    return df.withColumn("_draw", order).orderBy("_draw", key).limit(n).drop("_draw")


def one_per_key(df: DataFrame, keep: list[str], key: str) -> DataFrame:
    """Project and keep one row per key."""
    return df.select(*keep).dropDuplicates([key])


def joined_names(values: DataFrame, group: list[str], name: str, alias: str, separator: str = ", ") -> DataFrame:
    """Names of a group as one text, in name order (for drawn, thus few, rows)."""
    return values.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(name)), separator).alias(alias))
