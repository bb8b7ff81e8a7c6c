"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; ``component`` is the smallest node reachable.

    ``links`` has two columns of node numbers. Every step hangs nodes on a
    smaller neighbour, so it ends, after a number of steps that grows with the
    logarithm of the longest chain. Minima are combined before they are
    shuffled; each step is written, so a lost executor costs one step.
    """
    a, b = (F.col(c) for c in links.columns)
    links = links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    links = stage(links, "links")
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before or now[0] == 0:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = now
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        lower = large.join(lowest, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = stage(lower.unionByName(lowest.withColumnRenamed("m", "lo")).distinct(), "links")
