"""Theme co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import columns as c
from pressgauge.operators.topk import first_per_group
from pressgauge.session import shared_folder


def theme_bags(articles: DataFrame) -> DataFrame:
    """Per article its distinct themes, each with its number of mentions.

    Built inside the row by sorting the keys; nothing is shuffled.
    """
    present = articles.filter(F.col("EnhancedThemes").isNotNull() & (F.col("EnhancedThemes") != ""))
    keys = F.transform(c.pieces(F.col("EnhancedThemes")), lambda p: c.raw_theme_key(F.trim(p)))
    rows = present.select("GKGRECORDID", c.year_text(F.col("DATE")).alias("year"), keys.alias("_k"))
    # Equal themes stand together once sorted: a count is the distance of two first places.
    rows = rows.withColumn("_k", F.array_sort("_k"))
    size = F.size("_k")
    new = F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | ~F.get("_k", i).eqNullSafe(F.get("_k", i - 1))
    )
    rows = rows.withColumn("_at", F.when(size > 0, new).otherwise(F.array().cast("array<int>")))
    bag = F.transform(
        "_at",
        lambda i, j: F.struct(
            F.get("_k", i).alias("theme"), (F.coalesce(F.get("_at", j + 1), size) - i).cast("long").alias("n")
        ),
    )
    return rows.select("GKGRECORDID", "year", bag.alias("bag"))


def cooccurrence(articles: DataFrame, more_than: int = 500) -> DataFrame:
    """Theme pairs named in the same article, per year: (year, src, dst, weight).

    Repeated mentions multiply, as in a self join of the mentions, but an
    article only forms the pairs of its distinct themes. They are streamed by
    two generators, never held as a list, and summed per task before the
    shuffle. No articles meet each other, so there is no hot group.

    The first generator is an outer one: for an inner one the optimizer infers
    a filter on the bag's size and moves it into the scan, with the bag's whole
    definition written into it, sort by sort.
    """
    left = theme_bags(articles).select("year", "bag", F.posexplode_outer("bag").alias("_i", "_l"))
    pairs = left.filter(F.col("_i").isNotNull()).select(
        "year", "_l", F.explode(F.slice("bag", F.col("_i") + 2, F.size("bag"))).alias("_r")
    )
    return (
        pairs.groupBy("year", F.col("_l.theme").alias("src"), F.col("_r.theme").alias("dst"))
        .agg(F.sum(F.col("_l.n") * F.col("_r.n")).alias("weight"))
        .filter(F.col("weight") > more_than)
    )


def strongest_edges(edges: DataFrame, k: int = 25) -> DataFrame:
    return first_per_group(edges, ["year"], [F.desc("weight"), F.col("src"), F.col("dst")], k)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges: (``node``, ``component``).

    Every node takes the smallest label among itself, its neighbours and its
    label's own label, until nothing changes. Labels only fall, so it ends.
    Each round is checkpointed, so the plan stays short and a lost executor
    costs one round at most.
    """
    shared_folder(edges.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = both.distinct().checkpoint()
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("_near"))
        )
        hopped = labels.join(near, "node").select(
            "node", "component", F.least("component", "_near").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_root"))
        nxt = hopped.join(jump, "_new", "left").select(
            "node", F.least("_new", "_root").alias("component"), (F.least("_new", "_root") != F.col("component")).alias("_moved")
        ).checkpoint()
        labels = nxt.select("node", "component")
        if nxt.filter("_moved").isEmpty():
            return labels
