"""Mixing sources to target weights by Pareto order sampling.

1. Targets. Each source gets its weight's share of the budget, at most
   ``max_copies`` times its own size; the excess goes to the others by weight.
2. Expected copies. Within a source, a document is expected
   ``e = min(max_copies, k * w)`` times, ``w`` its inclusion weight and ``k``
   such that the expected words meet the target.
3. Whole copies. ``floor(e)`` copies are certain.
4. Pareto order sampling of the rest. With ``p = e - floor(e)`` and a uniform
   number ``u`` drawn from the document's id, documents are ranked by
   ``(u / (1 - u)) / (p / (1 - p))`` and taken until the words that the whole
   copies left open are reached, to within half a document.

Sums are of integers, so reruns agree. A source may hold most of the rows:
sums are combined before they are shuffled, and the ranking is cut in
``RANKS`` strips of the score, of which windows order only one at a time.

Defined results: null text has size 0; a null source is one source, last in
order; repeated rows are rows of their own; documents of size 0 take 0 words;
an empty table gives no rows; other columns are ignored by ``mix`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import n_words, query, stage, table

RANKS = 1024
SCALE = 1000


def _filled(rows: DataFrame, group: list[str], cap: Column, share: Column, amount: Column) -> DataFrame:
    """Share ``amount`` by ``share`` among the rows of a group, none above its ``cap``: adds ``level``.

    A row receives ``min(cap, level * share)``. Rows fill up in the order of
    ``cap / share``; the level is that of the first that does not, the largest from there on.
    """
    rows = rows.withColumns({"_cap": cap.cast("decimal(38,0)"), "_share": share.cast("decimal(38,0)")})
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy((F.col("_cap").cast("double") / F.col("_share").cast("double")).asc_nulls_first(), "_share")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(ahead), F.lit(0)).cast("double")

    level = (amount.cast("double") - before("_cap")) / (F.sum("_share").over(whole).cast("double") - before("_share"))
    rows = rows.withColumn("_level", level)
    short = F.col("_level") * F.col("_share").cast("double") < F.col("_cap").cast("double")
    return rows.withColumn("level", F.max(F.when(short, F.col("_level"))).over(whole)).drop("_level", "_cap", "_share")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, max_copies: int) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    pattern = F.array(*[F.lit(w) for w in weights])
    rows = per_source.withColumn("weight", F.element_at(pattern, (rank - 1) % len(weights) + 1)).withColumn(
        "budget", F.sum("source_size").over(everything) * (percent / 100)
    )
    cap = F.col("source_size") * max_copies
    rows = _filled(rows.withColumn("one", F.lit(0)), ["one"], cap, F.col("weight"), F.col("budget"))
    target = F.coalesce(F.least(cap.cast("double"), F.col("level") * F.col("weight")), cap.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    max_copies: int = 2,
    inclusion: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, text_key) of every document.

    ``inclusion`` is the inclusion weight as a column of ``doc_id``, ``source``
    and ``size`` (1 if not given); it is used in thousandths.
    """
    weight = F.lit(1.0) if inclusion is None else inclusion
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = documents.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("text_key"))
    sizes = sizes.withColumns({
        "w": F.greatest(F.round(weight * SCALE).cast("long"), F.lit(1)),
        "u": (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52),
    })
    sizes = stage(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, percent, max_copies)

    same = F.col("source").eqNullSafe(F.col("s"))
    levels = sizes.groupBy("source", "w").agg(F.sum("size").alias("size")).filter("size > 0")
    levels = levels.join(targets.withColumnRenamed("source", "s"), same).drop("s")
    heavy = F.col("w").cast("decimal(20,0)") * F.col("size").cast("decimal(18,0)")
    levels = _filled(levels, ["source"], F.col("size") * max_copies, heavy, F.col("target"))
    levels = levels.groupBy("source").agg(F.max("level").alias("level"))
    plan = targets.join(levels.withColumnRenamed("source", "s"), same, "left").drop("s")

    top = F.lit(float(max_copies))
    expected = F.when(F.col("target") >= F.col("source_size") * max_copies, top).otherwise(
        F.least(top, F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"))
    )
    # Stored, so that Spark knows its size and decides by that whether to send it to every executor.
    plan = stage(plan.withColumnRenamed("source", "s"), "mix-plan")
    docs = sizes.join(plan, same).drop("s")
    docs = docs.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    part = F.col("expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / (part / (1 - part))
    docs = docs.withColumn("q", F.when(part > 0, odds)).withColumn("q", F.col("q") / (1 + F.col("q")))
    # Documents without a draw need no order: they are dealt evenly.
    aside = F.lit(RANKS) + F.pmod("text_key", F.lit(RANKS)).cast("int")
    docs = docs.withColumn("strip", F.coalesce(F.floor(F.col("q") * RANKS).cast("int"), aside))

    strips = docs.groupBy("source", "strip", "target").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain")
    )
    by_source = Window.partitionBy("source")
    earlier = by_source.orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select(
        F.col("source").alias("s"),
        F.col("strip").alias("b"),
        (F.col("target") - F.sum("certain").over(by_source)).alias("open"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"),
    )
    strips = stage(strips, "mix-strips")
    docs = docs.join(strips, same & (F.col("strip") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "strip").orderBy("q", "doc_id", "size", "text_key")
    ahead = F.col("before") + F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    drawn = F.col("q").isNotNull() & (ahead + F.col("size") / 2 <= F.col("open"))
    copies = F.col("whole") + drawn.cast("long")
    return docs.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        "text_key",
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in their own columns."""
    names = documents.columns
    taken = mix(documents, **options).filter("copies > 0").groupBy("doc_id", "source", "text_key").agg(
        F.max("copies").alias("copies"), F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("rows")
    )
    left, right = documents.alias("l"), taken.alias("r")
    joined = left.join(
        right,
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        & F.col("l.source").eqNullSafe(F.col("r.source"))
        & (F.xxhash64("l.text") == F.col("r.text_key")),
    )
    # The row is one column while it is repeated: no name of a helper can clash with its columns.
    whole = F.struct(*[F.col(f"l.`{n}`") for n in names]).alias("row")
    return joined.select(whole, F.explode(F.sequence(F.lit(1), F.col("r.copies").cast("int")))).select("row.*")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
docs AS (
  SELECT *, greatest(CAST(round(sqrt(size) * 1000) AS BIGINT), 1) AS w,
    (CAST(CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM sizes),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    sum(source_size) OVER () * 1.5 AS budget FROM per),
fill AS (
  SELECT *, (budget - coalesce(sum(2 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv
  FROM weighted
  WINDOW o AS (ORDER BY 2.0 * source_size / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, max(CASE WHEN lv * weight < 2 * source_size THEN lv END) OVER () AS level FROM fill),
targets AS (
  SELECT source, source_size, CAST(coalesce(least(2.0 * source_size, level * weight), 2.0 * source_size) AS DOUBLE) AS target
  FROM lev),
kinds AS (
  SELECT d.source, d.w, CAST(sum(size) AS HUGEINT) AS size, any_value(t.target) AS target
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, d.w HAVING sum(size) > 0),
klev AS (
  SELECT *, (target - CAST(coalesce(sum(2 * size) OVER o, 0) AS DOUBLE))
    / (CAST(sum(w * size) OVER (PARTITION BY source) AS DOUBLE) - CAST(coalesce(sum(w * size) OVER o, 0) AS DOUBLE)) AS lv
  FROM kinds
  WINDOW o AS (PARTITION BY source ORDER BY 2.0 * size / (w * size), w * size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT source, max(CASE WHEN lv * CAST(w * size AS DOUBLE) < 2 * size THEN lv END) AS level FROM klev GROUP BY source),
plan AS (
  SELECT d.doc_id, d.source, d.size, d.w, d.u, t.source_size, t.target,
    CASE WHEN t.target >= 2 * t.source_size THEN 2.0 ELSE least(2.0, coalesce(k.level, 0) * d.w) END AS e
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
parts AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p FROM plan),
odds AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS o FROM parts),
ranked AS (
  SELECT *, o / (1 + o) AS q, sum(size * whole) OVER (PARTITION BY source) AS certain FROM odds),
drawn AS (
  SELECT *, whole + CASE WHEN q IS NOT NULL AND coalesce(sum(size) OVER r, 0) + size / 2 <= target - certain THEN 1 ELSE 0 END AS copies
  FROM ranked
  WINDOW r AS (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM drawn
"""


@query("op8_mix_sources", OP8_SQL)
def op8_mix_sources(spark, sf_dir):
    """The mix of all documents; longer documents have the larger inclusion weight."""
    documents = table(spark, sf_dir, "documents")
    mixed = mix(documents, inclusion=F.sqrt(F.col("size").cast("double")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
