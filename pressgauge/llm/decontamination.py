"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, weighted shingles.

A document leaks an item if one of its windows of the item's number of words
(cut at the ends of the text) has a weighted Jaccard similarity of 5-word
shingles of at least ``percent`` with it: shingles count as often as they occur.

1. A window of ``m`` shingles, cut or not, needs ``percent`` of ``m`` places with
   a shingle of an item of its size, a whole one 2 percent / (100 + percent) of
   them. Every window with so many is looked at, wherever the item has the
   shingles: the others cannot reach the similarity. The item table is joined by
   its shingles, sent to all executors only if Spark knows it to be small.
2. Each window and item gets a 64-bit SimHash. ``radius`` + 1 blocks of its
   bits are keys: fingerprints within the radius agree in a block at least.
   Windows meet items of their size by (size, block, value).
3. Pairs within the radius are verified on the shingles themselves.

The radius is far out: at the similarity of 0.8 the expected distance is 9.7
bits with a deviation of 2.9, so 22 bits leave less than one in 10,000 behind,
and exact copies have distance 0. Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased.

Defined results: null texts and texts or items of fewer than 5 words match
nothing; items of equal text are found each; repeated rows are found each once;
null ids are kept as ids; empty tables give no rows; other columns are ignored.
All steps are DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import WORD, query, stage, table

SHINGLE = 5


def _shingled(df: DataFrame) -> DataFrame:
    """Adds ``shingles``, hashes of every 5 successive words, and ``n``, the number of words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def made(w: Column) -> Column:
        places = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE))
        five = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.struct(F.coalesce(five, F.array().cast("array<bigint>")).alias("shingles"), F.size(w).alias("n"))

    # Bound to a variable, the words are made once for each text and not once for each place.
    bound = df.withColumn("_s", F.transform(F.array(hashed), made))
    return bound.withColumn("_s", F.explode("_s")).select(*df.columns, "_s.shingles", "_s.n")


def _simhash(shingles: str) -> Column:
    """64 bits, each by the majority of the shingles."""
    return F.expr(f"""aggregate(sequence(0, 63), 0L, (h, b) -> h | if(
        aggregate({shingles}, 0, (c, s) -> c + if((shiftright(s, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L))""")


def _blocks(radius: int) -> Column:
    """(block, value) of each of the radius + 1 blocks of ``simhash``."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("block"),
            F.expr(f"shiftrightunsigned(simhash, {a}) & {(1 << (b - a)) - 1}L").alias("value"),
        )
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]))


def _least(above: str, below: str) -> str:
    """SQL for the least number of places of a window of n words: above / below of its shingles, 1 at least."""
    return f"greatest(cast(ceil(({above}) * (n - {SHINGLE - 1}) / ({below})) as int), 1)"


def _starts(least: str) -> str:
    """SQL for all starts, each once, of windows of n words that hold ``least`` of the sorted ``places``."""
    last = f"places[i + {least} - 1]"
    begin = f"greatest({last} - (n - {SHINGLE}), if(i > 0, places[i - 1] + 1, {last} - (n - {SHINGLE})))"
    return f"""flatten(transform(
        filter(sequence(0, size(places) - 1), i -> i + {least} <= size(places) and {last} - places[i] <= n - {SHINGLE}),
        i -> sequence({begin}, places[i])))"""


_SHARED = """aggregate(array_distinct(ws), 0, (c, x) -> c + least(
    size(filter(ws, y -> y = x)), size(filter(item_shingles, y -> y = x))))"""


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 22) -> DataFrame:
    """(doc_id, text_key, item_id, first_word, shared, total) of the best window of each document and item.

    ``shared / total`` is the similarity; of equal windows the first counts.
    """
    items = benchmark.select("item_id", "text").distinct()
    items = _shingled(items).filter(F.size("shingles") > 0)
    items = items.withColumn("simhash", _simhash("shingles")).select("item_id", "n", "shingles", "simhash")
    items = stage(items, "benchmark-items")
    seeds = items.select("n", F.explode("shingles").alias("shingle")).distinct()
    seeds = stage(seeds.coalesce(1), "benchmark-seeds")

    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = _shingled(docs).select("doc_id", "text_key", F.posexplode("shingles").alias("place", "shingle"))
    hits = found.join(seeds, "shingle").groupBy("doc_id", "text_key", "n").agg(F.sort_array(F.collect_set("place")).alias("places"))
    hits = hits.withColumn("least", F.expr(_least(f"{percent}", "100")))
    hits = hits.withColumn("most", F.expr(_least(f"2 * {percent}", f"100 + {percent}")))
    # Cut windows need fewer places than whole ones, but stand at the ends of a text only.
    starts = hits.select(
        "doc_id", "text_key", "n", F.expr(_starts("most")).alias("whole"), F.expr(_starts("least")).alias("any"),
    ).filter(F.size("any") > 0)
    starts = starts.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("n", "whole", "any")).alias("wanted"))
    starts = stage(starts, "benchmark-windows")

    s = starts.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    held = docs.alias("d").join(s, same).select("d.doc_id", "d.text_key", "d.text", "s.wanted")
    held = _shingled(held).select("doc_id", "text_key", "shingles", F.explode("wanted").alias("w"))
    end = f"size(shingles) - (w.n - {SHINGLE - 1})"
    kept = F.expr(f"""concat(filter(w.whole, a -> a >= 0 and a <= {end}), filter(w.any, a -> a < 0 or a > {end}))""")
    held = held.withColumn("first", F.explode(kept))
    windows = held.select(
        "doc_id", "text_key", F.greatest("first", F.lit(0)).alias("first_word"), F.col("w.n").alias("n"), F.expr(
            f"slice(shingles, greatest(first, 0) + 1, greatest(first + w.n - {SHINGLE - 1} - greatest(first, 0), 0))"
        ).alias("ws"),
    ).filter(F.size("ws") > 0)
    windows = stage(windows.withColumn("simhash", _simhash("ws")), "benchmark-hashed")

    keyed = windows.select("*", _blocks(radius).alias("k")).select("*", "k.block", "k.value").drop("k")
    item_keys = items.select(
        "item_id", "n", F.col("shingles").alias("item_shingles"), F.col("simhash").alias("item_hash"),
        _blocks(radius).alias("k"),
    ).select("item_id", "n", "item_shingles", "item_hash", "k.block", "k.value")
    near = keyed.join(item_keys, ["n", "block", "value"])
    # A pair that agrees in several blocks is taken at the first of them.
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    first_block = F.coalesce(*[
        F.when(F.expr(f"(shiftrightunsigned(simhash ^ item_hash, {a}) & {(1 << (b - a)) - 1}L) = 0"), i)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ])
    near = near.filter((F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))) <= radius) & (F.col("block") == first_block))
    judged = near.withColumn("shared", F.expr(_SHARED)).withColumn(
        "total", F.size("ws") + F.size("item_shingles") - F.col("shared")
    )
    good = judged.filter(100 * F.col("shared") >= percent * F.col("total"))
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("s"), (-F.col("first_word")).alias("f"), "shared", "total"))
    return good.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select(
        "doc_id", "text_key", "item_id", (-F.col("b.f")).cast("long").alias("first_word"),
        F.col("b.shared").cast("long").alias("shared"), F.col("b.total").cast("long").alias("total"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, in their own columns."""
    found = stage(leaks(documents, benchmark, **options).select("doc_id", "text_key").distinct(), "benchmark-leaks")
    d, f = documents.alias("d"), found.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_key"))
    return d.join(f, same, "left_anti")


OP6_SQL = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, [array_to_string(w[i:i+4], chr(1)) for i in range(1, len(w) - 3)] AS s FROM it WHERE len(w) >= 5),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
docs AS (SELECT doc_id, [array_to_string(w[i:i+4], chr(1)) for i in range(1, len(w) - 3)] AS s FROM dw WHERE len(w) >= 5),
de AS (SELECT doc_id, unnest(s) AS sh, generate_subscripts(s, 1) - 1 AS p FROM docs),
ie AS (SELECT item_id, n, unnest(s) AS sh, generate_subscripts(s, 1) - 1 AS p FROM items),
hit AS (SELECT DISTINCT de.doc_id, ie.item_id, ie.n, de.p FROM de JOIN ie USING (sh)),
win AS (SELECT DISTINCT doc_id, item_id, n, unnest(generate_series(p - (n - 5), p)) AS a FROM hit),
wc AS (
  SELECT win.doc_id, win.item_id, win.n, win.a, de.sh, count(*) AS c FROM win JOIN de
  ON de.doc_id = win.doc_id AND de.p >= win.a AND de.p < win.a + win.n - 4 GROUP BY ALL),
ic AS (SELECT item_id, sh, count(*) AS c FROM ie GROUP BY ALL),
j AS (
  SELECT wc.doc_id, wc.item_id, wc.n, wc.a, sum(wc.c) AS wt, sum(least(wc.c, coalesce(ic.c, 0))) AS shared
  FROM wc LEFT JOIN ic ON wc.item_id = ic.item_id AND wc.sh = ic.sh GROUP BY ALL),
good AS (SELECT *, wt + (n - 4) - shared AS total FROM j WHERE 100 * shared >= 80 * (wt + (n - 4) - shared))
SELECT doc_id, item_id, CAST(max_by(greatest(a, 0), (shared / total, -greatest(a, 0), shared, total)) AS BIGINT) AS first_word,
  CAST(max_by(shared, (shared / total, -greatest(a, 0), shared, total)) AS BIGINT) AS shared,
  CAST(max_by(total, (shared / total, -greatest(a, 0), shared, total)) AS BIGINT) AS total
FROM good GROUP BY doc_id, item_id
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark, sf_dir):
    """Leaked items of all documents; documents without one have no row."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
