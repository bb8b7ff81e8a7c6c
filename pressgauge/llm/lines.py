"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are ``\\n``-split. A line that holds a word is removed if an earlier line,
by (doc_id, line number), equals it, or, among lines of at least ``shortest``
code points, is one edit (a character inserted, deleted or replaced) away.
Others stay.

1. Equal lines are one line, which stands where it first occurs. Its later
   occurrences go.
2. Which lines can have a partner? One edit leaves the first half or the last
   half of the shorter line as it is. Lines none of whose halves (as the shorter
   or the longer one) is found in another line have none, and leave.
3. Deletion neighbourhood. Every remaining line emits the hash of itself, of
   each variant with one character deleted, and of each variant with the place
   of the deletion. Two lines one insertion apart: a variant of the longer is
   the other line. Two lines one replacement apart: equal variants of the same
   place, and so are all lines that have these; each is joined to the earliest.
   Either way a line gets one pair for each of its keys at most.
   Candidate lines are numbered in their order, so keys need no places beside the
   numbers, and one shuffle of the keys serves for the leaders and their pairs.
4. The edit distance of each pair is verified, and its later line goes.

Keys have 64 bits, a line's identity 128; they are made from the characters by
powers of an odd base.
The bound is one edit: it needs as many variants as a line has characters.

Defined results: null texts have no lines; lines of null ids come last; repeated
rows are occurrences, ordered by a hash of their text; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import id_bits, maybe_in, query, stage, table
from pressgauge.llm.linear import code_points
from pressgauge.llm.vectors import mixed, powers, runs

SALTS = 16
_SIGNED = np.int64


def _points(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le"), np.uint32)


def _prefix(points: np.ndarray) -> np.ndarray:
    """Sums of scattered characters times powers: hashes of all beginnings before they are scattered."""
    value = mixed(points.astype(np.uint64), 5) * powers(len(points))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])


_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


def _line_keys(texts: pa.Array, shortest: int) -> Iterator[tuple]:
    """(text, line number, two hashes, four half keys, whether long) of the lines that hold a word.

    Half keys: for two lines of which the shorter has ``m`` characters, one
    edit leaves the first ``m // 2`` or the last ``m - m // 2 - 1`` characters
    alone. A line is the shorter one (m = its length) or the longer (one less).
    """
    for row, _, data, offsets in runs(texts):
        points, begins = code_points(data, offsets, lower=False)
        value = mixed(points.astype(np.uint64), 5)
        up = powers(len(points) + 1)
        down = np.concatenate([np.ones(1, np.uint64), np.full(len(points), _INVERSE)]).cumprod(dtype=np.uint64)
        ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:-1], dtype=np.uint64)])
        back = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * down[:-1], dtype=np.uint64)])

        def head(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (ahead[j] - ahead[i]) * down[i]

        def tail(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (back[j] - back[i]) * up[j]

        breaks = np.flatnonzero(points == 10)
        text_of_break = np.searchsorted(begins, breaks, "right") - 1
        starts = np.concatenate([begins[:-1], breaks + 1])
        ends = np.concatenate([breaks, begins[1:]])
        text = np.sort(np.concatenate([np.arange(len(begins) - 1), text_of_break]))
        starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
        number = np.arange(len(text)) - np.searchsorted(text, text)
        inside = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
        worded = inside[ends] > inside[starts]
        text, number, i, j = text[worded], number[worded], starts[worded], ends[worded]
        n = (j - i).astype(np.uint64)
        keys = []
        for m in (n - np.uint64(1), n):
            half = (m // np.uint64(2)).astype(np.int64)
            rest = np.maximum(m.astype(np.int64) - half - 1, 0)
            keys.append(mixed(head(i, i + half) ^ (m << np.uint64(40)), 101))
            keys.append(mixed(tail(j - rest, j) ^ (m << np.uint64(40)), 102))
        yield text + row, number, mixed(head(i, j) ^ n, 1), mixed(tail(i, j) ^ n, 2), *keys, j - i >= shortest


LINES = "doc_id long, text_key long, line_no int, h1 long, h2 long, a0 long, a1 long, b0 long, b1 long"


def _read_lines(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, number, h1, h2, *halves, long in _line_keys(batch.column(2), shortest):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)),
                     *(pa.array(k.view(_SIGNED)) for k in (h1, h2)),
                     *(pa.array(k.view(_SIGNED), mask=~long) for k in halves)],
                    names=["doc_id", "text_key", "line_no", "h1", "h2", "a0", "a1", "b0", "b1"],
                )

    return run


def _texts_with(wanted):
    """Texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(batch.column(0), wanted.value)))

    return run


WHOLE, DELETED, PLACED = range(3)


def _variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their kinds: the line, each variant with a character deleted, and each variant with its place."""
    points = _points(line)
    n = len(points)
    sums = _prefix(points)
    scattered = mixed(points.astype(np.uint64), 5)
    # After the deletion, what follows moves one place down: one power less.
    shifted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scattered[1:] * powers(n)[: n - 1], dtype=np.uint64)])
    variant = sums[:n] + shifted[-1] - shifted
    first = np.concatenate([[True], points[1:] != points[:-1]])  # a run of equal characters has one variant
    keys = [
        mixed(sums[-1:], 3) ^ np.uint64(n),
        mixed(variant[first], 3) ^ np.uint64(n - 1),
        mixed(variant, 4) ^ mixed(np.arange(n, dtype=np.uint64), 6),
    ]
    kinds = np.repeat(np.array([WHOLE, DELETED, PLACED], np.int32), [len(k) for k in keys])
    return np.concatenate(keys).view(_SIGNED), kinds


def _keyed(make):
    """(id, key, kind) for each key of each line, in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, held = [], [], 0

            def written() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({
                    "id": np.concatenate(ids), "key": np.concatenate([m[0] for m in made]),
                    "kind": np.concatenate([m[1] for m in made]),
                })

            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.append(make(line))
                ids.append(np.full(len(made[-1][0]), i, _SIGNED))
                held += len(ids[-1])
                if held > 1 << 18:
                    yield written()
                    ids, made, held = [], [], 0
            if ids:
                yield written()

    return run


KEYS = "id long, key long, kind int"


def repeated_lines(documents: DataFrame, shortest: int = 20) -> DataFrame:
    """(doc_id, text_key, removed): the numbers of each document's removed lines, for documents that have some."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    docs = docs.filter(F.col("text").isNotNull())
    found = stage(docs.mapInArrow(_read_lines(max(shortest, 2)), LINES), "lines-found")
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "line_no")
    hashed = found.select(at.alias("at"), "h1", "h2")
    distinct = found.select(at.alias("at"), "h1", "h2", "a0", "a1", "b0", "b1").groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("k"), *[F.max(c).alias(c) for c in ("a0", "a1", "b0", "b1")]
    )
    distinct = stage(distinct.withColumn("id", F.monotonically_increasing_id()), "lines-distinct")

    halves = distinct.select("id", F.explode(F.array("a0", "a1", "b0", "b1")).alias("key")).filter("key is not null")
    common = halves.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a != b").select("key")
    may = halves.join(common, "key").select("id").distinct()
    may = distinct.join(may, "id").select("at", "h1", "h2").repartitionByRange("at").sortWithinPartitions("at")
    # Tasks and rows in them are in order, and so are these numbers: an earlier line has a smaller one.
    may = stage(may.withColumn("id", F.monotonically_increasing_id()), "lines-may")
    # Only texts with such a line are moved, told by a filter of fixed size.
    wanted = spark.sparkContext.broadcast(id_bits(may.select("at.doc_id")))
    texts = docs.mapInArrow(_texts_with(wanted), docs.schema)
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.text_key") == F.col("f.text_key"))
    numbers = may.groupBy("at.doc_id", "at.text_key").agg(F.collect_list(F.struct("at.line_no", "id")).alias("wanted"))
    some = texts.alias("t").join(numbers.alias("f"), same).select(F.split("t.text", "\n").alias("l"), F.explode("f.wanted").alias("x"))
    some = some.select("x.id", F.get("l", F.col("x.line_no")).alias("line")).dropDuplicates(["id"])
    some = stage(some, "lines-candidates")

    # One shuffle: leaders and pairs both read the keys as they are dealt here.
    keys = some.mapInArrow(_keyed(_variants), KEYS).repartition("key")
    heads = keys.groupBy("key").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.when(F.col("kind") == WHOLE, F.col("id"))).alias("whole")
    ).filter("a != b")
    heads = keys.join(heads.select("key", "a", "whole"), "key")
    pairs = heads.select(F.when(F.col("kind") == PLACED, F.col("a")).when(F.col("kind") == DELETED, F.col("whole")).alias("x"), "id")
    pairs = pairs.filter("x is not null and x != id").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
    pairs = stage(pairs.distinct(), "lines-pairs")
    whole = pairs.join(some.toDF("a", "line_a"), "a").join(some.toDF("b", "line_b"), "b")
    near = whole.filter(F.levenshtein("line_a", "line_b", 1).between(0, 1)).select(F.col("b").alias("id")).distinct()
    near = stage(near.join(may, "id").select("h1", "h2"), "lines-near")

    # What a line's occurrences have to know: all go, or all but the first.
    rules = distinct.join(near.withColumn("gone", F.lit(True)), ["h1", "h2"], "left").filter("gone or k > 1")
    rules = rules.select("h1", "h2", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("at")).alias("keep"))
    # A frequent line is found in many documents: its rule is copied, its occurrences dealt by document.
    salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    spread = hashed.withColumn("salt", F.pmod(F.hash("at"), F.lit(SALTS)))
    gone = spread.join(salted, ["h1", "h2", "salt"]).filter("keep is null or at != keep")
    return gone.groupBy("at.doc_id", "at.text_key").agg(F.collect_set("at.line_no").alias("removed"))


def deduplicated(documents: DataFrame, shortest: int = 20, count_as: str | None = None) -> DataFrame:
    """The documents without their repeated lines, in their own columns.

    ``count_as`` names one more column for the number of lines removed.
    """
    gone = stage(repeated_lines(documents, shortest), "lines-removed")
    d, g = documents.alias("d"), gone.alias("g")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    kept = F.expr("array_join(filter(split(d.text, '\\n'), (x, i) -> not array_contains(g.removed, i)), '\\n')")
    text = F.when(F.col("g.removed").isNull(), F.col("d.text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in documents.columns]
    if count_as is not None:
        columns.append(F.when(F.col("g.removed").isNull(), F.lit(0)).otherwise(F.size("g.removed")).cast("long").alias(count_as))
    return d.join(g, same, "left").select(*columns)


@query("op2_line_dedup")
def op2_line_dedup(spark, sf_dir):
    """Removed lines and the digest of what is left, of all documents."""
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    left = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return deduplicated(given, count_as="n_removed").select("doc_id", "n_removed", F.sha2(left, 256).alias("kept_sha256"))
