"""Periodic runs of words by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), of at least ``max(least, 3 q)`` words, that no
neighbouring word extends. Words are ``[^\\x20\\x09-\\x0D]+``.

1. Splitting. A run holds each of its words three times or more. A word that
   occurs less often in its segment (at first the whole text) is in no run and
   splits it; pieces of fewer than ``least`` words go. This recurs on the pieces
   until no word splits any: plain prose falls to nothing here, what repeats is
   left. All segments of a batch are split at once, by sorted counts.
2. Which lags? Inside a run the first string of ``g`` words, ``q <= g < 2 q``,
   occurs again after ``q`` words, and not before: an earlier copy of a string
   of a whole period would give a smaller period. So the lags of a segment are
   the distances of next copies of strings of 8, 16, 32, ... words that are at
   most such a string long and more than half of it (all distances for 8).
3. Lag scan. A segment is compared with itself at each of its lags; stretches of
   equal words that are long enough are runs. One found with a smaller lag
   already, at the same place, has that smaller period.

Words are told apart by 64-bit hashes, inside one text. A text is worked through
by one task, in memory that grows with the text alone; nothing is shuffled.

Defined results: null, empty and short texts have no runs; repeated rows, null
ids and other columns are carried along as they are; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pressgauge.llm.common import WORD, query, table
from pressgauge.llm.vectors import runs as text_runs
from pressgauge.llm.vectors import word_hashes, words

SHORTEST = 24
TIMES = 3
_GRAM = 8  # SHORTEST holds a string of so many words and a copy of it

RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def split(ids: np.ndarray, segments: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that no splitting removes, and the number of the segment of each."""
    at = np.arange(len(ids))
    while len(at):
        _, segments, sizes = np.unique(segments, return_inverse=True, return_counts=True)
        width = np.int64(ids.max()) + 1
        _, pair, times = np.unique(segments * width + ids[at], return_inverse=True, return_counts=True)
        kept = (times[pair] >= TIMES) & (sizes[segments] >= least)
        if kept.all():
            break
        at, segments = at[kept], segments[kept]
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(segments) != 0)]) if len(at) else []
        segments = np.cumsum(new)
    return at, segments


def lags(ids: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Rows (segment, lag), sorted, at which a segment may hold a run."""
    n = len(ids)
    longest = int(np.bincount(segments).max()) // TIMES
    rank, g, found = ids.astype(np.int64), 1, [np.zeros((0, 2), np.int64)]
    place = np.arange(n)
    left = np.searchsorted(segments, segments, "right") - place  # words to the segment's end
    while g <= _GRAM or g // 2 < longest:
        if g >= _GRAM:
            whole = np.flatnonzero(left >= g)
            order = whole[np.argsort(rank[whole], kind="stable")]
            here, after = order[:-1], order[1:]
            far = after - here
            good = (rank[here] == rank[after]) & (segments[here] == segments[after]) & (far <= g)
            good &= (far > g // 2) | (g == _GRAM)
            found.append(np.unique(np.column_stack([segments[here[good]], far[good]]), axis=0))
        later = np.full(n, -1, np.int64)
        later[:-g] = np.where(left[:-g] > g, rank[g:], -1)
        _, rank = np.unique(rank * np.int64(n + 1) + later + 1, return_inverse=True)
        g *= 2
    return np.unique(np.concatenate(found), axis=0)


def scanned(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, after the last) of the longest stretches of that period, if they are runs."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    edges = np.flatnonzero(np.diff(same))
    begins, ends = edges[::2], edges[1::2] + lag
    long = ends - begins >= max(least, TIMES * lag)
    return list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))


def runs_of(hashes: np.ndarray, firsts: np.ndarray, least: int = SHORTEST) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has some, by start, then period.

    ``firsts`` says where the words of each text begin in ``hashes``.
    """
    if not len(hashes):
        return {}
    _, ids = np.unique(hashes, return_inverse=True)
    texts = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at, segments = split(ids, texts, max(least, TIMES * _GRAM))
    if not len(at):
        return {}
    _, left, segments = np.unique(segments, return_index=True, return_inverse=True)
    ends = np.append(left[1:], len(at))
    _, dense = np.unique(ids[at], return_inverse=True)
    found: dict[int, list[tuple[int, int, int]]] = {}
    seen: set[tuple[int, int]] = set()
    for segment, lag in lags(dense, segments).tolist():
        base = int(at[left[segment]])
        text = int(texts[base])
        for a, b in scanned(dense[left[segment] : ends[segment]], lag, least):
            a, b = a + base, b + base
            if (a, b) not in seen:
                seen.add((a, b))
                found.setdefault(text, []).append((a - int(firsts[text]), b - a, lag))
    return {text: sorted(some, key=lambda r: (r[0], r[2])) for text, some in found.items()}


def _kept_words(text: bytes, some: list[tuple[int, int, int]]) -> bytes:
    parts = text.split()  # the separators of bytes are those of WORD
    if not some:
        return b" ".join(parts)
    change = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in some:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(parts[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def _mapped(column: str, least: int, name: str, text_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for row, end, data, offsets in text_runs(texts):
                starts, ends, firsts = words(data, offsets)
                found = runs_of(word_hashes(data, starts, ends), firsts, least)
                lists = [found.get(i, []) for i in range(end - row)]
                flat = np.array([r for some in lists for r in some], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=["start", "length", "period"]
                )
                sizes = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                whole = data.tobytes()
                kept = [
                    _kept_words(whole[a:b], some).decode()
                    for a, b, some in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists, strict=True)
                ]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(sizes), structs), pa.array(kept, pa.string())],
                    names=[*part.schema.names, name, text_name],
                )

    return run


def with_runs(
    documents: DataFrame, column: str = "text", least: int = SHORTEST, runs: str = "runs", collapsed: str = "collapsed"
) -> DataFrame:
    """``documents`` with their runs (start, length, period: numbers of words) and their collapsed text.

    In the collapsed text, words inside any run after its first period are left
    out; the others are joined by one space. ``runs`` and ``collapsed`` name the
    two new columns. ``least`` is 24 or more.
    """
    if least < TIMES * _GRAM:
        raise ValueError(f"least must be {TIMES * _GRAM} or more")
    if clash := {runs, collapsed} & set(documents.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = StructType([*documents.schema, StructField(runs, RUNS), StructField(collapsed, StringType())])
    return documents.mapInArrow(_mapped(column, least, runs, collapsed), schema)


def planted(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, or for one id in ten its words with a repeated passage from some word on."""
    h = F.crc32(F.col(doc_id).cast("string"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    # Bound to a variable, the words are made once.
    changed = F.get(F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), repeated), 0)
    return F.when(F.col(text).isNotNull() & (h % 10 == 0), changed).otherwise(F.col(text))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of all documents, with the digests of runs and collapsed texts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    found = with_runs(documents)
    # Greatest length / period, compared exactly; ties by start, then period.
    best = F.get(F.array_sort("runs", lambda x, y: F.coalesce(
        F.nullif(F.signum(y.length * x.period - x.length * y.period).cast("int"), F.lit(0)),
        F.nullif(F.signum(x.start - y.start).cast("int"), F.lit(0)),
        F.signum(x.period - y.period).cast("int"),
    )), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
