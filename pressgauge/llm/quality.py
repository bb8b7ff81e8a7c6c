"""Quality rules: base rules, and a calibrated logistic regression on hashed n-grams.

Features are hashed word 1- and 2-grams and character 1- to 3-grams; a feature
has the square root of its share among the text's n-grams of its family as
value. The model trains on labelled quality rows (at most ``limit``, chosen by
the hash of their id, without fold 2, which tests can use), fold 3 calibrates
its margins to probabilities, and a text is kept at ``threshold`` or more.

Base rules: a text fails with fewer than ``min_words`` words, or if more than
``max_repeat`` percent of its words lie in 5-word windows found twice or more.

Defined results: null text is empty, has no words and fails; ties of the
threshold are kept; repeated rows are judged alike; a label that is not 0 or 1
is no label; without labelled rows of both kinds only the base rules count;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import query, stage, table
from pressgauge.llm.linear import (
    CALIBRATION,
    calibrated,
    char_grams,
    code_points,
    fitted,
    labelled_sample,
    probability,
)
from pressgauge.llm.vectors import mixed, runs, shingles, word_hashes, words

WIDTH = 1 << 17
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    scale: tuple[float, float]


def _features(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text from the hashes of each family."""
    index, value = [], []
    for hashes in families:
        if len(hashes):
            cells = np.sort((hashes & np.uint64(WIDTH - 1)).astype(np.int32))
            new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            index.append(cells[new])
            value.append(np.sqrt(np.diff(np.append(new, len(cells))) / len(cells)))
    if not index:
        return np.zeros(0, np.int32), np.zeros(0)
    return np.concatenate(index), np.concatenate(value)


def _families(data, offsets, starts, ends, firsts, hashes) -> Iterator[list[np.ndarray]]:
    """Per text: word 1-grams, 2-grams, character 1- to 3-grams."""
    ones, twos = mixed(hashes, 31), mixed(shingles(hashes, 2), 32)
    points, begins = code_points(data, offsets, lower=False)
    chars = char_grams(points, 3)
    for a, b, c, d in zip(firsts[:-1], firsts[1:], begins[:-1], begins[1:], strict=True):
        yield [ones[a:b], twos[a : max(b - 1, a)], *(g[c : max(d - n, c)] for n, g in enumerate(chars))]


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *rows]).astype(kind)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in runs(batch.column(0)):
            starts, ends, firsts = words(data, offsets)
            made = [_features(f) for f in _families(data, offsets, starts, ends, firsts, word_hashes(data, starts, ends))]
            yield pa.RecordBatch.from_pydict({
                "label": batch.column(1).slice(first, last - first), "index": _lists([m[0] for m in made], np.int32),
                "value": _lists([m[1] for m in made], np.float32),
                "fold": batch.column(2).slice(first, last - first),
            })


def train(documents: DataFrame, labels: DataFrame, limit: int = 6000, l2: float = 1e-5) -> Model | None:
    """The model, or None without labelled rows of both kinds."""
    sample = labelled_sample(documents, labels, "quality", limit)
    made = sample.select("text", "label", "fold").mapInArrow(
        _featured, "label double, index array<int>, value array<float>, fold int"
    )
    made = stage(made, "quality-features")
    kinds = made.agg(F.min("label"), F.max("label")).first()
    if kinds[0] == kinds[1]:
        return None
    rows = made.select("label", "index", "value", "fold")
    training = rows.filter(F.col("fold") != CALIBRATION).drop("fold")
    weights = fitted(training, WIDTH, l2)
    return Model(weights, calibrated(rows.filter(F.col("fold") == CALIBRATION).drop("fold"), weights))


def _repeat_words(windows: np.ndarray, n: int) -> int:
    """Words inside windows that are found twice or more."""
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(windows) + n, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier one."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    return n


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat: int = 20
    threshold: float = 0.5


def _verdicts(texts: pa.Array, model: Model | None, rules: Rules) -> dict[str, np.ndarray]:
    """Statistics and verdict of each text of a batch."""
    found: dict[str, list] = {c: [] for c in (*STATISTICS, "base_failed", "kept", "probability")}
    for _, _, data, offsets in runs(texts):
        starts, ends, firsts = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        fives = shingles(hashes, 5)
        heads = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(heads[ends] - heads[starts])])
        symbols = np.concatenate([np.zeros(1, np.int64), np.cumsum(_SYMBOL[data])])
        raw, n = data.tobytes(), np.diff(firsts)
        repeats = np.array([
            _repeat_words(fives[a : max(b - 4, a)], 5) for a, b in zip(firsts[:-1], firsts[1:], strict=True)
        ], np.int64)
        lines = np.array([
            _dup_lines(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ], np.int64)
        failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat * n)
        p = np.ones(len(n))
        if model is not None:
            w = model.weights
            made = (_features(f) for f in _families(data, offsets, starts, ends, firsts, hashes))
            p = probability(np.array([w[i] @ v for i, v in made]) + w[-1], model.scale)
        values = (
            n, letters[firsts[1:]] - letters[firsts[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], lines, repeats,
            failed, ~failed & (p >= rules.threshold), p,
        )
        for out, x in zip(found.values(), values, strict=True):
            out.append(x)
    return {c: np.concatenate(x) for c, x in found.items()} if found["kept"] else {}


def judged(documents: DataFrame, model: Model | None, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, the statistics, base_failed, kept, probability) of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _verdicts(batch.column(1), sent.value, rules)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **found})

    columns = ", ".join(f"{s} long" for s in STATISTICS)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, f"doc_id long, {columns}, base_failed boolean, kept boolean, probability double"
    )


def kept_documents(documents: DataFrame, model: Model | None, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, in their own columns."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_verdicts(batch.column(at), sent.value, rules)["kept"]))

    return documents.mapInArrow(run, documents.schema)


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    """Statistics and verdict of all documents."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return judged(documents, model)
