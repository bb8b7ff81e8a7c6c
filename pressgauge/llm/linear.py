"""Logistic regression on hashed text features, and its calibration.

Training works on a bounded sample of labelled rows, spread over tasks: each
step of L-BFGS sends the weights, of fixed size, to the tasks and gets sums of
the same size back. Scoring reads all texts once, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import stage
from pressgauge.llm.vectors import _NEXT, mixed

TASKS = 8
HELD_OUT, CALIBRATION, FOLDS = 2, 3, 4

_SMALL = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _SMALL[_c] = ord(chr(_c).lower())


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``limit`` labelled rows outside the held-out fold, and staged.

    Rows are chosen by the hash of their id. ``limit`` bounds what is sent to
    every executor to find their texts.
    """
    chosen = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(target)).cast("double").alias("label")
    )
    chosen = chosen.withColumn("fold", fold("doc_id")).filter(F.col("fold") != HELD_OUT)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    return stage(found.repartition(TASKS, "doc_id"), "labelled")


def code_points(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts given as UTF-8, and where each text begins in them."""
    heads = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if lower:
        points = np.where(points < len(_SMALL), _SMALL[np.minimum(points, len(_SMALL) - 1)], points)
    return points, heads[offsets]


def char_grams(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 1- to ``longest``-grams at each place."""
    value = mixed(points.astype(np.uint64), 3)
    grams = [value]
    for n in range(1, longest):
        last = grams[-1]
        grams.append(last[: max(len(last) - 1, 0)] * _NEXT + value[n:])
    return [mixed(g, 20 + n) for n, g in enumerate(grams)]


def _parsed(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if batch.num_rows:
            index, value = batch.column(1), batch.column(2)
            yield (
                batch.column(0).to_numpy(zero_copy_only=False),
                index.flatten().to_numpy().astype(np.int64),
                value.flatten().to_numpy().astype(np.float64),
                np.diff(index.offsets.to_numpy()),
            )


def margins(weights: np.ndarray, index: np.ndarray, value: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(weights[index] * value)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths] + weights[-1]


def _slopes(weights):
    """Loss and gradient of a task's rows; the last weight is the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        loss, rows, slope = 0.0, 0, np.zeros(len(w))
        for label, index, value, lengths in _parsed(batches):
            m = margins(w, index, value, lengths)
            loss += float(np.logaddexp(0, -np.where(label > 0, m, -m)).sum())
            error = 1 / (1 + np.exp(-m)) - label
            slope[:-1] += np.bincount(index, value * np.repeat(error, lengths), len(w) - 1)
            slope[-1] += error.sum()
            rows += len(label)
        yield pa.RecordBatch.from_pydict({"loss": [loss], "rows": [rows], "slope": [slope.astype(np.float32).tobytes()]})

    return run


def minimised(step: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8):
    """L-BFGS with halved steps; ends when the loss no longer falls by a millionth, or after ``rounds``."""
    value, slope = step(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < rounds:
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1e-12, np.sqrt(slope @ slope))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        length, moved = 1.0, False
        while used < rounds:
            new, (new_value, new_slope) = x - length * q, step(x - length * q)
            used += 1
            if new_value <= value - 1e-4 * length * (slope @ q):
                moved = True
                break
            length /= 2
        if not moved:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        small = value - new_value < 1e-6 * abs(value)
        x, value, slope = new, new_value, new_slope
        if small:
            break
    return x


def fitted(features: DataFrame, width: int, l2: float, rounds: int = 30) -> np.ndarray:
    """Weights, the intercept last, from (label double, index array<int>, value array<float>).

    ``TASKS`` tasks bound what a step sends to the driver, however the rows are stored.
    """
    context = features.sparkSession.sparkContext
    features = features.coalesce(TASKS)

    def step(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(w)
        parts = features.mapInArrow(_slopes(sent), "loss double, rows long, slope binary").collect()
        sent.destroy()
        parts.sort(key=lambda r: (r["rows"], r["loss"]))
        rows = max(1, sum(r["rows"] for r in parts))
        penalty = np.append(w[:-1], 0)
        slope = sum((np.frombuffer(bytes(r["slope"]), np.float32) for r in parts), np.zeros(len(w)))
        return sum(r["loss"] for r in parts) / rows + l2 / 2 * (penalty @ penalty), slope / rows + l2 * penalty

    return minimised(step, np.zeros(width + 1), rounds)


def _margin_rows(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, index, value, lengths in _parsed(batches):
            yield pa.RecordBatch.from_pydict({"label": label, "margin": margins(weights.value, index, value, lengths)})

    return run


def calibrated(features: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Platt scaling), from rows that did not train.

    ``features`` is part of the bounded sample; two numbers a row come to the
    driver. Without both labels the margins are left as they are.
    """
    sent = features.sparkSession.sparkContext.broadcast(weights)
    got = features.mapInArrow(_margin_rows(sent), "label double, margin double").toArrow()
    label, margin = got["label"].to_numpy(), got["margin"].to_numpy()
    up, down = label.sum(), len(label) - label.sum()
    if not up or not down:
        return 1.0, 0.0
    wanted = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.stack([margin, np.ones(len(margin))])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ design, -500, 500)))
        slope = design @ (p - wanted) + 1e-3 * (ab - [1.0, 0.0])
        curve = (design * (p * (1 - p))) @ design.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        ab = ab - move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return float(max(ab[0], 1e-6)), float(ab[1])


def probability(margin: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -500, 500)))
