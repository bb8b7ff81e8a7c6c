"""Words and shingles of many texts at once, as numpy arrays.

Helpers for tasks that get texts in Arrow batches. A batch is worked through
in runs of whole texts of about ``RUN`` bytes, so that the arrays stay small;
a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = 1 << 20

#: One random number per byte value; hashes must agree between tasks and runs.
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]).cumprod(dtype=np.uint64)[:n]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit numbers; equal numbers stay equal."""
    h = h ^ np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(texts: pa.Array, limit: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their UTF-8 bytes, offsets); null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, where each text's words begin in them); words never cross texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.concatenate([np.zeros(1, np.int64), lengths.cumsum()])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    value = BYTE[data[place + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(value, total[:-1]))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, at the place of the first."""
    out = np.full(max(len(hashes) - n + 1, 0), np.uint64(n))
    for i in range(n):
        out = out * _NEXT + hashes[i : i + len(out)]
    return mixed(out)


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct shingles of ``n`` words.

    A text of fewer words has its whole sequence as its one shingle, one
    without words none.
    """
    for _, _, data, offsets in runs(texts):
        if lower:
            data = LOWER[data]
        starts, ends, firsts = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        every = shingles(hashes, n)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            if b - a >= n:
                one = np.sort(every[a : b - n + 1])
                yield one[np.concatenate([[True], one[1:] != one[:-1]])]
            elif b > a:
                yield shingles(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
