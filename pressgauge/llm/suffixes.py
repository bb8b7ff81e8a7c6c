"""Deep-shallow sorting of suffixes cut at a fixed width, on numpy arrays.

The shallow part is a multikey quicksort whose characters are 8 bytes wide: it
splits groups of equal beginnings by their next character until ``SHALLOW``
bytes are equal. The deep part orders each remaining group by a blind trie: a
leader's path holds the branches, a branch is the depth and byte at which a
member leaves the path, and only members of one branch are compared again. All
groups are worked on together, one trie level at a time; a branch is deeper
than the one it hangs on, so there are at most ``width - SHALLOW`` levels.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16
_ROWS = 1 << 17


def _split(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Number the groups anew, in order of group and key."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), np.int64)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _crowded(group: np.ndarray) -> np.ndarray:
    return np.bincount(group)[group] > 1


def _character(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    value = np.zeros(len(starts), np.uint64)
    for i in range(8):
        value = (value << np.uint64(8)) | data[starts + i]
    return value


def ranks(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Rank of ``data[start : start + width]`` inside its group; equal strings of a group rank equal.

    ``width`` is at least ``SHALLOW``. Groups are numbers; ranks are in order of
    group, then string.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    rank = _split(group, np.zeros(len(group), np.int64))
    for depth in range(0, SHALLOW, 8):
        live = np.flatnonzero(_crowded(rank))
        key = np.zeros(len(rank), np.uint64)
        key[live] = _character(data, starts[live] + depth)
        rank = _split(rank, key)
    done = ~_crowded(rank)
    length = width - SHALLOW
    while not done.all():
        live = np.flatnonzero(~done)
        order = live[np.argsort(rank[live], kind="stable")]
        r = rank[order]
        first = np.concatenate([[True], r[1:] != r[:-1]])
        leader = order[first][np.cumsum(first) - 1]
        key = np.zeros(len(rank), np.int64)
        for a in range(0, len(order), _ROWS):
            mine, lead = order[a : a + _ROWS], leader[a : a + _ROWS]
            columns = np.arange(SHALLOW, width)
            x, y = data[starts[mine][:, None] + columns], data[starts[lead][:, None] + columns]
            differs = x != y
            at = differs.argmax(1)
            rows = np.arange(len(mine))
            left = differs[rows, at]
            b, c = x[rows, at].astype(np.int64), y[rows, at].astype(np.int64)
            # Smaller ones leave the leader's path ever deeper, greater ones ever higher.
            depth = np.where(b < c, at, 2 * length - at)
            key[mine] = np.where(left, depth * 256 + b, length * 256)
        leaf = key == length * 256
        rank = _split(rank, key)
        done = done | leaf | ~_crowded(rank)
    return rank
