"""Periodic runs against a brute force over all places and periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from pressgauge.llm import periods
from pressgauge.llm.common import QUERIES
from pressgauge.llm.vectors import mixed

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24):
    """All maximal stretches of a period, each with its smallest one."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_kept(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found_runs(lists):
    hashes = mixed(np.array([x for w in lists for x in w], np.uint64) + np.uint64(1))
    firsts = np.cumsum([0, *map(len, lists)])
    got = periods.runs_of(hashes, firsts)
    return [got.get(i, []) for i in range(len(lists))]


def repetitive(rng):
    w = []
    while len(w) < rng.randint(0, 260):
        block = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 25))]
        w += block * rng.randint(1, 8) + block[: rng.randint(0, len(block))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    lists = [repetitive(rng) for _ in range(120)]
    assert found_runs(lists) == [plain_runs(w) for w in lists]
    assert any(lists) and sum(map(len, map(plain_runs, lists))) > 50


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(1, 30), st.integers(0, 4))
def test_runs_of_few_words(lists, period, times):
    lists = [w[:period] * times + w for w in lists]
    assert found_runs(lists) == [plain_runs(w) for w in lists]


def test_long_runs():
    rng = random.Random(5)
    block = [rng.randint(0, 400) for _ in range(3000)]
    w = [1, 2, 3] + block * 4 + [7] * 30 + block[:100]
    assert found_runs([w]) == [[(3, 12_000, 3000), (12_003, 30, 1)]]


def test_prose_falls_apart_before_any_scan():
    rng = random.Random(6)
    words = np.array([int(rng.paretovariate(0.5)) for _ in range(20_000)])
    at, _ = periods.split(np.unique(words, return_inverse=True)[1], np.zeros(len(words), np.int64), 24)
    assert len(at) < 20_000
    assert found_runs([words.tolist()])[0] == plain_runs_fast(words)


def plain_runs_fast(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            if b + q - a >= max(24, 3 * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_odd_rows(spark):
    long = "la " * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, long, "x"), (4, long, "x"), (None, "é ü\u0000 " * 20, "x"), (5, "a b" * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = periods.with_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall(r.text or "")
        want = [(0, 40_000, 1)] if r.doc_id == 4 else plain_runs(w)
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == plain_kept(w, want)
    assert periods.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.with_runs(docs.withColumnRenamed("period", "runs"))


def contract(doc_id, text):
    """The rows of op13 written out word by word."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [r for r in plain_runs_fast(np.unique(w, return_inverse=True)[1])] if w else []
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(plain_kept(w, runs)),
    )


def test_query_equals_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(contract(*d) for d in docs)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] for r in want) > 5
