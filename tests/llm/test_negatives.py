"""Hard negatives against brute force; the tree's search against a scan of all rows."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from pressgauge.llm import negatives


def plain(rows, is_anchor, positives=5, n=5, low=80, high=100):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None:
            continue
        if i not in kept or (v, label) < (kept[i][1], kept[i][0]):
            kept[i] = (label, v)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        ranked = sorted(((-score(v, w), i, other) for i, (other, w) in kept.items() if i != a))
        near = [(-s, i) for s, i, other in ranked if other == label][:positives]
        for s, i in near:
            far = [(-t, j) for t, j, other in ranked if other != label and low * s <= -100 * t <= high * s][:n]
            out += [(a, i, r, j, s, t) for r, (t, j) in enumerate(far, 1)]
    return sorted(out)


def made(rng, n, dims, clusters):
    centres = [[rng.randint(-60, 60) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rng.randrange(clusters)
        rows.append((i, (c + (rng.random() < 0.3)) % 4, [x + rng.randint(-3, 3) for x in centres[c]]))
    rows += [(n + i, i % 2, list(centres[0])) for i in range(60)]  # ties, of two labels
    return rows


def on_spark(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(3)
    got = negatives.hard_negatives(df, "vec_id % 5 = 0", **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("options", [{}, {"tile_rows": 20, "part_rows": 15, "sample": 90}])
def test_equals_brute_force(spark, options):
    rows = made(random.Random(3), 400, 6, 9)
    want = plain(rows, lambda i: i % 5 == 0)
    assert len(want) > 500
    assert on_spark(spark, rows, **options) == want


def test_odd_rows(spark):
    rows = [(5, 1, [3, 4]), (5, 1, [3, 4]), (5, 0, [3, 5]), (1, 1, [3]), (2, 2, [2, 1]), (3, 1, []), (4, 2, [0, 0]), (10, 1, [-1, -1]),
            (None, 1, [1, 1]), (6, None, [1, 1]), (7, 1, None), (15, 3, [1, 1])]
    assert on_spark(spark, rows) == plain(
        [(i, a, None if v is None else v + [0] * (2 - len(v))) for i, a, v in rows], lambda i: i % 5 == 0
    )
    assert on_spark(spark, []) == []
    assert on_spark(spark, [(5, 1, [1])]) == []


def test_components_become_whole_numbers(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, 1, [float("nan"), 1.0]), (3, 1, [None, 1.0]), (4, 1, [float("inf"), 0.0]), (5, 1, []), (6, 1, None), (None, 1, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, v string")
    assert sorted(map(tuple, negatives.quantised(df).collect())) == [(1, 1, [128, -1]), (5, 1, [])]


@pytest.mark.parametrize("same", [True, False])
def test_search_opens_few_boxes_and_misses_nothing(same):
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 8))
    v = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-20, 20, (20_000, 8))).astype(np.int64)
    order = negatives.packed_order(v)
    assert sorted(order.tolist()) == list(range(len(v)))
    v, labels, ids = v[order], rng.integers(0, 3, len(v)), rng.permutation(len(v))
    tree, looked = negatives.Tree(ids, labels, v), 0
    for i in range(25):
        q, label = v[i * 700], int(labels[i * 700])
        scores = v @ q
        fits = (labels == label) == same
        top = int(scores[fits].max())
        low, high = [0, top // 2], [top, top // 2 + 5000]
        windows = negatives.Windows(low, high, 5, [-(2**63)] * 2)
        looked += tree.search(q, label, same, windows)
        for w in range(2):
            inside = np.flatnonzero(fits & (scores >= low[w]) & (scores <= high[w]))
            first = sorted(zip((-scores[inside]).tolist(), ids[inside].tolist()))[:5]
            assert list(zip((-windows.scores[w]).tolist(), windows.ids[w].tolist())) == first
    assert looked < 25 * len(v) / 3


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    result = entry.queries()["op12_hard_negatives"](spark, sf).toArrow()
    assert result.num_rows
    assert compare(result, connect(sf).execute(entry.oracle_sql()["op12_hard_negatives"]).to_arrow_table()) is None
