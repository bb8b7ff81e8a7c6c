"""MinHash near-duplicates against brute force on whole sets, and the multi-index on planted signatures."""

import itertools
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from pressgauge.llm import minhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "kltmnr" for b in ("abe", "ido", "ume", "esa", "oti", "uru")]


def plain_set(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain(rows, n, percent):
    sets = [plain_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(find(i), doc_id) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + "x"
    return " ".join(words)


def test_signatures_within_the_radius_share_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 65_536, minhash.SLOTS).astype(np.uint16)
    for apart in (0, 1, minhash.RADIUS - 1, minhash.RADIUS):
        others = np.tile(base, (300, 1))
        for row in others:
            row[rng.choice(minhash.SLOTS, apart, replace=False)] ^= np.uint16(1)
        keys = minhash.chunk_keys(np.vstack([base, others]))
        assert all(np.isin(keys[0], k).any() for k in keys[1:])
    spread = base.copy()
    spread[:: minhash.WIDE] ^= np.uint16(1)
    spread[1 :: minhash.WIDE] ^= np.uint16(1)  # two errors in every chunk: one more than the radius
    a, b = minhash.chunk_keys(np.vstack([base, spread]))
    assert not np.isin(a, b).any()


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    apart = []
    for n in (5, 45, 450):
        for _ in range(120):
            union = rng.integers(1, 2**63, n, dtype=np.uint64)
            k = n // 5 * 4  # similarity 0.8
            a, b = np.sort(union[: (n + k) // 2]), np.sort(np.concatenate([union[:k], union[(n + k) // 2 :]]))
            x, y = minhash.signatures([a, b])
            apart.append(int((x != y).sum()))
    assert abs(np.mean(apart) - 0.2 * minhash.SLOTS) < 1 and max(apart) <= minhash.RADIUS


@pytest.mark.parametrize("block", [2048, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 60)))) for i in range(80)]
    for base in range(0, 80, 8):
        words = rows[base][1].split()
        rows += [(1000 + len(rows), edited(rng, words, rng.randint(0, len(words) // 8 + 1))) for _ in range(10)]
    # Chains: neighbours are linked, ends are not; a passage shared by many others that are not linked.
    step = rng.choices(VOCABULARY, k=60)
    for i in range(25):
        step = step[4:] + rng.choices(VOCABULARY, k=4)
        rows.append((5000 - i, " ".join(step)))
    shared = " ".join(rng.choices(VOCABULARY, k=30))
    rows += [(7000 + i, shared + " " + " ".join(rng.choices(VOCABULARY, k=12))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=2, percent=80)
    want = plain(rows, 2, 80)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 20 < sum(not r[3] for r in want)


def test_odd_rows(spark):
    rng = random.Random(8)
    base = " ".join(rng.choices(VOCABULARY, k=80))
    long = " ".join(rng.choices(VOCABULARY, k=30_000))
    rows = [(1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (5, base), (6, base.upper() + " end"), (7, long), (8, long + " end"),
            (9, "one"), (10, "ONE"), (11, "two words"), (None, base), (None, "alone in this table"), (None, "alone in this table")]
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "doc_id long, text string, n long, key string, node string, signature string")
    assert sorted(map(tuple, minhash.near_duplicates(df, n=2).collect()), key=repr) == plain_null_safe(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def plain_null_safe(rows):
    return plain(rows, 2, 80)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (3, 40, 600):
        union = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2)
        a, b = union[: n - n // 10], union[n // 10 :]
        cells = [np.frombuffer(minhash.parities(x), np.uint64)[None] for x in (a, b)]
        assert np.bitwise_count(cells[0] ^ cells[1]).sum() <= 2 * (n // 10)
        places = minhash.signatures([a, b])
        good, _ = minhash._may_link(np.array([len(a)]), np.array([len(b)]), places[:1], places[1:], *cells, 80)
        assert len(good) == 1


def test_blocks_of_a_hot_list():
    """One large component and outsiders: inside the component nothing is compared."""
    rng = np.random.default_rng(5)
    places = np.tile(rng.integers(0, 65_536, minhash.SLOTS).astype(np.uint16), (200, 1))
    part = np.array([1] * 197 + [2, 3, 3])
    a, b = minhash.block_pairs(np.arange(200), part, np.full(200, 50), places, np.zeros((200, 32), np.uint64), 80)
    assert len(a) == 197 * 3 + 2 and all(part[x] != part[y] for x, y in zip(a, b))


def test_query_equals_sql(spark):
    result = entry.queries()["op11_minhash_dedup"](spark, SF).toArrow()
    assert compare(result, connect(SF).execute(entry.oracle_sql()["op11_minhash_dedup"]).to_arrow_table()) is None
