"""The numpy parts against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pressgauge.llm import chat, lines
from pressgauge.llm.linear import minimised
from pressgauge.llm.shards import permuted
from pressgauge.llm.suffixes import ranks
from pressgauge.llm.vectors import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="abAB é\n\t|", max_size=60)


def plain_set(text, n):
    low = {c: c + 32 for c in range(65, 91)}
    w = WORD.findall((text or "").translate(low))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, n):
    made = list(shingle_sets(pa.array(texts, pa.string()), n))
    assert [len(x) for x in made] == [len(plain_set(t, n)) for t in texts]
    for a, x in zip(texts, made):
        for b, y in zip(texts, made):
            assert len(np.intersect1d(x, y)) == len(plain_set(a, n) & plain_set(b, n))


def test_runs_of_whole_texts():
    texts = ["x y z " * 100_000, None, "", "a b c d", "x y z " * 100_000]
    made = list(shingle_sets(pa.array(texts), 4))
    assert [len(x) for x in made] == [3, 0, 0, 1, 3] and np.array_equal(made[0], made[4])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="ab", min_size=20, max_size=20)), max_size=30))
def test_ranks_sort_by_group_and_string(rows):
    data = np.frombuffer("".join(s for _, s in rows).encode(), np.uint8)
    got = ranks(data, np.arange(len(rows)) * 20, np.array([g for g, _ in rows], np.int64), 20)
    order = {key: i for i, key in enumerate(sorted(set(rows)))}
    assert got.tolist() == [order[r] for r in rows]


def test_ranks_of_long_common_prefixes():
    rng = random.Random(4)
    rows = ["a" * k + "b" + "".join(rng.choices("ab", k=49 - k)) for k in range(49) for _ in range(3)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    got = ranks(data, np.arange(len(rows)) * 50, np.zeros(len(rows), np.int64), 50)
    order = {s: i for i, s in enumerate(sorted(set(rows)))}
    assert got.tolist() == [order[r] for r in rows]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_one(n, key):
    assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<|\\im_startend>a\n", max_size=30))
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    assert chat._role_back(chat._role(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=2, max_size=12), st.integers(0, 11), st.sampled_from("abc"), st.integers(0, 2))
def test_lines_one_edit_apart_share_a_key(line, at, letter, kind):
    at %= len(line)
    other = [line[:at] + line[at + 1 :], line[:at] + letter + line[at:], line[:at] + letter + line[at + 1 :]][kind]
    (a, p), (b, q) = lines._variants(line), lines._variants(other)
    shared = [{int(k) for k in x[y == kind]} for x, y in ((a, p), (b, q)) for kind in (lines.WHOLE, lines.DELETED, lines.PLACED)]
    assert line == other or (shared[0] & shared[4] or shared[1] & shared[3] or shared[2] & shared[5])
    *_, a0, a1, b0, b1, long = next(lines._line_keys(pa.array([f"ü\n \n{line}\n", f"{other}"]), 2))
    assert len(long) == 3 - (not other) and not long[0]  # lines without a word are not judged
    if len(line) > 1 and len(other) > 1:
        mine = np.stack([a0, a1, b0, b1])[:, long].T
        assert len(mine) == 2 and set(mine[0].tolist()) & set(mine[1].tolist())


def test_minimum_of_a_bowl():
    x = minimised(lambda w: (float(((w - 3) ** 2).sum()), 2 * (w - 3)), np.zeros(4), 60)
    assert np.abs(x - 3).max() < 1e-2
