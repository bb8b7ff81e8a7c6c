"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``SLOTS`` places; each holds ``b`` = 16 bits of the
smallest hash of its set under that place's hash function, so two sets of Jaccard
similarity ``s`` differ in a share ``1 - s`` of the places, on average.

1. Documents of equal sets form one class; one of them stands for it.
2. Multi-index. The places are cut into ``CHUNKS`` chunks of 4. Signatures at
   most ``RADIUS`` = 2 CHUNKS - 1 places apart have a chunk with one error at most
   (pigeonhole: else every chunk had two). So each class lists, for each chunk and
   each place of it that may be the error, the other three values: a key is
   exactly (chunk, error, three values). Every pair within the radius shares a key.
3. In the list of a key, each class is paired with the smallest one. Pairs
   within the radius are confirmed on whole sets and joined to components.
4. In lists that still hold several components, ``ROUNDS`` times, another member is
   the leader, drawn by a hash: of each class that is in another component than
   the leader, the nearest such pair is confirmed. A group of near copies of which
   most pairs link becomes one component here, by few confirmations.
5. Lists that then hold several components: all pairs across components are
   tried, never those inside one. Long lists are cut into blocks of at most about
   ``BLOCK`` members, a large component's members into blocks of their own; two
   blocks of one component do not meet. Block pairs are dealt to tasks, compared by
   signature there, and only pairs within the radius become rows.
6. Those are confirmed as well, and the components made anew.

Before a pair is confirmed, its sets must agree in the parities of ``CELLS`` cells:
the cells that differ are at most the tokens that only one of the two has.

The radius is wide: at the similarity of 0.8 the 48 places differ in 9.6 on
average; more than 23 differ with a probability of 3e-6. The join loses no pair
within the radius, and confirmation is exact, so links have no false ones.

Defined results: null text, or one without words, has an empty set and links
with nothing; fewer than ``n`` words are one token; repeated rows are in one
component; a null ``doc_id`` is never the smallest and stands for itself if alone;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import links
from pressgauge.llm.common import id_bits, maybe_in, query, stage, table
from pressgauge.llm.vectors import mixed, shingle_sets

CHUNKS, WIDE = 12, 4
SLOTS = CHUNKS * WIDE
RADIUS = 2 * CHUNKS - 1
CELLS = 2048
BLOCK = 2048
ROUNDS = 1

_SIGNED = np.int64
_RANDOM = np.random.default_rng(11).integers(0, 2**63, (2, SLOTS), dtype=np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SLOTS`` 16-bit numbers for each set; an empty set has zeros."""
    out = np.zeros((len(sets), SLOTS), np.uint16)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full):
        tokens = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(SLOTS):
            least = np.minimum.reduceat((tokens ^ _XOR[k]) * _TIMES[k], at)
            out[full, k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def parities(tokens: np.ndarray) -> bytes:
    """Whether each of ``CELLS`` cells holds an odd number of tokens."""
    cells = np.bincount(((tokens >> np.uint64(20)) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    return np.packbits((cells & 1).astype(bool)).tobytes()


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(tokens, seed).sum(dtype=np.uint64).astype(_SIGNED)) for seed in (1, 2))


def _signed(n: int):
    """Per document the size of its set, its identity of 128 bits and its signature."""

    def written(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [_identity(s) for s in sets]
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "n": pa.array([len(s) for s in sets], pa.int64()),
            "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
            "signature": pa.array([row.tobytes() for row in signatures(sets)], pa.binary()),
            "cells": pa.array([parities(s) for s in sets], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for tokens in shingle_sets(batch.column(1), n):
                held.append(tokens)
                size += len(tokens) + 1
                if size > 1 << 16:
                    yield written(batch.column(0).slice(first, len(held)), held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield written(batch.column(0).slice(first, len(held)), held)

    return run


def chunk_keys(places: np.ndarray) -> np.ndarray:
    """For each signature its keys: for each chunk and each error allowed in it, the chunk's other values."""
    out = np.zeros((len(places), CHUNKS, WIDE), np.uint64)
    chunks = places.astype(np.uint64).reshape(-1, CHUNKS, WIDE)
    for error in range(WIDE):
        for i, place in enumerate(p for p in range(WIDE) if p != error):
            out[:, :, error] |= chunks[:, :, place] << np.uint64(16 * i)
        out[:, :, error] |= (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDE) + np.uint64(error)) << np.uint64(48)
    return out.reshape(len(places), -1)


def _places(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys = chunk_keys(_places(part.column(1)))
            nodes = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(_SIGNED), "node": nodes})


def _cells(packed: pa.Array) -> np.ndarray:
    # Unsigned: the count of bits of a negative number would be that of its absolute value.
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint64).reshape(-1, CELLS // 64)


def _may_link(na, nb, places_a, places_b, cells_a, cells_b, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs that fit in size, signature and parities, and how far their signatures are apart."""
    good = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))

    def of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return x[rows if len(x) > 1 else np.zeros_like(rows)]  # one row stands for all

    apart = (of(places_a, good) != of(places_b, good)).sum(1)
    good, apart = good[apart <= RADIUS], apart[apart <= RADIUS]
    unlike = np.bitwise_count(of(cells_a, good) ^ of(cells_b, good)).sum(1, dtype=np.int64)
    fits = unlike * (100 + percent) <= (100 - percent) * (of(na, good) + of(nb, good))
    return good[fits], apart[fits]


def _near(percent: int):
    """(a, b, apart) of the pairs (a, b, na, nb, signatures, cells) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                places = [_places(batch.column(i)) for i in (4, 5)]
                good, apart = _may_link(na, nb, *places, *(_cells(batch.column(i)) for i in (6, 7)), percent)
                some = batch.select([0, 1]).take(pa.array(good))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(apart.astype(np.int32))], names=["a", "b", "apart"])

    return run


def block_pairs(node, part, n, places, cells, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that may link, among the members of one or two blocks."""
    order = np.lexsort((node, part))
    node, part, n, places, cells = (x[order] for x in (node, part, n, places, cells))
    # Members of one component stand together: each is compared with what follows its component.
    behind = np.searchsorted(part, part, "right")
    found_a, found_b = [np.zeros(0, _SIGNED)], [np.zeros(0, _SIGNED)]
    for i in range(len(node)):
        if behind[i] < len(node):
            one, rest = slice(i, i + 1), slice(behind[i], None)
            fits, _ = _may_link(n[one], n[rest], places[one], places[rest], cells[one], cells[rest], percent)
            found_a.append(np.full(len(fits), node[i]))
            found_b.append(node[rest][fits])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return np.minimum(a, b), np.maximum(a, b)


def _across(percent: int):
    """Sorted rows (key, one, other, node, component, n, signature, cells): the pairs of each (key, one, other)."""

    def written(rows: dict[str, np.ndarray], edges: list[int]) -> pa.RecordBatch:
        pairs = [
            block_pairs(*(rows[c][i:j] for c in ("node", "component", "n", "places", "cells")), percent)
            for i, j in zip(edges[:-1], edges[1:], strict=True)
            if j > i + 1
        ]
        pairs.append((np.zeros(0, _SIGNED), np.zeros(0, _SIGNED)))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        ab = np.unique(np.column_stack([a, b]), axis=0)
        return pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(ab[:, 0]), "b": np.ascontiguousarray(ab[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("key", "one", "other", "node", "component", "n")
            now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            now["places"], now["cells"] = _places(batch.column(6)), _cells(batch.column(7))
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            new = np.zeros(len(now["key"]), bool)
            new[0] = True
            for c in ("key", "one", "other"):
                new[1:] |= now[c][1:] != now[c][:-1]
            edges = np.flatnonzero(new).tolist()
            yield written(now, edges)
            held = {c: x[edges[-1] :] for c, x in now.items()}  # may go on in the next batch
        if held is not None:
            yield written(held, [0, len(held["key"])])

    return run


def _texts_of(n: int, wanted):
    """Texts, compressed, whose id may be wanted, with the identity of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            some = batch.filter(pa.array(maybe_in(batch.column(0), wanted.value)))
            keys = [_identity(s) for s in shingle_sets(some.column(1), n)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": some.column(0), "k1": pa.array([k[0] for k in keys], pa.int64()),
                "k2": pa.array([k[1] for k in keys], pa.int64()),
                "text": pa.array([pack((t or "").encode()) for t in some.column(1).to_pylist()], pa.binary()),
            })

    return run


def _confirmed(n: int, percent: int):
    """Pairs (a, b, text of a, of b) whose whole sets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple = (None, None)
        for batch in batches:
            nodes, lefts, rights = (batch.column(i) for i in (0, 2, 3))
            kept = []
            for i, node in enumerate(nodes.to_pylist()):
                texts = [unpack(rights[i].as_py()).decode()]
                if node != last[0]:
                    texts.append(unpack(lefts[i].as_py()).decode())
                y, *x = shingle_sets(pa.array(texts, pa.string()), n)
                last = (node, x[0]) if x else last
                both = len(np.intersect1d(last[1], y, assume_unique=True))
                if 100 * both >= percent * (len(last[1]) + len(y) - both):
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents``."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = texts.mapInArrow(_signed(n), "doc_id long, n long, k1 long, k2 long, signature binary, cells binary")
    signed = stage(signed, "minhash-signatures")
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"), *[F.any_value(c).alias(c) for c in ("signature", "cells")]
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    facts = classes.select("node", "n", "signature", "cells")

    keys = classes.select("node", "signature").mapInArrow(_listed, "key long, node long")
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    lists = keys.join(leaders.filter("leader != last"), "key").select("key", "node", "leader")
    lists = stage(lists, "minhash-lists")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(ids.join(classes, "node").select("node", "k1", "k2", F.col("first_id").alias("doc_id")), "minhash-wanted")
        bits = spark.sparkContext.broadcast(id_bits(wanted))
        some = texts.mapInArrow(_texts_of(n, bits), "doc_id long, k1 long, k2 long, text binary")
        same = (F.col("t.k1") == F.col("w.k1")) & (F.col("t.k2") == F.col("w.k2")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
        found = some.alias("t").join(wanted.alias("w"), same).select("w.node", "t.text").dropDuplicates(["node"])
        found = stage(found, "minhash-texts")
        whole = pairs.join(found.toDF("b", "text_b"), "b").join(found.toDF("a", "text_a"), "a")
        return stage(whole.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(n, percent), "a long, b long"), "minhash-links")

    def within(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, apart) of the distinct pairs that may link."""
        sides = pairs.distinct().join(facts.toDF("b", "nb", "sb", "cb"), "b").join(facts.toDF("a", "na", "sa", "ca"), "a")
        sides = sides.select("a", "b", "na", "nb", "sa", "sb", "ca", "cb")
        return stage(sides.mapInArrow(_near(percent), "a long, b long, apart int"), name)

    def grouped(links_now: DataFrame) -> DataFrame:
        groups = links.components(links_now)
        named = lists.select("key", "node").join(groups, "node", "left")
        return stage(named.select("key", "node", F.coalesce("component", "node").alias("component")), "minhash-named")

    starred = lists.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    near = confirmed(within(starred, "minhash-starred").select("a", "b"))
    named = grouped(near)
    for turn in range(ROUNDS):
        drawn = F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("h"), "node", "component")
        heads = named.groupBy("key").agg(F.min(drawn).alias("x"), F.min("component").alias("low"), F.max("component").alias("high"))
        heads = heads.filter("low != high").select("key", F.col("x.node").alias("a"), F.col("x.component").alias("of"))
        pairs = named.join(heads, "key").filter("component != of").select("a", F.col("node").alias("b"))
        best = within(pairs, "minhash-drawn").groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b")
        near = near.unionByName(confirmed(stage(best, "minhash-nearest")))
        named = grouped(near)

    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("members")).filter("parts > 1")
    # Members of a large component have blocks of their own (``of`` names it), others share blocks.
    split = sizes.join(split, "key").select(
        "key", "component", F.when(F.col("k") > BLOCK, F.col("component")).alias("of"),
        F.ceil(F.when(F.col("k") > BLOCK, F.col("k")).otherwise(F.col("members")) / BLOCK).cast("long").alias("blocks"),
    )
    member = named.join(split, ["key", "component"]).withColumn(
        "block", F.xxhash64("of", F.pmod(F.xxhash64(F.when(F.col("of").isNull(), F.col("component")).otherwise(F.col("node"))), "blocks"))
    )
    member = stage(member.select("key", "node", "component", "of", "block"), "minhash-members")
    blocks = member.select("key", "of", "block").distinct()
    pairs = blocks.toDF("key", "of_a", "one").join(blocks.toDF("key", "of_b", "other"), "key")
    # A block of one component alone has nothing to compare inside, nor with another of it.
    pairs = pairs.filter("one <= other and (of_a is null or of_b is null or of_a != of_b)").select("key", "one", "other")
    sides = pairs.select("key", "one", "other", F.col("one").alias("block")).unionByName(
        pairs.filter("one != other").select("key", "one", "other", F.col("other").alias("block"))
    )
    dealt = member.select("key", "block", "node", "component").join(sides, ["key", "block"]).join(facts, "node")
    dealt = dealt.select("key", "one", "other", "node", "component", "n", "signature", "cells")
    dealt = dealt.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    across = stage(dealt.mapInArrow(_across(percent), "a long, b long").distinct(), "minhash-across")
    groups = links.components(near.unionByName(confirmed(across)))

    members = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_set = members.join(names, "component").select("k1", "k2", "component_id")
    found = signed.select("doc_id", "n", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT x, y FROM shared WHERE 100 * k >= 80 * (nx + ny - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT r.x, edge.y FROM reach r JOIN edge ON r.y = edge.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.y, s.doc_id)) AS component_id,
  least(s.doc_id, coalesce(low.y, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN low ON s.doc_id = low.x
"""


@query("op11_minhash_dedup", OP11_SQL)
def op11_minhash_dedup(spark, sf_dir):
    """Components of all documents by 2-word shingles that overlap by 80 % of their union."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)
