"""N-gram Jaccard join by multiple global token orders.

Two documents link when their sets of word n-grams overlap by a given share of
their union. Linked sets must share a token among the first
``n - ceil(share * n) + 1`` of each, under any one global order. So every order
is a filter of its own, and a pair must pass all of them before it is verified.

All orders put rare tokens first. How rare a token is comes from a table of
counts over all documents, of fixed size (``WIDTH`` cells, a token's cell is
its hash); any value is right, since an order only has to be the same for all
documents. Within a class of counts, each order has a hash of its own.

1. Documents of equal sets form one class; one of them stands for it.
2. Under the first order, every class lists its prefix tokens. In the list of
   a token, each class is paired with the smallest one. Verified pairs are
   joined to components.
3. In lists whose classes are still in different components, the other pairs
   across components are tried. Pairs inside a component need no test.
4. Pairs must agree in size and in the parities of ``BITS`` cells: the cells
   whose parity differs are at most the tokens that only one of the two has.
   In step 3 the members of a list are compared by these bits in blocks inside
   a task, and only pairs that pass become rows.
5. Pairs that pass the other orders too are verified on their whole sets.

Each filter is a necessary condition, so no link is lost. Tokens are 64-bit
hashes of n-grams; a set's identity has 128 bits.

Defined results: null text, or one without words, has an empty set and links
with nothing; fewer than ``n`` words are one token; repeated rows are in one
component; a null ``doc_id`` is never the smallest; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import links
from pressgauge.llm.common import id_bits, maybe_in, query, stage, table
from pressgauge.llm.vectors import mixed, shingle_sets

WIDTH, BLOCK = 1 << 20, 1 << 14
BITS = 2048

_SIGNED = np.int64


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    return (
        int(mixed(tokens, 1).sum(dtype=np.uint64).astype(_SIGNED)),
        int(mixed(tokens, 2).sum(dtype=np.uint64).astype(_SIGNED)),
    )


def _needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _first(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The tokens of the prefix under an order: rare ones first, then by the order's hash."""
    length = len(tokens) - _needed(len(tokens), percent) + 1
    if length >= len(tokens):
        return tokens
    rank = classes[tokens & np.uint64(WIDTH - 1)].astype(np.uint64) << np.uint64(58)
    rank |= mixed(tokens, 10 + order) >> np.uint64(6)
    return tokens[np.argpartition(rank, length - 1)[:length]]


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Whether each of ``BITS`` cells holds an odd number of tokens."""
    cells = np.bincount(((tokens >> np.uint64(24)) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((cells & 1).astype(bool)).view(_SIGNED)


def _signatures(n: int):
    """Per document its set's size, identity and parities; at the end the task's counts, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDTH, np.uint32)
        for batch in batches:
            sizes, ids, bits = [], [], [np.zeros(0, _SIGNED)]
            for tokens in shingle_sets(batch.column(1), n):
                sizes.append(len(tokens))
                ids.append(_identity(tokens))
                bits.append(_parities(tokens))
                np.add.at(counts, tokens & np.uint64(WIDTH - 1), np.uint32(1))
            k = len(sizes)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()),
                "k1": pa.array([x[0] for x in ids], pa.int64()), "k2": pa.array([x[1] for x in ids], pa.int64()),
                "bits": pa.ListArray.from_arrays(
                    pa.array(np.arange(k + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits))
                ),
                "block": pa.nulls(k, pa.int32()), "counts": pa.nulls(k, pa.binary()),
            })
        k = WIDTH // BLOCK
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": none, "n": none, "k1": none, "k2": none, "bits": pa.nulls(k, pa.list_(pa.int64())),
            "block": pa.array(range(k), pa.int32()),
            "counts": pa.array([counts[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(k)], pa.binary()),
        })

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for cells in pdf["counts"]:
        total += np.frombuffer(cells, np.uint32)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.log2(total + 1).astype(np.uint8).tobytes()]})


def _prefixes(n: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ids, prefixes = [], [], []
            for row, tokens in enumerate(shingle_sets(batch.column(1), n)):
                if len(tokens):
                    kept.append(row)
                    ids.append(_identity(tokens))
                    prefixes.append(_first(tokens, classes.value, 0, percent))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(_SIGNED)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(kept, pa.int64())),
                "k1": pa.array([x[0] for x in ids], pa.int64()), "k2": pa.array([x[1] for x in ids], pa.int64()),
                "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            })

    return run


def _candidate_texts(n: int, wanted):
    """Texts, compressed, whose id may be a candidate, with their set's identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            may = maybe_in(batch.column(0), wanted.value)
            some = batch.filter(pc.and_(pa.array(may), batch.column(1).is_valid()))
            keys = [_identity(t) for t in shingle_sets(some.column(1), n)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": some.column(0), "k1": pa.array([x[0] for x in keys], pa.int64()),
                "k2": pa.array([x[1] for x in keys], pa.int64()),
                "text": pa.array([pack(t.encode()) for t in some.column(1).to_pylist()], pa.binary()),
            })

    return run


def _verified(n: int, percent: int, orders: int, classes):
    """Pairs that share a prefix token under every order, then those that overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        unpack = zstandard.ZstdDecompressor().decompress

        def sets(packed: pa.Array) -> Iterator[np.ndarray]:
            return shingle_sets(pa.array([unpack(x).decode() for x in packed.to_pylist()], pa.string()), n)

        for batch in batches:
            kept = []
            step = 64  # pairs at a time, so that long texts do not pile up
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                nodes, right = part.column(0).to_pylist(), sets(part.column(3))
                lefts = part.column(2)
                for i, y in enumerate(right):
                    if nodes[i] != last[0]:
                        tokens = next(sets(lefts.slice(i, 1)))
                        last = (nodes[i], [tokens, *(_first(tokens, classes.value, k, percent) for k in range(1, orders))])
                    x = last[1][0]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    if not all(
                        np.isin(last[1][k], _first(y, classes.value, k, percent)).any() for k in range(1, orders)
                    ):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        kept.append(begin + i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return run


def _across(percent: int):
    """Pairs of a list across components that agree in size and parities: (a, the others) for each member."""

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(rows["node"])
        node, part, n, bits = (rows[c][order] for c in ("node", "component", "n", "bits"))
        step = max(1, (1 << 18) // len(node))
        for i in range(0, len(node), step):
            mine = slice(i, i + step)
            unlike = np.zeros((len(node[mine]), len(node)), np.int64)
            for word in range(bits.shape[1]):
                unlike += np.bitwise_count(bits[mine, word][:, None] ^ bits[:, word])
            both = n[mine][:, None] + n
            may = unlike * (100 + percent) <= (100 - percent) * both
            may &= 100 * np.minimum(n[mine][:, None], n) >= percent * np.maximum(n[mine][:, None], n)
            may &= (part[mine][:, None] != part) & (node[mine][:, None] < node)
            for row in np.flatnonzero(may.any(1)):
                yield int(node[i + row]), node[may[row]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(groups: list[dict]) -> pa.RecordBatch:
            found = [p for g in groups if len(g["node"]) > 1 for p in pairs(g)]
            ends = np.cumsum([0, *(len(b) for _, b in found)]).astype(np.int32)
            others = np.concatenate([np.zeros(0, _SIGNED), *(b for _, b in found)])
            return pa.RecordBatch.from_pydict({
                "a": pa.array([a for a, _ in found], pa.int64()),
                "others": pa.ListArray.from_arrays(pa.array(ends), pa.array(others)),
            })

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("token", "node", "component", "n")
            now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            # Unsigned: the count of bits of a negative number would be that of its absolute value.
            now["bits"] = batch.column(4).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            edges = np.flatnonzero(np.concatenate([[True], now["token"][1:] != now["token"][:-1]])).tolist()
            yield written([{c: x[a:b] for c, x in now.items()} for a, b in zip(edges[:-1], edges[1:], strict=True)])
            held = {c: x[edges[-1] :] for c, x in now.items()}  # its list may go on in the next batch
        if held is not None:
            yield written([held])

    return run


def linked(documents: DataFrame, n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents``."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stage(
        texts.mapInArrow(
            _signatures(n), "doc_id long, n long, k1 long, k2 long, bits array<long>, block int, counts binary"
        ),
        "jaccard-signatures",
    )
    blocks = first.filter("block is not null").select("block", "counts").groupBy("block")
    cells = dict(blocks.applyInPandas(_summed, "block int, counts binary").collect())
    classes = spark.sparkContext.broadcast(
        np.frombuffer(b"".join(bytes(cells[b]) for b in sorted(cells)) or bytes(WIDTH), np.uint8)
    )
    signatures = first.filter("block is null").select("doc_id", "n", "k1", "k2")
    sets = first.filter("block is null").filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.any_value("bits").alias("bits")
    )
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "jaccard-sets")

    prefixes = texts.mapInArrow(_prefixes(n, percent, classes), "doc_id long, k1 long, k2 long, prefix array<long>")
    own = prefixes.alias("p").join(
        sets.alias("s"),
        (F.col("p.k1") == F.col("s.k1"))
        & (F.col("p.k2") == F.col("s.k2"))
        & F.col("p.doc_id").eqNullSafe(F.col("s.first_id")),
    )
    postings = own.select("s.node", F.explode("p.prefix").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    lists = postings.join(leaders.filter("leader != last"), "token").select("token", "node", "leader")
    lists = stage(lists, "jaccard-lists")

    facts = sets.select("node", "n", "bits")
    alike = f"""100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * aggregate(
        zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y) <= {100 - percent} * (na + nb)"""

    def verify(pairs: DataFrame) -> DataFrame:
        known = pairs.join(facts.toDF("a", "na", "bits_a"), "a").join(facts.toDF("b", "nb", "bits_b"), "b")
        pairs = stage(known.filter(alike).select("a", "b"), "jaccard-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(ids.join(sets, "node").select("node", "k1", "k2", F.col("first_id").alias("doc_id")), "jaccard-ids")
        bits = spark.sparkContext.broadcast(id_bits(wanted))
        some = texts.mapInArrow(_candidate_texts(n, bits), "doc_id long, k1 long, k2 long, text binary")
        some = some.dropDuplicates(["k1", "k2", "doc_id"])
        found = some.alias("t").join(
            wanted.alias("w"),
            (F.col("t.k1") == F.col("w.k1"))
            & (F.col("t.k2") == F.col("w.k2"))
            & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")),
        )
        found = stage(found.select("w.node", "t.text"), "jaccard-texts")
        with_b = pairs.join(found.toDF("b", "text_b"), "b")
        whole = with_b.join(found.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
        return stage(whole.mapInArrow(_verified(n, percent, orders, classes), "a long, b long"), "jaccard-links")

    starred = lists.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    near = verify(starred)
    groups = stage(links.components(near), "jaccard-components")

    named = lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named, "jaccard-named")
    split = named.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("k")
    )
    rest = named.filter("node != leader").join(split.filter("low != high and k > 2").select("token"), "token")
    rest = rest.join(facts, "node").select("token", "node", "component", "n", "bits")
    dealt = rest.repartition("token").sortWithinPartitions("token")
    others = dealt.mapInArrow(_across(percent), "a long, others array<long>")
    # A pair is found in the list of each token that it shares: made one before it becomes a row.
    others = others.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    across = stage(others.select("a", F.explode("others").alias("b")), "jaccard-across")
    near = near.unionByName(verify(across))
    groups = links.components(near)

    members = sets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named_sets = members.join(names, "component").select("k1", "k2", "component_id")
    return signatures.join(named_sets, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def representatives(documents: DataFrame, **options) -> DataFrame:
    """The documents with the smallest id of their component, in their own columns.

    Documents without an id stay; of rows of equal id and text one stays.
    """
    found = stage(linked(documents, **options), "jaccard-found")
    gone = found.filter("doc_id is not null and doc_id != component_id").select("doc_id").distinct()
    gone = stage(gone, "jaccard-gone")
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    twice = stage(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "jaccard-twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_anti").select(*documents.columns)
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").select(*documents.columns).dropDuplicates(["doc_id", "text"]))


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark, sf_dir):
    """Components of all documents by 4-word shingles that overlap by 85 % of their union."""
    return linked(table(spark, sf_dir, "documents"), n=4, percent=85)
