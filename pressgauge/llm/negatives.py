"""Hard negatives by best-first search in STR-packed R-trees of bounding boxes.

A row's score is its integer inner product with an anchor. An anchor's positives
are the first rows of its label, by score, then id. For each positive, its hard
negatives are the first rows of other labels whose score lies in a window below
the positive's score.

1. Rows of one id count once. Of rows with equal vector and label only those of
   the smallest ids can be among the first, so as many as are looked for stay
   (counted before and after the shuffle); anchors of equal vector and label are
   one query.
2. Tiles. Sort-tile-recursive cuts along the three coordinates of greatest
   variance, fitted on a sample of ``sample`` rows, give each row one of at most
   4,096 tiles. A tile of more than ``part_rows`` rows is dealt to parts. Every row
   is in the tree: within a part, rows are packed by the same rule to leaves
   of ``LEAF`` rows, ``FAN`` boxes to a box above.
3. Bounds. A box holds each coordinate in an interval, so a query's product with
   it lies in the sum of the coordinates' product intervals. What a query finds
   in the fitted sample bounds its k-th score from below.
4. Chunks of near queries meet the tiles whose box can hold something for them:
   blocks of the query set against all rows, in waves of bounded size. In a part,
   a best-first queue takes boxes by their upper bound and drops those outside
   all windows or strictly below the k-th score found; at equal scores smaller
   ids win, so a box that only reaches the k-th score is opened.
5. The first of all parts are merged by (score, id).

The result is exact; the sample decides only how much is pruned.

Defined results: rows with null id, label or vector, or a null or non-finite
component take no part; of different rows with one id the least (by vector, then
label) counts; a shorter vector is filled up with zeros; scores must fit in 64
bits; an anchor without positives or negatives has no rows, nor has an empty
table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import query, stage, table

LEAF, FAN = 64, 16
CHUNK, WAVE = 256, 64
SLABS = 16  # to the third power: tiles at most
_NONE, _MOST = -(2**63), 2**63 - 1


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): components become ``floor(scale * x)``; rows with missing parts go."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; shorter lists are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths(), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lists(m: np.ndarray) -> pa.Array:
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).reshape(-1)))


# -- The tree -----------------------------------------------------------------------

@dataclass
class Cuts:
    """Sort-tile-recursive cuts along some coordinates: slabs of equal size, cut again along the next."""

    axes: list[int]
    edges: list[np.ndarray]

    def tiles(self, v: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(v), np.int64)
        for axis, edges in zip(self.axes, self.edges, strict=True):
            tile = tile * (edges.shape[1] + 1) + (edges[tile] <= v[:, axis, None]).sum(1)
        return tile


def fitted_cuts(v: np.ndarray, slabs: int) -> Cuts:
    axes = np.argsort(-v.var(0), kind="stable")[:3].tolist() if len(v) else []
    cuts = Cuts([], [])
    for axis in axes if slabs > 1 else []:
        tile = cuts.tiles(v)
        count = int(np.prod([e.shape[1] + 1 for e in cuts.edges], dtype=np.int64))
        edges = np.zeros((count, slabs - 1), np.int64)
        for t in range(count):
            some = np.sort(v[tile == t, axis])
            if len(some):
                edges[t] = some[np.minimum(np.arange(1, slabs) * len(some) // slabs, len(some) - 1)]
        cuts = Cuts([*cuts.axes, axis], [*cuts.edges, edges])
    return cuts


def packed_order(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which each ``leaf`` of them make a leaf: sort, tile, recurse on the next coordinate."""
    axes = np.argsort(-v.var(0), kind="stable").tolist() if len(v) else []

    def order(rows: np.ndarray, depth: int) -> np.ndarray:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == min(len(axes), 4):
            return rows
        rows = rows[np.argsort(v[rows, axes[depth]], kind="stable")]
        left = min(len(axes), 4) - depth
        slabs = int(np.ceil(leaves ** (1 / left)))
        size = -(-leaves // slabs) * leaf
        return np.concatenate([order(rows[i : i + size], depth + 1) for i in range(0, len(rows), size)])

    return order(np.arange(len(v)), 0)


class Tree:
    """Boxes over rows that stand in packed order; level 0 are the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.ids, self.labels, self.v, self.leaf, self.fan = ids, labels, v, leaf, fan
        at = np.arange(0, len(v), leaf)
        bits = np.left_shift(np.uint64(1), (labels % 64).astype(np.uint64))
        levels = [(np.minimum.reduceat(v, at), np.maximum.reduceat(v, at), np.bitwise_or.reduceat(bits, at))]
        while len(levels[-1][0]) > 1:
            low, high, some = levels[-1]
            at = np.arange(0, len(low), fan)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(some, at)))
        self.levels = levels

    def search(self, q: np.ndarray, label: int, same: bool, windows: "Windows") -> int:
        """Offer to ``windows`` all rows that can be among their first; returns the number of rows looked at."""
        bit = np.uint64(1) << np.uint64(label % 64)
        heap: list[tuple[int, int, int]] = []

        def push(level: int, first: int, last: int) -> None:
            low, high, some = (x[first:last] for x in self.levels[level])
            a, b = q * low, q * high
            top, bottom = np.maximum(a, b).sum(1), np.minimum(a, b).sum(1)
            may = windows.may_hold(bottom, top)
            if same:
                may &= (some & bit) != 0
            for i in np.flatnonzero(may).tolist():
                heapq.heappush(heap, (-int(top[i]), level, first + i, int(bottom[i])))

        push(len(self.levels) - 1, 0, 1)
        seen = 0
        while heap:
            top, level, node, bottom = heapq.heappop(heap)
            if -top < windows.least():
                break
            if not windows.may_hold_one(bottom, -top):
                continue
            if level:
                push(level - 1, node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0])))
                continue
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            scores = self.v[rows] @ q
            seen += len(scores)
            fits = (self.labels[rows] == label) if same else (self.labels[rows] != label)
            windows.offer(scores[fits], self.ids[rows][fits])
        return seen


class Windows:
    """The first ``k`` rows of each window of scores [low, high], by score, then id."""

    def __init__(self, low: list[int], high: list[int], k: int, known: list[int]):
        self.low, self.high, self.k = np.array(low, np.int64), np.array(high, np.int64), k
        self.bound = np.maximum(self.low, np.array(known, np.int64))  # scores strictly below are no use
        self.scores = [np.zeros(0, np.int64) for _ in low]
        self.ids = [np.zeros(0, np.int64) for _ in low]

    def least(self) -> int:
        return int(self.bound.min())

    def may_hold(self, bottom: np.ndarray, top: np.ndarray) -> np.ndarray:
        return ((top[:, None] >= self.bound) & (bottom[:, None] <= self.high)).any(1)

    def may_hold_one(self, bottom: int, top: int) -> bool:
        return bool(((top >= self.bound) & (bottom <= self.high)).any())

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores) or scores.max() < self.bound.min():
            return
        for w in range(len(self.low)):
            good = (scores >= self.bound[w]) & (scores <= self.high[w])
            if not good.any():
                continue
            s, i = np.concatenate([self.scores[w], scores[good]]), np.concatenate([self.ids[w], ids[good]])
            first = np.lexsort((i, -s))[: self.k]
            self.scores[w], self.ids[w] = s[first], i[first]
            if len(first) == self.k:
                self.bound[w] = max(self.bound[w], self.scores[w][-1])


# -- On Spark -----------------------------------------------------------------------

def _tiled(cuts: Cuts, dims: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = cuts.tiles(matrix(batch.column(names.index("v")), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=[*names, "tile"])

    return run


def _packed(dims: int):
    """Rows of a part in packed order, in blocks of some leaves, each with its box."""

    def run(rows: pa.Table) -> pa.Table:
        v = matrix(rows["v"], dims)
        order = packed_order(v)
        at = np.arange(0, len(v), LEAF * FAN)
        v = v[order]
        pieces = np.split(np.arange(len(v)), at[1:])
        ids, labels = (rows[c].to_numpy()[order] for c in ("vec_id", "label"))
        return pa.table({
            "tile": np.full(len(at), rows["tile"][0].as_py()), "part": np.full(len(at), rows["part"][0].as_py()),
            "block": np.arange(len(at)), "low": _lists(np.minimum.reduceat(v, at)), "high": _lists(np.maximum.reduceat(v, at)),
            "ids": pa.array([ids[p].tobytes() for p in pieces], pa.binary()),
            "labels": pa.array([labels[p].tobytes() for p in pieces], pa.binary()),
            "rows": pa.array([v[p].tobytes() for p in pieces], pa.binary()),
        })

    return run


BLOCKS = "tile long, part long, block long, low array<long>, high array<long>, ids binary, labels binary, rows binary"


@dataclass
class Sample:
    """The rows that cuts are fitted on; what a query finds among them bounds what it finds among all."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def known(self, q: np.ndarray, label: int, same: bool, low: list[int], high: list[int], k: int) -> list[int]:
        scores = (self.v @ q)[(self.labels == label) if same else (self.labels != label)]
        out = []
        for a, b in zip(low, high, strict=True):
            some = scores[(scores >= a) & (scores <= b)]
            out.append(int(np.partition(some, len(some) - k)[len(some) - k]) if len(some) >= k else _NONE)
        return out


def _chunked(sample, dims: int, k: int, same: bool):
    """Queries of one tile, in chunks with the box of their vectors and the union of their windows."""

    def run(rows: pa.Table) -> pa.Table:
        v = matrix(rows["v"], dims)
        order = packed_order(v, CHUNK)
        rows, v = rows.take(pa.array(order)), v[order]
        labels, out = rows["label"].to_numpy(), []
        keys, lows, highs = (rows[c].to_pylist() for c in ("keys", "lows", "highs"))
        known = [sample.value.known(v[i], int(labels[i]), same, lows[i], highs[i], k) for i in range(len(v))]
        for a in range(0, len(v), CHUNK):
            b = min(a + CHUNK, len(v))
            bounds = [max(x, y) for i in range(a, b) for x, y in zip(lows[i], known[i], strict=True)]
            out.append({
                "chunk": rows["query"][a].as_py(), "low": v[a:b].min(0).tolist(), "high": v[a:b].max(0).tolist(),
                "least": min(bounds), "most": max(h for i in range(a, b) for h in highs[i]),
                "queries": rows["query"].to_numpy()[a:b].tobytes(), "labels": labels[a:b].tobytes(), "rows": v[a:b].tobytes(),
                "sizes": [len(x) for x in lows[a:b]], "keys": sum(keys[a:b], []), "lows": sum(lows[a:b], []), "highs": sum(highs[a:b], []),
                "known": sum(known[a:b], []),
            })
        return pa.Table.from_pylist(out, schema=_CHUNKS)

    return run


_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64()),
    ("queries", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("sizes", pa.list_(pa.int64())),
    ("keys", pa.list_(pa.int64())), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())),
])
CHUNKS = (
    "chunk long, low array<long>, high array<long>, least long, most long, queries binary, labels binary, rows binary, "
    "sizes array<long>, keys array<long>, lows array<long>, highs array<long>, known array<long>"
)


def _met(boxes, dims: int):
    """(chunk, tile) wherever a query of the chunk may find something in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, low, high = boxes.value
        for batch in batches:
            ql, qh = matrix(batch.column(1), dims), matrix(batch.column(2), dims)
            least, most = (batch.column(i).to_numpy() for i in (3, 4))
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                ends = np.stack([ql[i] * low, ql[i] * high, qh[i] * low, qh[i] * high])
                may = (ends.max(0).sum(1) >= least[i]) & (ends.min(0).sum(1) <= most[i])
                yield pa.RecordBatch.from_pydict({"chunk": np.full(int(may.sum()), chunk), "tile": tiles[may]})

    return run


def _searched(dims: int, k: int, same: bool):
    """Cogroup of a part's blocks and a wave of chunks: the first rows of every window in this part."""

    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if blocks.num_rows and chunks.num_rows:
            blocks = blocks.sort_by("block")

            def joined(name: str) -> np.ndarray:
                return np.frombuffer(b"".join(blocks[name].to_pylist()), np.int64)

            tree = Tree(joined("ids"), joined("labels"), joined("rows").reshape(-1, dims))
            for c in chunks.to_pylist():
                ids, labels = np.frombuffer(c["queries"], np.int64), np.frombuffer(c["labels"], np.int64)
                v, at = np.frombuffer(c["rows"], np.int64).reshape(-1, dims), 0
                for i, size in enumerate(c["sizes"]):
                    some = slice(at, at + size)
                    windows = Windows(c["lows"][some], c["highs"][some], k, c["known"][some])
                    tree.search(v[i], int(labels[i]), same, windows)
                    for key, scores, found in zip(c["keys"][some], windows.scores, windows.ids, strict=True):
                        out.append((np.full(len(found), ids[i]), np.full(len(found), key), scores, found))
                    at += size
        columns = [np.concatenate([np.zeros(0, np.int64), *(o[j] for o in out)]) for j in range(4)]
        return pa.table(dict(zip(("query", "key", "score", "vec_id"), columns, strict=True)))

    return run


FOUND = "query long, key long, score long, vec_id long"


class Index:
    """The packed rows of a table on Spark, and searches in them."""

    def __init__(self, rows: DataFrame, copies: int, tile_rows: int, part_rows: int, sample: int):
        """``rows``: staged (vec_id, label, v). Of equal (v, label), ``copies`` smallest ids are kept."""
        self.spark, self.part_rows = rows.sparkSession, part_rows
        n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.dims = max(dims or 0, 1)
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        held = Sample(some["vec_id"].to_numpy(), some["label"].to_numpy(), matrix(some["v"], self.dims))
        self.sample = self.spark.sparkContext.broadcast(held)
        self.cuts = fitted_cuts(held.v, min(SLABS, int(np.ceil((n / tile_rows) ** (1 / 3) - 1e-9))))
        equal = Window.partitionBy("v", "label").orderBy("vec_id")
        points = rows.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= copies).drop("nth")
        points = stage(self.tiled(points), "negatives-points")
        self.blocks = stage(self.parted(points, part_rows).applyInArrow(_packed(self.dims), BLOCKS), "negatives-blocks")
        ends = self.blocks.select("tile", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x"))
        ends = ends.groupBy("tile", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        # Two numbers for each axis of 4,096 tiles at most.
        ends = ends.orderBy("tile", "axis").toArrow()
        low, high = (ends[c].to_numpy().reshape(-1, self.dims) for c in ("low", "high"))
        self.boxes = self.spark.sparkContext.broadcast((ends["tile"].to_numpy()[:: self.dims], low, high))

    def tiled(self, rows: DataFrame) -> DataFrame:
        schema = rows.schema.simpleString()[len("struct<") : -1]
        return rows.mapInArrow(_tiled(self.cuts, self.dims, rows.columns), f"{schema},tile:bigint")

    def parted(self, rows: DataFrame, size: int):
        """Rows grouped by tile, dealt to parts of about ``size`` rows."""
        counts = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
        key = F.pmod(F.xxhash64(*[c for c in ("vec_id", "query") if c in rows.columns]), F.ceil(F.col("n") / size))
        # At most 4,096 rows.
        return rows.join(F.broadcast(counts), "tile").withColumn("part", key.cast("long")).drop("n").groupBy("tile", "part")

    def first(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, key, score, vec_id, rank): the first ``k`` of every window of ``queries``.

        ``queries`` has query, label, v and the windows' keys, lows and highs.
        """
        chunks = self.parted(self.tiled(queries), CHUNK * 16).applyInArrow(_chunked(self.sample, self.dims, k, same), CHUNKS)
        chunks = stage(chunks, "negatives-chunks")
        met = chunks.select("chunk", "low", "high", "least", "most").mapInArrow(_met(self.boxes, self.dims), "chunk long, tile long")
        waves = max(1, -(-chunks.count() // WAVE))
        met = met.withColumn("wave", F.pmod(F.xxhash64("chunk"), F.lit(waves)))
        met = stage(met, "negatives-met")
        parts = self.blocks.groupBy("tile").agg(F.collect_set("part").alias("parts"))
        body = chunks.select("chunk", "queries", "labels", "rows", "sizes", "keys", "lows", "highs", "known")
        asking = met.join(parts, "tile").select("tile", "wave", "chunk", F.explode("parts").alias("part")).join(body, "chunk")
        asking = asking.toDF(*asking.columns)  # columns of its own: both sides come from ``met``
        asked = self.blocks.drop("low", "high").join(met.select("tile", "wave").distinct(), "tile")
        keys = ("tile", "part", "wave")
        found = asked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_searched(self.dims, k, same), FOUND)
        order = Window.partitionBy("query", "key").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: str,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    tile_rows: int = 8192,
    part_rows: int = 65_536,
    sample: int = 20_000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor.

    ``rows`` is (vec_id, label, v) with whole numbers, as from ``quantised``;
    ``anchors`` is a condition on it. A negative's score lies between the two
    percentages of the positive's.
    """
    rows = rows.filter("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v")
    one = stage(one, "negatives-rows")
    index = Index(one, max(positives + 1, negatives), tile_rows, part_rows, sample)

    queries = one.filter(anchors).groupBy("v", "label").agg(F.min("vec_id").alias("query"))
    queries = stage(queries, "negatives-queries")
    everything = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("keys", 0), ("lows", _NONE), ("highs", _MOST))]
    near = index.first(queries.select("query", "label", "v", *everything), positives + 1, True)
    near = stage(near.select("query", "score", F.col("vec_id").alias("positive"), "rank"), "negatives-positives")

    # For each score of a positive, the window of its negatives.
    below = near.select("query", "score", *[(F.col("score") * x).alias(n) for n, x in zip(("low", "high"), percent, strict=True)])
    below = below.select(
        "query", F.col("score").alias("key"), F.expr("-((-low - pmod(-low, 100)) div 100)").alias("least"),
        F.expr("(high - pmod(high, 100)) div 100").alias("most"),
    ).filter("least <= most").distinct()
    below = below.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("key", "least", "most"))).alias("w"))
    asked = queries.join(below, "query").select(
        "query", "label", "v", F.col("w.key").alias("keys"), F.col("w.least").alias("lows"), F.col("w.most").alias("highs")
    )
    far = stage(index.first(asked, negatives, False), "negatives-found")
    far = far.groupBy("query", F.col("key").alias("score")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score")))).alias("negatives")
    )
    # Positives without negatives stay: they count among an anchor's first.
    lists = near.join(far, ["query", "score"], "left").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive", "score", "negatives"))).alias("positives")
    )
    # Many anchors can be one query; adaptive execution splits that side of the join.
    answers = queries.join(lists, "query").select("v", "label", "positives")
    mine = F.slice(F.filter("positives", lambda p: p.positive != F.col("vec_id")), 1, positives)
    found = one.filter(anchors).join(answers, ["v", "label"]).select(F.col("vec_id").alias("anchor_id"), F.explode(mine).alias("p"))
    found = found.select("anchor_id", "p.positive", F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("x"))
    return found.select(
        "anchor_id", F.col("positive").alias("positive_id"), F.col("x.rank").cast("int").alias("rank"),
        F.col("x.negative").alias("negative_id"), "positive_score", "x.negative_score",
    )


OP12_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
  p.positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, sf_dir):
    """Five hard negatives for each of five positives of every hundredth row, from all rows."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")
