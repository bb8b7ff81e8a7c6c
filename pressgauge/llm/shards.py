"""Token ids in training order: fixed-stride binary shards in a keyed, reproducible order.

1. Documents become token ids, each followed by ``end``, one after another in
   the order in which the tasks read them. The ids are written once; a task's
   running position in them gives each document its place in the whole stream.
2. The stream is cut in sequences of ``length`` ids, the last one padded with
   ``end``. A Feistel network over the next power of four, keyed and walked
   until it lands below the number of sequences, permutes their numbers: the
   result is the sequence's global slot.
3. Slot ``s`` is record ``s % per_shard`` of shard ``s // per_shard``. A shard is
   put together by one task and written under a temporary name that is then
   renamed, so that a lost executor leaves no half shard.

Every record has the same size. A reader finds slot ``s`` at byte
``(s % per_shard) * stride`` of its shard and resumes there.

Defined results: null or empty texts add no ids; repeated rows are repeated in
the stream; special-token strings in texts are plain text; an empty table gives
no shard and no rows; other columns are ignored. Ids are unsigned 16-bit
numbers if all fit, else 32-bit ones, little-endian.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import query, stage, table
from pressgauge.llm.substrings import _read, _slices, _written
from pressgauge.llm.vectors import mixed
from pressgauge.session import fresh_path

# Fixed value: how the vocabulary's text is split before its merges apply.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary: a file of base64 tokens and ranks, found at this path on every machine."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    end: int = 50256

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.end < 1 << 16 else "<u4")


@lru_cache(maxsize=4)
def encoding(tokenizer: Tokenizer):
    import tiktoken

    with open(tokenizer.path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("given", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a keyed permutation of ``range(n)`` sends ``numbers``."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(numbers).astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> half, x & mask
        for r in range(rounds):
            left, right = right, left ^ (mixed(right + np.uint64(1), key * 64 + r + 1) & mask)
        x = (left << half) | right
        out[walking] = x
        walking[walking] = x >= np.uint64(n)
    return out.astype(np.int64)


def _tokenized(tokenizer: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoding(tokenizer).encode_ordinary, tokenizer.kind
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                ids = [np.array([*encode(t), tokenizer.end], kind) if t else None for t in part.column(1).to_pylist()]
                kept = [i for i, x in enumerate(ids) if x is not None]
                sizes = np.array([len(ids[i]) for i in kept], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "task": pa.array([task] * len(kept), pa.int64()),
                    "at": pa.array(at + np.cumsum(sizes) - sizes),
                    "doc_id": part.column(0).take(pa.array(kept, pa.int64())),
                    "n": pa.array(sizes), "ids": pa.array([ids[i].tobytes() for i in kept], pa.binary()),
                })
                at += int(sizes.sum())

    return run


def _dealt(kind: np.dtype, length: int, per_shard: int, n: int, key: int):
    """Pieces of documents by shard: where they go in it, and their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                docs = part.column(0)
                first, sizes = (part.column(i).to_numpy() for i in (1, 2))
                ids = np.frombuffer(b"".join(part.column(3).to_pylist()), kind)
                low, high = first // length, (first + sizes - 1) // length
                pieces = high - low + 1
                doc = np.repeat(np.arange(len(first)), pieces)
                sequence = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(sequence * length, first[doc])
                size = np.minimum((sequence + 1) * length, first[doc] + sizes[doc]) - start
                source = (np.cumsum(sizes) - sizes)[doc] + start - first[doc]
                slot = permuted(sequence, n, key)
                order = np.lexsort((start, slot))
                shards, payloads = [], []
                for shard, a, b in _slices(slot[order] // per_shard):
                    some = order[a:b]
                    m = size[some]
                    spot = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(source[some], m)
                    shards.append(shard)
                    payloads.append(_written({
                        "slot": slot[some], "sequence": sequence[some], "place": start[some] % length, "size": m,
                        "doc_id": docs.take(pa.array(doc[some])), "ids": pa.array(
                            [x.tobytes() for x in np.split(ids[spot], np.cumsum(m)[:-1])], pa.large_binary()
                        ),
                    }, level=6))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(shards, pa.int64()), "payload": pa.array(payloads, pa.binary())
                })

    return run


RECORDS = (
    "slot long, sequence long, shard long, byte_offset long, n_tokens long, doc_ids array<long>, crc32 long, path string"
)


def _assembled(tokenizer: Tokenizer, length: int, per_shard: int, n: int, folder: str):
    def run(key, sent):
        shard, kind = key[0].as_py(), tokenizer.kind
        read = _read(sent["payload"]).sort_by([("slot", "ascending"), ("place", "ascending")])
        slot, place, size = (read[c].to_numpy() for c in ("slot", "place", "size"))
        base, records = shard * per_shard, min(per_shard, n - shard * per_shard)
        whole = np.full(records * length, tokenizer.end, kind)
        ids = np.frombuffer(b"".join(read["ids"].to_pylist()), kind)
        spot = np.repeat((slot - base) * length + place - (np.cumsum(size) - size), size) + np.arange(len(ids))
        whole[spot] = ids
        path = f"{folder}/shard-{shard:08d}.bin"
        store, inside = pa.fs.FileSystem.from_uri(path)
        part = f"{inside}.{TaskContext.get().taskAttemptId()}"
        store.create_dir(inside.rpartition("/")[0], recursive=True)
        with store.open_output_stream(part) as out:
            out.write(whole)
        store.move(part, inside)
        edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
        docs, stride = read["doc_id"].to_pylist(), length * kind.itemsize
        raw = whole.tobytes()
        at = (slot[edges[:-1]] - base) * stride
        return pa.table({
            "slot": slot[edges[:-1]], "sequence": read["sequence"].to_numpy()[edges[:-1]],
            "shard": pa.array([shard] * len(at), pa.int64()), "byte_offset": at,
            "n_tokens": pa.array(np.add.reduceat(size, edges[:-1])),
            "doc_ids": pa.array([docs[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.int64())),
            "crc32": pa.array([binascii.crc32(raw[a : a + stride]) for a in at.tolist()], pa.int64()),
            "path": pa.array([path] * len(at), pa.string()),
        })

    return run


def _located(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme; where it names none, that of the default file system, as for Spark's own tables."""
    if "://" in folder:
        return folder
    if folder.startswith("file:"):
        return f"file://{folder.removeprefix('file:')}"
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{default.removesuffix('/')}{folder}"


def shards(
    documents: DataFrame,
    tokenizer: Tokenizer = Tokenizer(),
    length: int = 2048,
    per_shard: int = 2048,
    key: int = 1,
    folder: str | None = None,
) -> DataFrame:
    """One row per sequence of the shards that running it writes to ``folder``.

    (slot, sequence, shard, byte_offset, n_tokens, doc_ids, crc32, path). The
    default folder is a new one under ``spark.checkpoint.dir``; it has to be
    one that all machines share.
    """
    spark = documents.sparkSession
    folder = folder or fresh_path(spark, "token-shards")
    folder = _located(spark, folder)
    ids = stage(
        documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _tokenized(tokenizer), "task long, at long, doc_id long, n long, ids binary"
        ),
        "token-ids",
        level=6,
    )
    tasks = ids.groupBy("task").agg(F.max(F.col("at") + F.col("n")).alias("ids"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stage(tasks.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0))), "token-tasks")
    total = tasks.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]
    n = -(-total // length)
    placed = ids.join(tasks.select("task", "before"), "task").select(
        "doc_id", (F.col("before") + F.col("at")).alias("first"), "n", "ids"
    )
    dealt = placed.mapInArrow(_dealt(tokenizer.kind, length, per_shard, n, key), "shard long, payload binary")
    return dealt.groupBy("shard").applyInArrow(_assembled(tokenizer, length, per_shard, n, folder), RECORDS)


@query("op9_token_shards")
def op9_token_shards(spark, sf_dir):
    """Shards of all documents, one row per sequence."""
    return shards(table(spark, sf_dir, "documents")).drop("path")
