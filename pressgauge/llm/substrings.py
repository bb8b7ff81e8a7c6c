"""Removal of repeated 50-byte strings by suffix sorting.

A byte goes if a ``width``-byte string that covers it also starts in a document
with a smaller ``doc_id``. Strings are judged on the input.

1. Equal texts form one class, which stands for its smallest ``doc_id``; the
   other members lose everything. Texts are packed by their hash into buckets
   of about ``PACK`` bytes, copies of one task combined.
2. Candidates. The smallest hash of the ``GRAM``-byte strings inside a window
   is a property of the window's bytes, so equal windows have equal minima.
   Successive windows of equal minimum are a run. Buckets send their distinct
   minima to be counted; a run can only hold repeated windows if its minimum is
   found in two texts. This loses nothing and leaves out most runs.
3. The bytes of candidate runs go to the part of their minimum, equal ones of a
   bucket combined. There all windows, the suffixes cut at ``width``, are put
   in order by deep-shallow sorting (``suffixes.ranks``); of equal ones, all
   but those of the smallest ``doc_id`` are removed.
4. Removed windows go back to the texts' buckets and are cut out.

Buckets and parts follow the size of the input; a frequent string reaches its
part once for each bucket, not once for each document.

Defined results: null text is empty; a null ``doc_id`` counts as greater than
all others; rows of equal ``doc_id`` do not judge one another; texts below
``width`` bytes stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import query, table
from pressgauge.llm.suffixes import ranks
from pressgauge.llm.vectors import BYTE, mixed, powers, runs

GRAM = 16
PACK = 8 << 20
LAST = np.iinfo(np.int64).max


def _written(columns: dict, level: int = 3) -> bytes:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(payloads) -> pa.Table | None:
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, after the last) of sorted keys."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[a]), int(a), int(b)


def _packed(parts: int):
    """Distinct texts of a batch, by bucket, each with its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((ids, k2, k1))
            same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
            order = order[np.concatenate([[True], ~same])]
            bucket = np.mod(k1[order], parts)
            order, bucket = order[np.argsort(bucket, kind="stable")], np.sort(bucket)
            keys, payloads = [], []
            for b, first, last in _slices(bucket):
                some = batch.take(pa.array(order[first:last]))
                keys.append(b)
                payloads.append(_written(dict(zip(("doc_id", "k1", "k2", "text"), some.columns, strict=True))))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return run


def _texts(packed: pa.Table):
    """Distinct texts of a bucket in order of their hashes: (doc_id, k1, k2, text)."""
    read = _read(packed["payload"])
    ids, k1, k2 = (read[c].to_numpy() for c in ("doc_id", "k1", "k2"))
    order = np.lexsort((ids, k2, k1))
    same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
    order = order[np.concatenate([[True], ~same])]
    return ids[order], k1[order], k2[order], read["text"].combine_chunks().take(pa.array(order))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, step = BYTE[data], 1
    power = powers(2)[1:]
    while step < GRAM:
        h = h[: max(len(h) - step, 0)] * power + h[step:]
        power, step = power * power, step * 2
    return mixed(h)


def _window_minima(h: np.ndarray, length: int) -> np.ndarray:
    step = 1
    while step * 2 <= length:
        h = np.minimum(h[: max(len(h) - step, 0)], h[step:])
        step *= 2
    rest = length - step
    return np.minimum(h[: max(len(h) - rest, 0)], h[rest:]) if rest else h


def _window_runs(data: np.ndarray, offsets: np.ndarray, width: int):
    """(minimum, text, first window's place in ``data``, windows) of each run."""
    minima = _window_minima(_gram_hashes(data), width - GRAM + 1)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    total = np.concatenate([np.zeros(1, np.int64), counts.cumsum()])
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total[-1]) + np.repeat(offsets[:-1] - total[:-1], counts)
    value = minima[place] if len(place) else np.zeros(0, np.uint64)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return value[first], text[first], place[first], np.diff(np.append(first, len(value)))


def _short(minima: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 more bits of a minimum in one number that sorts by part."""
    return ((minima % np.uint64(parts)) << np.uint64(32)) | (minima >> np.uint64(32))


def _all_runs(texts: pa.Array, width: int):
    found = [[], [], [], []]
    for row, _, data, offsets in runs(texts):
        minimum, text, place, windows = _window_runs(data, offsets, width)
        for out, x in zip(found, (minimum, text + row, place - offsets[text], windows), strict=True):
            out.append(x)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return [np.concatenate([np.zeros(0, k), *x]).astype(k, copy=False) for x, k in zip(found, kinds, strict=True)]


def _minima(width: int, parts: int):
    def run(key, packed):
        minimum = _all_runs(_texts(packed)[3], width)[0]
        short = np.unique(_short(minimum, parts))
        rows = [(p, a, b) for p, a, b in _slices((short >> np.uint64(32)).astype(np.int64))]
        low = short.astype(np.uint32)
        return pa.table({
            "part": pa.array([p for p, _, _ in rows], pa.int32()),
            "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "minima": pa.array([low[a:b].tobytes() for _, a, b in rows], pa.binary()),
        })

    return run


def _repeated(key, sent):
    """Which of its minima a bucket shares with another, one bit each."""
    lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in sent["minima"]]
    every = np.sort(np.concatenate([np.zeros(0, np.uint32), *lists]))
    twice = every[1:][every[1:] == every[:-1]]
    at = [np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0)) for x in lists]
    bits = [np.packbits(twice[i] == x).tobytes() if len(twice) else bytes(-(-len(x) // 8)) for i, x in zip(at, lists, strict=True)]
    return pa.table({
        "bucket": sent["bucket"], "part": pa.array([key[0].as_py()] * len(lists), pa.int32()),
        "bits": pa.array(bits, pa.binary()),
    })


def _context_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.int64), lengths.cumsum()])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    value = BYTE[data[place + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(value, total[:-1]) ^ (lengths.astype(np.uint64) << np.uint64(40)))


def _classes(minimum: np.ndarray, content: np.ndarray, ids: np.ndarray):
    """(order by minimum, content and id; start of each class of equal contexts in it; its number by place)."""
    order = np.lexsort((ids, content, minimum))
    m, c = minimum[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _removal_rows(k1: np.ndarray, begin: np.ndarray, end: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    bucket = np.mod(k1, parts)
    order = np.lexsort((begin, k1, bucket))
    keys, payloads = [], []
    for b, i, j in _slices(bucket[order]):
        some = order[i:j]
        keys.append(b)
        payloads.append(_written({"k1": k1[some], "begin": begin[some], "end": end[some]}))
    return keys, payloads


def _contexts(width: int, parts: int):
    """Bytes of the candidate runs, by part; what the bucket can already tell is removed."""

    def run(key, packed, answers):
        out: dict[str, list] = {"part": [], "bucket": [], "payload": []}
        if packed.num_rows:
            ids, k1, _, texts = _texts(packed)
            minimum, text, place, windows = _all_runs(texts, width)
            short, number = np.unique(_short(minimum, parts), return_inverse=True)
            shared = np.zeros(len(short), bool)
            known = {p.as_py(): b.as_buffer() for p, b in zip(answers["part"], answers["bits"], strict=True)}
            for p, a, b in _slices((short >> np.uint64(32)).astype(np.int64)):
                if p in known:
                    shared[a:b] = np.unpackbits(np.frombuffer(known[p], np.uint8))[: b - a]
            low, high = np.full(len(short), len(ids), np.int64), np.full(len(short), -1, np.int64)
            np.minimum.at(low, number, text)
            np.maximum.at(high, number, text)
            chosen = np.flatnonzero((shared | (low != high))[number])
            minimum, text, place = minimum[chosen], text[chosen], place[chosen]
            lengths = windows[chosen] + width - 1
            large = texts.cast(pa.large_string())
            data = np.frombuffer(large.buffers()[2] or b"", np.uint8)
            ends = np.frombuffer(large.buffers()[1], np.int64)[large.offset :]
            starts = ends[text] + place
            order, first, number = _classes(minimum, _context_hashes(data, starts, lengths), ids[text])
            later = ids[text[order]] > ids[text[order]][first][number] if len(order) else np.zeros(0, bool)
            gone, sent = order[later], order[~later]
            keys, payloads = _removal_rows(k1[text[gone]], place[gone], place[gone] + lengths[gone], parts)
            spread = [b % parts for b in keys]
            out = {"part": spread, "bucket": keys, "payload": payloads}
            part = (minimum[sent] % np.uint64(parts)).astype(np.int64)
            sent, part = sent[np.argsort(part, kind="stable")], np.sort(part)
            for p, a, b in _slices(part):
                some = sent[a:b]
                n = lengths[some]
                total = np.concatenate([np.zeros(1, np.int64), n.cumsum()])
                spot = np.arange(total[-1]) + np.repeat(starts[some] - total[:-1], n)
                content = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(some), [None, pa.py_buffer(total), pa.py_buffer(data[spot])]
                )
                out["part"].append(p)
                out["bucket"].append(None)
                out["payload"].append(_written({
                    "minimum": minimum[some], "doc_id": ids[text[some]], "k1": k1[text[some]], "place": place[some],
                    "content": content,
                }))
        return pa.table({
            "part": pa.array(out["part"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
            "payload": pa.array(out["payload"], pa.binary()),
        })

    return run


def _sorted_out(width: int, parts: int):
    """Order all windows of a part's contexts; those of later documents are removed."""

    def run(key, sent):
        told = pc.is_valid(sent["bucket"])
        known, contexts = sent.filter(told), _read(sent.filter(pc.invert(told))["payload"])
        buckets, payloads = known["bucket"].to_pylist(), known["payload"].to_pylist()
        if contexts is not None and contexts.num_rows:
            minimum, ids, k1, place = (contexts[c].to_numpy() for c in ("minimum", "doc_id", "k1", "place"))
            content = contexts["content"].combine_chunks()
            ends = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
            data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
            lengths = np.diff(ends)
            order, first, number = _classes(minimum, _context_hashes(data, ends[:-1], lengths), ids)
            head = order[first]
            # Windows of one context for each class; classes alone with their minimum have nothing to compare with.
            group = np.cumsum(np.concatenate([[True], minimum[head][1:] != minimum[head][:-1]])) - 1
            crowded = np.flatnonzero(np.bincount(group)[group] > 1)
            windows = lengths[head[crowded]] - width + 1
            total = np.concatenate([np.zeros(1, np.int64), windows.cumsum()])
            owner = np.repeat(crowded, windows)
            step = np.arange(total[-1]) - np.repeat(total[:-1], windows)
            rank = ranks(data, ends[:-1][head[owner]] + step, group[owner], width)
            lowest = np.full(int(rank.max()) + 1 if len(rank) else 0, LAST, np.int64)
            np.minimum.at(lowest, rank, ids[head[owner]])
            cut = ids[head[owner]] > lowest[rank]
            # Successive removed windows of a class are one span.
            o, s = owner[cut], step[cut]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(o)) - 1
            span_class, span_begin, span_end = (o[i], s[i], s[j] + width) if len(o) else (o, s, s)
            # Later members lose their whole context, the others what their class loses.
            later = ids[order] > ids[head][number]
            full, rest = order[later], order[~later]
            rest_class = number[~later]
            a, b = np.searchsorted(span_class, rest_class), np.searchsorted(span_class, rest_class, "right")
            n = b - a
            member = np.repeat(rest, n)
            span = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            more_b, more_p = _removal_rows(
                np.concatenate([k1[full], k1[member]]),
                np.concatenate([place[full], place[member] + span_begin[span]]),
                np.concatenate([place[full] + lengths[full], place[member] + span_end[span]]),
                parts,
            )
            buckets, payloads = buckets + more_b, payloads + more_p
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "removed": pa.array(payloads, pa.binary())})

    return run


def _cut(keep: bool):
    """Take the removed spans out of a bucket's texts."""

    def run(key, packed, removed):
        out: dict[str, list] = {c: [] for c in ("k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept")}
        first = np.zeros(0, np.int64)
        if packed.num_rows:
            first, k1, k2, texts = _texts(packed)
            spans = _read(removed["removed"])
            owner = begin = end = np.zeros(0, np.int64)
            if spans is not None:
                owner, begin, end = (spans[c].to_numpy() for c in ("k1", "begin", "end"))
                order = np.lexsort((begin, owner))
                owner, begin, end = owner[order], begin[order], end[order]
            lows, highs = np.searchsorted(owner, k1), np.searchsorted(owner, k1, "right")
            for i, (a, b) in enumerate(zip(lows, highs, strict=True)):
                raw = (texts[i].as_py() or "").encode()
                pieces, at, gone, n = [], 0, 0, 0
                if b > a:
                    reach = np.maximum.accumulate(end[a:b])
                    new = np.concatenate([[True], begin[a + 1 : b] > reach[:-1]])
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], b - a) - 1
                    for x, y in zip(begin[a:b][heads].tolist(), reach[tails].tolist(), strict=True):
                        pieces.append(raw[at:x])
                        at, gone, n = y, gone + y - x, n + 1
                pieces.append(raw[at:])
                kept = b"".join(pieces)
                values = (int(k1[i]), int(k2[i]), gone, n, hashlib.sha256(kept).hexdigest(), kept if keep else None)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        table_ = {c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)}
        return pa.table({"first_id": pa.array(first, pa.int64()), **table_})

    return run


def deduplicated(documents: DataFrame, width: int = 50, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; ``kept`` only if asked for."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.crc32(text.cast("binary")).alias("k2"),
        text.alias("text"),
    )
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PACK))

    packed = docs.mapInArrow(_packed(parts), "bucket int, payload binary").groupBy("bucket")
    minima = packed.applyInArrow(_minima(width, parts), "part int, bucket int, minima binary")
    answers = minima.groupBy("part").applyInArrow(_repeated, "bucket int, part int, bits binary")
    contexts = packed.cogroup(answers.groupBy("bucket")).applyInArrow(
        _contexts(width, parts), "part int, bucket int, payload binary"
    )
    removed = contexts.groupBy("part").applyInArrow(_sorted_out(width, parts), "bucket int, removed binary")
    classes = packed.cogroup(removed.groupBy("bucket")).applyInArrow(
        _cut(keep),
        "first_id long, k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )

    own = docs.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = own.join(classes, ["k1", "k2"])
    judged = (F.col("doc_id") == F.col("first_id")) | (F.col("n_bytes") < width)
    empty = hashlib.sha256(b"").hexdigest()
    result = joined.select(
        F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(judged, F.col("n_removed")).otherwise(F.col("n_bytes")).alias("n_removed"),
        F.when(judged, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(judged, F.col("kept_sha256")).otherwise(F.lit(empty)).alias("kept_sha256"),
        F.when(judged, F.col("kept")).otherwise(F.lit(b"")).alias("kept"),
    )
    return result if keep else result.drop("kept")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    """Repeated 50-byte strings of all documents."""
    return deduplicated(table(spark, sf_dir, "documents"), 50, keep=False)
