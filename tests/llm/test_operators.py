"""Operators on small rows: brute force, planted cases, and rows of every odd kind."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from pressgauge.llm import chat, decontamination, jaccard, lines, links, mixing, quality, secrets, shards, substrings, toxicity
from pressgauge.llm.linear import HELD_OUT, fold

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "kltmnr" for b in ("abe", "ido", "ume", "esa", "oti", "uru")]
# Besides the columns of documents, names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n long, label string, bits string, kept string, "
    "copies long, size string, token string, removed string, w string, s string"
)
EXTRA = (7, "label", "bits", "kept", 5, "size", "token", "removed", "w", "s")


def prose(rng, k):
    return " ".join(rng.choices(VOCABULARY, k=k))


def table(spark, rows):
    full = [(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(1)
    base = prose(rng, 80)
    near = base.replace(base.split()[40], "other", 1)
    long = prose(rng, 30_000)
    return [
        (1, base, "b"), (2, None, "b"), (3, "", None), (4, " \n\t ", None), (5, base, "a"), (5, base, "a"), (6, near, "a"),
        (7, long, "c"), (8, long + " end", "c"), (9, "one", "a"), (10, "ONE", "a"), (11, "two words", None),
        (None, prose(rng, 50), "a"), (None, prose(rng, 50), None), (12, "<|im_end|> é \u0000 ü " * 30, "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return table(spark, odd_rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 9)] + [(None, 1, 0), (6, None, None), (7, 5, 5), (5, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# -- 1 Quality rules ------------------------------------------------------------

def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    fives = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(fives)
    twice = {j for i, f in enumerate(fives) if count[f] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup, "n_repeat_words": len(twice), "base_failed": len(w) < 10 or 100 * len(twice) > 20 * len(w),
    }


def test_quality_statistics(spark, odd, odd_rows, labels, none):
    rng = random.Random(2)
    more = [(100 + i, "\n".join(prose(rng, rng.randint(0, 8)) for _ in range(rng.randint(1, 12))) * rng.randint(1, 2), "a") for i in range(40)]
    docs = odd.unionByName(table(spark, more))
    got = rows_of(quality.judged(docs, None))
    want = Counter(tuple(sorted({"doc_id": i or 0, **plain_statistics(t)}.items())) for i, t, _ in odd_rows + more)
    assert Counter(tuple(sorted({k: (r[k] or 0) for k in ("doc_id", *plain_statistics(""))}.items())) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judged(none, None).count() == 0
    model = quality.train(docs, labels)
    assert quality.judged(docs, model).count() == len(odd_rows) + len(more)
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and kept.filter("size != 'size'").count() == 0


def test_quality_without_labels_of_both_kinds(spark, odd, labels):
    assert quality.train(odd, labels.filter("quality = 1")) is None
    assert quality.train(odd, labels.limit(0)) is None


# -- 2 Line dedup -----------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :]


def plain_lines(rows, shortest):
    seen, short, out = [], set(), {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if WORD.search(line) and line in short:
                continue
            short.add(line)
            if len(line) >= shortest and any(one_edit(line, s) for s in seen):
                seen.append(line)
                continue
            if len(line) >= shortest:
                seen.append(line)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abé", k=rng.randint(8, 14))) for _ in range(12)]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(x))
            x = rng.choice([x[:p] + x[p + 1 :], x[:p] + rng.choice("abé") + x[p:], x[:p] + rng.choice("abé") + x[p + 1 :]])
        return x

    short = ["", " ", "a", "ab", "é b", "abé", "\t"]
    rows = [(i, "\n".join(rng.choice(short) if rng.random() < 0.3 else line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = lines.deduplicated(table(spark, [(i, t, "a") for i, t in rows]), shortest=8)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_lines(rows, 8)


def test_lines_of_odd_rows(odd, odd_rows, none):
    got = lines.deduplicated(odd, count_as="n_removed")
    assert got.columns == [*odd.columns, "n_removed"] and lines.deduplicated(none).count() == 0
    got = rows_of(got)
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] and r["doc_id"] != 5}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[1]["n_removed"] == 0
    assert all((r["n_removed"], r["text"]) == (1, "") for r in got if r["doc_id"] == 5)  # equal to document 1


# -- 3 Substrings -----------------------------------------------------------------

def plain_substrings(rows, width):
    out, first = {}, {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(raw):
        for j in range(len(b) - width + 1):
            first.setdefault(b[j : j + width], i)
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if first[b[j : j + width]] < i:
                gone[j : j + width] = b"\1" * width
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["".join(rng.choices("ab é", k=rng.randint(10, 90))) for _ in range(14)] + ["a" * 120, "ab" * 40]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(70)] + [(200, None), (201, "")]
    got = substrings.deduplicated(table(spark, [(i, t, "a") for i, t in rows]).repartition(5), 50)
    want = plain_substrings(rows, 50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got.collect()} == want


def test_substrings_of_odd_rows(odd, odd_rows, none):
    got = rows_of(substrings.deduplicated(odd, 50, keep=False))
    assert len(got) == len(odd_rows) and substrings.deduplicated(none).count() == 0
    assert {r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] == 5} == {True}
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_removed"] == 0 and by[8]["n_spans"] == 1 and by[8]["n_bytes"] - by[8]["n_removed"] < 5


# -- 4 Secrets ----------------------------------------------------------------------

def test_secrets(spark, odd, none):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        key = "".join(rng.choices("0123456789abcdef", k=40))
        word = "".join(rng.choices(VOCABULARY, k=6))
        rows.append((i, f'{prose(rng, 20)} token = "{key}" {prose(rng, 5)} {word} {prose(rng, 5)}', "a"))
    got = secrets.scan(table(spark, rows)).toPandas()
    assert len(got) == 160 and got.kept.sum() == 80
    assert set(got[got.kept].doc_id) == set(range(80)) and got[got.kept].candidate.str.len().eq(40).all()
    assert secrets.scan(none).count() == 0
    assert secrets.scan(odd).filter("kept").count() == 0


# -- 5 Chat -----------------------------------------------------------------------

def test_chat_examples_hold_every_prefix(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "<|im_start|>assistant x<|im_end|>"), (1, 2, "assistant", "<\\|a"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
        (4, None, None, "x\n"), (None, 0, "assistant", "n"),
    ]
    given = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, seq string")
    rows = chat.formatted(given)
    rendering = {}
    for r in sorted(rows_of(rows), key=lambda r: (r["conv_id"] or 0, r["seq"])):
        rendering[r["conv_id"]] = rendering.get(r["conv_id"], "") + r["rendered"]
    examples, whole = rows_of(chat.examples(rows)), rows_of(chat.expanded(rows))
    assert len(examples) == len(whole) == 6
    text = {(r["conv_id"], r["target_seq"]): r for r in whole}
    for e in examples:
        r, full = text[e["conv_id"], e["target_seq"]], rendering[e["conv_id"]]
        assert r["context"] == full[: e["context_chars"]] and r["target"] == full[e["target_start"] : e["target_end"]]
    got = {r["conv_id"]: r for r in rows_of(chat.digests(rows))}
    assert got[3]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest() and got[2]["loss_chars"] == 0
    assert got[4]["turns_sha256"] == hashlib.sha256(b"\nx\n\n").hexdigest() and got[None]["loss_chars"] == 1
    assert chat.digests(chat.formatted(given.limit(0))).count() == 0


def test_chat_losses_come_from_the_examples(spark):
    long = "w<|" * 200_000
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, "user", long), (1, 3, "assistant", "end")]
    rows = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    made = chat.examples(rows)
    (one,) = rows_of(chat.digests(rows, made.filter("target_seq = 3")))
    assert (one["n_turns"], one["loss_chars"]) == (4, 3)
    (both,) = rows_of(chat.digests(rows))
    assert both["loss_sha256"] == hashlib.sha256(f"{long}end".encode()).hexdigest()
    for broken in ("context_chars", "target_end"):
        with pytest.raises(Exception, match="does not fit its turn"):
            chat.digests(rows, made.withColumn(broken, F.col(broken) - 1)).collect()


# -- 6 Decontamination -----------------------------------------------------------------

def test_leaks(spark, odd, none):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(12)] + [(50, "too short"), (51, None)]
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, n string")
    rows, leaked = [], {}
    for i in range(60):
        text, item = prose(rng, 60), items[i % 12][1].split()
        if i % 3 == 0:
            leaked[i] = i % 12
            text += " " + "\n".join(item).upper() + " " + prose(rng, 20)
        elif i % 3 == 1:
            text += " " + " ".join(item[: len(item) // 2]) + " " + prose(rng, 20)
        rows.append((i, text, "a"))
    docs = table(spark, rows).unionByName(odd.filter("doc_id is null or doc_id > 5").withColumn("doc_id", F.col("doc_id") + 1000))
    found = rows_of(decontamination.leaks(docs, bench))
    assert {(r["doc_id"], r["item_id"]) for r in found if r["shared"] == r["total"]} == set(leaked.items())
    assert {r["doc_id"] for r in found} == set(leaked)
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(leaked)
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def plain_leaks(rows, items, percent):
    """(doc, item): (similarity, shared, total, first word) of the best of all windows."""

    def five(text):
        w = re.findall(decontamination.WORD, (text or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = {}
    for (d, text, *_), (k, item) in itertools.product(rows, items):
        have, want = five(text), five(item)
        m, counts = len(want), Counter(want)
        for a in range(1 - m, len(have)) if want else ():
            window = have[max(a, 0) : a + m]
            shared = sum((Counter(window) & counts).values())
            total = len(window) + m - shared
            if shared and 100 * shared >= percent * total:
                out[d, k] = max(out.get((d, k), (0,)), (shared / total, -max(a, 0), shared, total))
    return {k: (v[2], v[3], -v[1]) for k, v in out.items()}


def test_leaks_against_brute_force(spark):
    """All windows, with items that are reordered, changed, cut or shifted inside."""
    rng = random.Random(66)
    items = [(i, prose(rng, n)) for i, n in enumerate((50, 50, 40, 30, 5, 12))] + [(6, "so it is " * 12)]
    rows = []
    for i in range(84):
        w = items[i % 7][1].split()
        k = rng.choice([6, 8, len(w) // 2])
        w = [
            lambda: w[k:] + w[:k], lambda: w[len(w) // 2 :] + w[: len(w) // 2], lambda: w[:-3] + ["x"], lambda: w[4:],
            lambda: w[: len(w) // 2] + ["other"] + w[len(w) // 2 :], lambda: ["y"] * 2 + w[2:],
        ][i // 7 % 6]()
        ahead, after = ("", prose(rng, 20)) if i % 5 == 0 else (prose(rng, 30), "") if i % 5 == 1 else (prose(rng, 30), prose(rng, 20))
        rows.append((i, f"{ahead} {' '.join(w)} {after}", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for percent in (80, 60):
        got = rows_of(decontamination.leaks(table(spark, rows), bench, percent, 40 if percent == 60 else 22))
        assert {(r["doc_id"], r["item_id"]): (r["shared"], r["total"], r["first_word"]) for r in got} == plain_leaks(rows, items, percent)
    # The case of the first 8 of 50 words moved to the end.
    w = items[0][1].split()
    assert plain_leaks([(1, " ".join(w[8:] + w[:8]))], items[:1], 80)[1, 0][:2] == (42, 50)


def test_radius_covers_the_similarity(spark):
    """Of pairs at the similarity of 0.8, none is beyond the radius."""
    rng = np.random.default_rng(8)
    far = 0
    for _ in range(400):
        m = int(rng.integers(11, 53))
        shared = int(np.ceil(8 * m / 9))
        common = rng.integers(0, 2**63, shared, dtype=np.uint64)
        one, two = (np.concatenate([common, rng.integers(0, 2**63, m - shared, dtype=np.uint64)]) for _ in "ab")
        bits = [((x[:, None] >> np.arange(63, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 > m for x in (one, two)]
        far = max(far, int((bits[0] != bits[1]).sum()))
    assert far <= 22


# -- 7 Toxicity ---------------------------------------------------------------------

def test_toxicity(spark, odd, labels, none):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, rng.randint(10, 60)).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zgrobnik", "wjaxxor"]))
        rows.append((i, " ".join(words), "a"))
        marks.append((i, 1, int(bad)))
    docs = table(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, model).toPandas()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 5 == 0)).all() and got.score.between(0, 1).all()
    other = toxicity.scored(odd, model).toPandas()
    assert len(other) == 15 and other.score.notna().all() and other[other.doc_id.isin([2, 3])].score.nunique() == 1
    assert toxicity.scored(none, model).count() == 0
    alone = toxicity.train(docs, labels.filter("toxic = 0"))
    assert set(toxicity.scored(docs, alone).toPandas().score.round(3)) == {0.0}


def test_toxicity_of_words_in_few_texts(spark):
    """Words in 6 training texts each, all toxic, are evidence."""
    rng = random.Random(10)
    used = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    words = ["zgrobnik", "wjaxxor", "quvvyth", "kzefplo"]
    with_word = dict(zip(used, [w for w in words for _ in range(6)]))
    rows = [(i, f"{prose(rng, 20)} {with_word.get(i, '')} {prose(rng, 20)}", "a") for i in range(400)]
    marks = spark.createDataFrame([(i, 1, int(i in with_word)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table(spark, rows), marks)
    plain = prose(rng, 30)
    new = table(spark, [(1000 + k, f"{plain} {w}", "a") for k, w in enumerate(["", *words])])
    score = {r["doc_id"] - 1000: r["score"] for r in rows_of(toxicity.scored(new, model))}
    assert all(score[k] > score[0] for k in range(1, 5))


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string")
    held = {r["doc_id"] for r in docs.filter(fold("doc_id") == HELD_OUT).collect()}
    assert held == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    from pressgauge.llm.linear import labelled_sample

    marks = docs.select("doc_id", F.lit(1).alias("toxic"))
    sample = labelled_sample(docs, marks, "toxic", 50)
    assert sample.count() == 50 and not held & {r["doc_id"] for r in sample.collect()}


# -- 8 Mixing -------------------------------------------------------------------------

def test_mix_of_odd_rows(odd, odd_rows, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(odd_rows) and (got.taken <= 2 * got["size"]).all() and mixing.mix(none).count() == 0
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    again = mixing.mix(odd.repartition(1)).toPandas()
    key = ["doc_id", "size", "taken", "target"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    written = mixing.mixed_documents(odd)
    assert written.columns == odd.columns
    assert written.count() == got.copies.sum()


def test_mix_of_a_column_named_like_a_helper(spark):
    docs = table(spark, [(i, "one two three", "a") for i in range(6)]).withColumn("_copy", F.lit(1)).withColumn("row", F.lit("x"))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {(r["_copy"], r["row"]) for r in got.collect()} == {(1, "x")}


def test_mix_meets_its_targets(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(1, 40)), rng.choice("abcd")) for i in range(600)]
    got = mixing.mix(table(spark, rows), inclusion=F.sqrt(F.col("size").cast("double"))).toPandas()
    by = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (by["size"] == by.source_size).all() and ((by.taken - by.target).abs() <= 40).all()
    total, weight = 1.5 * by["size"].sum(), dict(zip("abcd", (3, 1, 2, 3)))
    open_ = set("abcd")
    level = 0.0
    while True:
        level = (total - sum(2 * by.source_size[s] for s in set("abcd") - open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * by.source_size[s]}
        if not full:
            break
        open_ -= full
    for s in "abcd":
        assert abs(by.target[s] - (level * weight[s] if s in open_ else 2 * by.source_size[s])) < 1e-6


# -- 9 Shards ---------------------------------------------------------------------------

def test_shards_go_to_the_default_file_system(spark):
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").removesuffix("/")
    assert shards._located(spark, "/a/b") == f"{default}/a/b"
    assert shards._located(spark, "file:/a") == "file:///a" and shards._located(spark, "s3a://x/a") == "s3a://x/a"


def test_shards_round_trip(odd, odd_rows, none, tmp_path):
    tokenizer = shards.Tokenizer()
    got = shards.shards(odd, tokenizer, length=64, per_shard=100, key=3, folder=str(tmp_path / "out")).toPandas()
    n = len(got)
    assert sorted(got.slot) == list(range(n)) == sorted(got.sequence)
    assert (got.shard == got.slot // 100).all() and (got.byte_offset == got.slot % 100 * 128).all()
    stream = []
    for r in got.sort_values("sequence").itertuples():
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.byte_offset)
            raw = f.read(128)
        assert zlib.crc32(raw) == r.crc32
        stream.append(np.frombuffer(raw, "<u2"))
    texts, ids = [], []
    for t in np.concatenate(stream).tolist():
        if t == tokenizer.end:
            texts.append(shards.encoding(tokenizer).decode(ids))
            ids = []
        else:
            ids.append(t)
    assert sorted(t for t in texts if t) == sorted(t for _, t, _ in odd_rows if t)
    sizes = sorted(os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.endswith(".bin"))
    assert sum(sizes) == n * 128 and all(s == 12800 for s in sizes[1:])
    assert shards.shards(none).count() == 0


def test_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("It's 2 o'clock,  <|endoftext|>\n\n  é ü 漢字", " a  b\t c ", "x" * 300):
        assert shards.encoding(shards.Tokenizer()).encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


# -- 10 N-gram Jaccard ----------------------------------------------------------------------

def plain_set(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def plain_components(rows, n, percent):
    sets = [(i, plain_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def test_jaccard_against_brute_force(spark):
    """Families of near copies, so spread that many pairs of a family do not link."""
    rng = random.Random(11)
    rows = []
    for family in range(4):
        base = prose(rng, rng.randint(30, 70)).split()
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 2)] = rng.choices(VOCABULARY, k=rng.randint(0, 1))
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A B"), (504, "a b c")]
    rng.shuffle(rows)
    docs = table(spark, [(i, t, "a") for i, t in rows]).repartition(4)
    for n, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs, n, percent).collect()}
        assert got == plain_components(rows, n, percent)


def test_jaccard_of_odd_rows(odd, odd_rows, none):
    got = rows_of(jaccard.linked(odd, 4, 85))
    assert len(got) == len(odd_rows) and jaccard.linked(none).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert (by[1], by[5], by[6], by[8], by[10], by[2], by[3]) == (1, 1, 1, 7, 9, 2, 3)
    kept = jaccard.representatives(odd, n=4, percent=85)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 7, 9, 11, None, None, 12])


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- Queries and pipeline -----------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op5_chat_examples", "op6_decontamination", "op8_mix_sources"])
def test_query_equals_sql(spark, name):
    result = entry.queries()[name](spark, SF).toArrow()
    assert compare(result, connect(SF).execute(entry.oracle_sql()[name]).to_arrow_table()) is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.select("doc_id", "text").toPandas()]
    for name, function in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(function(spark, docs, SF).toArrow())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            seen.append(docs.select("doc_id", "text").toPandas())
    given, good, single, clean, mixed = seen
    bad = {i for i, t in zip(given.doc_id, given.text) if plain_statistics(t)["base_failed"]}
    assert not bad & set(good.doc_id)
    marks = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    fine = set(marks[marks.quality == 1].doc_id) - bad
    assert len(fine & set(good.doc_id)) >= 0.95 * len(fine)
    want = plain_components(list(zip(good.doc_id, good.text)), 5, 80)
    assert set(single.doc_id) == {i for i, (_, c) in want.items() if i == c}
    leaks = decontamination.leaks(
        spark.createDataFrame(single), spark.read.parquet(f"{SF}/benchmark.parquet")
    ).toPandas()
    assert set(clean.doc_id) == set(single.doc_id) - set(leaks.doc_id)
    assert set(mixed.doc_id) <= set(clean.doc_id) and Counter(mixed.doc_id).most_common(1)[0][1] <= 2
    ids = [i for r in docs.collect() for i in r["doc_ids"]]
    assert set(ids) == set(mixed.doc_id)


def test_toxicity_ratios_equal_counts_by_hand(spark):
    texts = ["bad cat", "bad dog", "good cat", "good dog", "good owl", "calm owl"]
    toxic = [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    sample = spark.createDataFrame(
        list(zip(texts, toxic, [0, 1, 0, 1, 3, 0])), "text string, label double, fold int"
    )
    counts, rows = toxicity._counts(sample)
    assert rows.tolist() == [[2, 1], [1, 1], [0, 0], [1, 0]]
    total = counts[[0, 1]].sum(0)
    cells = list(toxicity._cells(pa.array(texts)))
    brute = np.zeros((2, toxicity.WIDTH))
    for text, label, part in zip(cells, toxic, [0, 1, 0, 1, 3, 0]):
        if part in (0, 1):
            brute[int(label), text] += 1
    assert (total == brute).all()
    share = (brute + 1) / (brute + 1).sum(1, keepdims=True)
    wanted = np.log(share[1] / share[0])
    got = toxicity.ratios(total, 1.0, 0.9, 2)
    left = (np.abs(wanted) >= 0.9) & (brute.sum(0) >= 2)
    assert left.any() and np.allclose(got, np.where(left, wanted, 0), atol=1e-6)
    assert toxicity.average_precision(np.array([1.0, 0, 1]), np.array([3.0, 2, 1])) == pytest.approx((1 + 2 / 3) / 2)
