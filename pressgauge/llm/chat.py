"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it are the context
and only its reply is trainable. The contexts of one conversation are prefixes
of one another, so the rendering is kept once, one row per turn, and an example
is a row that names its prefix and its target as spans of that rendering.
``expanded`` writes the prefixes out where a trainer wants whole strings.

Template, per turn::

    <|im_start|>{role}\\n{text}<|im_end|>\\n

Inside texts, ``<``, any backslashes, ``|`` gets one more backslash, so that no
text contains ``<|`` and the change can be undone.

Defined results: a null role or text is the empty string; rows of equal turn
are ordered by role and text, repeated rows stay; a null turn comes first; a
null ``conv_id`` is a conversation of its own; an empty table gives no rows;
very long texts are rendered whole, one turn in memory at a time beside its
batch; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import query, stage, table

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
FLUSH = 4 << 20
SPANS = ("context_chars", "target_start", "target_end")

FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("rendered", pa.string()),
    ("start", pa.int64()), ("target_start", pa.int64()), ("target_end", pa.int64()), ("trainable", pa.bool_()),
])
FORMATTED_DDL = (
    "conv_id long, seq long, role string, rendered string, start long, target_start long, target_end long, "
    "trainable boolean"
)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation; only the running position is kept."""
    current, seq, at = object(), 0, 0
    for batch in batches:
        rows, held = [], 0
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if conv != current:
                current, seq, at = conv, 0, 0
            head = f"{START}{_role(role)}\n"
            body = escape(text)
            rendered = f"{head}{body}{END}\n"
            begin = at + len(head)
            rows.append((conv, seq, role, rendered, at, begin, begin + len(body), role == "assistant"))
            at += len(rendered)
            seq += 1
            held += len(rendered)
            if held >= FLUSH:
                yield _written(rows, FORMATTED)
                rows, held = [], 0
        if rows:
            yield _written(rows, FORMATTED)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn in order: its rendering, where it starts, the span of its text, whether it is a target.

    ``start`` and the target's span count code points in the conversation's
    rendering. Rows are dealt by conversation and streamed, so memory does not
    grow with the length of a conversation.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_render, FORMATTED_DDL)


def examples(rows: DataFrame) -> DataFrame:
    """One row per assistant turn: context is ``[0, target_start)`` of the rendering, target the span after it."""
    return rows.filter("trainable").select(
        "conv_id",
        F.col("seq").alias("target_seq"),
        F.col("target_start").alias("context_chars"),
        "target_start",
        "target_end",
    )


def expanded(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Examples as whole strings: (conv_id, target_seq, context, target).

    The contexts of one conversation add up to the square of its length, as the
    form asks; pass ``conversations`` (conv_id) to write out only some.
    """
    if conversations is not None:
        rows = rows.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    before = rows.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), F.col("rendered").alias("r"))
    head = F.expr("substring(rendered, 1, cast(target_start - start as int))")
    targets = rows.filter("trainable").select(
        "conv_id",
        "seq",
        head.alias("head"),
        F.expr("substring(rendered, cast(target_start - start as int) + 1, cast(target_end - target_start as int))").alias(
            "target"
        ),
    )
    joined = targets.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("s") < F.col("seq")), "left")
    turns = F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "r"))))
    return joined.groupBy("conv_id", F.col("seq").alias("target_seq"), "head", "target").agg(turns.alias("t")).select(
        "conv_id",
        "target_seq",
        F.concat(F.array_join(F.transform("t", lambda x: x["r"]), ""), "head").alias("context"),
        "target",
    )


DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
DIGEST_DDL = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, each followed by the example whose target it holds."""
    current, state = object(), None
    done: list[tuple] = []

    def closed() -> tuple:
        n, turns, loss_chars, loss, chars = state
        return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    seq, start, begin, rendered = -1, 0, 0, ""
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_id"] != current:
                if state:
                    done.append(closed())
                current, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                seq, rendered = -1, ""
            if row["rendered"] is None:
                # The context is all that was read before this turn, and its head.
                end = start + len(rendered) - len(END) - 1
                if (row["seq"], row["context_chars"], row["target_start"], row["target_end"]) != (seq, begin, begin, end):
                    raise ValueError(f"an example of conversation {current} does not fit its turn {row['seq']}")
                target = unescape(rendered[row["target_start"] - start : row["target_end"] - start])
                state[2] += len(target)
                state[3].update(target.encode())
                continue
            seq, start, rendered = row["seq"], state[4], row["rendered"]
            turn = _TURN.fullmatch(rendered)
            begin = start + turn.start(2)
            state[0] += 1
            state[1].update(f"{_role_back(turn[1])}\n{unescape(turn[2])}\n".encode())
            state[4] += len(rendered)
        if done:
            yield _written(done, DIGEST)
            done = []
    if state:
        yield _written([closed()], DIGEST)


def digests(rows: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Per conversation: turns and length of the rendering, text under the loss masks of its examples.

    ``rows`` are stored once; the examples ``made`` of them (by ``examples``, if none are given) are dealt to the
    renderings they name and streamed behind the turn that holds their target.
    An example whose context is not the whole rendering before its target is an error.
    """
    stored = stage(rows, "chat-turns")
    turns = stored.select("conv_id", "seq", "rendered", *[F.lit(None).cast("long").alias(n) for n in SPANS])
    made = examples(stored) if made is None else made
    targets = made.select("conv_id", F.col("target_seq").alias("seq"), F.lit(None).cast("string").alias("rendered"), *SPANS)
    dealt = turns.unionByName(targets).repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "seq", F.col("rendered").isNull())
    return ordered.mapInArrow(_read_back, DIGEST_DDL)


CONTROL = f"{END}{START}assistant ok"

OP5_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op5_chat_examples", OP5_SQL)
def op5_chat_examples(spark, sf_dir):
    """Digests of all conversations and of one whose texts imitate the template."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string"
    )
    return digests(formatted(given.unionByName(control)))
