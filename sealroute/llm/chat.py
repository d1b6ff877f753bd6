"""Chat formatting with prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context, and only its own text is trained
on. The texts of a conversation's examples are beginnings of one formatted conversation, so that is stored once, a row
a turn, with offsets; an example is a reference to it (where its context ends, where its loss mask starts and stops).
What is stored then grows with the turns and not with their square; `render` writes chosen examples out.

A formatted turn is ``### Role: text</turn>`` and a line feed. Backslash, ``#`` and ``<`` inside a text get a backslash,
so no text can hold a mark; a role other than the four known ones is written as ``=role``, with ``:`` escaped as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealroute.llm.common import attach

ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
TRAINED = "assistant"
END = "</turn>\n"
#: Turns whose offsets are added up in one go.
BLOCK = 256
_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column, marks: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{marks}])", r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    label, text = _PIECE.fullmatch(piece).groups()
    return unescaped(label[1:]) if label.startswith("=") else label.lower(), unescaped(text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, piece, start, chars, loss_start, loss_stop) of every row of ``conversations``.

    ``piece`` is the formatted turn and ``start`` its offset in the formatted conversation, in code points; the loss
    mask (null but for assistant turns) has offsets of the same kind. Turns are ordered by number, then role and text,
    null first; null text and role are empty; rows with a null conv_id are one conversation. Repeated rows repeat.
    Other columns are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = F.create_map(*[F.lit(part) for pair in ROLES.items() for part in pair])
    label = F.coalesce(F.try_element_at(known, role), F.concat(F.lit("="), escaped(role, r"\\#<:")))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.floor(F.col("turn") / BLOCK).alias("block"),
        F.concat(F.lit("### "), label, F.lit(": ")).alias("head"), escaped(text).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("chars", F.length("piece").cast("bigint"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("of_conv").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block")).agg(
        F.sum("chars").alias("block_chars")).withColumn("before", F.coalesce(F.sum("block_chars").over(earlier), F.lit(0)))
    placed = rows.withColumn("within", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("block").eqNullSafe(F.col("of_block")))
    start = F.col("before") + F.col("within")
    begin = F.when(F.col("role") == TRAINED, start + F.length("head"))
    return placed.select("conv_id", "turn", "role", "piece", start.alias("start"), "chars", begin.alias("loss_start"),
                         (begin + F.length("body")).alias("loss_stop"))


def expand(turns: DataFrame) -> DataFrame:
    """One example an assistant turn: (conv_id, turn, context_chars, chars, loss_start, loss_stop).

    The example's text is the first ``chars`` code points of its formatted conversation; the first ``context_chars``
    are its context, and its loss mask is the reply alone.
    """
    return turns.where("loss_start is not null").select(
        "conv_id", "turn", F.col("start").alias("context_chars"), (F.col("start") + F.col("chars")).alias("chars"),
        "loss_start", "loss_stop")


def render(examples: DataFrame, turns: DataFrame) -> DataFrame:
    """The examples with their whole text. Its size is that of all contexts together, so choose the examples."""
    parts = turns.select(F.col("conv_id").alias("of_conv"), "start", "piece")
    keys = ["conv_id", "turn", "context_chars", "chars", "loss_start", "loss_stop"]
    held = examples.join(parts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("start") <= F.col("context_chars")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda one: one["piece"]), "")
    return held.groupBy(*keys).agg(joined.alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each conversation's turns, which come one after the other; one row is held at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    current, state, done = None, None, []
    for batch in batches:
        kinds[0] = batch.schema.field("conv_id").type
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "piece", "start", "loss_start", "loss_stop")]
        for conv, piece, start, begin, stop in zip(*columns):
            if state is None or conv != current:
                if state is not None:
                    done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
                current, state = conv, [0, sha256(), 0, sha256(), 0, 0]
            role, text = read_turn(piece)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
            if begin is not None:
                target = unescaped(piece[begin - start : stop - start])
                state[2] += len(target)
                state[3].update(target.encode("utf-8", "surrogatepass"))
                state[5] += 1
        if done:
            yield batch_of(done)
            done = []
    if state is not None:
        yield batch_of([(current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])])


def digests(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """A row a conversation, read back from its formatted turns and the loss masks of its examples.

    A hash of a conversation needs its turns in order, so each conversation streams through one task, which holds one
    batch at a time.
    """
    attach(turns.sparkSession)
    masks = examples.select(F.col("conv_id").alias("of_conv"), F.col("context_chars").alias("of_start"),
                            F.col("loss_start").alias("mask_start"), F.col("loss_stop").alias("mask_stop"))
    read = turns.join(masks, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("start") == F.col("of_start")), "left")
    rows = read.select("conv_id", "piece", "start", F.col("mask_start").alias("loss_start"), F.col("mask_stop").alias("loss_stop"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(
        _digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                 "formatted_chars bigint, n_examples bigint")
