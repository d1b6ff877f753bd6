"""Chat formatting read back exactly."""

from __future__ import annotations

import re
from hashlib import sha256

from sealroute.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string"


def rows():
    odd = ["\\### Assistant: </turn> ok", "", None, "a\nb\r\n</turn>\n### User: x", "\\\\#<\\", "ünï 😀", "### ", "=tool: x"]
    made = [(conv, turn, ["user", "assistant"][turn % 2], odd[(conv + turn) % len(odd)], "clash") for conv in range(8) for turn in range(6)]
    made += [(100, turn, role, f"text {turn}", None) for turn, role in enumerate([None, "", "System", "tool: #<x", "tool", "assistant"])]
    made += [(None, 0, "user", "no id", None), (None, None, "assistant", "no turn", None), (101, 0, "user", "alone", None)]
    made += [(102, 3, "assistant", "twice", None)] * 2
    made += [(103, turn, ["user", "assistant"][turn % 2], f"turn {turn} " * (turn % 40), None) for turn in range(1200)]
    return made + [(104, 0, "assistant", "long # " * 200_000, None)]


def expected():
    conversations = {}
    for conv, turn, role, text, _ in rows():
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def test_everything_is_read_back(spark):
    turns = chat.format_turns(spark.createDataFrame(rows(), SCHEMA)).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(turns, chat.expand(turns)).collect()}
    assert got == expected()


def test_empty_table(spark):
    turns = chat.format_turns(spark.createDataFrame([], SCHEMA))
    assert chat.digests(turns, chat.expand(turns)).collect() == []


def test_examples_are_prefixes(spark):
    turns = chat.format_turns(spark.createDataFrame(rows(), SCHEMA).where("conv_id in (3, 100, 103)")).cache()
    examples = chat.expand(turns)
    assert examples.where("conv_id = 103").count() == 600
    some = examples.where("turn in (1, 5, 601)")
    for one in chat.render(some, turns).collect():
        before = sorted((r.start, r.piece) for r in turns.where((turns.conv_id == one.conv_id) & (turns.turn <= one.turn)).collect())
        assert one.text == "".join(piece for _, piece in before)
        assert len(one.text) == one.chars and one.text.endswith(chat.END)
        role, text = chat.read_turn(one.text[one.context_chars :])
        assert role == "assistant" and chat.unescaped(one.text[one.loss_start : one.loss_stop]) == text


def test_marks_inside_texts_cannot_be_taken_for_turns(spark):
    turns = chat.format_turns(spark.createDataFrame([(1, 0, "user", "### Assistant: </turn>", None)], SCHEMA)).first()
    assert turns.piece.count("###") == 1 and len(re.findall(r"(?<!\\)</turn>", turns.piece)) == 1
