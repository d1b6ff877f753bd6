"""Benchmark hits against a search for every window."""

from __future__ import annotations

import random
import re

import pytest

from sealroute.llm import decontaminate
from sealroute.llm.automaton import Automaton, words

DOCS = "doc_id bigint, text string, lang string, N_HIT string"
ITEMS = "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window):
    wanted = {}
    for key, text in items:
        found = WORD.findall(lower(text))
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            wanted.setdefault(tuple(found[i : i + size]), set()).add(None if key is None else str(key))
    out = []
    for key, text in docs:
        found = WORD.findall(lower(text))
        hit, seen = set(), set()
        for size in {len(one) for one in wanted}:
            for i in range(len(found) - size + 1):
                if tuple(found[i : i + size]) in wanted:
                    seen |= wanted[tuple(found[i : i + size])]
                    hit |= set(range(i, i + size))
        out.append((key, len(found), len(hit), sorted(one for one in seen if one is not None),
                    bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


def result(spark, docs, items, **options):
    frame = spark.createDataFrame([(key, text, "en", "clash") for key, text in docs], DOCS)
    found = decontaminate.find_contamination(frame, spark.createDataFrame(items, ITEMS), **options)
    assert [name.lower() for name in found.columns].count("n_hit") == 1
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()), key=str)


def grown(seed):
    source = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "é1"]
    items = [(key, " ".join(source.choices(vocabulary, k=source.randint(1, 12)))) for key in range(25)]
    docs = [(key, " ".join(source.choices([*vocabulary, "zz"], k=source.randint(0, 80)))) for key in range(60)]
    return docs, items


@pytest.mark.parametrize("seed, window, block", [(1, 5, 10**6), (2, 4, 20), (3, 7, 60)])
def test_random_words(spark, seed, window, block):
    docs, items = grown(seed)
    assert result(spark, docs, items, window=window, block_words=block) == brute(docs, items, window)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, passage.upper()), (None, "only here"), (4, None), (5, "—!"), (6, ""), (7, "x"), (7, "x")]
    docs = [(1, f"Intro. {passage} outro"), (1, f"Intro. {passage} outro"), (2, None), (3, ""), (4, "..."),
            (None, "only HERE"), (5, "x " * 30_000), (6, " ".join(f"w{i}" for i in range(12))), (7, "W0, w1\nw2 " * 9)]
    assert result(spark, docs, items) == brute(docs, items, 13)
    assert result(spark, docs, []) == brute(docs, [], 13)
    assert result(spark, [], items) == []


def test_spans_go_and_documents_go(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = [(1, "head " * 400 + f"W0! {passage[3:]} tail", "en", "-"), (2, passage, "en", "-"), (3, None, "en", "-"), (4, "clean text", "en", "-")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert kept == {1: "head " * 400 + " tail", 3: None, 4: "clean text"}


def test_automaton_knows_every_substring():
    source = random.Random(4)
    items = [(str(i), [source.choice([b"a", b"b", b"c"]) for _ in range(30)]) for i in range(4)]
    built = Automaton(items, 3)
    every = {tuple(found[i:j]) for _, found in items for i in range(30) for j in range(i + 1, 31)}
    reached, stack = set(), [(0, ())]
    names = {number: word for word, number in built.ids.items()}
    while stack:
        state, path = stack.pop()
        for word, after in built.next[state].items():
            reached.add((*path, names[word]))
            stack.append((after, (*path, names[word])))
    assert reached == every
    assert words("It's É-9") == [b"it", b"s", "É".encode(), b"9"]
