"""The mix: targets, solved rates, whole copies."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from statistics import median

import pytest

from sealroute.llm import mixing

SCHEMA = "doc_id bigint, source string, size bigint, target string, mix_cell string"


def expected_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[name] for name in capped)
        share = sum(weight[name] for name in names if name not in capped)
        level = rest / share if share else 0
        over = {name for name in names if name not in capped and level * weight[name] > limit * sizes[name]}
        if not over:
            return {name: limit * sizes[name] if name in capped else level * weight[name] for name in names}
        capped |= over


def made(seed, count, sources):
    draw = random.Random(seed)
    return [(i, draw.choices(sources, weights=range(1, len(sources) + 1))[0],
             int(draw.lognormvariate(4, 1.5)) if draw.random() > 0.05 else 0) for i in range(count)]


def result(spark, rows):
    frame = spark.createDataFrame([(*row, "clash", "clash") for row in rows], SCHEMA)
    return mixing.mix(frame).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken").collect()


@pytest.mark.parametrize("seed, count", [(1, 40), (2, 3000)])
def test_mix(spark, seed, count):
    rows = made(seed, count, [None, "a", "ä", "z1", "z10", "z9", ""])
    rows += [(10_000 + i, "a", 77) for i in range(count)]
    got = result(spark, rows)
    assert sorted((r.doc_id, r.source or "-", r.size) for r in got) == sorted((k, s or "-", n) for k, s, n in rows)
    sizes, words, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        words[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    wanted = expected_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for name, target in wanted.items():
        # Copies are whole, so a source of a few documents may miss its target by less than half a usual document.
        usual = median([r.size for r in got if r.source == name and r.size])
        assert abs(words[name] - target) <= max(usual / 2 if count < 100 else 0, 0.01 * target), (name, words[name], target)
        # The rates solve the balancing problem: exponentially tilted, and their words meet the target.
        own = [r for r in got if r.source == name]
        assert math.isclose(sum(r.rate * r.size for r in own), target, rel_tol=1e-6, abs_tol=1e-6)
        mean = max(1.0, sizes[name] / len(own))
        tilts = {round(math.log(r.rate) / (1 + r.size / (r.size + mean)), 6) for r in own if r.size and r.rate < 3}
        assert len(tilts) <= 1
    again = result(spark, rows[::-1])
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_tables(spark):
    assert result(spark, []) == []
    assert {r.taken for r in result(spark, [(1, None, 0), (None, "a", 0)])} == {0}
    one = result(spark, [(1, None, 5), (1, None, 5)])
    assert [r.taken for r in one] == [5, 5]


def test_words_and_pipeline_form(spark):
    docs = spark.createDataFrame(
        [(1, "one  two\n", "en", "a", 9, "x"), (2, None, "en", "a", None, "x"), (3, "\u00a0 x", "en", None, 3, "x")],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string")
    sized = {r.doc_id: r.size for r in docs.select("doc_id", mixing.word_count("text").alias("size")).collect()}
    assert sized == {1: 2, 2: 0, 3: 2}
    kept = mixing.mixed(docs.drop("copies"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    assert mixing.mixed(docs).count() == kept.count()
