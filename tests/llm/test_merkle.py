"""The hash tree: every column against a plain tree, on ordinary and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sealroute.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if value is None else f"{len(str(value).encode())}:{value}" for value in row))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def climb(levels, place):
    for level in levels[:-1]:
        first = place // 16 * 16
        yield level[first:place], level[place + 1 : first + 16]
        place //= 16


def expected(rows):
    trees = defaultdict(list)
    for row in rows:
        chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
        seen = (*row[:4], row[4].translate(LOWER)) if chosen else row
        trees[row[1]].append((row[0], leaf_of(row), leaf_of(seen)))
    sources = sorted(trees, key=lambda name: (name is not None, (name or "").encode()))
    for name in sources:
        trees[name].sort(key=lambda one: (one[0] is not None, one[0] or 0, one[1]))
    built = {name: levels_of([one[1] for one in trees[name]]) for name in sources}
    top = levels_of([built[name][-1][0] for name in sources])
    out = []
    for order, name in enumerate(sources):
        for place, (key, leaf, seen) in enumerate(trees[name]):
            path = [*climb(built[name], place), *climb(top, order)]
            folded = seen
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            proof = sha("".join("".join(before + after) for before, after in path))
            root = top[-1][0]
            out.append((key, leaf, built[name][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def result(frame):
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(frame, {"text": F.when(chosen, merkle.lower_ascii(text)).otherwise(text)})
    assert found.columns == list(merkle.RESULTS)
    return sorted([tuple(row) for row in found.collect()], key=str)


def test_odd_rows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄA") for i in range(600)]
    rows += [(i, None, None, None, None) for i in range(5)] + [(None, "s1", "en", 3, "A")] * 40
    rows += [(7, "s0", "en", 3, "same")] * 20 + [(7, "s0", "en", 3, "other")] * 3
    rows += [(900, "lone", "", 0, ""), (901, "ÿ", "-", 1, "-"), (902, "𐀀", "de", 9, "X" * 300_000), (903, "", "de", 1, "B")]
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], f"{SCHEMA}, hash string, place int")
    assert result(frame) == expected(rows)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 257])
def test_sizes_of_one_source(spark, count):
    rows = [(i, "only", "en", i, "A") for i in range(count)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_more_sources_than_a_run(spark):
    rows = [(i, f"host{i % 40:02}", "en", i, f"B{i}") for i in range(100)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_empty(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    found = {row[0]: row[-1] for row in result(spark.createDataFrame(rows, SCHEMA))}
    chosen = {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, good in found.items() if not good} == {i for i in chosen if i % 2}
