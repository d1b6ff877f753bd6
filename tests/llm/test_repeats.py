"""Repeated strings: the run-length index against all pairs of positions, removal against every string's count."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealroute.llm import repeats, rlbwt

SCHEMA = "doc_id bigint, text string, kept string, k1 int, spans int, row int"


def longest_elsewhere(texts):
    places = [(k, i) for k, text in enumerate(texts) for i in range(len(text))]

    def common(one, two):
        a, b, n = texts[one[0]][one[1]:], texts[two[0]][two[1]:], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    return [max((common(one, two) for two in places if two != one), default=0) for one in places]


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    draw = random.Random(seed)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 5))]
    texts += [texts[0]] * (seed % 3) + [texts[0][3:] + b"z" + texts[-1] * 3] * (seed % 2)
    index = rlbwt.build_index(texts)
    assert index.lengths.sum() == sum(map(len, texts))
    assert rlbwt.matching_statistics(index).tolist() == longest_elsewhere(texts)


def test_copies_cost_runs_and_not_bytes():
    draw = random.Random(1)
    text = bytes(draw.randrange(97, 123) for _ in range(2000))
    assert len(rlbwt.build_index([text] * 50).firsts) < 2 * len(rlbwt.build_index([text]).firsts) + 100


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, hash of the rest) by counting every string."""
    held = [(key, (text or "").encode()) for key, text in rows]
    size = repeats.LENGTH
    counts = Counter(data[i : i + size] for _, data in held for i in range(len(data) - size + 1))
    out = []
    for key, data in held:
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if counts[data[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, one in enumerate(gone) if one and not (i and gone[i - 1]))
        kept = bytes(byte for byte, one in zip(data, gone) if not one)
        out.append((key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    frame = spark.createDataFrame([(*row, "clash", 1, 2, 3) for row in rows], SCHEMA).repartition(5)
    found = repeats.remove_repeats(frame)
    assert found.columns == ["doc_id", "text", "k1", "spans", "row", "n_bytes", "n_removed", "n_spans", "kept"]
    got = found.collect()
    assert {(row.k1, row.spans, row.row) for row in got} <= {(1, 2, 3)}
    assert sorted(((row.doc_id, row.text) for row in got), key=str) == sorted(rows, key=str)
    return sorted(((row.doc_id, row.n_bytes, row.n_removed, row.n_spans, hashlib.sha256(row.kept).hexdigest()) for row in got), key=str)


def words(draw, count):
    return " ".join("".join(draw.choice("abcdefghäß") for _ in range(draw.randint(2, 9))) for _ in range(count))


def made(seed):
    draw = random.Random(seed)
    passage, base = words(draw, 120), words(draw, 400)
    rows = [(i, words(draw, draw.randint(0, 150))) for i in range(40)]
    rows += [(100 + i, words(draw, 30) + passage + words(draw, 30)) for i in range(25)]
    rows += [(200, base), (200, base), (None, base), (201, base[:399]), (202, base[5:1200]), (None, None), (203, "")]
    for i in range(30):
        text = list(base)
        for _ in range(4):
            text[draw.randrange(len(text))] = "X"
        rows.append((300 + i, "".join(text)))
    rows += [(400, "x" * 399), (401, "y" * 400), (402, "z" * 401), (403, "ab" * 1500), (404, "ab" * 300), (405, base + base)]
    rows += [(406, passage[:500] + "|" + passage[:500]), (407, "\n".join([passage] * 6))]
    return rows


@pytest.mark.parametrize("most", [repeats.MOST, 3])
def test_against_counts_of_every_string(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    rows = made(3)
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "short")], [(1, "a" * 5000)]])
def test_little(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_chunks_lose_no_string(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 256)
    draw = random.Random(2)
    texts = [words(draw, 300).encode(), b"q" * 390, words(draw, 900).encode(), b"k" * 400]
    ends = np.cumsum([len(text) for text in texts])
    held = []
    for starts, sizes, _ in repeats.contexts_of(np.frombuffer(b"".join(texts), np.uint8), ends):
        held += [i for start, size in zip(starts, sizes) for i in range(start, start + size - repeats.LENGTH + 1)]
    begins = ends - [len(text) for text in texts]
    assert held == [i for a, b in zip(begins, ends) for i in range(a, b - repeats.LENGTH + 1)]


def test_equal_strings_have_equal_pieces():
    draw = random.Random(4)
    shared = words(draw, 200).encode()
    first, second = words(draw, 50).encode() + shared, words(draw, 77).encode() + shared
    filed = {}
    for text in (first, second):
        data = np.frombuffer(text, np.uint8)
        for starts, sizes, pieces in repeats.contexts_of(data, np.array([len(text)])):
            for start, size, piece in zip(starts, sizes, pieces):
                for i in range(start, start + size - repeats.LENGTH + 1):
                    filed.setdefault(text[i : i + repeats.LENGTH], set()).add(int(piece))
    assert all(len(pieces) == 1 for pieces in filed.values())


def test_no_piece_is_one_tasks(spark, monkeypatch):
    """Contexts of near copies have pieces in common; neither finding nor joining them brings a piece to one task."""
    draw = random.Random(5)
    base = words(draw, 60)
    texts = [words(draw, draw.randint(1, 9)) + base + words(draw, draw.randint(1, 9)) for _ in range(400)]
    texts += [base] * 400
    monkeypatch.setattr(repeats, "MOST", 20)

    def dealt(rows, pieces):
        # A scan packs small files into one task; here the rows come from several.
        out = of_pieces(rows.repartition(8), pieces)
        found = out.withColumn("task", F.spark_partition_id()).groupBy("task", "piece").count().agg(F.max("count")).first()[0]
        spread.append((found, out.groupBy("piece").count().agg(F.max("count")).first()[0]))
        return out

    of_pieces, spread = repeats._of_pieces, []
    monkeypatch.setattr(repeats, "_of_pieces", dealt)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = list(enumerate(texts))
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(spread) == 2 and all(in_task <= 0.6 * in_all for in_task, in_all in spread)


def test_registered_query(spark):
    from sealroute.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(row) for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_repeats"][0](spark, sf)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(row) for row in found.collect()), key=str) == brute(rows)
