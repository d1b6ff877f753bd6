"""Near-duplicate groups against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np

from sealroute.llm import neardup, sketch

SCHEMA = "doc_id bigint, text string, lang string, n_shingles string"


def brute(rows, width=4, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        size = min(width, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if both and 100 * both >= percent * len(one | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return sorted(
        ((key, len(one), smallest.get(find(i)) if one else key) for i, ((key, _), one) in enumerate(zip(rows, sets))), key=str)


def grown(seed, groups, copies, edits):
    source = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = source.choices(words, k=source.randint(3, 120))
        for _ in range(copies):
            text = list(base)
            for _ in range(source.randint(0, edits)):
                at = source.randrange(len(text))
                kind = source.random()
                if kind < 0.6:
                    text[at] = source.choice(words)
                elif kind < 0.8:
                    text.insert(at, source.choice(words))
                elif len(text) > 1:
                    del text[at]
            rows.append(" ".join(text))
    source.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows, **options):
    docs = spark.createDataFrame([(key, text, "en", "clash") for key, text in rows], SCHEMA)
    found = neardup.near_duplicates(docs, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


def test_many_small_and_one_large_group(spark):
    rows = grown(1, 40, 3, 4) + [(10_000 + key, text) for key, text in grown(2, 1, 150, 9)]
    assert result(spark, rows) == brute(rows)


def test_another_similarity(spark):
    rows = grown(3, 2, 60, 8)
    assert result(spark, rows, percent=60) == brute(rows, percent=60)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (5, "one two"), (7, "ÄB c"), (8, "äb c"),
            (None, "one two"), (9, "a b c d e " * 4000), (10, "a b c d e " * 4001), (11, "zz"), (None, None)]
    assert result(spark, rows) == brute(rows)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "one two three four five"), (2, "One two three four five"), (2, "one two three four five"), (7, None),
            (7, ""), (9, "another text")]
    docs = spark.createDataFrame([(key, text, "en", "clash") for key, text in rows], SCHEMA)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "-") for r in kept.collect()) == [
        (2, "One two three four five"), (7, "-"), (7, "-"), (9, "another text")]


def test_rows_are_chosen_by_row_and_not_by_id(spark):
    rows = [(None, "apples are red and round"), (None, "zebras live far from here"), (None, "Zebras live far from here"),
            (None, "under the same text here"), (8, "under the same text here"), (None, None), (3, "kept by the smaller id"),
            (5, "kept by the smaller id"), (5, "quite another text than that")]
    docs = spark.createDataFrame([(key, text, "en", "clash") for key, text in rows], SCHEMA)
    got = neardup.deduplicate(docs).collect()
    assert sorted(((r.doc_id, (r.text or "-").lower()) for r in got), key=str) == sorted([
        (None, "apples are red and round"), (None, "zebras live far from here"), (8, "under the same text here"), (None, "-"),
        (3, "kept by the smaller id"), (5, "quite another text than that")], key=str)


def test_every_pair_of_a_small_bucket_is_confirmed(spark):
    """Sizes may rule a pair out, an estimate may not."""
    rows = [(7, b"a", 10), (7, b"b", 9), (7, b"c", 7), (8, b"a", 10), (8, b"d", 8)]
    buckets = spark.createDataFrame([(*row, 3) for row in rows], "bucket bigint, digest binary, n bigint, members bigint")
    found = neardup._small_pairs(buckets, 80).collect()
    assert sorted((bytes(r.u), bytes(r.v)) for r in found) == [(b"a", b"b"), (b"a", b"d")]


def test_sketches_estimate_similarity():
    source = np.random.default_rng(5)
    base = source.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    other = np.r_[base[:800], source.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)]
    shares = [float(np.mean(sketch.sketch(base ^ np.uint64(i)) == sketch.sketch(other ^ np.uint64(i)))) for i in range(0, 4000, 40)]
    assert abs(np.mean(shares) - 0.8) < 0.02 and np.std(shares) < 0.06
    assert len(np.unique(sketch.sketch(base[:1]))) > 100
