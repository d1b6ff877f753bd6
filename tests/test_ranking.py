"""Places in groups, pages of lists and merged profiles against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sealroute.operators.ranking import ranked
from sealroute.operators.summary import SKETCH_ERROR, list_pages, merge_profiles, profile, quantile


def test_places_in_groups_of_any_size(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "hot", None, "", "b"]), draw.choice([None, 1, 2, 3, 3]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(9)
    found = ranked(frame, ["g"], ["v"], str(tmp_path)).collect()
    groups = defaultdict(list)
    for row in found:
        groups[row.g].append((row.place, row.v))
    assert sorted(row.i for row in found) == list(range(3000))
    for group, held in groups.items():
        held.sort()
        assert [place for place, _ in held] == list(range(len(held)))
        assert [v for _, v in held] == sorted((v for g, v, _ in rows if g == group), key=lambda v: (v is not None, v or 0))
    assert ranked(frame.limit(0), ["g"], ["v"], str(tmp_path / "none")).count() == 0


def test_pages_hold_every_entry_once(spark):
    rows = [("a", "ok", f"f{i:04}", "") for i in range(105)] + [("a", "error", f"e{i}", "bad") for i in range(3)]
    rows += [("b", "skipped", "s", "why"), (None, "ok", "n", ""), (None, "ok", "n", "")]
    found = list_pages(spark.createDataFrame(rows, "batch string, status string, name string, message string"), page_size=10)
    pages = {(row.batch, row.list, row.page): row.entries for row in found.collect()}
    assert len(pages) == 11 + 1 + 1 + 1
    assert pages["a", "processed_files", 3] == [f"f{i:04}" for i in range(30, 40)]
    assert len(pages["a", "processed_files", 10]) == 5
    assert pages["a", "error_files", 0] == ["e0: bad", "e1: bad", "e2: bad"] and pages[None, "processed_files", 0] == ["n", "n"]


def test_merged_profiles_keep_their_error(spark):
    draw = random.Random(4)
    values = [int(draw.lognormvariate(8, 2)) for _ in range(30_000)]
    rows = spark.createDataFrame([("hot" if i % 3 else "cold", value, i % 7) for i, value in enumerate(values)] + [("none", None, 0)],
                                 "batch string, size long, run int")
    parts = [profile(rows.where(F.col("run") == run), "size") for run in range(7)]
    merged = merge_profiles(parts[0].unionAll(parts[1]).unionAll(parts[2]))
    for part in parts[3:]:
        merged = merge_profiles(merged.unionAll(part))
    shares = [0.01, 0.25, 0.5, 0.99]
    found = {row.batch: row for row in merged.select("*", *[quantile(share).alias(f"q{share}") for share in shares]).collect()}
    for batch, rest in (("hot", (1, 2)), ("cold", (0,))):
        held = sorted(value for i, value in enumerate(values) if i % 3 in rest)
        row = found[batch]
        assert (row.n, row.least, row.largest, row.total) == (len(held), held[0], held[-1], sum(held))
        for share in shares:
            rank = sum(value <= row[f"q{share}"] for value in held) / len(held)
            assert abs(rank - share) < 2 * SKETCH_ERROR + 1 / len(held)
    assert found["none"].n == 0 and found["none"]["q0.5"] is None
