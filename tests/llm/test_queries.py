"""The registered queries of this subpackage: SQL where there is any, rules of the result elsewhere."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from sealroute.llm.queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("documents", "benchmark", "pages", "conversations", "labels")


def test_every_operator_and_the_pipeline_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "decontamination", "personal_data", "mixing"]


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as duck:
        for table in TABLES:
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        result = duck.execute(oracle_sql()[name])
        columns = [column[0] for column in result.description]
        expected = sorted(result.fetchall(), key=str)
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(row) for row in got.select(*columns).collect()), key=str) == expected


def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def test_personal_data_query_equals_the_plain_patterns(spark):
    from hashlib import sha256

    from tests.llm.test_pii import PLAIN, base

    got = {r.doc_id: r for r in queries()["op5_personal_data"](spark, SF).collect()}
    rows = documents()
    assert set(got) == {row[0] for row in rows}
    for key, text, *_ in rows:
        found = base(text)
        assert got[key].base_sha256 == sha256(",".join(found).encode()).hexdigest()
        assert [got[key][f"n_{kind}"] for kind in PLAIN] == [sum(one.startswith(kind) for one in found) for kind in PLAIN]
        assert [one for one in got[key].spans.split(",") if one and not one.startswith("id:")] == found


def test_mixing_query_meets_its_targets(spark):
    from tests.llm.test_mixing import expected_targets

    got = queries()["op8_mixing"](spark, SF).collect()
    of = {key: (len((text or "").encode().split()), source) for key, text, _, source in documents()}
    assert {r.doc_id: r.size for r in got} == {key: size for key, (size, _) in of.items()}
    sizes, words = {}, {}
    for r in got:
        source = of[r.doc_id][1]
        sizes[source] = sizes.get(source, 0) + r.size
        words[source] = words.get(source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in got:
        target = expected_targets(sizes)[of[r.doc_id][1]]
        assert r.target == pytest.approx(target) and r.source_size == sizes[of[r.doc_id][1]]
        assert words[of[r.doc_id][1]] == pytest.approx(target, rel=0.01)


def test_pipeline_stages_follow_from_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, against plain Python on the same rows."""
    from tests.llm.test_contamination import brute as contaminated
    from tests.llm.test_neardup import brute as groups
    from tests.llm.test_pii import base

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
        assert frames[-1].columns == columns + (["copies", "taken"] if name == "mixing" else [])
    texts = [{r.doc_id: r.text for r in frame.collect()} for frame in frames]
    assert set(texts[1]) == set(texts[0])
    assert set(texts[2]) == {key for key, _, of in groups(list(texts[1].items())) if key == of}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {row[0]: row for row in contaminated(list(texts[2].items()), items, 13)}
    assert set(texts[3]) == {key for key, row in found.items() if not row[-1]}
    assert all(text == texts[2][key] for key, text in texts[3].items() if not found[key][2])
    assert set(texts[4]) == set(texts[3])
    for key, text in texts[4].items():
        assert base(text) == [] and (text == texts[3][key] or base(texts[3][key]) or "<ID>" in text)
    mixed = frames[5].collect()
    assert {r.doc_id for r in mixed} <= set(texts[4])
    assert all(r.text == texts[4][r.doc_id] and 1 <= r.copies <= 3 and r.taken == r.copies * len(r.text.encode().split()) for r in mixed)
