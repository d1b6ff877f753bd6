"""Runs that are broken off are finished by the next call with their journal."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sealroute.operators.codec import AesProvider
from sealroute.plans import decrypt_job, encrypt_job
from sealroute.plans.decrypt_job import decrypt_files, open_files, route_files
from sealroute.session import journal_run
from tests.test_decrypt_job import AT, put, request, seal, summaries, tree


def landed(spark, sealed, root):
    put(root, {f"inbound/{'ab'[i % 2]}/{name}.pgp": data for i, (name, data) in enumerate(sorted(sealed.items()))})
    put(root, {"inbound/a/bad.csv.pgp": b"junk", "inbound/b/notes.txt": b"n", "inbound/a/f1.csv.PGP": b"junk"})
    return request(spark, root, "a", "b")


@pytest.mark.parametrize("stop", ["listed", "opened", "moved"])
def test_a_broken_off_decrypt_run(spark, keys, tmp_path, monkeypatch, stop):
    clean, broken = tmp_path / "clean", tmp_path / "broken"
    sealed = seal(spark, keys, {f"f{i}.csv": b"row" * i for i in range(1, 7)})
    expected = decrypt_files(landed(spark, sealed, clean), keys, AesProvider(), at=AT)
    requests, journal = landed(spark, sealed, broken), str(tmp_path / "journal")
    if stop == "listed":
        monkeypatch.setattr(decrypt_job, "read_payload", lambda *args, **kwargs: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            decrypt_files(requests, keys, AesProvider(), at=AT, journal=journal)
        monkeypatch.undo()
    else:
        opened = open_files(requests, keys, AesProvider(), at=AT, journal=journal)
        if stop == "moved":
            half = replace(opened, results=opened.results.where(F.col("path").rlike("f[135]|bad")))
            assert route_files(half).count() == 5
    put(broken, {"inbound/a/later.csv.pgp": b"junk"})
    run = decrypt_files(requests, keys, AesProvider(), journal=journal)
    assert summaries(run) == summaries(expected)
    assert run.metrics == expected.metrics
    left = tree(broken)
    assert left.pop("inbound/a/later.csv.pgp") == b"junk"
    assert left == tree(clean)
    after = decrypt_files(requests, keys, AesProvider(), at=AT, journal=journal)
    assert [(row.batch, row.total, row.failed) for row in after.summary.orderBy("batch").collect()] == [("a", 1, 1), ("b", 0, 0)]


def test_a_broken_off_encrypt_run(spark, tmp_path, monkeypatch):
    from tests.test_encrypt_job import request as encrypt_request

    put(tmp_path, {"staging/1/d.csv": b"one", "staging/1/_x": b"", "keys/partner.key": b"key", "out/1/old.pgp": b"old"})
    requests, journal = encrypt_request(spark, tmp_path, {1: {}}), str(tmp_path / "journal")
    monkeypatch.setattr(encrypt_job, "_clear_staging", lambda *args, **kwargs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        encrypt_job.encrypt_files(requests, AesProvider(), at=AT, journal=journal)
    monkeypatch.undo()
    sealed = {name: data for name, data in tree(tmp_path).items() if name.startswith("out/")}
    results = encrypt_job.encrypt_files(requests, AesProvider(), journal=journal).results.collect()
    assert [row.status for row in results] == ["SUCCESS"]
    left = tree(tmp_path)
    assert {name: data for name, data in left.items() if name.startswith("out/")} == sealed and len(sealed) == 1
    assert not [name for name in left if name.startswith("staging/")]


def test_journal_runs_follow_each_other(tmp_path):
    journal = str(tmp_path)
    assert journal_run(journal, "summary").endswith("run-000001")
    (tmp_path / "run-000001" / "summary").mkdir(parents=True)
    assert journal_run(journal, "summary").endswith("run-000001")
    (tmp_path / "run-000001" / "summary" / "_SUCCESS").write_bytes(b"")
    assert journal_run(journal, "summary").endswith("run-000002")
