"""The encrypt job on scratch folders."""

from __future__ import annotations

import secrets
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sealroute.operators.codec import AesProvider
from sealroute.plans.encrypt_job import SAME_OUTPUT, encrypt_files
from tests.test_decrypt_job import put, tree

AT = datetime(2026, 4, 17, 14, 30, 15, tzinfo=timezone.utc)
REQUEST = (
    "request_id long, root string, storageAccountName string, container string, tempFolder string, "
    "outputFolder string, pgpKeyPath string, archiveFolder string, errorFolder string, filePrefix string, runId string"
)


def request(spark, root, changes: dict[int, dict]):
    rows = []
    for number, change in changes.items():
        values = {
            "request_id": number, "root": str(root), "storageAccountName": "store", "container": "lake",
            "tempFolder": f"staging/{number}/", "outputFolder": f"out/{number}", "pgpKeyPath": "keys/partner.key",
            "archiveFolder": f"sent/{number}", "errorFolder": f"errors/{number}", "filePrefix": None,
            "runId": "a1b2c3d4-e5f6-7890-abcd-ef1234567890"}
        values.update(change)
        rows.append(tuple(values.values()))
    return spark.createDataFrame(rows, REQUEST)


def opened(spark, secret: str, data: bytes) -> bytes:
    rows = spark.createDataFrame([("p", "k", data)], "path string, key_id string, content binary").withColumns(
        {"status": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    keys = spark.createDataFrame([("k", secret)], "key_id string, material string")
    return bytes(AesProvider().decrypt(rows, keys).first().plaintext)


def test_picked_file_is_sealed_archived_and_cleared(spark, tmp_path):
    secret = secrets.token_hex(16)
    put(tmp_path, {
        "keys/partner.key": secret.encode(), "staging/1/part-0.csv": b"first", "staging/1/part-1.csv": b"second",
        "staging/1/_SUCCESS": b"", "staging/1/sub/_meta": b"m", "out/1/old.csv.pgp": b"old",
        "out/1/keep/deep.txt": b"deep"})
    run = encrypt_files(request(spark, tmp_path, {1: {"filePrefix": "export_"}}), AesProvider(), at=AT)
    row = run.results.first().asDict()
    assert row == {
        "request_id": 1, "status": "SUCCESS", "message": "File encrypted and archived successfully.",
        "outputFileName": "export_20260417143015.csv.pgp", "outputPath": "out/1/export_20260417143015.csv.pgp",
        "archivedFileName": "export_20260417143015.csv",
        "archivedPath": "sent/1/2026/04/17/export_20260417143015.csv", "originalSize": 6, "encryptedSize": 6 + 28,
        "tempFolder": None, "runId": "a1b2c3d4e5f67890abcd", "code": 200}
    files = tree(tmp_path)
    assert opened(spark, secret, files.pop("out/1/export_20260417143015.csv.pgp")) == b"second"
    assert files == {
        "keys/partner.key": secret.encode(), "staging/1/part-0.csv": b"first", "out/1/keep/deep.txt": b"deep",
        "sent/1/2026/04/17/export_20260417143015.csv": b"second"}
    assert {(r.path, r.action) for r in run.staging.collect()} == {
        ("staging/1/part-0.csv", "unprocessed"), ("staging/1/part-1.csv", "deleted"),
        ("staging/1/_SUCCESS", "deleted"), ("staging/1/sub/_meta", "deleted")}


def test_terminal_states(spark, tmp_path):
    put(tmp_path, {
        "keys/partner.key": b"k", "staging/2/_only": b"x", "staging/3/e.csv": b"", "staging/4/a.csv": b"data",
        "staging/6/a.csv": b"data", "staging/8/a.csv": b"data", "staging/9/a.csv": b"data", "out/8": b"a file",
        "out/9/old": b"old"})
    changes = {
        1: {"outputFolder": "/"}, 2: {}, 3: {}, 4: {"pgpKeyPath": "../k"}, 5: {}, 6: {"pgpKeyPath": "keys/none"},
        7: {"errorFolder": None}, 8: {}, 9: {"archiveFolder": "sent/8", "filePrefix": "x_"}}
    run = encrypt_files(request(spark, tmp_path, changes), AesProvider(), at=AT, error_table=str(tmp_path / "log"))
    got = {row.request_id: (row.code, row.status) for row in run.results.collect()}
    assert got == {
        1: (400, None), 2: (404, "NO_FILE"), 3: (422, "EMPTY_FILE"), 4: (400, None), 5: (500, "SETUP_FAILED"),
        6: (500, "SETUP_FAILED"), 7: (400, None), 8: (500, "POST_ENCRYPT_FAILED"), 9: (200, "SUCCESS")}
    assert (tmp_path / "staging/8/a.csv").read_bytes() == b"data"
    log = (tmp_path / "errors/8/error_20260417143015.log").read_text().splitlines()
    assert log[0] == "Timestamp: 2026-04-17T14:30:15.000000+00:00" and log[1].startswith("Error: ")
    assert log[2] == "TempFolder: staging/8"
    errors = spark.read.parquet(str(tmp_path / "log")).collect()
    assert [(row.temp_folder, str(row.ts)) for row in errors] == [("staging/8", "2026-04-17 14:30:15")]


def test_requests_sharing_an_output_do_not_overwrite_each_other(spark, tmp_path):
    put(tmp_path, {"keys/partner.key": b"k", "staging/1/a.csv": b"one", "staging/2/a.csv": b"two"})
    shared = {"outputFolder": "out", "archiveFolder": "sent"}
    run = encrypt_files(request(spark, tmp_path, {1: shared, 2: shared}), AesProvider(), at=AT)
    first, second = sorted(run.results.collect(), key=lambda row: row.request_id)
    assert first.status == "SETUP_FAILED" and SAME_OUTPUT in first.message
    assert second.status == "SUCCESS"
    files = tree(tmp_path)
    assert files["staging/1/a.csv"] == b"one" and "staging/2/a.csv" not in files
