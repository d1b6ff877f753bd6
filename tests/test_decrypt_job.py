"""The decrypt job on scratch folders: real files are written, archived and quarantined."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sealroute.operators.codec import DECRYPT_FAILED, AesProvider
from sealroute.operators.keys import KeyTable
from sealroute.operators.openpgp import OpenPgpProvider
from sealroute.plans.decrypt_job import SAME_BATCH, SAME_FOLDER, decrypt_files

AT = datetime(2026, 4, 17, 14, 30, 15, 123456, tzinfo=timezone.utc)
STAMP = "20260417143015123456"
REQUEST = (
    "batch string, root string, key_id string, file_system_name string, source_folder string, "
    "destination_folder string, error_folder string, archive_folder string"
)


def seal(spark, keys, texts: dict[str, bytes], key_id: str = "alpha") -> dict[str, bytes]:
    rows = spark.createDataFrame(list(texts.items()), "path string, content binary").withColumns({
        "key_id": F.lit(key_id), "status": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    return {row.path: bytes(row.sealed) for row in AesProvider().encrypt(rows, keys).collect()}


def put(root: Path, files: dict[str, bytes]) -> None:
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def tree(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()}


def request(spark, root, *batches, **changes):
    rows = []
    for batch in batches:
        values = {
            "batch": batch, "root": str(root), "key_id": "alpha", "file_system_name": "lake",
            "source_folder": f"inbound/{batch}", "destination_folder": f"done/{batch}",
            "error_folder": f"errors/{batch}", "archive_folder": f"archive/{batch}",
        }
        values.update(changes.get(batch, {}))
        rows.append(tuple(values.values()))
    return spark.createDataFrame(rows, REQUEST)


def summaries(run):
    return {row.batch: row.asDict() for row in run.summary.collect()}


def test_folders_are_decrypted_routed_and_summarised(spark, keys, tmp_path):
    plain = {f"f{i}.csv": f"row {i}\n".encode() * (i + 1) for i in range(4)}
    sealed = seal(spark, keys, plain)
    put(tmp_path / "inbound/a", {f"{name}.pgp": data for name, data in sealed.items()})
    put(tmp_path / "inbound/a", {
        "_SUCCESS": b"", "notes.pdf": b"x", "broken.csv.pgp": sealed["f0.csv"][:-1], "empty.csv.pgp": b"",
        ".hidden.csv.PGP": seal(spark, keys, {"h": b"hidden"})["h"], ".pgp": b"junk", "sub/deep.csv.pgp": b"not listed"})
    (tmp_path / "inbound/void").mkdir(parents=True)
    run = decrypt_files(request(spark, tmp_path, "a", "void"), keys, AesProvider(), at=AT)
    got = summaries(run)
    assert got["void"] | {} == {
        "batch": "void", "total": 0, "ok": 0, "failed": 0, "skipped": 0, "processed_files": [], "skipped_files": [],
        "error_files": [], "message": "No files found in source folder: inbound/void", "code": 200}
    a = got["a"]
    size = sum(map(len, plain.values())) + len(b"hidden")
    assert run.metrics["files"] == 10 and run.metrics["bytes_out"] == size
    assert all(row.elapsed_ms is not None for row in run.files.collect())
    assert (a["total"], a["ok"], a["failed"], a["skipped"], a["code"]) == (10, 5, 3, 2, 207)
    assert a["processed_files"] == [".hidden.csv.PGP", *[f"f{i}.csv.pgp" for i in range(4)]]
    assert a["skipped_files"] == ["_SUCCESS", "notes.pdf"]
    assert a["error_files"] == [
        ".pgp: file name is empty without its extension", f"broken.csv.pgp: {DECRYPT_FAILED}",
        f"empty.csv.pgp: {DECRYPT_FAILED}"]
    files = tree(tmp_path)
    for name, data in plain.items():
        assert files.pop(f"done/a/{name}") == data
        assert files.pop(f"archive/a/{STAMP}_{name}.pgp") == sealed[name]
    assert files.pop("done/a/.hidden.csv") == b"hidden"
    files.pop(f"archive/a/{STAMP}_.hidden.csv.PGP")
    assert sorted(files) == [
        "errors/a/.pgp", "errors/a/_SUCCESS", "errors/a/broken.csv.pgp", "errors/a/empty.csv.pgp",
        "errors/a/notes.pdf", "inbound/a/sub/deep.csv.pgp"]
    assert {tuple(row) for row in run.entries.collect()} == {
        ("a", name, entry) for name in ["processed_files", "skipped_files", "error_files"] for entry in a[name]}


def test_request_states(spark, keys, tmp_path):
    put(tmp_path, {f"inbound/many/f{i}.txt": b"x" for i in range(4)})
    put(tmp_path, {"inbound/bad/f.csv.pgp": b"junk"})
    requests = request(
        spark, tmp_path, "blank", "unsafe", "nokey", "gone", "many", "bad", "offline",
        blank={"error_folder": " \t", "archive_folder": None}, unsafe={"error_folder": "a/%2e%2e/b"},
        nokey={"key_id": "other"}, offline={"root": "nosuch://store"})
    got = summaries(decrypt_files(requests, keys, AesProvider(), at=AT, cap=3))
    assert {batch: (row["code"], row["message"]) for batch, row in got.items()} == {
        "blank": (400, "Missing required parameters: error_folder, archive_folder"),
        "unsafe": (400, "Invalid path (path traversal not allowed): error_folder"),
        "nokey": (500, "Failed to retrieve PGP credentials from the key store. Check permissions and secret names."),
        "gone": (500, "Unexpected error occurred. Check the job logs for details."),
        "offline": (500, "Storage connection error."),
        "many": (400, "Too many files in source folder (4). Maximum allowed: 3"),
        "bad": (500, None),
    }
    assert sorted(tree(tmp_path)) == ["errors/bad/f.csv.pgp", *[f"inbound/many/f{i}.txt" for i in range(4)]]


@pytest.mark.parametrize("kind", ["aes", "gpg"])
def test_a_large_key_table_is_joined_before_payloads_are_opened(spark, keys, tmp_path, kind):
    provider = AesProvider() if kind == "aes" else OpenPgpProvider(start_agent=False)
    data = seal(spark, keys, {"x": b"fine"})["x"] if kind == "aes" else b"no message"
    put(tmp_path, {f"inbound/a/f{i}.csv.pgp": data for i in range(5)})
    table = KeyTable(KeyTable.of(keys.withColumn("passphrase", F.lit("p"))).frame, small=False)
    row = summaries(decrypt_files(request(spark, tmp_path, "a"), table, provider, at=AT))["a"]
    assert (row["ok"], row["failed"]) == ((5, 0) if kind == "aes" else (0, 5))


def test_only_faulty_requests(spark, keys, tmp_path):
    run = decrypt_files(request(spark, tmp_path, "x", x={"source_folder": ".."}), keys, AesProvider())
    assert summaries(run)["x"]["code"] == 400 and run.files.count() == 0


def test_without_cap_the_lists_are_complete(spark, keys, tmp_path):
    put(tmp_path, {f"inbound/many/f{i}.txt": b"x" for i in range(40)})
    run = decrypt_files(request(spark, tmp_path, "many"), keys, AesProvider(), at=AT, cap=None, hot_rows=7)
    row = summaries(run)["many"]
    assert (row["total"], row["skipped"], row["code"]) == (40, 40, 200)
    assert row["skipped_files"] == sorted(f"f{i}.txt" for i in range(40))
    assert sorted(r.entry for r in run.entries.collect()) == sorted(f"f{i}.txt" for i in range(40))


def test_no_file_is_lost_where_folders_are_shared(spark, keys, tmp_path):
    sealed = seal(spark, keys, {f"{store}{batch}": f"{store}{batch}".encode() for store in "ab" for batch in "xy"})
    shared = {"destination_folder": "done", "error_folder": "errors", "archive_folder": "archive"}
    for store in "ab":
        for batch in "xy":
            put(tmp_path / store, {
                f"inbound/{batch}/f.csv.pgp": sealed[f"{store}{batch}"], f"inbound/{batch}/bad.csv.pgp": batch.encode(),
                f"inbound/{batch}/n.pdf": f"{store}{batch}".encode()})
    requests = request(spark, tmp_path / "a", "x", "y", x=shared, y=shared).unionByName(
        request(spark, tmp_path / "b", "x2", "y2", x2={**shared, "source_folder": "inbound/x"},
                y2={**shared, "source_folder": "inbound/y"}))
    run = decrypt_files(requests, keys, AesProvider(), at=AT)
    assert {row["code"] for row in summaries(run).values()} == {207}
    assert run.files.where("move_error is not null").count() == 0
    for store in "ab":
        left = tree(tmp_path / store)
        assert left["done/f.csv"] == f"{store}y".encode()
        # Every source is still there: one under its plain name, the other under a name with a suffix.
        names = sorted(name.split("/", 1)[0] for name in left)
        assert names == ["archive"] * 2 + ["done"] + ["errors"] * 4
        assert sorted(data for name, data in left.items() if name.startswith("archive")) == sorted(
            sealed[f"{store}{batch}"] for batch in "xy")
        assert {data for name, data in left.items() if name.startswith("errors")} == {
            b"x", b"y", f"{store}x".encode(), f"{store}y".encode()}


def test_no_work_is_done_twice(spark, keys, tmp_path):
    put(tmp_path, {"inbound/a/f.txt": b"1", "inbound/b/g.txt": b"2"})
    same = {"source_folder": "inbound/a/"}
    requests = request(spark, tmp_path, "a", "c", c=same).unionByName(
        request(spark, tmp_path, "b")).unionByName(request(spark, tmp_path, "b", b={"source_folder": "inbound/other"}))
    run = decrypt_files(requests, keys, AesProvider(), at=AT)
    got = sorted((row.batch, row.code, row.total, row.message) for row in run.summary.collect())
    assert got == [("a", 200, 1, None), ("b", 200, 1, None), ("b", 400, 0, SAME_BATCH), ("c", 400, 0, SAME_FOLDER)]
    assert set(tree(tmp_path)) == {"errors/a/f.txt", "errors/b/g.txt"}


def test_oversized_file_is_not_opened(spark, keys, tmp_path):
    put(tmp_path, {"inbound/a/big.csv.pgp": b"x" * 1001, "inbound/a/edge.csv.pgp": b"x" * 1000})
    row = summaries(decrypt_files(request(spark, tmp_path, "a"), keys, AesProvider(), at=AT, max_bytes=1000))["a"]
    assert row["error_files"] == [
        "big.csv.pgp: File size 1,001 bytes exceeds limit of 1,000 bytes", f"edge.csv.pgp: {DECRYPT_FAILED}"]


@pytest.mark.parametrize("winner_decrypts", [True, False])
def test_contested_destination_goes_to_the_highest_path_that_decrypts(spark, keys, tmp_path, winner_decrypts):
    sealed = seal(spark, keys, {"low": b"from upper case", "high": b"from lower case"})
    put(tmp_path, {
        "inbound/a/x.csv.PGP": sealed["low"],
        "inbound/a/x.csv.pgp": sealed["high"] if winner_decrypts else b"junk", "inbound/a/y.csv.pgp": sealed["low"]})
    run = decrypt_files(request(spark, tmp_path, "a"), keys, AesProvider(), at=AT)
    files = tree(tmp_path)
    assert files["done/a/x.csv"] == (b"from lower case" if winner_decrypts else b"from upper case")
    assert sorted(name for name in files if name.startswith("done/")) == ["done/a/x.csv", "done/a/y.csv"]
    assert {row.path: row.collision for row in run.files.collect()} == {
        "inbound/a/x.csv.PGP": True, "inbound/a/x.csv.pgp": True, "inbound/a/y.csv.pgp": False}


def test_stuck_and_unarchived_files_are_reported(spark, keys, tmp_path):
    # A plain file where a folder should be makes the move fail, also for root.
    sealed = seal(spark, keys, {"good": b"fine"})
    put(tmp_path, {"inbound/a/bad.csv.pgp": b"junk", "inbound/a/good.csv.pgp": sealed["good"],
                   "errors": b"", "archive": b""})
    run = decrypt_files(request(spark, tmp_path, "a"), keys, AesProvider(), at=AT)
    row = summaries(run)["a"]
    assert (row["ok"], row["failed"], row["code"]) == (1, 1, 207)
    assert row["error_files"] == [f"bad.csv.pgp: {DECRYPT_FAILED} | WARNING: file stuck in source_folder"]
    files = {r.name: r for r in run.files.collect()}
    assert files["good.csv.pgp"].status == "ok" and files["good.csv.pgp"].archive_error
    assert (tmp_path / "done/a/good.csv").read_bytes() == b"fine"
    assert (tmp_path / "inbound/a/good.csv.pgp").exists() and (tmp_path / "inbound/a/bad.csv.pgp").exists()


def test_a_second_run_picks_up_what_the_first_left(spark, keys, tmp_path):
    sealed = seal(spark, keys, {"good": b"fine"})["good"]
    put(tmp_path, {"inbound/a/good.csv.pgp": sealed})
    decrypt_files(request(spark, tmp_path, "a"), keys, AesProvider(), at=AT)
    # As after a crash between copy and delete: the archived original is back in the source.
    put(tmp_path, {"inbound/a/good.csv.pgp": sealed})
    run = decrypt_files(request(spark, tmp_path, "a"), keys, AesProvider(), at=AT)
    assert summaries(run)["a"]["ok"] == 1
    assert sorted(tree(tmp_path)) == [f"archive/a/{STAMP}_good.csv.pgp", "done/a/good.csv"]
