"""Streams and the batch job report the same."""

from __future__ import annotations

import json

from sealroute.operators.codec import AesProvider
from sealroute.operators.summary import summarise
from sealroute.plans.decrypt_job import decrypt_table, run_stamp
from sealroute.queries.landing import SIZE_CAP, landing, run_keys, with_targets
from sealroute.queries.jobs import sealed_landing
from sealroute.streaming.decrypt_stream import stream_files, stream_folders, stream_requests
from tests.test_decrypt_job import REQUEST, put, request, seal, tree


def test_requests_arriving_as_files_run_the_job(spark, keys, tmp_path):
    sealed = seal(spark, keys, {"good": b"fine"})["good"]
    put(tmp_path, {"inbound/a/x.csv.pgp": sealed, "inbound/b/y.csv.pgp": b"junk"})
    rows = [json.dumps(row.asDict()) for row in request(spark, tmp_path, "a", "b").collect()]
    inbox, folder = tmp_path / "inbox", str(tmp_path / "stream")
    put(inbox, {"1.json": rows[0].encode()})
    start = lambda: stream_requests(spark, str(inbox), REQUEST, keys, AesProvider(), folder).awaitTermination()
    start()
    put(inbox, {"2.json": rows[1].encode()})
    start()
    summary = spark.read.parquet(f"{folder}/summary").orderBy("batch").collect()
    assert [(r.batch, r.ok, r.failed, r.code, r.epoch) for r in summary] == [("a", 1, 0, 200, 0), ("b", 0, 1, 500, 1)]
    assert (tmp_path / "done/a/x.csv").read_bytes() == b"fine"


def test_a_backlog_of_small_request_files_is_one_run_and_answers_every_line(spark, keys, tmp_path):
    inbox, folder = tmp_path / "inbox", str(tmp_path / "stream")
    put(inbox, {f"{number}.json": json.dumps({"batch": f"b{number}"}).encode() for number in range(130)})
    stream_requests(spark, str(inbox), REQUEST, keys, AesProvider(), folder).awaitTermination()
    summary = spark.read.parquet(f"{folder}/summary").collect()
    assert sorted(r.batch for r in summary) == sorted(f"b{number}" for number in range(130))
    assert {(r.code, r.epoch) for r in summary} == {(400, 0)}
    folder = str(tmp_path / "counted")
    stream_requests(spark, str(inbox), REQUEST, keys, AesProvider(), folder, max_files=100).awaitTermination()
    assert spark.read.parquet(f"{folder}/summary").select("epoch").distinct().count() == 2


def test_polled_folders_run_the_job_for_those_with_files(spark, keys, tmp_path):
    sealed = seal(spark, keys, {"good": b"fine"})["good"]
    put(tmp_path, {"inbound/a/x.csv.pgp": sealed, "inbound/a/_SUCCESS": b""})
    (tmp_path / "inbound/b").mkdir()
    folder = str(tmp_path / "stream")
    standing = request(spark, tmp_path, "a", "b")
    stream_folders(standing, keys, AesProvider(), folder).awaitTermination()
    put(tmp_path, {"inbound/b/y.csv.pgp": sealed})
    stream_folders(standing, keys, AesProvider(), folder).awaitTermination()
    summary = spark.read.parquet(f"{folder}/summary").orderBy("epoch", "batch").collect()
    assert [(r.batch, r.ok, r.skipped, r.code) for r in summary] == [("a", 1, 1, 200), ("b", 1, 0, 200)]
    assert not [name for name in tree(tmp_path) if name.startswith("inbound/")]


def test_stream_and_batch_give_the_same_results(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    keys = run_keys(spark)
    stamp = run_stamp()
    path = str(tmp_path / "files")
    sealed_landing(with_targets(landing(spark, sf)), keys).repartition(4, "path").write.parquet(path)
    stored = spark.read.parquet(path)
    expected = summarise(decrypt_table(stored, keys, AesProvider(), stamp, cap=None, max_bytes=SIZE_CAP))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    folder = str(tmp_path / "stream")
    stream_files(stream, keys, AesProvider(), stamp, folder, max_bytes=SIZE_CAP).awaitTermination()
    results = spark.read.parquet(f"{folder}/results")
    assert results.select("epoch").distinct().count() == 4
    got = summarise(results)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
