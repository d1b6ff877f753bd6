"""Jobs that write files: all of a job's files or none, whatever is repeated or broken off."""

from __future__ import annotations

import os
from datetime import timedelta

import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.errors import PySparkException
from pyspark.sql import Row

from sealroute.sources import commit
from sealroute.sources.landing import LandingWriter
from sealroute.sources.storage import name_file
from tests.test_decrypt_job import put, tree

PAYLOAD = "path string, content binary"


def rows(*names):
    return [Row(path=name, content=name.encode()) for name in names]


def test_a_failing_row_leaves_no_file_of_its_job(spark, tmp_path):
    put(tmp_path, {"old.csv": b"old"})
    made = [(f"d{i % 3}/f{i}", b"x" if i != 17 else None) for i in range(40)]
    with pytest.raises(PySparkException, match="no content for d2/f17"):
        spark.createDataFrame(made, PAYLOAD).repartition(6).write.format("landing").mode("append").save(str(tmp_path))
    assert tree(tmp_path) == {"old.csv": b"old"}
    good = [row for row in made if row[1]] + [("old.csv", b"new"), ("empty", b"")]
    spark.createDataFrame(good, PAYLOAD).repartition(6).write.format("landing").mode("append").save(str(tmp_path))
    assert tree(tmp_path) == dict(good)


def test_repeated_attempts_do_not_count(tmp_path):
    writer = LandingWriter(str(tmp_path))
    first = writer.write(rows("a", "b/c"))
    lost = writer.write(rows("a", "b/c", "never"))
    assert lost.files == 3 and not (tmp_path / "a").exists()
    writer.commit([first])
    assert tree(tmp_path) == {"a": b"a", "b/c": b"b/c"}


def test_an_attempt_that_fails_removes_its_files(tmp_path):
    writer = LandingWriter(str(tmp_path))
    kept = writer.write(rows("a"))
    with pytest.raises(ValueError):
        writer.write([*rows("b"), Row(path="c", content=None)])
    assert len([name for name in tree(tmp_path) if name.endswith("/0")]) == 1
    writer.abort([kept, None])
    assert tree(tmp_path) == {} and not list(tmp_path.iterdir())


def test_an_empty_job_leaves_nothing(spark, tmp_path):
    spark.createDataFrame([], PAYLOAD).write.format("landing").mode("append").save(str(tmp_path / "new"))
    assert tree(tmp_path) == {}


def test_a_broken_off_job_is_finished_or_removed(spark, tmp_path):
    done, half, broken = LandingWriter(str(tmp_path)), LandingWriter(str(tmp_path)), LandingWriter(str(tmp_path))
    done.commit([done.write(rows("done"))])
    tasks = [half.write(rows("x/1", "x/2")), half.write(rows("x/3"))]
    half.write(rows("x/3", "x/4"))
    commit.record(half.folder, half.job, tasks)
    commit.publish(half.folder, half.job, tasks[0].attempt)
    broken.write(rows("y/1"))
    young = commit.recover_jobs(spark, str(tmp_path)).collect()
    assert [(row.job, row.state, row.files) for row in young] == [(half.job, "committed", 1)]
    assert {name for name in tree(tmp_path) if not name.startswith(".")} == {"done", "x/1", "x/2", "x/3"}
    old = commit.recover_jobs(spark, str(tmp_path), abandoned_after=timedelta(0)).collect()
    assert [(row.job, row.state) for row in old] == [(broken.job, "abandoned")]
    assert set(tree(tmp_path)) == {"done", "x/1", "x/2", "x/3"}
    assert commit.recover_jobs(spark, str(tmp_path)).count() == 0


def test_naming_may_be_broken_off_and_repeated(tmp_path):
    writer = LandingWriter(str(tmp_path))
    task = writer.write(rows(*[f"f{i}" for i in range(9)]))
    commit.record(writer.folder, writer.job, [task])
    staged = next(path for path in tmp_path.rglob("4"))
    staged.rename(tmp_path / "f4")
    assert commit.recorded(writer.folder, writer.job) == [task.attempt]
    commit.publish(writer.folder, writer.job, task.attempt)
    commit.discard(writer.folder, writer.job)
    assert tree(tmp_path) == {f"f{i}": f"f{i}".encode() for i in range(9)}


def test_files_are_named_in_tasks_all_or_none(spark, tmp_path):
    put(tmp_path, {"old.csv": b"old"})
    made = [(f"d{i % 3}/f{i}", b"x" * i) for i in range(40)]
    assert commit.save_files(spark.createDataFrame([*made, ("old.csv", b"new")], PAYLOAD).repartition(6), str(tmp_path)) == 41
    assert tree(tmp_path) == dict(made) | {"old.csv": b"new"} and not list(tmp_path.glob(".*"))
    with pytest.raises(PySparkException, match="no content for late"):
        commit.save_files(spark.createDataFrame([("d0/f0", b"other"), ("late", None)], PAYLOAD), str(tmp_path))
    assert tree(tmp_path) == dict(made) | {"old.csv": b"new"} and not list(tmp_path.glob(".*"))
    assert commit.save_files(spark.createDataFrame([], PAYLOAD), str(tmp_path / "new")) == 0


def test_a_named_job_that_is_broken_off_is_finished(spark, tmp_path):
    rows_of = spark.createDataFrame([("a/1", b"1"), ("a/2", b"2")], PAYLOAD)
    rows_of.write.format("landing").option("job", "named").mode("append").save(str(tmp_path))
    assert not (tmp_path / "a").exists()
    assert [(row.job, row.files) for row in commit.recover_jobs(spark, str(tmp_path)).collect()] == [("named", 2)]
    assert tree(tmp_path) == {"a/1": b"1", "a/2": b"2"}


def test_a_name_that_was_given_halfway_is_ended(tmp_path):
    source, target, files = tmp_path / "0", tmp_path / "to/a", LocalFileSystem()
    for content in (b"new", b"newer"):
        source.write_bytes(content)
        name_file(files, str(source), str(target))
        assert target.read_bytes() == content and not source.exists()
    os.link(target, source)
    name_file(files, str(source), str(target))
    assert target.read_bytes() == b"newer" and not source.exists()
    name_file(files, str(source), str(target))
    with pytest.raises(FileNotFoundError):
        name_file(files, str(source), str(tmp_path / "b"))
