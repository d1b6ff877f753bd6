"""Jobs that write named files and publish them together.

Tasks put their files under numbers into a folder of their attempt, below the job's hidden folder, and end it with a
table of names. The driver gets one message a task, with the attempt and its totals. A job that succeeds first leaves a
record of the attempts that count, then gives their files their names; a job that fails removes its folder. Whoever
finds a record later can finish the work, as giving a name may be repeated; a folder without a record never counts.
The writer of ``format("landing")`` gives names on the driver, as a data source has no tasks after its commit;
``save_files`` runs the same job and gives them in tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import WriterCommitMessage

from sealroute.sources.storage import TEMP_PREFIX, exists, locate, name_file, read_file, write_file

JOB_PREFIX = f"{TEMP_PREFIX}job-"
RECORD, NAMES = "committed", "names"
PUBLISHERS = 16


@dataclass
class StagedTask(WriterCommitMessage):
    """What a task attempt staged: the name of its folder and totals, whatever the number of its files."""

    attempt: str
    files: int
    bytes: int


def new_job() -> str:
    return uuid.uuid4().hex


def _place(folder: str, job: str, *parts: str) -> tuple[pafs.FileSystem, str]:
    return locate(folder, "/".join((f"{JOB_PREFIX}{job}", *parts)))


def _remove(filesystem: pafs.FileSystem, path: str) -> None:
    if exists(filesystem, path):
        filesystem.delete_dir(path)


def stage(folder: str, job: str, rows: Iterable[tuple[str, bytes | None]]) -> StagedTask:
    """Write the files of one task attempt; if one cannot be written nothing of the attempt stays."""
    attempt = uuid.uuid4().hex
    filesystem, base = _place(folder, job, attempt)
    names, total = [], 0
    try:
        for path, content in rows:
            if content is None:
                raise ValueError(f"no content for {path}")
            if not names:
                filesystem.create_dir(base, recursive=True)
            with filesystem.open_output_stream(f"{base}/{len(names)}") as out:
                out.write(content)
            names.append(path)
            total += len(content)
        if names:
            write_file(filesystem, f"{base}/{NAMES}", json.dumps(names).encode())
    except BaseException:
        _remove(filesystem, base)
        raise
    return StagedTask(attempt, len(names), total)


def record(folder: str, job: str, tasks: list[StagedTask]) -> None:
    """From here on the job counts: the attempts named here are the only ones that do."""
    filesystem, path = _place(folder, job, RECORD)
    write_file(filesystem, path, json.dumps([task.attempt for task in tasks if task.files]).encode())


def recorded(folder: str, job: str) -> list[str] | None:
    """The attempts of a job that was committed; None if it was not."""
    filesystem, path = _place(folder, job, RECORD)
    return json.loads(read_file(filesystem, path)) if exists(filesystem, path) else None


def publish(folder: str, job: str, attempt: str) -> int:
    """Give the files of an attempt their names, replacing files of these names; may be repeated."""
    filesystem, base = _place(folder, job, attempt)
    if not exists(filesystem, base):
        return 0
    names = json.loads(read_file(filesystem, f"{base}/{NAMES}"))

    def named(numbers: range) -> None:
        for number in numbers:
            name_file(filesystem, f"{base}/{number}", locate(folder, names[number])[1])

    # A local name takes less time than to hand it to a thread.
    threads = 1 if filesystem.type_name == "local" else PUBLISHERS
    with ThreadPoolExecutor(threads) as pool:
        for _ in pool.map(named, [range(first, len(names), threads) for first in range(threads)]):
            pass
    _remove(filesystem, base)
    return len(names)


def discard(folder: str, job: str) -> None:
    """Remove what is left of a job: of one that failed, was published, or whose repeated attempts do not count."""
    _remove(*_place(folder, job))


def commit(folder: str, job: str, tasks: list[StagedTask]) -> None:
    """Publish a job whose tasks have all succeeded. Files of several rows with one path: one of them stays."""
    if any(task.files for task in tasks):
        record(folder, job, tasks)
        for task in tasks:
            if task.files:
                publish(folder, job, task.attempt)
    discard(folder, job)


def _jobs(folder: str, abandoned_after: timedelta) -> Iterator[tuple[str, str | None, str]]:
    """(job, attempt, state) of the jobs that lie in a folder: ``committed``, with a row an attempt, or ``abandoned``."""
    filesystem, base = locate(folder, "")
    found = filesystem.get_file_info(pafs.FileSelector(base.rstrip("/"), allow_not_found=True))
    for info in found:
        if not info.base_name.startswith(JOB_PREFIX):
            continue
        job = info.base_name.removeprefix(JOB_PREFIX)
        attempts = recorded(folder, job)
        if attempts is not None:
            yield from ((job, attempt, "committed") for attempt in attempts or [None])
        elif info.mtime is None or datetime.now(timezone.utc) - info.mtime >= abandoned_after:
            yield job, None, "abandoned"


def recover_jobs(spark: SparkSession, folder: str, abandoned_after: timedelta = timedelta(days=1)) -> DataFrame:
    """Finish the jobs of a folder that were committed but not wholly published, and remove abandoned ones.

    Attempts are published in tasks. A job without a record counts as abandoned once its folder is older than
    ``abandoned_after``; a younger one may still be running and is left. Returns (job, state, files).
    """
    done = _publish_in_tasks(spark, folder, list(_jobs(folder, abandoned_after)))
    return spark.createDataFrame(done, "job string, state string, files bigint")


def _publish_in_tasks(spark: SparkSession, folder: str, rows: list[tuple[str, str | None, str]]) -> list[tuple]:
    """Publish (job, attempt, state) rows, a task each, and remove their jobs; (job, state, files)."""
    if not rows:
        return []
    schema = "job string, attempt string, state string"
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs, attempts, states = (batch.column(i).to_pylist() for i in range(3))
            files = [publish(folder, job, attempt) if attempt else 0 for job, attempt in zip(jobs, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.int64())], names=[*batch.schema.names, "files"])

    done = jobs.mapInArrow(run, f"{schema}, files bigint").groupBy("job", "state").agg(F.sum("files").alias("files")).collect()
    for row in done:
        discard(folder, row.job)
    return [tuple(row) for row in done]


def save_files(files: DataFrame, folder: str) -> int:
    """Write rows (path, content) as files below ``folder``, all of them or none; the number of files.

    The landing writer stages and records them as one job, then tasks give the files their names, an attempt each. A
    call that is broken off after the record is finished by ``recover_jobs``, as any job.
    """
    job, folder = new_job(), folder.rstrip("/")
    files.select("path", "content").write.format("landing").option("job", job).mode("append").save(folder)
    rows = [(job, attempt, "committed") for attempt in recorded(folder, job) or []]
    return sum(files for _, _, files in _publish_in_tasks(files.sparkSession, folder, rows))
