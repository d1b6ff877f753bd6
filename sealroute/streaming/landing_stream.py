"""Landing folders as a stream that sees only what is new, and only once it is whole.

Each poll lists the folders in tasks. State is kept per destination: for each of its files when it was first seen, its
size and time at the last poll, and whether it was handed on. A file is handed on when two polls find it alike, so one
that still grows waits; a file's state expires ``keep_for`` after it last changed. As all files of one destination meet in one state, a file
knows of those that were handed on before it, whatever micro-batch they were in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sealroute.functions.paths import has_extension, plain_name
from sealroute.operators.codec import Provider
from sealroute.operators.keyed import fits_broadcast
from sealroute.operators.keys import KeyTable
from sealroute.plans.decrypt_job import check_requests, decrypt_files
from sealroute.session import attach

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SEEN = "files array<struct<path string, first_seen bigint, length bigint, modified bigint, handed boolean, noted bigint>>"
# The state of a destination is one entry.
ENTRY = ("",)
SETTLED = ("claim string, batch string, root string, path string, name string, length bigint, first_seen bigint, "
           "before array<string>")


class Settle(StatefulProcessor):
    """Hands a file on when two polls in a row find it with one size and time."""

    def __init__(self, keep_for: timedelta):
        self.keep_ms = round(keep_for.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "entry string", SEEN, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        polled = {row.path: row for row in rows}
        # Each call of the state costs far more than the files of a destination, so it is asked once and told once.
        held = [seen for _, (files,) in self.claims.iterator() for seen in files]
        known = {seen[0]: tuple(seen) for seen in held if now - seen[5] < self.keep_ms}
        before, ready = dict(known), []
        for path, row in sorted(polled.items()):
            modified = None if row.modified is None else round(row.modified.timestamp() * 1000)
            old = before.get(path)
            alike = old is not None and (old[2], old[3]) == (row.length, modified)
            if alike and not old[4]:
                ready.append((row, old[1]))
            if not alike or not old[4]:
                known[path] = (path, old[1] if old is not None else now, row.length, modified, alike, now)
        if known != before:
            self.claims.updateValue(ENTRY, (list(known.values()),))
        if ready:
            fresh = {row.path for row, _ in ready}
            handed = sorted(path for path, seen in known.items() if seen[4] and path not in fresh)
            for row, first in ready:
                yield Row(claim=key[0], batch=row.batch, root=row.root, path=row.path, name=row.name, length=row.length,
                          first_seen=first, before=[path for path in handed if path > row.path])

    def close(self) -> None:
        pass


def landed_files(requests: DataFrame, keep_for: timedelta = timedelta(days=7)) -> DataFrame:
    """The stream of settled files of the ``requests``' source folders, a row a file.

    ``before`` names the files of the same destination with a higher path that were handed on earlier. The folders'
    names are options of the source, so they are as many as a driver may list. A file that changes after it was handed
    on is a new one; one that lies there unchanged is not handed on again before its state has expired.
    """
    spark = attach(requests.sparkSession)
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    source = F.concat(F.rtrim(F.col("root"), F.lit("/")), F.lit("/"), F.rtrim(F.col("source_folder"), F.lit("/")))
    known = requests.select("batch", "root", "source_folder", "destination_folder", source.alias("source"))
    folders = [row.source for row in known.select("source").distinct().collect()]
    polls = spark.readStream.format("landing").option("folders", json.dumps(folders)).load().where(~F.col("is_dir"))
    polls = polls.withColumn("source", F.substr("path", F.lit(1), F.length("path") - F.length("name") - 1))
    rows = polls.join(F.broadcast(known) if fits_broadcast(known) else known, "source").withColumn(
        "path", F.concat(F.rtrim("source_folder", F.lit("/")), F.lit("/"), F.col("name")))
    place = F.concat_ws("\n", "root", F.rtrim("destination_folder", F.lit("/")), plain_name(F.col("name")))
    claim = F.when(has_extension(F.col("name")), place).otherwise(F.concat_ws("\n", "root", "path"))
    return rows.select(claim.alias("claim"), "batch", "root", "path", "name", "length", "modified").groupBy(
        "claim").transformWithState(Settle(keep_for), SETTLED, "Append", "ProcessingTime")


def _earlier(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """The results of the files of other micro-batches; None before there are any."""
    try:
        return spark.read.parquet(f"{folder}/files").where(F.col("epoch") != epoch)
    except AnalysisException:
        return None


def _losing(files: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Add ``loses``: whether an earlier file with a higher path has been decrypted to the same destination."""
    named = files.where(F.size("before") > 0)
    if earlier is None or named.isEmpty():
        return files.withColumn("loses", F.lit(False))
    done = earlier.where("status = 'ok'").select("root", F.col("path").alias("earlier")).distinct()
    losing = named.select("root", "path", F.explode("before").alias("earlier")).join(done, ["root", "earlier"]).select(
        "root", "path", F.lit(True).alias("loses")).distinct()
    return files.join(losing, ["root", "path"], "left").withColumn("loses", F.coalesce("loses", F.lit(False)))


def stream_landing(
    requests: DataFrame, keys: DataFrame | KeyTable, provider: Provider, folder: str, *, keep_for: timedelta = timedelta(days=7),
    available_now: bool = True, every: str = "30 seconds", **options,
) -> StreamingQuery:
    """Run the decrypt job for the files that have settled in the landing folders of standing ``requests``.

    The state's checkpoint, the files' results and the summaries of the batches that had files go to ``folder``, an
    epoch each, so a micro-batch that is run again replaces its rows. Of several files of one destination the highest
    path that was decrypted has it in the end, as in one batch run, also if they came in different micro-batches.
    """
    spark = attach(requests.sparkSession)
    keys = KeyTable.of(keys)
    sound = check_requests(requests, keys, strict=options.get("strict", False)).where("sound")

    def process(batch: DataFrame, epoch: int) -> None:
        files = batch.drop("claim").persist()
        try:
            if files.isEmpty():
                return
            earlier = _earlier(spark, folder, epoch)
            chosen = _losing(files, earlier)
            run = decrypt_files(requests, keys, provider, listed=chosen, taken=earlier, **options)
            run.files.write.mode("overwrite").parquet(f"{folder}/files/epoch={epoch}")
            run.summary.filter("total > 0").write.mode("overwrite").parquet(f"{folder}/summary/epoch={epoch}")
        finally:
            files.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        landed_files(sound, keep_for).writeStream.outputMode("append").foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
    )
