"""The decrypt job driven by a stream.

``stream_requests`` takes each arriving request record as one call of the job, ``stream_folders``
polls the folders of standing requests, and ``stream_files`` takes payload rows and keeps a results
table that summaries read. Each micro-batch writes to its own ``epoch=N`` folder, so a micro-batch
that is run again replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from sealroute.operators.codec import Provider
from sealroute.operators.files import MAX_FILE_BYTES
from sealroute.operators.keys import KeyTable
from sealroute.operators.routing import mark_collisions
from sealroute.plans.decrypt_job import decrypt_files, decrypt_table
from sealroute.session import attach, keep


def _start(stream: DataFrame, process, folder: str, available_now: bool, every: str) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )


CORRUPT = "_corrupt_record"
# Bytes of request files that a micro-batch takes.
POLL_BYTES = 64 << 20


def name_broken(requests: DataFrame, corrupt: str) -> DataFrame:
    """Requests of which unreadable lines (``corrupt``) have no value but a batch of their own, made of the line.

    Lines that are equal are told apart by a number.
    """
    again = F.row_number().over(Window.partitionBy(corrupt).orderBy(corrupt))
    broken = requests.where(F.col(corrupt).isNotNull()).withColumn("batch", F.concat(
        F.lit("broken-"), F.left(F.sha2(corrupt, 256), F.lit(16)), F.lit("-"), again.cast("string")))
    values = [name for name in requests.columns if name not in ("batch", corrupt)]
    nulled = broken.withColumns({name: F.lit(None).cast(requests.schema[name].dataType) for name in values})
    return requests.where(F.col(corrupt).isNull()).unionByName(nulled)


def stream_requests(
    spark: SparkSession, inbox: str, schema: StructType | str, keys: DataFrame | KeyTable, provider: Provider,
    folder: str, *,
    available_now: bool = True, every: str = "30 seconds", max_files: int | None = None, **options,
) -> StreamingQuery:
    """Run the decrypt job for the requests in each JSON file that arrives in ``inbox``.

    A micro-batch takes the oldest ``POLL_BYTES`` of files, as many as these are: a run has about thirty Spark jobs
    whatever its size, so a backlog of small files must not take one for each few of them. ``max_files`` counts files
    instead.

    Summaries go to ``folder``/summary, the requests as they were read to ``folder``/requests. A line that is no JSON
    record counts as a request without values, as an unreadable body does: it is answered in a summary row of its own,
    under a name made of the line. ``options`` are those of ``decrypt_files``.
    """
    attach(spark)
    keys = KeyTable.of(keys)
    known = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = StructType([*known.fields, StructField(CORRUPT, StringType())])
    limit = ("maxBytesPerTrigger", POLL_BYTES) if max_files is None else ("maxFilesPerTrigger", max_files)
    requests = spark.readStream.schema(read).option(*limit).option("columnNameOfCorruptRecord", CORRUPT).json(inbox)

    def process(batch: DataFrame, epoch: int) -> None:
        # Read once: which columns a later step asks for must not decide which lines count as broken.
        read = keep(name_broken(batch, CORRUPT), f"{folder}/requests", f"epoch={epoch}")
        run = decrypt_files(read.drop(CORRUPT), keys, provider, **options)
        run.summary.write.mode("overwrite").parquet(f"{folder}/summary/epoch={epoch}")

    return _start(requests, process, folder, available_now, every)


def stream_folders(
    requests: DataFrame, keys: DataFrame | KeyTable, provider: Provider, folder: str, *,
    available_now: bool = True, every: str = "30 seconds", **options,
) -> StreamingQuery:
    """Poll the landing folders of standing ``requests`` and run the decrypt job for those with files.

    The stream only says when to poll; each poll's job lists all folders once, in its tasks, so
    their number is not limited. Summaries of the folders that held files go to ``folder``/summary.
    """
    spark = attach(requests.sparkSession)
    keys = KeyTable.of(keys)
    polls = spark.readStream.format("landing").option("folders", "[]").load()

    def process(batch: DataFrame, epoch: int) -> None:
        run = decrypt_files(requests, keys, provider, **options)
        run.summary.filter("total > 0").write.mode("overwrite").parquet(f"{folder}/summary/epoch={epoch}")

    return _start(polls, process, folder, available_now, every)


def stream_files(
    files: DataFrame, keys: DataFrame | KeyTable, provider: Provider, stamp: Column, folder: str, *,
    max_bytes: int | None = MAX_FILE_BYTES, available_now: bool = True, every: str = "30 seconds",
) -> StreamingQuery:
    """Decrypt and route a stream of payload rows; results go to ``folder``/results.

    The batch cap needs a batch's whole count, so it is applied when the results are summarised.
    """
    keys = KeyTable.of(keys)

    def process(batch: DataFrame, epoch: int) -> None:
        results = decrypt_table(batch, keys, provider, stamp, cap=None, max_bytes=max_bytes)
        mark_collisions(results).write.mode("overwrite").parquet(f"{folder}/results/epoch={epoch}")

    return _start(files, process, folder, available_now, every)
