"""Batch summaries, entry lists, byte metrics and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.functions.text import list_entry
from sealroute.operators.ranking import ranked
from sealroute.operators.requests import batch_code
from sealroute.session import attach, work_folder

# The size of quantile sketches, and the error that goes with it.
SKETCH_K, SKETCH_ERROR = 800, 0.005

# Status of a file and the list it is reported in.
LISTS = {"ok": "processed_files", "skipped": "skipped_files", "error": "error_files"}


def _entry() -> Column:
    return F.when(F.col("status") == "error", list_entry(F.col("name"), F.col("message"))).otherwise(F.col("name"))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    ]


def count_batches(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Counts and code per batch; combines map-side, so a batch may be of any size."""
    return results.groupBy(batch).agg(*_counts()).withColumn("code", batch_code(F.col("ok"), F.col("failed")))


def summarise(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Counts, code and the three name lists per batch.

    Only for batches that passed the cap, which bounds each list. Without a cap use
    ``count_batches`` and ``list_entries``.
    """
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("status") == status, _entry()))).alias(column)
        for status, column in LISTS.items()
    ]
    return (
        results.groupBy(batch).agg(*_counts(), *lists)
        .withColumn("code", batch_code(F.col("ok"), F.col("failed")))
    )


def list_entries(results: DataFrame, batch: str = "batch") -> DataFrame:
    """The same lists as rows ``(batch, list, entry)``: complete for a batch of any size, no shuffle."""
    which = F.when(F.col("status") == "ok", LISTS["ok"]).when(
        F.col("status") == "skipped", LISTS["skipped"]).otherwise(LISTS["error"])
    return results.select(batch, which.alias("list"), _entry().alias("entry"))


def list_pages(results: DataFrame, batch: str = "batch", page_size: int = 1000) -> DataFrame:
    """The lists in pages ``(batch, list, page, entries)`` of at most ``page_size`` sorted entries, pages from zero.

    For batches without a cap: the entries are ranked over all tasks, so neither a row nor a task holds a whole batch.
    """
    entries = list_entries(results, batch)
    placed = ranked(entries, [batch, "list"], ["entry"], work_folder(attach(results.sparkSession), "pages"))
    page = F.floor(F.col("place") / page_size).cast("bigint").alias("page")
    return placed.groupBy(batch, "list", page).agg(F.array_sort(F.collect_list("entry")).alias("entries"))


def profile(results: DataFrame, value: str, batch: str = "batch") -> DataFrame:
    """Count, least, largest, total and a quantile sketch of a whole-number column of each batch.

    Profiles of parts, runs or epochs can be put together by ``merge_profiles``: the sketch then has the error that
    one of all rows would have, at most ``SKETCH_ERROR`` of the rows in the rank of a quantile (99 in 100 times).
    """
    return results.groupBy(batch).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.sum(value).cast("bigint").alias("total"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(SKETCH_K)).alias("sketch"))


def merge_profiles(profiles: DataFrame, batch: str = "batch") -> DataFrame:
    """One profile a batch out of several; the sketches are merged, not the rows read again."""
    return profiles.groupBy(batch).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.sum("total").cast("bigint").alias("total"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch"))


def quantile(share: float, sketch: Column | str = "sketch") -> Column:
    """The value below which about ``share`` of a profile's rows lie; null for a profile without any."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(share))))


def byte_totals(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Bytes in and out and the number of opened files per batch."""
    return results.groupBy(batch).agg(
        F.count("bytes_out").alias("files"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
    )


def decrypt_response(summary: DataFrame) -> DataFrame:
    """``batch``, ``code`` and the reply text: the summary as JSON, or the bare message of a refusal."""
    fields = ["total", "ok", "failed", "skipped", *[name for name in LISTS.values() if name in summary.columns]]
    empty = (F.col("code") == 200) & F.col("message").isNotNull()
    body = F.when(F.col("message").isNull(), F.to_json(F.struct(*fields))).when(
        empty, F.to_json(F.struct(*fields, "message"))).otherwise(F.col("message"))
    return summary.select("batch", "code", body.alias("body"))


def encrypt_response(results: DataFrame) -> DataFrame:
    """``request_id``, ``code`` and the reply text of each encrypt request."""
    done = ["status", "message", "outputFileName", "outputPath", "archivedFileName", "archivedPath",
            "originalSize", "encryptedSize"]
    failed = F.to_json(
        F.struct("status", "message", "outputFileName", "tempFolder"), {"ignoreNullFields": "false"})
    body = F.when(F.col("status").isNull(), F.col("message")).when(
        F.col("status") == "SUCCESS", F.to_json(F.struct(*done))).otherwise(failed)
    return results.select("request_id", "code", body.alias("body"))
