"""Classifying listed files, the batch cap, and picking the staging file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.functions.paths import base_name, has_extension, is_system_file, plain_name
from sealroute.operators.keyed import HOT_ROWS, attach_exceptions
from sealroute.operators.requests import MAX_FILES

# The size cap of a file and the texts of files that are not opened.
MAX_FILE_BYTES = 500 * 1024 * 1024
NOT_PGP = "file does not have .pgp extension"
NO_STEM = "file name is empty without its extension"


def oversized(length: Column, max_bytes: int | None) -> Column:
    """A known length above the cap; an unknown length passes."""
    return F.lit(False) if max_bytes is None else F.coalesce(length > max_bytes, F.lit(False))


def classify(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Add ``name``, ``dest_name``, ``status`` and ``message`` from the listing alone.

    A null status marks the files whose payload has to be opened.
    """
    name, length = F.col("name"), F.col("length")
    too_big = F.concat(
        F.lit("File size "), F.format_number(length, 0), F.lit(f" bytes exceeds limit of {max_bytes or 0:,} bytes"))
    skipped, big, bare = ~has_extension(name), oversized(length, max_bytes), F.col("dest_name") == ""
    return (
        files.withColumn("name", base_name(F.col("path")))
        .withColumn("dest_name", F.when(has_extension(name), plain_name(name)))
        .withColumn("status", F.when(skipped, "skipped").when(big | bare, "error"))
        .withColumn("message", F.when(skipped, NOT_PGP).when(big, too_big).when(bare, NO_STEM))
    )


def recheck_payload(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """The size cap once more, on the bytes that were read."""
    size = F.octet_length("content")
    failed = F.col("status").isNull() & oversized(size, max_bytes)
    text = F.concat(F.lit("Downloaded file size "), F.format_number(size, 0), F.lit(" bytes exceeds limit"))
    return files.withColumns({
        "status": F.when(failed, "error").otherwise(F.col("status")),
        "message": F.when(failed, text).otherwise(F.col("message")),
    })


def is_empty_payload(content: Column) -> Column:
    return F.octet_length(content) == 0


def batch_totals(files: DataFrame, batch: str = "batch") -> DataFrame:
    return files.groupBy(batch).agg(F.count(F.lit(1)).alias("total"))


def accept_batches(
    files: DataFrame, totals: DataFrame, cap: int | None = MAX_FILES, batch: str = "batch", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep the files of batches within the cap; a larger batch is turned away as a whole.

    Rejected batches are few as a rule, so that files which may carry payloads are not shuffled.
    """
    if cap is None:
        return files
    rejected = totals.filter(F.col("total") > cap).select(batch, F.col("total").alias("_total"))
    return (
        attach_exceptions(files, rejected, batch, "path", count="_total", hot_rows=hot_rows)
        .filter(F.col("_total").isNull())
        .drop("_total")
    )


def staging_pick(files: DataFrame, request: str = "request_id", carry: list[str] | None = None) -> DataFrame:
    """Per request the last data file in path order; names starting with ``_`` are not data.

    Only path, length and the ``carry`` columns of the current best travel through the aggregate.
    """
    picked = F.struct("path", "length", *(carry or []))
    data = ~is_system_file(base_name(F.col("path")))
    return files.groupBy(request).agg(
        F.max_by(F.when(data, picked), F.when(data, F.col("path"))).alias("picked"),
        F.count(F.lit(1)).alias("staged"),
        F.count_if(data).alias("data_files"),
    )
