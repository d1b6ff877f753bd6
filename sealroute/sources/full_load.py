"""Replacing the content of an output folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.session import keep, work_folder
from sealroute.sources.landing import read_manifest
from sealroute.sources.payloads import apply_deletes


def replace_folder(rows: DataFrame, folder: str) -> DataFrame:
    """Full load: write the named files, then delete the folder's other direct child files.

    Old files go only after the new ones are complete. Returns the deleted paths with
    ``delete_error`` where one could not be removed.
    """
    rows.write.format("landing").mode("append").save(folder)
    spark = rows.sparkSession
    base = folder.rstrip("/")
    written = rows.select(F.concat(F.lit(base + "/"), F.col("path")).alias("path"))
    stale = read_manifest(spark, [base]).join(written, "path", "left_anti")
    removed = apply_deletes(stale.select(F.lit(None).cast("string").alias("root"), "path"), "path")
    return keep(removed.drop("root"), work_folder(spark, "replace"), "removed")
