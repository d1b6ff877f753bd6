"""What the text operators share: tables, work folders, and columns that replace others of their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealroute.session import attach, keep, work_folder

__all__ = ["add_columns", "attach", "carried", "documents", "drop_clashes", "held_out", "keep", "restored", "table", "work"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def work(frame: DataFrame, name: str) -> str:
    """A new work folder in the shared place the cluster names; the package is on the executors afterwards."""
    return work_folder(attach(frame.sparkSession), name)


def drop_clashes(frame: DataFrame, *results: str) -> DataFrame:
    """The frame without the columns that an operator is about to add: a result replaces a column of its name."""
    return frame.drop(*results)


def add_columns(frame: DataFrame, **results: Column) -> DataFrame:
    """``withColumns`` that replaces columns of the same name in any case."""
    return drop_clashes(frame, *results).withColumns(results)


#: Where a stage keeps the caller's columns that it does not work on.
CARRIED = "carried_row"


def carried(frame: DataFrame, *needed: str) -> DataFrame:
    """The needed columns as they are, all others inside one struct: no name of theirs meets one of the stage's."""
    others = [F.col(f"`{name}`") for name in frame.columns if name not in needed]
    return frame.select(F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias(CARRIED), *needed)


def restored(names: list[str], needed: tuple[str, ...], **changed: Column) -> list[Column]:
    """The caller's columns in their order out of a `carried` frame, with new values for the changed ones."""
    def value(name: str) -> Column:
        held = changed[name] if name in changed else F.col(f"`{name}`" if name in needed else f"{CARRIED}.`{name}`")
        return held.alias(name)

    return [value(name) for name in names]


def new_length(changes: Column, text: Column, names: list[str]) -> dict[str, Column]:
    """``n_chars`` counted anew where a text changes, if the caller has that column."""
    if "n_chars" not in names:
        return {}
    return {"n_chars": F.when(changes, F.length(text).cast("bigint")).otherwise(F.col(f"{CARRIED}.n_chars"))}


def held_out(key: Column) -> Column:
    """Whether a row is kept out of training: the remainder of its key's CRC-32 by four is two."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
