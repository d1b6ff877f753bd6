"""The dated archive as a table: a folder for each day, and a load replaces the days that it has rows of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = ("year", "month", "day")


def with_day(rows: DataFrame, at: Column) -> DataFrame:
    """Add ``year``, ``month`` and ``day`` as the dated paths have them; rows without a time get empty parts."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    return rows.withColumns({name: F.coalesce(F.date_format(at, form), F.lit("")) for name, form in parts.items()})


def load_days(rows: DataFrame, folder: str, at: Column, max_rows: int = 5_000_000) -> None:
    """Full load of the days that ``rows`` have: their folders are replaced as a whole, all other days stay.

    Rows of a day meet in one file of at most ``max_rows`` rows each, so a load has few files however many tasks it has;
    a day with more rows gets more files and, as its partitions are split when they are large, more tasks. Running the
    same load again changes nothing.
    """
    spread = with_day(rows, at).hint("rebalance", *DAY)
    (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_rows)
     .partitionBy(*DAY).parquet(folder))
