"""Places of rows within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealroute.session import keep

_INDEX_BITS = 33


def ranked(rows: DataFrame, group: list[str], order: list[str], folder: str, output: str = "place") -> DataFrame:
    """Add each row's place in its group by ``order``, counted from zero; rows alike in all of it in any order.

    Rows are sorted by range over all partitions, so a large group spans many. A place is the row's place in its
    partition and the counts of its group in earlier ones; only these counts, a row for each partition that a group
    spans, are summed up. ``folder`` is for the work tables.
    """
    number = "_number"
    numbered = keep(rows.withColumn(number, F.monotonically_increasing_id()), folder, "numbered")
    keys = [*group, *order, number]
    at = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = keep(at, folder, "sorted").withColumn("_part", F.shiftright("_at", _INDEX_BITS))
    counts = at.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = keep(counts.select(
        F.struct(*group).alias("_of"), F.col("_part").alias("_in"),
        (F.coalesce(before, F.lit(0).cast("bigint")) - F.col("_first")).alias("_shift")), folder, "shifts")
    of = F.col("_of").eqNullSafe(F.struct(*group)) & (F.col("_in") == F.col("_part"))
    return at.join(shifts, of).withColumn(output, F.col("_at") + F.col("_shift")).drop(
        "_of", "_in", "_shift", "_part", "_at", number)
