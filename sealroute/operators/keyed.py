"""Many-to-one joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task may get: of plain metadata, and of rows that carry payloads.
HOT_ROWS = 1_000_000
PAYLOAD_HOT_ROWS = 10_000
# A table is broadcast only if it was measured to have no more rows and bytes than these.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20


def attach_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, row_id: str, count: str = "n", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join ``rows`` to ``per_key``, which has one row per key and the row count of that key.

    A key with more than ``hot_rows`` rows is spread over ``ceil(count / hot_rows)`` salts, so no
    task gets more than about ``hot_rows`` rows of one key. The list of hot keys holds at most total
    rows / ``hot_rows`` entries; it is broadcast if it was measured to be small.
    """
    per_key = per_key.filter(F.col(key).isNotNull())
    salts = F.ceil(F.col(count) / F.lit(hot_rows)).cast("bigint")
    hot = per_key.filter(F.col(count) > hot_rows).select(key, salts.alias("_salts"))
    # Rows without a key match nothing; they are spread widely instead of meeting in one task.
    spread = F.coalesce("_salts", F.when(F.col(key).isNull(), F.lit(hot_rows)).otherwise(F.lit(1))).cast("bigint")
    salted = (
        rows.join(F.broadcast(hot) if fits_broadcast(hot) else hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(row_id), spread))
        .drop("_salts")
    )
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def measured(table: DataFrame) -> tuple[int, int]:
    """Rows of a table and about how many bytes they hold, in one aggregate that combines map-side."""
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))
    return tuple(table.agg(F.count(F.lit(1)), size).first())


def _fits(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def fits_broadcast(table: DataFrame) -> bool:
    return _fits(*measured(table))


def attach_exceptions(
    rows: DataFrame, per_key: DataFrame, key: str, row_id: str, count: str = "n", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Like ``attach_per_key`` for a table that is expected to hold few keys, or none.

    It is measured first. An empty one adds nulls without a join and a small one is broadcast, so
    the rows are not shuffled; a large one is joined with its hot keys salted.
    """
    found, size = measured(per_key)
    if found == 0:
        added = [field for field in per_key.schema.fields if field.name != key]
        return rows.withColumns({field.name: F.lit(None).cast(field.dataType) for field in added})
    if _fits(found, size):
        return rows.join(F.broadcast(per_key), key, "left")
    return attach_per_key(rows, per_key, key, row_id, count, hot_rows)


def attach_small(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join to a table with unique keys: broadcast when it is checked to be small, else salted."""
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), key, "left")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(table, key, "left")
    return attach_per_key(rows, counted, key, row_id, count="_n").drop("_n")
