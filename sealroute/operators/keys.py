"""The key table of a run: who may open what, checked for size once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.functions.text import unwrap_secret
from sealroute.operators.keyed import PAYLOAD_HOT_ROWS, attach_per_key, fits_broadcast


@dataclass(frozen=True)
class KeyTable:
    """``key_id``, ``material`` and ``passphrase`` (null where none is needed), secrets unwrapped.

    ``small`` tells whether the table was checked to be small enough to broadcast; a larger one is
    joined with its hot keys salted, which counts the rows per key first and shuffles the rows.
    """

    frame: DataFrame
    small: bool

    @classmethod
    def of(cls, keys: DataFrame | KeyTable) -> KeyTable:
        if isinstance(keys, KeyTable):
            return keys
        passphrase = unwrap_secret(F.col("passphrase")) if "passphrase" in keys.columns else F.lit(None).cast("string")
        unwrapped = keys.select(
            "key_id", unwrap_secret(F.col("material")).alias("material"), passphrase.alias("passphrase"))
        return cls(unwrapped, fits_broadcast(keys))

    def attach(self, rows: DataFrame, output: str, row_id: str = "path") -> DataFrame:
        """Left join the key material as ``output``. It only ever is a column, never a plan literal.

        Rows that have it already stay as they are.
        """
        if output in rows.columns:
            return rows
        secrets = self.frame.select("key_id", F.col("material").alias(output))
        if self.small:
            return rows.join(F.broadcast(secrets), "key_id", "left")
        counted = rows.groupBy("key_id").agg(F.count(F.lit(1)).alias("_n")).join(secrets, "key_id", "left")
        return attach_per_key(rows, counted, "key_id", row_id, count="_n", hot_rows=PAYLOAD_HOT_ROWS).drop("_n")

    def mark_known(self, rows: DataFrame, output: str, row_id: str) -> DataFrame:
        """Add whether the row's key is in the table."""
        marked = KeyTable(self.frame.select("key_id", F.lit(True).alias("material")), self.small)
        return marked.attach(rows, output, row_id).withColumn(output, F.coalesce(output, F.lit(False)))
