"""Payload encryption and decryption jobs.

A provider turns a DataFrame with ``path``, ``key_id`` and ``content`` into one with a status per
row. It joins the key table itself, or before the payloads are opened when asked to through
``for_opening`` or ``for_sealing``: a key table too large to broadcast shuffles the rows, which
should not carry payloads then. ``AesProvider`` stays inside Catalyst; the OpenPGP provider runs the gpg program in tasks.
AES payloads are an internal envelope, not an OpenPGP message.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.operators.keys import KeyTable

DECRYPT_FAILED = "payload could not be decrypted"
ENCRYPT_FAILED = "payload could not be encrypted"
MATERIAL = "_material"


class Provider(Protocol):
    def for_opening(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        """Join what each file is opened with."""

    def for_sealing(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        """Join what each file is sealed with."""

    def decrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        """Add ``plaintext`` and settle the rows whose ``status`` is null to ``ok`` or ``error``."""

    def encrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        """Add ``sealed`` and settle the rows whose ``status`` is null to ``ok`` or ``error``."""


def _settle(files: DataFrame, pending: Column, output: str, failure: str) -> DataFrame:
    """Status and message of the rows that were pending, from whether ``output`` is there."""
    done = F.col(output).isNotNull()
    return files.withColumns({
        "status": F.when(pending, F.when(done, "ok").otherwise("error")).otherwise(F.col("status")),
        "message": F.when(pending, F.when(done, "").otherwise(failure)).otherwise(F.col("message")),
    })


class AesProvider:
    """AES-GCM with a 256-bit key hashed from the key table's material."""

    def _key(self) -> Column:
        return F.unhex(F.sha2(F.col(MATERIAL), 256))

    def for_opening(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        return KeyTable.of(keys).attach(files, MATERIAL)

    for_sealing = for_opening

    def decrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        pending = F.col("status").isNull()
        plain = F.try_aes_decrypt("content", self._key(), F.lit("GCM"))
        opened = self.for_opening(files, keys).withColumn("plaintext", F.when(pending, plain))
        return _settle(opened, pending, "plaintext", DECRYPT_FAILED).drop(MATERIAL)

    def encrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        pending = F.col("status").isNull()
        sealed = F.when(
            pending & F.col(MATERIAL).isNotNull(), F.aes_encrypt("content", self._key(), F.lit("GCM")))
        out = self.for_sealing(files, keys).withColumn("sealed", sealed)
        return _settle(out, pending, "sealed", ENCRYPT_FAILED).drop(MATERIAL)


def fan_out(files: DataFrame, key: str) -> DataFrame:
    """Spread rows over all cores when a scan has fewer splits than cores; else leave them in place.

    For a plain scan only: a large table already has more splits than cores and is not shuffled.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= cores else files.repartition(cores, key)


def payload_partitions(files: DataFrame, target_bytes: int = 1 << 30, target_files: int = 2000) -> int:
    """How many tasks a codec job gets, from the listing: at most ``target_bytes`` and ``target_files`` on average.

    The job is then repartitioned by path, so no folder keeps its files in one task.
    """
    total, count = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-int(total) // target_bytes), -(-count // target_files))
