"""OpenPGP payloads through the gpg program, which must be installed on every worker.

Each task keeps a private keyring folder per key, imports the key once, and removes the folder
when the task ends; nothing else is kept on the worker's disk. Payloads go through pipes and the
passphrase through its own pipe. gpg starts an agent process per keyring for private keys; it is
stopped with the keyring, or never started with ``start_agent=False``, which is enough to encrypt
and to open messages sealed with a passphrase alone.
"""

from __future__ import annotations

import logging
import os
import subprocess
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from sealroute.functions.armor import normalise_armor
from sealroute.functions.text import strip
from sealroute.operators.codec import MATERIAL
from sealroute.operators.keylist import NO_FINGERPRINT
from sealroute.operators.keys import KeyTable

# What a caller learns about a failed opening; the cause stays in the worker's log. A failed sealing
# names the cause after a colon instead, as its message goes to the error log and not to the caller.
IMPORT_FAILED = "gpg --import failed"
DECRYPT_FAILED = "gpg --decrypt failed"
ENCRYPT_FAILED = "gpg --encrypt failed"
SEE_LOG = ". Check function logs for details."

KEYRINGS_PER_TASK = 16
BATCH_BYTES = 64 << 20
log = logging.getLogger(__name__)


class GpgError(RuntimeError):
    """A failed gpg call: the text a caller may see, and the whole one."""

    def __init__(self, failure: str, cause: str | None = None):
        super().__init__(failure if cause is None else failure + SEE_LOG)
        self.whole = failure if cause is None else f"{failure}: {cause}"


class Keyring:
    """A temporary gpg home holding one imported key."""

    def __init__(self, gpg: str, start_agent: bool, timeout: float, scratch: str | None):
        self.folder = tempfile.TemporaryDirectory(prefix="sealroute-keyring-", dir=scratch)
        self.start_agent = start_agent
        self.timeout = timeout
        self.fingerprint: str | None = None
        self.command = [gpg, "--homedir", self.folder.name, "--batch", "--yes", "--no-tty"]
        if not start_agent:
            self.command.append("--no-autostart")

    def call(self, arguments: list[str], data: bytes, failure: str, **options) -> bytes:
        try:
            done = subprocess.run(
                self.command + arguments, input=data, capture_output=True, timeout=self.timeout, **options)
        except (OSError, subprocess.TimeoutExpired) as error:
            log.error("%s %s", failure, type(error).__name__)
            raise GpgError(failure, type(error).__name__) from None
        if done.returncode != 0:
            cause = done.stderr.decode(errors="replace")
            log.error("%s %s", failure, cause)
            raise GpgError(failure, cause)
        return done.stdout

    def load(self, key: str) -> None:
        self.call(["--import"], key.encode("utf-8"), IMPORT_FAILED)

    def recipient(self) -> str:
        """Fingerprint of the first key that lists one."""
        if self.fingerprint is None:
            listing = self.call(["--list-keys", "--with-colons"], b"", NO_FINGERPRINT).decode(errors="replace")
            fields = (line.split(":") for line in listing.split("\n") if line.startswith("fpr:"))
            self.fingerprint = next((field[9] for field in fields if len(field) > 9 and field[9]), None)
        if self.fingerprint is None:
            raise GpgError(NO_FINGERPRINT)
        return self.fingerprint

    def decrypt(self, passphrase: str, data: bytes) -> bytes:
        reader, writer = os.pipe()
        try:
            with os.fdopen(writer, "wb") as pipe:
                pipe.write(passphrase.encode("utf-8"))
            arguments = ["--passphrase-fd", str(reader), "--pinentry-mode", "loopback", "--decrypt"]
            return self.call(arguments, data, DECRYPT_FAILED, pass_fds=(reader,))
        finally:
            os.close(reader)

    def encrypt(self, data: bytes) -> bytes:
        return self.call(["--trust-model", "always", "--recipient", self.recipient(), "--encrypt"], data, ENCRYPT_FAILED)

    def close(self) -> None:
        if self.start_agent:
            subprocess.run(["gpgconf", "--homedir", self.folder.name, "--kill", "gpg-agent"], capture_output=True)
        self.folder.cleanup()


class Keyrings:
    """The few keyrings a task has open, by key text."""

    def __init__(self, *options):
        self.options = options
        self.open: OrderedDict[str, Keyring] = OrderedDict()

    def get(self, key: str) -> Keyring:
        if key not in self.open:
            ring = Keyring(*self.options)
            try:
                if key:
                    ring.load(key)
            except GpgError:
                ring.close()
                raise
            self.open[key] = ring
            if len(self.open) > KEYRINGS_PER_TASK:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(key)
        return self.open[key]

    def close(self) -> None:
        for ring in self.open.values():
            ring.close()


class OpenPgpProvider:
    """Provider that seals to a public key and opens with a private key and its passphrase.

    The key table's ``material`` is the armored key; for decryption ``passphrase`` goes with it.
    Armor is normalised once on the key table, not once per file. ``scratch`` is where tasks put
    their keyrings; a memory-backed folder such as ``/dev/shm`` keeps them off the disk.
    """

    def __init__(
        self, gpg: str = "gpg", start_agent: bool = True, timeout: float = 600, scratch: str | None = None
    ):
        self.options = (gpg, start_agent, timeout, scratch)

    def for_opening(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        table = KeyTable.of(keys)
        tidy = normalise_armor(table.frame, "material", "_tidy").select(
            "key_id", F.struct(F.when(F.col("material") == "", "").otherwise(F.col("_tidy")).alias("key"),
                               strip(F.coalesce("passphrase", F.lit(""))).alias("passphrase")).alias("material"))
        return KeyTable(tidy, table.small).attach(files, MATERIAL)

    def for_sealing(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        table = KeyTable.of(keys)
        plain = table.frame.select("key_id", F.struct(
            F.col("material").alias("key"), F.lit("").alias("passphrase")).alias("material"))
        return KeyTable(plain, table.small).attach(files, MATERIAL)

    def decrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        return _run(self.for_opening(files, keys), "plaintext", self.options,
                    lambda ring, row: ring.decrypt(row["passphrase"], row["content"]), whole=False)

    def encrypt(self, files: DataFrame, keys: DataFrame | KeyTable) -> DataFrame:
        return _run(self.for_sealing(files, keys), "sealed", self.options,
                    lambda ring, row: ring.encrypt(row["content"]), whole=True)


def _run(
    files: DataFrame, output: str, options: tuple, action: Callable[[Keyring, dict], bytes], whole: bool
) -> DataFrame:
    """Apply a keyring action to the rows whose status is null; one failed row never fails the task."""
    flat = files.withColumns({"_key": F.col(f"{MATERIAL}.key"), "_passphrase": F.col(f"{MATERIAL}.passphrase")}).drop(
        MATERIAL)
    kept = [name for name in flat.columns if name not in ("status", "message", "_key", "_passphrase")]
    added = [StructField("status", StringType()), StructField("message", StringType()),
             StructField(output, BinaryType())]
    schema = StructType([*[flat.schema[name] for name in kept], *added])

    def settle(rings: Keyrings, key: str | None, row: dict) -> tuple:
        if row["status"] is not None:
            return row["status"], row["message"], None
        try:
            if key is None:
                raise GpgError(IMPORT_FAILED, "no key")
            return "ok", "", action(rings.get(key), row)
        except GpgError as error:
            return "error", error.whole if whole else str(error), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Keyrings(*options)

        def extended(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done) if done else [[], [], []]
            types = [pa.string(), pa.string(), pa.large_binary()]
            arrays = [pa.array(column, type=kind) for column, kind in zip(columns, types)]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], names=[*batch.schema.names, "status", "message", output])

        try:
            for batch in batches:
                rest = batch.select(kept)
                done: list[tuple] = []
                start, held = 0, 0
                for position in range(batch.num_rows):
                    row = {name: batch.column(name)[position].as_py() for name in ("status", "message", "content")}
                    row["passphrase"] = batch.column("_passphrase")[position].as_py()
                    done.append(settle(rings, batch.column("_key")[position].as_py(), row))
                    held += len(done[-1][2] or b"")
                    if held >= BATCH_BYTES:
                        yield extended(rest.slice(start, len(done)), done)
                        done, start, held = [], position + 1, 0
                yield extended(rest.slice(start), done)
        finally:
            rings.close()

    return flat.mapInArrow(run, schema)
