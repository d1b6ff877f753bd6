"""The gpg provider without an agent process: public-key encryption and passphrase messages.

The recipient key is made here: a fresh RSA key written as OpenPGP packets. Private-key import
needs gpg's agent, which these tests do not start.
"""

from __future__ import annotations

import base64
import hashlib
import secrets
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealroute.functions.checksum import crc24_of
from sealroute.operators.openpgp import DECRYPT_FAILED, IMPORT_FAILED, SEE_LOG, OpenPgpProvider
from sealroute.plans.decrypt_job import decrypt_files
from sealroute.plans.encrypt_job import encrypt_files
from tests.test_decrypt_job import put
from tests.test_decrypt_job import request as decrypt_request
from tests.test_encrypt_job import request as encrypt_request

pytestmark = pytest.mark.skipif(shutil.which("gpg") is None, reason="gpg is not installed")
PROVIDER = OpenPgpProvider(start_agent=False)


def _prime(bits: int) -> int:
    while True:
        n = secrets.randbits(bits) | (3 << (bits - 2)) | 1
        if all(n % p for p in (3, 5, 7, 11, 13, 17, 19, 23)) and all(
                pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)) and n % 65537 != 1:
            return n


def _mpi(n: int) -> bytes:
    return n.bit_length().to_bytes(2, "big") + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _packet(tag: int, body: bytes) -> bytes:
    return bytes([0xC0 | tag, 0xFF]) + len(body).to_bytes(4, "big") + body


def public_key() -> tuple[str, int, int]:
    """Armored public key with a self-signed user id, and its modulus and private exponent."""
    p, q = _prime(1024), _prime(1024)
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    key = b"\x04" + (1700000000).to_bytes(4, "big") + b"\x01" + _mpi(n) + _mpi(65537)
    user = b"Partner <partner@example.org>"
    framed = b"\x99" + len(key).to_bytes(2, "big") + key
    fingerprint = hashlib.sha1(framed).digest()
    hashed = b"\x05\x02" + (1700000001).to_bytes(4, "big") + b"\x02\x1b\x0f"
    head = b"\x04\x13\x01\x08" + len(hashed).to_bytes(2, "big") + hashed
    signed = framed + b"\xb4" + len(user).to_bytes(4, "big") + user + head + b"\x04\xff" + len(head).to_bytes(4, "big")
    digest = hashlib.sha256(signed).digest()
    info = bytes.fromhex("3031300d060960864801650304020105000420") + digest
    padded = b"\x00\x01" + b"\xff" * (256 - 3 - len(info)) + b"\x00" + info
    unhashed = b"\x09\x10" + fingerprint[-8:]
    signature = head + len(unhashed).to_bytes(2, "big") + unhashed + digest[:2] + _mpi(
        pow(int.from_bytes(padded, "big"), d, n))
    packets = _packet(6, key) + _packet(13, user) + _packet(2, signature)
    checksum = base64.b64encode(crc24_of(np.frombuffer(packets, dtype=np.uint8)).to_bytes(3, "big")).decode()
    body = f"{base64.encodebytes(packets).decode()}={checksum}\n"
    return f"-----BEGIN PGP PUBLIC KEY BLOCK-----\n\n{body}-----END PGP PUBLIC KEY BLOCK-----\n", n, d


def gpg(home, *arguments, data: bytes) -> bytes:
    command = ["gpg", "--homedir", str(home), "--batch", "--yes", "--no-tty", "--no-autostart", *arguments]
    return subprocess.run(command, input=data, capture_output=True, check=True, timeout=60).stdout


def session_key(message: bytes, n: int, d: int) -> str:
    """The session key inside the first packet, opened with the private exponent."""
    header = 2 if message[0] & 0x40 else 1 + (1 << (message[0] & 3))
    if message[0] & 0x40 and message[1] >= 192:
        header = 3 if message[1] < 224 else 6
    start = header + 10
    bits = int.from_bytes(message[start:start + 2], "big")
    value = int.from_bytes(message[start + 2:start + 2 + (bits + 7) // 8], "big")
    plain = pow(value, d, n).to_bytes(256, "big")
    content = plain[plain.index(b"\x00", 2) + 1:]
    return f"{content[0]}:{content[1:-2].hex()}"


def files(spark, rows):
    frame = spark.createDataFrame(rows, "path string, key_id string, content binary, status string")
    return frame.withColumn("message", F.when(F.col("status").isNotNull(), "settled before"))


def test_files_are_sealed_to_the_recipient(spark, tmp_path):
    armored, n, d = public_key()
    keys = spark.createDataFrame([("partner", armored), ("broken", "not a key")], "key_id string, material string")
    payloads = {f"f{i}": secrets.token_bytes(1000 * i + 50) for i in range(5)}
    rows = [(path, "partner", data, None) for path, data in payloads.items()]
    rows += [("bad", "broken", b"x", None), ("lost", "nobody", b"x", None), ("done", "partner", b"x", "empty")]
    got = {row.path: row for row in PROVIDER.encrypt(files(spark, rows).repartition(3), keys).collect()}
    home = tmp_path / "h"
    home.mkdir(mode=0o700)
    for path, data in payloads.items():
        sealed = bytes(got[path].sealed)
        assert got[path].status == "ok" and data not in sealed
        opened = gpg(home, "--override-session-key", session_key(sealed, n, d), "--decrypt", data=sealed)
        assert opened == data
    # The message goes to the error log, so it names the cause.
    assert (got["bad"].status, got["bad"].sealed) == ("error", None)
    assert got["bad"].message.startswith(f"{IMPORT_FAILED}: ") and "gpg: " in got["bad"].message
    assert (got["lost"].status, got["lost"].message) == ("error", f"{IMPORT_FAILED}: no key")
    assert (got["done"].status, got["done"].message, got["done"].sealed) == ("empty", "settled before", None)


def test_passphrase_messages_are_opened(spark, tmp_path):
    home = tmp_path / "h"
    home.mkdir(mode=0o700)
    payloads = {f"f{i}": secrets.token_bytes(500 * i) for i in range(4)}
    sealed = {}
    for path, data in payloads.items():
        plain = tmp_path / path
        plain.write_bytes(data)
        target = tmp_path / f"{path}.pgp"
        subprocess.run(
            ["gpg", "--homedir", str(home), "--batch", "--yes", "--no-tty", "--no-autostart", "--pinentry-mode",
             "loopback", "--passphrase-fd", "0", "--output", str(target), "--symmetric", str(plain)],
            input=b"open sesame\n", capture_output=True, timeout=60)
        sealed[path] = target.read_bytes()
    keys = spark.createDataFrame(
        [("right", "", " open sesame\n"), ("wrong", "", "guess")],
        "key_id string, material string, passphrase string")
    rows = [(path, "right", data, None) for path, data in sealed.items()]
    rows += [("wrong", "wrong", sealed["f1"], None), ("junk", "right", b"junk", None), ("void", "right", b"", None)]
    got = {row.path: row for row in PROVIDER.decrypt(files(spark, rows), keys).collect()}
    for path, data in payloads.items():
        assert (got[path].status, bytes(got[path].plaintext)) == ("ok", data)
    for path in ["wrong", "junk", "void"]:
        assert (got[path].status, got[path].message, got[path].plaintext) == ("error", DECRYPT_FAILED + SEE_LOG, None)


def test_jobs_run_with_the_provider(spark, tmp_path):
    armored, n, d = public_key()
    put(tmp_path, {"keys/partner.key": armored.encode(), "staging/1/a.csv": b"rows to send"})
    sent = encrypt_files(encrypt_request(spark, tmp_path, {1: {}}), PROVIDER).results.first()
    assert (sent.status, sent.originalSize) == ("SUCCESS", 12)
    sealed = (tmp_path / sent.outputPath).read_bytes()
    assert len(sealed) == sent.encryptedSize
    home = tmp_path / "h"
    home.mkdir(mode=0o700)
    opened = gpg(home, "--override-session-key", session_key(sealed, n, d), "--decrypt", data=sealed)
    assert opened == b"rows to send"

    plain = tmp_path / "in.csv"
    plain.write_bytes(b"rows received")
    subprocess.run(
        ["gpg", "--homedir", str(home), "--batch", "--yes", "--no-tty", "--no-autostart", "--pinentry-mode", "loopback",
         "--passphrase-fd", "0", "--output", str(tmp_path / "in.pgp"), "--symmetric", str(plain)],
        input=b"sesame\n", capture_output=True, timeout=60)
    put(tmp_path, {"inbound/a/in.csv.pgp": (tmp_path / "in.pgp").read_bytes(), "inbound/a/junk.csv.pgp": b"junk"})
    keys = spark.createDataFrame([("alpha", "", "sesame")], "key_id string, material string, passphrase string")
    row = decrypt_files(decrypt_request(spark, tmp_path, "a"), keys, PROVIDER).summary.first()
    assert (row.ok, row.failed, row.code, row.error_files) == (1, 1, 207, [f"junk.csv.pgp: {DECRYPT_FAILED + SEE_LOG}"])
    assert (tmp_path / "done/a/in.csv").read_bytes() == b"rows received"


def test_passphrase_is_in_no_plan(spark):
    keys = spark.createDataFrame([("k", "", "very secret words")], "key_id string, material string, passphrase string")
    plan = PROVIDER.decrypt(files(spark, [("p", "k", b"x", None)]), keys)._jdf.queryExecution().toString()
    assert "very secret words" not in plan
