"""Column functions against stated cases and brute-force restatements."""

from __future__ import annotations

import base64
import random
import re
import urllib.parse
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealroute.functions import paths, text
from sealroute.functions.armor import audit_armor, normalise_armor
from sealroute.functions.checksum import crc24_of
from sealroute.operators.keylist import NO_FINGERPRINT, first_fingerprint


def evaluate(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression(F.col("v"))).collect()]


UNSAFE = [
    "../../../etc/passwd", "../../private/secrets", "folder/../../../win.ini", "..\\..\\..\\windows\\system32",
    "%2e%2e%2f%2e%2e%2fetc%2fpasswd", "%2e%2e/sensitive", "..%2fprivate", "..%5c..%5cwindows", "%252e%252e%252f",
    "folder/..\\..\\system", "foo../bar", "%2e./x", "100%/..", "..", ".%2E", "a/.%2e", "x.\\\\y",
]
SAFE = ["inbound/data/2026/04", "errors/failed", "a/..b", "..%252f", "．．", "%zz/a", "a+b/c", "100%", "", "a/...", "%"]


def test_path_safety_cases(spark):
    assert evaluate(spark, UNSAFE + SAFE, paths.is_safe_path) == [False] * len(UNSAFE) + [True] * len(SAFE)


def test_strict_path_safety(spark):
    strict = lambda c: paths.is_safe_path(c, strict=True)
    tricky = ["..%252f", "．．/x", "a／..", "%25252e%252e/x", "․․"]
    assert evaluate(spark, tricky + UNSAFE, strict) == [False] * (len(tricky) + len(UNSAFE))
    assert evaluate(spark, ["inbound/2026", "a/..b", "100%"], strict) == [True] * 3


def test_path_safety_fuzz(spark):
    def safe(value):
        decoded = urllib.parse.unquote(value).replace("\\", "/")
        raw = value.lower()
        marks = ["../", ".\\\\", "%2e%2e", "%252e", "..%2f", "..%5c"]
        return ".." not in decoded.split("/") and not any(mark in raw for mark in marks)

    pick = random.Random(11)
    pieces = [".", "..", "/", "\\", "%2e", "%2E", "%2f", "%5C", "%25", "%", "a", "é", "%c3%a9", "%ff", "+", "．", " "]
    values = ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 7))) for _ in range(4000)]
    assert evaluate(spark, values, paths.is_safe_path) == [safe(value) for value in values]


def test_first_unsafe_keeps_the_order(spark):
    rows = spark.createDataFrame([("ok", "..", ".."), ("ok", "ok", "ok")], "a string, b string, c string")
    named = {name: F.col(name) for name in "abc"}
    assert [r[0] for r in rows.select(paths.first_unsafe(named)).collect()] == ["b", None]


def test_key_path(spark):
    values = ["keys/a.asc", "/keys/a.asc", "keys/../a", "a..b", ""]
    assert evaluate(spark, values, paths.is_bad_key_path) == [False, True, True, True, False]


def test_names(spark):
    values = ["in/a.csv.pgp", "a.csv.PGP", "in/x/.pgp", "_SUCCESS", "in/notes.pdf", "in/"]
    assert evaluate(spark, values, paths.base_name) == ["a.csv.pgp", "a.csv.PGP", ".pgp", "_SUCCESS", "notes.pdf", ""]
    assert evaluate(spark, values, paths.has_extension) == [True, True, True, False, False, False]
    assert evaluate(spark, ["a.csv.pgp", "a.csv.PGP", ".pgp", "é.pgp"], paths.plain_name) == ["a.csv", "a.csv", "", "é"]
    assert evaluate(spark, ["out//", "/", "", "a/b"], paths.drop_trailing_slashes) == ["out", "", "", "a/b"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stamped_names_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        moments = [
            datetime(2026, 4, 17, 14, 30, 15), datetime(2026, 3, 8, 2, 30, 0, 120),
            datetime(2024, 12, 31, 23, 59, 59, 999999)]
        names = evaluate(spark, moments, lambda c: paths.archive_name(c, F.lit("f.pgp")), "timestamp_ntz")
        dated = evaluate(spark, moments, lambda c: paths.dated_path(
            F.lit("archive/sent"), c, paths.plain_output_name(F.lit("data_encrypted_"), c)), "timestamp_ntz")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert names == ["20260417143015000000_f.pgp", "20260308023000000120_f.pgp", "20241231235959999999_f.pgp"]
    assert dated[0] == "archive/sent/2026/04/17/data_encrypted_20260417143015.csv"
    assert [d.split("data")[0] for d in dated[1:]] == ["archive/sent/2026/03/08/", "archive/sent/2024/12/31/"]


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [space + "a b" + space for space in spaces] + ["", " ", "​x​", "a\n", None]
    assert evaluate(spark, values, text.strip) == [None if v is None else v.strip() for v in values]


def test_first_line_equals_python(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    values = [f"one{b}two" for b in breaks] + [f"{b}two" for b in breaks] + ["", "x" * 300, "é" * 201, "\x1fkept"]
    expected = [(value.splitlines() or [""])[0][:200] for value in values]
    assert evaluate(spark, values, text.first_line) == expected


def test_run_id(spark):
    values = ["a1b2c3d4-e5f6-7890-abcd-ef1234567890", " _-é ", None, "x" * 30]
    assert evaluate(spark, values, text.clean_run_id) == ["a1b2c3d4e5f67890abcd", "", "", "x" * 20]
    assert all(re.fullmatch("[A-Za-z0-9]{0,20}", v) for v in evaluate(spark, values, text.clean_run_id))


def test_secret(spark):
    values = [" plain \n", '{"value": " v "}', '{"value": "", "Value": "W"}', '{"Value": "W"}', '{"x": 1}', '{"value"', ""]
    assert evaluate(spark, values, text.unwrap_secret) == ["plain", "v", "W", "W", "", '{"value"', ""]


def _bitwise_crc(data: bytes) -> int:
    register = 0xB704CE
    for byte in data:
        register ^= byte << 16
        for _ in range(8):
            register = (register << 1) ^ (0x1864CFB if register & 0x800000 else 0)
    return register


def test_crc24_equals_a_bit_loop():
    pick = random.Random(5)
    assert crc24_of(np.frombuffer(b"123456789", dtype=np.uint8)) == 0x21CF02
    for size in [0, 1, 2, 3, 4, 255, 511, 512, 513, 514, 515, 1024, 3000, 70000]:
        data = pick.randbytes(size)
        assert crc24_of(np.frombuffer(data, dtype=np.uint8)) == _bitwise_crc(data)


def _wrapped(body: str) -> str:
    return "\n".join(body[i:i + 76] for i in range(0, len(body), 76))


def _checksum(data: bytes) -> str:
    return "=" + base64.b64encode(_bitwise_crc(data).to_bytes(3, "big")).decode()


def _decoded(body: str) -> bytes | None:
    try:
        return base64.b64decode(body)
    except ValueError:
        return None


def _expected_armor(block: str) -> str | None:
    lines = block.replace("\r\n", "\n").strip().split("\n")
    starts = [i for i, line in enumerate(lines) if line.startswith("-----BEGIN PGP")]
    ends = [i for i, line in enumerate(lines) if line.startswith("-----END PGP")]
    if not starts or not ends:
        body = re.sub("[\n\r ]", "", "\n".join(lines))
        data = _decoded(body)
        kind = "PGP PRIVATE KEY BLOCK"
        return body if data is None else (
            f"-----BEGIN {kind}-----\n\n{_wrapped(body)}\n{_checksum(data)}\n-----END {kind}-----\n")
    inside = [line for line in lines[starts[0] + 1:ends[0]] if not line.startswith("-----BEGIN PGP")]
    blank = inside.index("") if "" in inside else len(inside)
    body = "".join(line for line in inside[blank + 1:] if not (line[:1] == "=" and len(line) == 5))
    data = _decoded(body)
    if data is None:
        return None
    return "\n".join([lines[starts[0]], *inside[:blank], "", _wrapped(body), _checksum(data), lines[ends[0]]]) + "\n"


def _random_block(pick: random.Random) -> str:
    body = base64.b64encode(pick.randbytes(pick.choice([0, 1, 2, 3, 57, 58, 200, 900]))).decode()
    for _ in range(pick.choice([0, 0, 1, 3])):
        at = pick.randint(0, len(body))
        body = body[:at] + pick.choice("= =-_.\té  x=A") + body[at:]
    if pick.random() < 0.15:
        body = body.rstrip("=")
    width = pick.choice([5, 64, 76, 80])
    newline = pick.choice(["\n", "\n", "\r\n", "\r"])
    body = newline.join(body[i:i + width] for i in range(0, len(body), width))
    if pick.random() < 0.25:
        return pick.choice(["", " ", "\n"]) + body + pick.choice(["", " ", "\r\n"])
    kind = pick.choice(["MESSAGE", "PUBLIC KEY BLOCK", "PRIVATE KEY BLOCK"])
    parts = [f"-----BEGIN PGP {kind}-----", "Comment: x", "", body, "=abcd", f"-----END PGP {kind}-----"]
    kept = [part for part, chance in zip(parts, [0.93, 0.4, 0.9, 1, 0.6, 0.93]) if pick.random() < chance]
    if pick.random() < 0.1:
        pick.shuffle(kept)
    return newline.join(kept)


def test_armor_fuzz(spark):
    pick = random.Random(3)
    blocks = [_random_block(pick) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(blocks)), "i int, block string")
    got = {row.i: row.normalised for row in normalise_armor(frame, "block").collect()}
    wrong = [(block, _expected_armor(block), got[i]) for i, block in enumerate(blocks) if got[i] != _expected_armor(block)]
    assert not wrong, wrong[0]


def test_armor_audit(spark):
    good = base64.b64encode(b"payload").decode()
    blocks = [
        f"-----BEGIN PGP MESSAGE-----\nA: 1\nB: 2\n\n{good}\n{_checksum(b'payload')}\n-----END PGP MESSAGE-----",
        f"-----BEGIN PGP MESSAGE-----\n{good}\n-----END PGP MESSAGE-----",
        "-----BEGIN PGP MESSAGE-----\n\nabc\n=abcd\n-----END PGP MESSAGE-----", "no armor!", None]
    frame = spark.createDataFrame(list(enumerate(blocks)), "i int, block string")
    columns = ["has_begin", "has_end", "block_type", "header_count", "no_blank_line", "body_bytes", "bad_body", "crc_matches"]
    got = [tuple(row) for row in audit_armor(frame, "block").orderBy("i").select(*columns).collect()]
    assert got[0] == (True, True, "MESSAGE", 2, False, 7, False, True)
    assert got[1] == (True, True, "MESSAGE", 1, True, 0, False, None)
    assert got[2] == (True, True, "MESSAGE", 0, False, None, True, None)
    assert got[3] == (False, False, None, 0, False, None, True, None)


def test_fingerprint(spark):
    lines = [
        ("a", 1, "pub:u:2048"), ("a", 2, "fpr::::::::::"), ("a", 3, "fpr:::::::::ABC123DEF456789:::"),
        ("a", 4, "fpr:::::::::LATER:"), ("b", 1, "fpr:short"), ("b", 2, "uid:::::::::X:")]
    frame = spark.createDataFrame(lines, "key_id string, line_no int, line string")
    assert {tuple(row) for row in first_fingerprint(frame).collect()} == {
        ("a", "ABC123DEF456789", None), ("b", None, NO_FINGERPRINT)}
