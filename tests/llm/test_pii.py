"""Personal data against the plain patterns, and identifiers found by their contexts."""

from __future__ import annotations

import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from sealroute.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id bigint, text string, lang string, Row string"


def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return [name for *_, name in sorted(found)]


def texts():
    fixed = [
        None, "", "a@b.c_d@e.f", "x@y", "😀 mail: é.x@ä.de a.b+c@mail-1.example.com, 1.2.3.4.5.6.7.8 and 256.1.1.1 0001.02.3.255",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (555) 010-9999 +12 +1((((((((( 5 +1234567890123456",
        "a" * 60_000, "1" * 60_000, "1 " * 30_000, "a@" * 30_000, "1." * 30_000, "+1" * 30_000, "a@b.c " * 5_000,
        "x" * 40_000 + "@b.co 10.0.0.1", "\n\n10.1.1.1\n+1 800 555 0100\n4012888888881881\n", "@a.b c@.d e@f..g h@i.j.", "--@--.--"]
    source = random.Random(3)
    marks = list("ab1259@@..  +-()_%é\n") + ["4111111111111111", "10.0.0.1", "a@b.cd", "+1 800 555 0100"]
    return fixed + ["".join(source.choices(marks, k=source.randint(1, 60))) for _ in range(1500)]


def test_base_spans_match_the_plain_patterns(spark):
    rows = list(enumerate(texts())) + [(2, "a@b.c_d@e.f"), (None, "10.0.0.1")]
    found = pii.personal_data(spark.createDataFrame([(key, text, "en", "clash") for key, text in rows], SCHEMA))
    base_only = F.filter("found", lambda one: one["kind"] < 4)
    got = found.select("doc_id", pii.spans_text(base_only).alias("spans"), F.sha2(pii.spans_text(base_only), 256).alias("sha")).collect()
    want = sorted(((key, ",".join(base(text))) for key, text in rows), key=str)
    assert sorted(((r.doc_id, r.spans) for r in got), key=str) == want
    assert all(r.sha == sha256(r.spans.encode()).hexdigest() for r in got)


def test_contexts_discover_what_no_base_pattern_knows(spark):
    rows = [(i, f"Please send it to card number 40128888888{i:05d} today", "en", "-") for i in range(90)]
    rows += [(i, f"Dear all, my badge is a{i}b@mail.example.com thanks", "en", "-") for i in range(100, 112)]
    rows += [(200, "Dear all, my badge is (KX-4471-09), thanks", "en", "-"), (201, "The year was 2024-2025 then", "en", "-"),
             (202, "my badge is none", "en", "-"), (203, "version 12345678 is out", "en", "-")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r.spans for r in pii.personal_data(frame).select("doc_id", pii.spans_text(F.col("found")).alias("spans")).collect()}
    assert found[200] == "id:23:33" and rows[-4][1][23:33] == "KX-4471-09"
    assert found[201] == found[202] == found[203] == ""
    masked = {r.doc_id: r.text for r in pii.without_personal_data(frame).collect()}
    assert masked[200] == "Dear all, my badge is <ID> thanks" and masked[100] == "Dear all, my badge is <EMAIL> thanks"
    assert masked[203] == rows[-1][1]


def test_masking_keeps_columns_rows_and_clean_texts(spark):
    rows = [(1, "a@b.cd, +1 800 555 0100, 4111111111111111, 10.0.0.1, 300.1.1.1", 9, "p"), (2, None, None, "p"), (3, "clean 12", 8, "p"),
            (3, "clean 12", 8, "p"), (4, "a@b.c " * 3000, 0, "p")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, pii_x string")
    got = pii.without_personal_data(frame)
    assert got.columns == frame.columns and got.count() == 5
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].text == "<EMAIL>, <PHONE>, <CARD>, <IP>, 300.1.1.1" and by_id[1].n_chars == len(by_id[1].text)
    assert by_id[2].text is None and by_id[3].text == "clean 12" and by_id[3].n_chars == 8 and by_id[4].text == "<EMAIL> " * 3000
    assert pii.without_personal_data(frame.limit(0)).collect() == []


def test_cards_of_parted_digits_are_masked(spark):
    rows = [(1, "pay 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 now"), (2, "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now"), (3, "1-2 and 3")]
    got = pii.without_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {1: "pay <CARD> now", 2: "pay <CARD> now", 3: "1-2 and 3"}
