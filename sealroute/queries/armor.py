"""Queries on armored text, checksums and key listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealroute.functions.armor import audit_armor, normalise_armor, wrap
from sealroute.functions.checksum import crc24, crc24_line
from sealroute.operators.codec import fan_out
from sealroute.operators.keylist import NO_FINGERPRINT, first_fingerprint
from sealroute.queries.landing import LANDING_SQL, WS_SQL, payload_landing, read


# Fixed value: the checksum line of an empty payload.
EMPTY_CRC = "=twTO"


def one_line_base64(column: str):
    return F.translate(F.base64(column), "\r\n", "")


def framed_cases(spark, sf):
    """One framed block per document, in six shapes from tidy to undecodable.

    The stored checksum of the first shape is that of an empty payload, so it is right for some.
    """
    case = F.col("doc_id") % 6
    body = one_line_base64("content")
    cut = F.when(case == 5, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    wrapped = wrap(cut, 64)
    lines = F.when(case == 4, F.replace(wrapped, F.lit("\n"), F.lit(".\n"))).otherwise(wrapped)
    block = F.concat(
        F.lit("-----BEGIN PGP "), F.col("kind"), F.lit("-----\n"),
        F.when(case == 1, "Version: 1\nComment: a b\n").otherwise(""),
        F.when(case == 3, "").otherwise("\n"),
        lines, F.lit("\n"),
        F.when(case == 0, EMPTY_CRC).otherwise("=abcd"),
        F.lit("\n-----END PGP "), F.col("kind"), F.lit("-----\n"))
    kinds = F.when(case < 2, "MESSAGE").when(case < 4, "PUBLIC KEY BLOCK").otherwise("PRIVATE KEY BLOCK")
    return (
        payload_landing(spark, sf).select("doc_id", "content", kinds.alias("kind"))
        .select("doc_id", F.when(case == 2, F.replace(block, F.lit("\n"), F.lit("\r\n"))).otherwise(block).alias("block"))
    )


def armor_normalise(spark, sf):
    return normalise_armor(framed_cases(spark, sf), "block").select("doc_id", "normalised")


def armor_reconstruct(spark, sf):
    body = one_line_base64("content")
    case = F.col("doc_id") % 3
    bare = (
        F.when(case == 0, F.concat(F.lit("  "), wrap(body, 60), F.lit("\r\n")))
        .when(case == 1, F.rtrim(body, F.lit("=")))
        .otherwise(F.col("content").cast("string")))
    cases = payload_landing(spark, sf).select("doc_id", bare.alias("block"))
    return normalise_armor(cases, "block").select("doc_id", "normalised")


def armor_audit(spark, sf):
    flags = ["has_begin", "has_end", "no_blank_line", "bad_body", "crc_matches"]
    return audit_armor(framed_cases(spark, sf), "block").select(
        "doc_id", "block_type", "header_count", "body_bytes", "stored_crc", "computed_crc",
        *[F.col(name).cast("int").alias(name) for name in flags])


def crc24_of_texts(spark, sf):
    content = F.col("text").cast("binary")
    texts = fan_out(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return texts.select("doc_id", crc24(content).alias("crc"), crc24_line(content).alias("line"))


def key_listing(spark, sf):
    order = F.col("o_orderkey")
    line = (
        F.when(order % 5 == 0, F.concat(F.lit("fpr:::::::::"), F.md5(order.cast("string")), F.lit(":::")))
        .when(order % 5 == 1, "fpr::::::::::")
        .when(order % 5 == 2, F.concat(F.lit("uid:u::::1::X::"), order.cast("string"), F.lit("::")))
        .when(order % 5 == 3, "fpr:short").otherwise(F.concat(F.lit("pub:u:255:22:"), order.cast("string"))))
    lines = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("key_id"), order.alias("line_no"), line.alias("line"))
    return first_fingerprint(lines)


_SHIFT_SQL = """
shift AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 8388608 > 0 THEN xor((c << 1) & 16777215, 8801531)
    ELSE (c << 1) & 16777215 END, b << 16) ORDER BY b) AS tab FROM range(256) r(b))"""


def _crc_sql(payload: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({payload}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"list_reduce({octets}, lambda c, x: xor((c << 8) & 16777215, tab[xor(c >> 16, x) + 1]), "
            "11994318::BIGINT)")


def _line_sql(crc: str) -> str:
    return f"'=' || base64(unhex(lpad(hex({crc}), 6, '0')))"


def _wrap_sql(body: str, width: int) -> str:
    return f"rtrim(regexp_replace({body}, '(.{{{width}}})', '\\1' || chr(10), 'g'), chr(10))"


_FRAMED_SQL = LANDING_SQL + f""",
bodies AS (
  SELECT doc_id, content, doc_id % 6 AS c,
    CASE WHEN doc_id % 6 = 5 THEN left(base64(content), greatest(length(base64(content)) - 1, 0)) ELSE base64(content)
      END AS body,
    CASE WHEN doc_id % 6 < 2 THEN 'MESSAGE' WHEN doc_id % 6 < 4 THEN 'PUBLIC KEY BLOCK' ELSE 'PRIVATE KEY BLOCK' END
      AS kind
  FROM landing),
tidy AS (
  SELECT doc_id, c, '-----BEGIN PGP ' || kind || '-----' || chr(10) ||
    CASE WHEN c = 1 THEN 'Version: 1' || chr(10) || 'Comment: a b' || chr(10) ELSE '' END ||
    CASE WHEN c = 3 THEN '' ELSE chr(10) END ||
    CASE WHEN c = 4 THEN replace({_wrap_sql('body', 64)}, chr(10), '.' || chr(10)) ELSE {_wrap_sql('body', 64)} END ||
    chr(10) || CASE WHEN c = 0 THEN '{EMPTY_CRC}' ELSE '=abcd' END || chr(10) ||
    '-----END PGP ' || kind || '-----' || chr(10) AS block FROM bodies),
cases AS (
  SELECT doc_id, CASE WHEN c = 2 THEN replace(block, chr(10), chr(13) || chr(10)) ELSE block END AS block FROM tidy)"""

_BARE_SQL = LANDING_SQL + f""",
cases AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' || {_wrap_sql('base64(content)', 60)} || chr(13) || chr(10)
    WHEN 1 THEN rtrim(base64(content), '=') ELSE decode(content) END AS block FROM landing)"""

# One group of four, and how a base64 text may end, with padding ignored elsewhere.
_D = "[A-Za-z0-9+/]"
_BASE64_SQL = f"'^(=*{_D}=*{_D}=?{_D}{_D})*(=*$|=*{_D}=*{_D}==|=*{_D}=*{_D}=?{_D}=)'"

_PARSED_SQL = f""",
texts AS (SELECT doc_id, trim(replace(block, chr(13) || chr(10), chr(10)), {WS_SQL}) AS t FROM cases),
parts AS (SELECT *, string_split(t, chr(10)) AS ls FROM texts),
marks AS (
  SELECT *, coalesce(list_position(list_transform(ls, lambda l: starts_with(l, '-----BEGIN PGP')), true), 0) AS b,
    coalesce(list_position(list_transform(ls, lambda l: starts_with(l, '-----END PGP')), true), 0) AS e FROM parts),
insides AS (
  SELECT *, b > 0 AND e > 0 AS framed, CASE WHEN b > 0 AND e > b + 1 THEN ls[b + 1:e - 1] ELSE [] END AS ins FROM marks),
blanks AS (SELECT *, coalesce(list_position(ins, ''), 0) AS k FROM insides),
split AS (
  SELECT *, CASE WHEN k > 0 THEN ins[1:k - 1] ELSE ins END AS headers,
    CASE WHEN k > 0 THEN ins[k + 1:] ELSE [] END AS rest FROM blanks),
joined AS (
  SELECT *, CASE WHEN framed
    THEN array_to_string(list_filter(rest, lambda l: NOT (starts_with(l, '=') AND length(l) = 5)), '')
    ELSE replace(replace(replace(t, chr(10), ''), chr(13), ''), ' ', '') END AS body FROM split),
cleaned AS (SELECT *, regexp_replace(body, '[^A-Za-z0-9+/=]', '', 'g') AS clean FROM joined),
data AS (
  SELECT *, CASE WHEN regexp_matches(clean, {_BASE64_SQL}) AND NOT regexp_matches(body, '[^\\x00-\\x7f]')
    THEN replace(regexp_extract(clean, {_BASE64_SQL}), '=', '') END AS chars FROM cleaned),
payloads AS (
  SELECT *, from_base64(rpad(chars, ((length(chars) + 3) // 4 * 4)::INTEGER, '=')) AS payload FROM data),
checked AS (SELECT *, {_crc_sql('payload')} AS crc FROM payloads, shift)"""

_NORMALISED_SQL = f"""
SELECT doc_id, CASE
  WHEN payload IS NULL THEN CASE WHEN framed THEN NULL ELSE body END
  WHEN framed THEN array_to_string(list_concat([ls[b]], headers, ['', {_wrap_sql('body', 76)}, {_line_sql('crc')}, ls[e]]),
    chr(10)) || chr(10)
  ELSE '-----BEGIN PGP PRIVATE KEY BLOCK-----' || chr(10) || chr(10) || {_wrap_sql('body', 76)} || chr(10) ||
    {_line_sql('crc')} || chr(10) || '-----END PGP PRIVATE KEY BLOCK-----' || chr(10) END AS normalised
FROM checked"""

QUERIES = {
    "armor_normalise": (armor_normalise, f"WITH {_SHIFT_SQL}, {_FRAMED_SQL} {_PARSED_SQL} {_NORMALISED_SQL}"),
    "armor_reconstruct": (armor_reconstruct, f"WITH {_SHIFT_SQL}, {_BARE_SQL} {_PARSED_SQL} {_NORMALISED_SQL}"),
    "armor_audit": (armor_audit, f"""WITH {_SHIFT_SQL}, {_FRAMED_SQL} {_PARSED_SQL},
found AS (SELECT *, list_filter(rest, lambda l: starts_with(l, '=') AND length(l) = 5)[1] AS stored,
  CASE WHEN payload IS NOT NULL THEN {_line_sql('crc')} END AS computed FROM checked)
SELECT doc_id, regexp_extract(ls[b], '^-----BEGIN PGP (.*)-----$', 1) AS block_type,
  len(headers)::INTEGER AS header_count, octet_length(payload)::INTEGER AS body_bytes, stored AS stored_crc,
  computed AS computed_crc, (b > 0)::INTEGER AS has_begin, (e > 0)::INTEGER AS has_end,
  (framed AND k = 0)::INTEGER AS no_blank_line, (payload IS NULL)::INTEGER AS bad_body,
  (stored = computed)::INTEGER AS crc_matches FROM found"""),
    "crc24": (crc24_of_texts, f"""WITH {_SHIFT_SQL},
sums AS (SELECT doc_id, {_crc_sql('encode(text)')} AS crc FROM documents, shift)
SELECT doc_id, crc::INTEGER AS crc, {_line_sql('crc')} AS line FROM sums"""),
    "key_listing": (key_listing, f"""WITH lines AS (
  SELECT o_custkey AS key_id, o_orderkey AS line_no,
    CASE WHEN o_orderkey % 5 = 0 THEN md5(o_orderkey::VARCHAR) END AS fpr FROM orders)
SELECT key_id, arg_min(fpr, line_no) FILTER (fpr IS NOT NULL) AS fingerprint,
  CASE WHEN count(fpr) = 0 THEN '{NO_FINGERPRINT}' END AS error FROM lines GROUP BY key_id"""),
}
