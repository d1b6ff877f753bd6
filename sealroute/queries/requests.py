"""Queries on control tables and path values."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealroute.functions.paths import drop_trailing_slashes, first_unsafe, is_bad_key_path, is_safe_path
from sealroute.functions.text import clean_run_id, unwrap_secret
from sealroute.operators.requests import (
    DECRYPT_FIELDS, any_missing, check_encrypt_requests, missing_fields, param, parse_body,
)
from sealroute.queries.landing import WS_SQL, read


def _path_case(key: str, url: str, shift: int = 0):
    """A page address with one of seven endings, some of which climb out of the folder."""
    number = (F.col(key) + shift) % 7
    ending = (
        F.when(number == 0, "/%2e%2e/x").when(number == 1, "/../y").when(number == 2, "/..%252f")
        .when(number == 3, "/a..b").when(number == 4, "\\..").when(number == 5, "/．．/z").otherwise(""))
    return F.concat(F.col(url), ending)


def path_safe(spark, sf):
    value = _path_case("page_id", "url")
    return read(spark, sf, "pages").select(
        "page_id", is_safe_path(value).cast("int").alias("safe"),
        is_safe_path(value, strict=True).cast("int").alias("safe_strict"))


def first_unsafe_folder(spark, sf):
    folders = {
        "source_folder": _path_case("page_id", "url", 3),
        "destination_folder": F.when(F.col("page_id") % 5 == 0, _path_case("page_id", "url")).otherwise(F.col("url")),
        "error_folder": F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/..%5cx"))).otherwise(F.col("url")),
        "archive_folder": F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/.%2e/x"))).otherwise(F.col("url")),
    }
    return read(spark, sf, "pages").select("page_id", first_unsafe(folders).alias("first_unsafe"))


def key_path_check(spark, sf):
    path = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), "url"))
        .when(F.col("page_id") % 5 == 1, F.concat("url", F.lit("/a..b"))).otherwise(F.col("url")))
    return read(spark, sf, "pages").select("page_id", is_bad_key_path(path).cast("int").alias("rejected"))


_BLANKS = ["", " \t", "\xa0\u2003", None]


def _blank_some(key: str, value, modulus: int):
    """The value, replaced by one kind of blank for every ``modulus``-th row."""
    blank = F.get(F.array(*[F.lit(text) for text in _BLANKS]), (F.floor(F.col(key) / modulus) % 4).cast("int"))
    return F.when(F.col(key) % modulus == 0, blank).otherwise(value)


def missing_request_fields(spark, sf):
    values = {
        name: _blank_some("c_custkey", F.concat(F.col("c_name"), F.lit("/" + name)), modulus)
        for name, modulus in zip(DECRYPT_FIELDS, [2, 3, 5, 7, 11])}
    return read(spark, sf, "customer").select("c_custkey", missing_fields(values).alias("missing"))


def encrypt_required(spark, sf):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    slashes = F.repeat(F.lit("/"), (key % 4).cast("int"))
    requests = read(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").alias("storageAccountName"),
        segment.alias("container"),
        F.when(key % 13 == 0, slashes).otherwise(F.concat(F.lit("staging/"), segment, slashes)).alias("tempFolder"),
        F.concat(F.lit("out/"), segment, slashes).alias("outputFolder"),
        F.when(key % 11 != 0, F.lit("keys/a.asc")).alias("pgpKeyPath"),
        F.concat(F.lit("sent/"), slashes).alias("archiveFolder"),
        F.when(key % 7 == 0, "").otherwise(F.lit("errors//x//")).alias("errorFolder"),
        F.lit(None).cast("string").alias("filePrefix"),
        F.lit(None).cast("string").alias("runId"),
    )
    return check_encrypt_requests(requests).select(
        "c_custkey", "tempFolder", "outputFolder", "archiveFolder", "errorFolder",
        F.col("missing").cast("int").alias("missing"))


def run_id_clean(spark, sf):
    run_id = F.concat_ws("-", F.concat(F.lit(" \t"), "event_type"), F.md5(F.col("props")), F.col("user_id").cast("string"))
    return read(spark, sf, "events").select("event_id", clean_run_id(run_id).alias("run_id"))


def secret_unwrap(spark, sf):
    turn, text = F.col("turn"), F.col("text")
    padded = F.concat(F.lit(" \n "), text, F.lit("\r\n　"))
    material = (
        F.when(turn % 4 == 0, padded)
        .when(turn % 4 == 1, F.to_json(F.struct(padded.alias("value"))))
        .when(turn % 4 == 2, F.to_json(F.struct(F.lit("").alias("value"), padded.alias("Value"))))
        .otherwise(F.to_json(F.struct(text.alias("other")))))
    return read(spark, sf, "conversations").select("conv_id", "turn", unwrap_secret(material).alias("secret"))


def param_coalesce(spark, sf):
    key = F.col("event_id")
    body = (
        F.when(key % 5 == 0, "not json").when(key % 5 == 1, '{"k": " \\t "}')
        .when(key % 5 == 2, '["k"]').otherwise(F.col("props")))
    query = F.when(key % 3 == 0, F.concat(F.lit(" \t"), "event_type", F.lit(" \n"))).when(key % 3 == 1, " ")
    requests = read(spark, sf, "events").select("event_id", body.alias("raw"), query.alias("query_k"))
    return parse_body(requests, "raw", ["k"]).select(
        "event_id", param(F.col("body.k"), F.col("query_k")).alias("k"))


def slashes_and_required(spark, sf):
    """Trailing slashes and the all-fields test on raw values of every order."""
    folder = F.concat(F.col("o_orderpriority"), F.repeat(F.lit("/"), (F.col("o_orderkey") % 3).cast("int")))
    stripped = drop_trailing_slashes(F.when(F.col("o_orderkey") % 9 == 0, "//").otherwise(folder))
    fields = {"folder": stripped, "status": F.col("o_orderstatus")}
    return read(spark, sf, "orders").select(
        "o_orderkey", stripped.alias("folder"), any_missing(fields).cast("int").alias("missing"))


_CASES_SQL = """CASE {number} WHEN 0 THEN '/%2e%2e/x' WHEN 1 THEN '/../y' WHEN 2 THEN '/..%252f' WHEN 3 THEN '/a..b'
  WHEN 4 THEN chr(92) || '..' WHEN 5 THEN '/' || chr(65294) || chr(65294) || '/z' ELSE '' END"""


def _raw_unsafe_sql(value: str) -> str:
    patterns = ["'../'", "'.' || chr(92) || chr(92)", "'%2e%2e'", "'%252e'", "'..%2f'", "'..%5c'"]
    return "(" + " OR ".join(f"contains(lower({value}), {pattern})" for pattern in patterns) + ")"


def _climbs_sql(decoded: str) -> str:
    return f"list_contains(string_split(replace({decoded}, chr(92), '/'), '/'), '..')"


def _unsafe_sql(value: str) -> str:
    return f"({_climbs_sql(f'url_decode({value})')} OR {_raw_unsafe_sql(value)})"


def _ascii_sql(value: str) -> str:
    return (f"translate({value}, chr(8228) || chr(65294) || chr(8725) || chr(65295) || chr(65340) || chr(65128), "
            "'..//' || chr(92) || chr(92))")


_BLANKS_SQL = "CASE (c_custkey // {m}) % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) WHEN 2 THEN chr(160) || chr(8195) END"


def _missing_sql() -> str:
    tests = ", ".join(
        f"CASE WHEN c_custkey % {m} = 0 AND coalesce(trim({_BLANKS_SQL.format(m=m)}, {WS_SQL}), '') = '' THEN '{name}' END"
        for name, m in zip(DECRYPT_FIELDS, [2, 3, 5, 7, 11]))
    return f"SELECT c_custkey, nullif(concat_ws(', ', {tests}), '') AS missing FROM customer"


QUERIES = {
    "path_safe": (path_safe, f"""WITH cases AS (
  SELECT page_id, url || {_CASES_SQL.format(number='page_id % 7')} AS v FROM pages),
once AS (SELECT *, {_ascii_sql('url_decode(v)')} AS d1 FROM cases),
twice AS (SELECT *, {_ascii_sql('url_decode(d1)')} AS d2 FROM once),
thrice AS (SELECT *, {_ascii_sql('url_decode(d2)')} AS d3 FROM twice)
SELECT page_id, (NOT {_unsafe_sql('v')})::INTEGER AS safe,
  (NOT ({_raw_unsafe_sql('v')} OR {_climbs_sql('d1')} OR {_climbs_sql('d2')} OR {_climbs_sql('d3')}))::INTEGER
    AS safe_strict
FROM thrice"""),
    "first_unsafe_folder": (first_unsafe_folder, f"""WITH cases AS (
  SELECT page_id, url || {_CASES_SQL.format(number='(page_id + 3) % 7')} AS s,
    CASE WHEN page_id % 5 = 0 THEN url || {_CASES_SQL.format(number='page_id % 7')} ELSE url END AS d,
    CASE WHEN page_id % 3 = 0 THEN url || '/..%5cx' ELSE url END AS e,
    CASE WHEN page_id % 2 = 0 THEN url || '/.%2e/x' ELSE url END AS a FROM pages)
SELECT page_id, CASE WHEN {_unsafe_sql('s')} THEN 'source_folder' WHEN {_unsafe_sql('d')} THEN 'destination_folder'
  WHEN {_unsafe_sql('e')} THEN 'error_folder' WHEN {_unsafe_sql('a')} THEN 'archive_folder' END AS first_unsafe
FROM cases"""),
    "key_path_check": (key_path_check, """WITH cases AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN url || '/a..b' ELSE url END AS p FROM pages)
SELECT page_id, (contains(p, '..') OR starts_with(p, '/'))::INTEGER AS rejected FROM cases"""),
    "missing_fields": (missing_request_fields, _missing_sql()),
    "encrypt_required": (encrypt_required, """WITH cases AS (
  SELECT c_custkey, c_mktsegment AS seg, repeat('/', (c_custkey % 4)::INTEGER) AS sl FROM customer),
stripped AS (
  SELECT c_custkey, rtrim(CASE WHEN c_custkey % 13 = 0 THEN sl ELSE 'staging/' || seg || sl END, '/') AS "tempFolder",
    rtrim('out/' || seg || sl, '/') AS "outputFolder", 'sent/' || sl AS "archiveFolder",
    rtrim(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'errors//x//' END, '/') AS "errorFolder" FROM cases)
SELECT *, ("tempFolder" = '' OR "errorFolder" = '' OR c_custkey % 11 = 0)::INTEGER AS missing FROM stripped"""),
    "trailing_slashes": (slashes_and_required, """WITH cases AS (
  SELECT o_orderkey, o_orderstatus, rtrim(CASE WHEN o_orderkey % 9 = 0 THEN '//'
    ELSE o_orderpriority || repeat('/', (o_orderkey % 3)::INTEGER) END, '/') AS folder FROM orders)
SELECT o_orderkey, folder, (folder = '' OR o_orderstatus IS NULL OR o_orderstatus = '')::INTEGER AS missing FROM cases"""),
    "run_id_clean": (run_id_clean, """SELECT event_id, left(regexp_replace(
  event_type || '-' || md5(props) || '-' || user_id, '[^A-Za-z0-9]', '', 'g'), 20) AS run_id FROM events"""),
    "secret_unwrap": (secret_unwrap, f"""SELECT conv_id, turn,
  CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text, {WS_SQL}) END AS secret FROM conversations"""),
    "param_coalesce": (param_coalesce, f"""WITH cases AS (
  SELECT event_id, CASE WHEN event_id % 5 > 2 THEN nullif(trim(json_extract_string(props, '$.k'), {WS_SQL}), '') END AS b,
    CASE event_id % 3 WHEN 0 THEN event_type END AS q FROM events)
SELECT event_id, coalesce(b, q) AS k FROM cases"""),
}
