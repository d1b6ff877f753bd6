"""Queries that run the codec and the jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealroute.operators.codec import DECRYPT_FAILED, AesProvider
from sealroute.operators.files import accept_batches, batch_totals, staging_pick
from sealroute.operators.keyed import fits_broadcast
from sealroute.operators.requests import check_encrypt_requests, is_bad_json
from sealroute.operators.summary import decrypt_response, encrypt_response, summarise
from sealroute.plans.decrypt_job import check_requests, decrypt_table, settle_requests
from sealroute.plans.encrypt_job import name_outputs, seal_payloads, settle_encrypt
from sealroute.queries.files import joined_lists, stamp
from sealroute.queries.landing import (
    CODE_SQL, LANDING_SQL, RESULTS_SQL, SUMMARY_SQL, key_of, landing, landing_of, payload_landing, read,
    run_keys, with_targets,
)
from sealroute.session import attach, work_folder
from sealroute.streaming.decrypt_stream import stream_files


def unsettled(rows):
    return rows.withColumns({"status": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})


def sealed_landing(files, keys, key_id=None):
    """The landing view as it would arrive: payloads encrypted, some empty, some damaged."""
    rows = unsettled(files.withColumn("key_id", key_of("doc_id") if key_id is None else key_id))
    sealed = AesProvider().encrypt(rows, keys)
    damaged = F.substring("sealed", F.lit(1), F.octet_length("sealed") - 1)
    content = (
        F.when(F.col("length") == 0, F.lit(b"")).when(F.col("corrupt"), damaged).otherwise(F.col("sealed")))
    return sealed.withColumn("content", content).drop("sealed", "status", "message", "corrupt")


def crypt_roundtrip(spark, sf):
    keys = run_keys(spark)
    opened = AesProvider().decrypt(unsettled(sealed_landing(payload_landing(spark, sf), keys)), keys)
    return opened.select(
        "doc_id", "status", "message", F.sha2("plaintext", 256).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("bytes_in"),
        F.octet_length("plaintext").cast("bigint").alias("bytes_out"))


def decrypt_requests(spark, sf, batch: str):
    """A request per batch of the landing view, and one per nation that is faulty or finds nothing."""
    batches = landing(spark, sf).select(F.col(batch).alias("batch")).distinct().select(
        "batch", F.col("batch").alias("source_folder"), F.lit("processed/x").alias("destination_folder"),
        F.lit("errors/x").alias("error_folder"), F.lit("archive/x").alias("archive_folder"),
        F.lit("key0").alias("key_id"))
    key = F.col("n_nationkey")
    nations = read(spark, sf, "nation").select(
        F.col("n_name").alias("batch"),
        F.concat(F.lit("inbound/"), F.lower("n_name")).alias("source_folder"),
        F.when(key % 5 != 0, F.lit("processed/y")).alias("destination_folder"),
        F.when(key % 5 == 1, "errors/%2E%2E/y").otherwise("errors/y").alias("error_folder"),
        F.when(key % 10 == 0, " ").otherwise("archive/y").alias("archive_folder"),
        F.when(key % 5 == 2, "lost").otherwise("key0").alias("key_id"))
    return batches.unionByName(nations).withColumn("file_system_name", F.lit("lake"))


def decrypt_summary(spark, sf, batch: str):
    """The decrypt job on the landing view: a summary row per request."""
    keys = run_keys(spark)
    totals = batch_totals(landing(spark, sf).withColumn("batch", F.col(batch)))
    files = payload_landing(spark, sf).withColumn("batch", F.col(batch))
    results = decrypt_table(
        with_targets(sealed_landing(files, keys)), keys, AesProvider(), stamp())
    checked = check_requests(decrypt_requests(spark, sf, batch), keys)
    return settle_requests(checked, totals, results)


def decrypt_job(spark, sf):
    return joined_lists(decrypt_summary(spark, sf, "batch"))


def decrypt_status(spark, sf):
    return decrypt_summary(spark, sf, "folder").select("batch", "total", "code", "message")


def decrypt_replies(spark, sf):
    return decrypt_response(decrypt_summary(spark, sf, "batch"))


def encrypt_states(spark, sf):
    """An encrypt request per customer, in every terminal state a request can reach."""
    key = F.col("c_custkey")
    requests = read(spark, sf, "customer").select(
        key.alias("request_id"),
        is_bad_json(F.when(key % 17 == 0, '{"tempFolder": ').otherwise(F.to_json(F.struct("c_name")))).alias("bad_json"),
        F.lit("store").alias("storageAccountName"),
        F.lit("lake").alias("container"),
        F.concat(F.lit("staging/"), F.col("c_name"), F.lit("/")).alias("tempFolder"),
        F.when(key % 13 == 0, "//").otherwise("out").alias("outputFolder"),
        F.when(key % 11 == 0, "/keys/a.asc").otherwise("keys/a.asc").alias("pgpKeyPath"),
        F.lit("sent").alias("archiveFolder"),
        F.lit("errors").alias("errorFolder"),
        F.lit(None).cast("string").alias("filePrefix"),
        F.col("c_name").alias("runId"),
        F.when(key % 19 == 0, F.repeat("c_name", 40)).alias("setup_error"),
        F.when(key % 23 == 0, "disk full").alias("write_error"),
    )
    staged = landing(spark, sf).withColumn("request_id", F.floor(F.col("doc_id") / 2)).drop("content")
    picks = staging_pick(staged, carry=["corrupt"]).select("request_id", "picked.*")
    rows = name_outputs(check_encrypt_requests(requests), stamp()).join(picks, "request_id", "left")
    status = F.when(F.col("length") == 0, "empty").when(F.col("corrupt"), "error").otherwise("ok")
    sizes = {
        "status": F.when(F.col("path").isNotNull(), status),
        "originalSize": F.col("length"), "encryptedSize": F.col("length") + 28}
    return settle_encrypt(rows.withColumns(sizes))


def encrypt_status(spark, sf):
    return encrypt_states(spark, sf).select("request_id", "code", "status", "message", "tempFolder")


def encrypt_replies(spark, sf):
    return encrypt_response(encrypt_states(spark, sf))


def staged_requests(spark, sf):
    """Staged files by request, and an encrypt request for each; some hold system files only."""
    request = F.concat(F.col("source"), F.lit("/"), F.expr("doc_id div 60").cast("string"))
    files = payload_landing(spark, sf).withColumn("request_id", request).withColumn("path", F.concat(
        F.lit("staging/"), "request_id", F.lit("/"), F.substring_index("path", "/", -1)))
    requests = landing(spark, sf).select(request.alias("request_id"), "source").distinct().select(
        "request_id", F.lit(False).alias("bad_json"), F.lit("store").alias("storageAccountName"),
        F.lit("lake").alias("container"), F.concat(F.lit("staging/"), F.col("request_id")).alias("tempFolder"),
        F.concat(F.lit("out/"), F.col("request_id"), F.lit("/")).alias("outputFolder"),
        F.lit("keys/a.asc").alias("pgpKeyPath"), F.concat(F.lit("sent/"), F.col("request_id")).alias("archiveFolder"),
        F.lit("errors").alias("errorFolder"), F.concat("source", F.lit("_")).alias("filePrefix"),
        F.lit(None).cast("string").alias("runId"))
    return files, requests


def encrypt_result(spark, sf):
    keys = run_keys(spark)
    files, requests = staged_requests(spark, sf)
    # The listing's length is left out here, as it would cost another pass over the texts.
    listed = files.drop("content").withColumn("length", F.lit(None).cast("bigint"))
    picks = staging_pick(listed).select("request_id", "picked.path").filter(F.col("path").isNotNull())
    payloads = files.select("path", "content", "doc_id")
    # Few picks are broadcast, so that the payloads stay where they are.
    found = payloads.join(F.broadcast(picks) if fits_broadcast(picks) else picks, "path")
    sealed = seal_payloads(unsettled(found.withColumn("key_id", key_of("doc_id"))), keys, AesProvider()).drop(
        "content", "sealed")
    rows = name_outputs(check_encrypt_requests(requests), stamp()).join(sealed, "request_id", "left")
    no_error = F.lit(None).cast("string")
    return settle_encrypt(rows.withColumns({"setup_error": no_error, "write_error": no_error}))


def stream_summary(spark, sf):
    attach(spark)
    keys = run_keys(spark)
    folder = work_folder(spark, "stream")
    # As a pattern, the name may be that of one file or of a folder of part files.
    stream = spark.readStream.schema(read(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    files = with_targets(sealed_landing(landing_of(stream), keys))
    stream_files(files, keys, AesProvider(), stamp(), folder).awaitTermination()
    results = spark.read.parquet(f"{folder}/results")
    return joined_lists(summarise(accept_batches(results, batch_totals(results))))


_REQUESTS_SQL = """
faulty AS (
  SELECT n_name AS batch,
    CASE WHEN n_nationkey % 5 = 0 THEN 400 WHEN n_nationkey % 5 = 1 THEN 400 WHEN n_nationkey % 5 = 2 THEN 500
      ELSE 200 END AS code,
    CASE WHEN n_nationkey % 10 = 0 THEN 'Missing required parameters: destination_folder, archive_folder'
      WHEN n_nationkey % 5 = 0 THEN 'Missing required parameters: destination_folder'
      WHEN n_nationkey % 5 = 1 THEN 'Invalid path (path traversal not allowed): error_folder'
      WHEN n_nationkey % 5 = 2
        THEN 'Failed to retrieve PGP credentials from the key store. Check permissions and secret names.'
      ELSE 'No files found in source folder: inbound/' || lower(n_name) END AS message FROM nation)"""

_TOO_MANY_SQL = "'Too many files in source folder (' || total || '). Maximum allowed: 500'"

_ENCRYPT_STATES_SQL = f"""{LANDING_SQL},
ranked AS (
  SELECT doc_id // 2 AS request_id, length, corrupt,
    row_number() OVER (PARTITION BY doc_id // 2 ORDER BY path DESC) AS r
  FROM landing WHERE NOT starts_with(file_name, '_')),
raw AS (
  SELECT c_custkey AS request_id, c_name, length,
    CASE WHEN c_custkey % 17 = 0 THEN 'json' WHEN c_custkey % 13 = 0 THEN 'missing'
    WHEN c_custkey % 11 = 0 THEN 'key' WHEN c_custkey % 19 = 0 THEN 'SETUP_FAILED' WHEN r IS NULL THEN 'NO_FILE'
    WHEN length = 0 THEN 'EMPTY_FILE' WHEN corrupt THEN 'ENCRYPTION_FAILED'
    WHEN c_custkey % 23 = 0 THEN 'POST_ENCRYPT_FAILED' ELSE 'SUCCESS' END AS state
  FROM customer LEFT JOIN ranked ON request_id = c_custkey AND r = 1),
states AS (
SELECT request_id, c_name, length,
  CASE state WHEN 'json' THEN 400 WHEN 'missing' THEN 400 WHEN 'key' THEN 400 WHEN 'NO_FILE' THEN 404
    WHEN 'EMPTY_FILE' THEN 422 WHEN 'SUCCESS' THEN 200 ELSE 500 END AS code,
  CASE WHEN state NOT IN ('json', 'missing', 'key') THEN state END AS status,
  CASE state WHEN 'json' THEN 'Invalid JSON body'
    WHEN 'missing' THEN 'Missing required parameters: storageAccountName, container, tempFolder, outputFolder, ' ||
      'archiveFolder, pgpKeyPath, errorFolder are all required.'
    WHEN 'key' THEN 'Invalid pgpKeyPath: path traversal not permitted.'
    WHEN 'SETUP_FAILED' THEN 'Could not connect to storage or locate required files: ' || left(repeat(c_name, 40), 400)
    WHEN 'NO_FILE' THEN 'No staging file found in temp folder.'
    WHEN 'EMPTY_FILE' THEN 'Staging file is empty — no payload to encrypt.'
    WHEN 'ENCRYPTION_FAILED' THEN 'Encryption process failed. Check error log for details.'
    WHEN 'POST_ENCRYPT_FAILED' THEN 'Encryption succeeded but writing output or archiving failed. ' ||
      'Verify if encrypted file already exists before retrying.'
    ELSE 'File encrypted and archived successfully.' END AS message,
  CASE WHEN state NOT IN ('json', 'missing', 'key', 'SUCCESS') THEN 'staging/' || c_name END AS "tempFolder"
FROM raw)"""

CAPPED_SQL = f"""batch, total, CASE WHEN total > 500 THEN 0 ELSE ok END AS ok, CASE WHEN total > 500 THEN 0 ELSE failed END
    AS failed, CASE WHEN total > 500 THEN 0 ELSE skipped END AS skipped,
    CASE WHEN total > 500 THEN '' ELSE processed_files END AS processed_files,
    CASE WHEN total > 500 THEN '' ELSE skipped_files END AS skipped_files,
    CASE WHEN total > 500 THEN '' ELSE error_files END AS error_files,
    CASE WHEN total > 500 THEN {_TOO_MANY_SQL} END AS message,
    CASE WHEN total > 500 THEN 400 ELSE {CODE_SQL} END AS code"""

ENCRYPT_RESULT_SQL = f"""WITH {LANDING_SQL},
staged AS (SELECT source || '/' || (doc_id // 60) AS request_id, source, file_name, length,
  NOT starts_with(file_name, '_') AS data FROM landing),
picked AS (SELECT request_id, source, count(*) FILTER (data) AS n, arg_max(length, file_name) FILTER (data) AS size
  FROM staged GROUP BY request_id, source),
states AS (SELECT *, CASE WHEN n = 0 THEN 'NO_FILE' WHEN size = 0 THEN 'EMPTY_FILE' ELSE 'SUCCESS' END AS status,
  n > 0 AND size > 0 AS done, source || '_20260417143015.csv' AS plain FROM picked)
SELECT request_id, status, CASE status WHEN 'NO_FILE' THEN 'No staging file found in temp folder.'
    WHEN 'EMPTY_FILE' THEN 'Staging file is empty — no payload to encrypt.'
    ELSE 'File encrypted and archived successfully.' END AS message,
  CASE WHEN done THEN plain || '.pgp' END AS "outputFileName",
  CASE WHEN done THEN 'out/' || request_id || '/' || plain || '.pgp' END AS "outputPath",
  CASE WHEN done THEN plain END AS "archivedFileName",
  CASE WHEN done THEN 'sent/' || request_id || '/2026/04/17/' || plain END AS "archivedPath",
  CASE WHEN done THEN size END AS "originalSize", CASE WHEN done THEN size + 28 END AS "encryptedSize",
  CASE WHEN NOT done THEN 'staging/' || request_id END AS "tempFolder", '' AS "runId",
  CASE status WHEN 'NO_FILE' THEN 404 WHEN 'EMPTY_FILE' THEN 422 ELSE 200 END AS code FROM states"""

QUERIES = {
    "crypt_roundtrip": (crypt_roundtrip, f"""WITH {LANDING_SQL}
SELECT doc_id, CASE WHEN corrupt OR length = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN corrupt OR length = 0 THEN '{DECRYPT_FAILED}' ELSE '' END AS message,
  CASE WHEN NOT corrupt AND length > 0 THEN sha256(content) END AS sha256,
  CASE WHEN length = 0 THEN 0 WHEN corrupt THEN length + 27 ELSE length + 28 END AS bytes_in,
  CASE WHEN NOT corrupt AND length > 0 THEN length END AS bytes_out FROM landing"""),
    "decrypt_job": (decrypt_job, f"""WITH {RESULTS_SQL}, {SUMMARY_SQL}, {_REQUESTS_SQL},
capped AS (SELECT {CAPPED_SQL} FROM summary)
SELECT * FROM capped UNION ALL BY NAME
SELECT batch, 0 AS total, 0 AS ok, 0 AS failed, 0 AS skipped, '' AS processed_files, '' AS skipped_files,
  '' AS error_files, message, code FROM faulty"""),
    "decrypt_response": (decrypt_replies, f"""WITH {RESULTS_SQL}, {_REQUESTS_SQL},
entries AS (SELECT *, CASE WHEN message = '' THEN name ELSE name || ': ' || message END AS entry FROM results),
lists AS (
  SELECT batch, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
    count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    coalesce(list(name ORDER BY name) FILTER (status = 'ok'), []) AS processed_files,
    coalesce(list(name ORDER BY name) FILTER (status = 'skipped'), []) AS skipped_files,
    coalesce(list(entry ORDER BY entry) FILTER (status = 'error'), []) AS error_files FROM entries GROUP BY batch)
SELECT batch, CASE WHEN total > 500 THEN 400 ELSE {CODE_SQL} END AS code, CASE WHEN total > 500 THEN {_TOO_MANY_SQL}
  ELSE to_json({{'total': total, 'ok': ok, 'failed': failed, 'skipped': skipped, 'processed_files': processed_files,
    'skipped_files': skipped_files, 'error_files': error_files}})::VARCHAR END AS body FROM lists
UNION ALL BY NAME
SELECT batch, code, CASE WHEN code = 200 THEN to_json({{'total': 0, 'ok': 0, 'failed': 0, 'skipped': 0,
  'processed_files': []::VARCHAR[], 'skipped_files': []::VARCHAR[], 'error_files': []::VARCHAR[],
  'message': message}})::VARCHAR ELSE message END AS body FROM faulty"""),
    "decrypt_status": (decrypt_status, f"""WITH {RESULTS_SQL}, {_REQUESTS_SQL},
counted AS (SELECT folder AS batch, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'error') AS failed FROM results GROUP BY folder)
SELECT batch, total, CASE WHEN total > 500 THEN 400 ELSE {CODE_SQL} END AS code,
  CASE WHEN total > 500 THEN {_TOO_MANY_SQL} END AS message FROM counted
UNION ALL BY NAME SELECT batch, 0 AS total, code, message FROM faulty"""),
    "encrypt_status": (encrypt_status, f"""WITH {_ENCRYPT_STATES_SQL}
SELECT request_id, code, status, message, "tempFolder" FROM states"""),
    "encrypt_response": (encrypt_replies, f"""WITH {_ENCRYPT_STATES_SQL},
sized AS (SELECT *, 'data_encrypted_20260417143015.csv' AS plain FROM states)
SELECT request_id, code, CASE WHEN status IS NULL THEN message WHEN status = 'SUCCESS' THEN
  to_json({{'status': status, 'message': message, 'outputFileName': plain || '.pgp', 'outputPath': 'out/' || plain || '.pgp',
    'archivedFileName': plain, 'archivedPath': 'sent/2026/04/17/' || plain, 'originalSize': length,
    'encryptedSize': length + 28}})::VARCHAR
  ELSE to_json({{'status': status, 'message': message, 'outputFileName': NULL, 'tempFolder': 'staging/' || c_name}})::VARCHAR
  END AS body FROM sized"""),
    "encrypt_result": (encrypt_result, ENCRYPT_RESULT_SQL),
    "stream_summary": (stream_summary, f"""WITH {RESULTS_SQL}, {SUMMARY_SQL}
SELECT *, {CODE_SQL} AS code FROM summary WHERE total <= 500"""),
}
