"""Queries on real files: the given table files themselves, or documents written to a work folder."""

from __future__ import annotations

import secrets
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.operators.codec import DECRYPT_FAILED, AesProvider, payload_partitions
from sealroute.plans.decrypt_job import decrypt_files, open_files, route_files
from sealroute.plans.encrypt_job import encrypt_files
from sealroute.queries.files import STAMP, joined_lists
from sealroute.queries.jobs import CAPPED_SQL, ENCRYPT_RESULT_SQL, sealed_landing, staged_requests, unsettled
from sealroute.queries.landing import LANDING_SQL, SUMMARY_SQL, landing, payload_landing, read, run_keys
from sealroute.session import attach, keep, work_folder
from sealroute.sources.commit import save_files
from sealroute.sources.dated import DAY, load_days
from sealroute.sources.landing import list_folders
from sealroute.sources.payloads import read_payload
from sealroute.sources.tree import delete_tree, list_tree, name_pages
from sealroute.streaming.decrypt_stream import stream_folders

AT = datetime.fromisoformat(STAMP).replace(tzinfo=timezone.utc)
# Files and folders that a round of ``encrypt_outputs`` has at most, about 4.8 KB each, and those of a request beside its staged files.
ROUND_ENTRIES, REQUEST_ENTRIES = 4_000_000, 12


@contextmanager
def scratch(spark, name):
    """A folder for files that hold plain texts; it goes when the query has its rows, or fails."""
    root = work_folder(attach(spark), name)
    try:
        yield root
    finally:
        delete_tree(spark, root)


def kept(spark, rows):
    return keep(rows, work_folder(spark, "query"), "rows")


def found_below(spark, root, folders, temporary=False):
    """The listing of the trees below some folders of a store, in rounds of tasks; a tree is never one task's."""
    named = spark.createDataFrame([(root, folder) for folder in folders], "root string, folder string")
    return list_tree(named, "folder", temporary=temporary).where("path is not null")


def open_listed(spark, listed):
    """The listed files, opened in tasks. The listing is written once, as its size says how many tasks there are."""
    files = keep(listed, work_folder(spark, "listed"), "files")
    return read_payload(unsettled(files.repartition(payload_partitions(files), "path")))


def landed_documents(spark, sf, root):
    """The documents as files below ``root``, in a folder per batch; the batches as requests."""
    files = payload_landing(spark, sf).withColumn("path", F.concat("batch", F.lit("/"), F.substring_index("path", "/", -1)))
    save_files(files.select("path", "content"), root)
    return landing(spark, sf).select("batch").distinct().withColumn("root", F.lit(root))


def folder_scan(spark, sf):
    """The listing of every batch's folder, empty and system files included."""
    with scratch(spark, "scan") as root:
        return kept(spark, list_folders(landed_documents(spark, sf, root), "batch").select("batch", "name", "length"))


def job_commits(spark, sf):
    with scratch(spark, "commits") as root:
        return kept(spark, _job_commits(spark, sf, root))


def _job_commits(spark, sf, root):
    """What lies in a folder after three jobs: all documents, new content for a third of them, and a job of which one
    row fails. Staged files that a job left behind would be rows too."""
    files = payload_landing(spark, sf).withColumn("path", F.concat("batch", F.lit("/"), F.substring_index("path", "/", -1)))
    save_files(files.select("path", "content"), root)
    newer = files.where("doc_id % 3 = 0").withColumn("content", F.concat(F.lit(b"new "), "content"))
    save_files(newer.select("path", "content"), root)
    last = files.agg(F.max("doc_id")).first()[0]
    failing = files.select("path", F.when(F.col("doc_id") != last, b"of the failed job").alias("content"))
    try:
        save_files(failing, root)
    except PySparkException:
        pass
    else:
        raise RuntimeError("a job with a row without content has succeeded")
    return open_listed(spark, found_below(spark, root, [""], temporary=True)).select(
        F.ltrim("path", F.lit("/")).alias("path"), F.sha2("content", 256).alias("sha256"))


def tree_scan(spark, sf):
    """The listing of a tree with a deep branch, a wide level and one flat folder, in small shares and, as of a store
    that lists by name, in ranges of names."""
    with scratch(spark, "tree") as root:
        files = payload_landing(spark, sf)
        deep = F.concat(F.lit("deep"), F.repeat(F.lit("/down"), F.expr("cast(doc_id div 3 % 40 as int)")))
        place = F.when(F.col("doc_id") % 3 == 0, deep).when(
            F.col("doc_id") % 3 == 1, F.concat(F.lit("wide/"), F.expr("doc_id % 50").cast("string"))).otherwise(F.lit("flat"))
        name = F.substring_index("path", "/", -1)
        save_files(files.select(F.concat(place, F.lit("/"), name).alias("path"), "content"), root)
        folder = spark.createDataFrame([(root, "")], "root string, folder string")
        levels = list_tree(folder, "folder", share=200, folders=4)
        ranges = list_tree(folder, "folder", share=200, folders=4, page=50, pages=name_pages)
        found = levels.withColumn("way", F.lit("levels")).unionAll(ranges.withColumn("way", F.lit("ranges")))
        return kept(spark, found.select(
            "way", F.ltrim("path", F.lit("/")).alias("path"), "name", "length", "listing_error", "storage_error"))


def payload_read(spark, sf):
    """Every file of every batch's folder, opened in tasks."""
    with scratch(spark, "read") as root:
        read = open_listed(spark, list_folders(landed_documents(spark, sf, root), "batch"))
        return kept(spark, read.select("batch", "name", F.sha2("content", 256).alias("sha256"), "message"))


def _files_below(spark, root, folders):
    """Every file below the folders of a store: its path and the hash of what it holds."""
    return open_listed(spark, found_below(spark, root, folders)).select("path", F.sha2("content", 256).alias("sha256"))


def decrypt_outputs(spark, sf):
    with scratch(spark, "outputs") as base:
        return kept(spark, _decrypt_outputs(spark, sf, base))


def _decrypt_outputs(spark, sf, base):
    """What a decrypt run leaves behind: two stores whose requests share destination, error and archive folder.

    Files of several requests of a store meet under one name in each of the three folders; the other store has the
    same names. Hashes are those of the plain text, so a quarantined or archived file is opened first.
    """
    keys = run_keys(spark)
    key_id = F.lit("key0")
    store, name = F.expr("doc_id % 2").cast("string"), F.concat(F.lit("part_"), F.expr("doc_id div 8").cast("string"))
    files = sealed_landing(payload_landing(spark, sf), keys, key_id).withColumns({
        "store": store, "folder": F.concat(F.lit("in/"), F.expr("doc_id % 8 div 2").cast("string"))})
    ends = F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(".csv.pgp")
    files = files.withColumn("file", F.concat("folder", F.lit("/"), name, ends)).select("store", "folder", "file", "content")
    stored = files.select(F.concat("store", F.lit("/"), "file").alias("path"), "content")
    save_files(stored, base)
    requests = landing(spark, sf).select(store.alias("store"), F.concat(
        F.lit("in/"), F.expr("doc_id % 8 div 2").cast("string")).alias("source_folder")).distinct().select(
        F.concat_ws(":", "store", "source_folder").alias("batch"), F.concat(F.lit(f"{base}/"), "store").alias("root"),
        key_id.alias("key_id"), F.lit("lake").alias("file_system_name"), "source_folder",
        F.lit("processed").alias("destination_folder"), F.lit("errors").alias("error_folder"),
        F.lit("archive").alias("archive_folder"))
    decrypt_files(requests, keys, AesProvider(), at=AT, cap=None)
    found = _files_below(spark, base, ["0", "1"])
    parts = F.split("path", "/")
    return found.select(
        F.element_at(parts, 1).alias("store"), F.element_at(parts, 2).alias("folder"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[0-9a-f]{16}$", "").alias("name"),
        F.when(F.element_at(parts, 2) == "processed", F.col("sha256")).alias("sha256"))


def encrypt_errors(spark, sf):
    with scratch(spark, "failing") as root:
        return kept(spark, _encrypt_errors(spark, sf, root))


def _encrypt_errors(spark, sf, root):
    """Encrypt requests that really fail: no key, a key that is no text, an output that cannot be written.

    Returns the record of each request with the error that its log file holds.
    """
    files, requests = staged_requests(spark, sf)
    save_files(files.select("path", "content"), root)
    number = F.substring_index("request_id", "/", -1).cast("bigint") % 4
    made = spark.createDataFrame(
        [("keys/a.asc", secrets.token_hex(16).encode()), ("keys/bad.asc", b"\xff\xfe"), ("blocked", b"a file, not a folder")],
        "path string, content binary")
    save_files(made, root)
    long = "keys/" + "missing" * 60 + ".asc"
    failing = requests.withColumns({
        "root": F.lit(root), "errorFolder": F.lit("errors"),
        "pgpKeyPath": F.when(number == 1, "keys/bad.asc").when(number == 2, long).otherwise(F.col("pgpKeyPath")),
        "outputFolder": F.when(number == 3, F.concat(F.lit("blocked/"), "request_id")).otherwise(F.col("outputFolder"))})
    results = encrypt_files(failing, AesProvider(), at=AT).results
    texts = open_listed(spark, found_below(spark, root, ["errors"])).select(F.col("content").cast("string").alias("log"))
    logged = texts.select(F.regexp_extract("log", "TempFolder: staging/(.*)\n", 1).alias("of"),
                          F.contains("log", F.lit("+00:00\nError: ")).cast("int").alias("logged"))
    rows = results.join(logged, F.col("request_id") == F.col("of"), "left")
    # The texts of the operating system differ; their length shows that none is cut before the reply's own limit.
    return rows.select("request_id", "status", "code", F.regexp_extract("message", "^[^:]*", 0).alias("message"),
                       (F.length("message") > 400).cast("int").alias("long"),
                       F.coalesce("logged", F.lit(0)).alias("logged"))


def encrypt_outputs(spark, sf):
    """What the encrypt job leaves, in rounds of whole requests, so that the scratch disk holds a bounded number of files.

    Every request is in one round. A round's files are made, the job runs on its requests, all that it leaves is read,
    and its folder goes before the next round.
    """
    files, requests = staged_requests(spark, sf)
    folder = work_folder(attach(spark), "query")
    requests = keep(requests, folder, "requests")
    entries = files.select("doc_id").count() + REQUEST_ENTRIES * requests.count()
    rounds = max(1, -(-entries // ROUND_ENTRIES))
    found = []
    for number in range(rounds):
        chosen = F.pmod(F.xxhash64("request_id"), F.lit(rounds)) == number
        with scratch(spark, "replaced") as root:
            found.append(keep(_encrypt_outputs(spark, files.where(chosen), requests.where(chosen), root), folder, f"rows-{number}"))
    return reduce(DataFrame.unionAll, found)


def _encrypt_outputs(spark, files, requests, root):
    """What an encrypt run leaves in folders that were not empty: requests with several staged files, some in a folder
    below, system files beside them, an older output, and a file below the output folder.

    An output's hash is that of its plain text, so it is opened first.
    """
    below = F.regexp_replace("path", "/([^/]*)$", "/deep/$1")
    staged = files.select(F.when(F.col("doc_id") % 5 == 0, below).otherwise(F.col("path")).alias("path"), "content")
    old = [requests.select(F.concat(F.lit("out/"), "request_id", F.lit(name)).alias("path"), F.lit(text).alias("content"))
           for name, text in (("/old.csv.pgp", b"old"), ("/keep/deep.txt", b"deep"))]
    secret = secrets.token_hex(16)
    key = spark.createDataFrame([("keys/a.asc", secret.encode())], "path string, content binary")
    cores = spark.sparkContext.defaultParallelism
    for rows in (staged, *(one.repartition(cores, "path") for one in old), key):
        save_files(rows, root)
    encrypt_files(requests.withColumn("root", F.lit(root)), AesProvider(), at=AT)
    read = open_listed(spark, found_below(spark, root, ["staging", "out", "sent"])).withColumn("key_id", F.lit("a"))
    plain = AesProvider().decrypt(read, spark.createDataFrame([("a", secret)], "key_id string, material string"))
    return plain.select("path", "length", F.sha2(F.coalesce("plaintext", "content"), 256).alias("sha256"))


def encrypt_on_files(spark, sf):
    """The encrypt job on the documents, staged per request as files."""
    with scratch(spark, "staging") as root:
        files, requests = staged_requests(spark, sf)
        save_files(files.select("path", "content"), root)
        key = spark.createDataFrame([("keys/a.asc", secrets.token_hex(16).encode())], "path string, content binary")
        save_files(key, root)
        return encrypt_files(requests.withColumn("root", F.lit(root)), AesProvider(), at=AT).results


def landed_batches(spark, sf, root, keys):
    """The sealed documents as files below ``root``, in a landing folder per batch; a decrypt request for each."""
    key_id = F.lit("key0")
    sealed = sealed_landing(payload_landing(spark, sf), keys, key_id)
    landed = F.concat("batch", F.lit("/"), F.substring_index("path", "/", -1))
    save_files(sealed.select(landed.alias("path"), "content"), root)
    targets = {"destination_folder": "processed/", "error_folder": "errors/", "archive_folder": "archive/"}
    return landing(spark, sf).select("batch").distinct().select(
        "batch", F.lit(root).alias("root"), key_id.alias("key_id"), F.lit("lake").alias("file_system_name"),
        F.col("batch").alias("source_folder"),
        *[F.concat(F.lit(prefix), "batch").alias(name) for name, prefix in targets.items()])


def decrypt_on_files(spark, sf):
    """The decrypt job on the sealed documents, put into a landing folder per batch as files."""
    keys = run_keys(spark)
    with scratch(spark, "landing") as root:
        return joined_lists(decrypt_files(landed_batches(spark, sf, root, keys), keys, AesProvider(), at=AT).summary)


def decrypt_resume(spark, sf):
    """The summary of a run that is broken off when half of its files were moved, and finished by the next call.

    Files that arrive in between belong to the run after it."""
    keys, journal = run_keys(spark), work_folder(attach(spark), "journal")
    with scratch(spark, "resumed") as root:
        requests = landed_batches(spark, sf, root, keys)
        opened = open_files(requests, keys, AesProvider(), at=AT, journal=journal)
        half = replace(opened, results=opened.results.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0))
        route_files(half).write.format("noop").mode("overwrite").save()
        late = requests.select(F.concat("batch", F.lit("/late.csv.pgp")).alias("path"), F.lit(b"late").alias("content"))
        save_files(late.repartition(spark.sparkContext.defaultParallelism, "path"), root)
        return joined_lists(decrypt_files(requests, keys, AesProvider(), journal=journal).summary)


def dated_loads(spark, sf):
    """Events archived by their day, then a load of some events of some days, twice: those days alone are replaced."""
    with scratch(spark, "dated") as root:
        rows = read(spark, sf, "events").select("event_id", "ts", "event_type", F.lit(1).alias("load"))
        load_days(rows, f"{root}/events", F.col("ts"))
        late = rows.where("day(ts) % 7 = 0 and event_id % 2 = 0").withColumns({"event_type": F.lit("late"), "load": F.lit(2)})
        for _ in range(2):
            load_days(late, f"{root}/events", F.col("ts"))
        schema = "event_id bigint, event_type string, load int, " + ", ".join(f"{name} string" for name in DAY)
        return kept(spark, spark.read.schema(schema).parquet(f"{root}/events"))


def stream_polls(spark, sf):
    """The same files found and decrypted by a stream that polls the folders of standing requests."""
    keys, folder = run_keys(spark), work_folder(attach(spark), "polls")
    with scratch(spark, "polled") as root:
        stream_folders(landed_batches(spark, sf, root, keys), keys, AesProvider(), folder, at=AT).awaitTermination()
    return joined_lists(spark.read.parquet(f"{folder}/summary").drop("epoch"))


ENCRYPT_OUTPUTS_SQL = f"""WITH {LANDING_SQL},
staged AS (SELECT source || '/' || (doc_id // 60) AS request_id, source, length, sha256(content) AS sha256,
  CASE WHEN doc_id % 5 = 0 THEN 'deep/' ELSE '' END || file_name AS name, NOT starts_with(file_name, '_') AS data FROM landing),
picked AS (SELECT request_id, source, arg_max(name, name) FILTER (data) AS pick, arg_max(length, name) FILTER (data) AS size,
    arg_max(sha256, name) FILTER (data) AS hash FROM staged GROUP BY request_id, source),
states AS (SELECT *, coalesce(size, 0) > 0 AS done FROM picked)
SELECT 'staging/' || request_id || '/' || name AS path, length, sha256 FROM staged JOIN states USING (request_id)
  WHERE NOT done OR (data AND name <> pick)
UNION ALL SELECT 'out/' || request_id || '/keep/deep.txt', 4, sha256('deep') FROM states
UNION ALL SELECT 'out/' || request_id || '/old.csv.pgp', 3, sha256('old') FROM states WHERE NOT done
UNION ALL SELECT 'out/' || request_id || '/' || source || '_20260417143015.csv.pgp', size + 28, hash FROM states WHERE done
UNION ALL SELECT 'sent/' || request_id || '/2026/04/17/' || source || '_20260417143015.csv', size, hash FROM states WHERE done"""

ENCRYPT_ERRORS_SQL = f"""WITH {LANDING_SQL},
staged AS (SELECT source || '/' || (doc_id // 60) AS request_id, doc_id // 60 % 4 AS kind, file_name, length,
  NOT starts_with(file_name, '_') AS data FROM landing),
picked AS (SELECT request_id, kind, count(*) FILTER (data) AS n, arg_max(length, file_name) FILTER (data) AS size
  FROM staged GROUP BY request_id, kind),
states AS (SELECT request_id, kind, CASE WHEN kind IN (1, 2) THEN 'SETUP_FAILED' WHEN n = 0 THEN 'NO_FILE'
  WHEN size = 0 THEN 'EMPTY_FILE' WHEN kind = 3 THEN 'POST_ENCRYPT_FAILED' ELSE 'SUCCESS' END AS status FROM picked)
SELECT request_id, status,
  CASE status WHEN 'NO_FILE' THEN 404 WHEN 'EMPTY_FILE' THEN 422 WHEN 'SUCCESS' THEN 200 ELSE 500 END AS code,
  CASE status WHEN 'SETUP_FAILED' THEN 'Could not connect to storage or locate required files'
    WHEN 'NO_FILE' THEN 'No staging file found in temp folder.'
    WHEN 'EMPTY_FILE' THEN 'Staging file is empty — no payload to encrypt.'
    WHEN 'POST_ENCRYPT_FAILED' THEN 'Encryption succeeded but writing output or archiving failed. ' ||
      'Verify if encrypted file already exists before retrying.'
    ELSE 'File encrypted and archived successfully.' END AS message,
  (kind = 2)::INTEGER AS long, (status = 'POST_ENCRYPT_FAILED')::INTEGER AS logged FROM states"""

DECRYPT_SQL = f"""WITH {LANDING_SQL},
sealed AS (SELECT *, file_name AS name FROM landing),
results AS (
  SELECT batch, name,
    CASE WHEN lower(name) NOT LIKE '%.pgp' THEN 'skipped' WHEN corrupt OR length = 0 THEN 'error' ELSE 'ok' END
      AS status,
    CASE WHEN lower(name) NOT LIKE '%.pgp' THEN 'file does not have .pgp extension'
      WHEN corrupt OR length = 0 THEN '{DECRYPT_FAILED}' ELSE '' END AS message FROM sealed), {SUMMARY_SQL}
SELECT {CAPPED_SQL} FROM summary"""

QUERIES = {
    "folder_scan": (folder_scan, f"""WITH {LANDING_SQL}
SELECT batch, file_name AS name, length FROM landing"""),
    "job_commits": (job_commits, f"""WITH {LANDING_SQL}
SELECT batch || '/' || file_name AS path,
  sha256(CASE WHEN doc_id % 3 = 0 THEN 'new '::BLOB || content ELSE content END) AS sha256 FROM landing"""),
    "tree_scan": (tree_scan, f"""WITH {LANDING_SQL},
placed AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'deep' || repeat('/down', (doc_id // 3 % 40)::INTEGER) WHEN 1 THEN 'wide/' || (doc_id % 50)
    ELSE 'flat' END || '/' || file_name AS path, file_name AS name, length FROM landing)
SELECT way, path, name, length, NULL::VARCHAR AS listing_error, NULL::VARCHAR AS storage_error
FROM placed, (VALUES ('levels'), ('ranges')) AS ways(way)"""),
    "payload_read": (payload_read, f"""WITH {LANDING_SQL}
SELECT batch, file_name AS name, sha256(content) AS sha256, NULL::VARCHAR AS message FROM landing"""),
    "decrypt_outputs": (decrypt_outputs, f"""WITH {LANDING_SQL},
files AS (
  SELECT doc_id % 2 AS store, 'part_' || (doc_id // 8) AS stem, doc_id % 8 // 2 AS folder, content,
    CASE WHEN doc_id % 7 = 0 THEN '.pdf' ELSE '.csv.pgp' END AS ending,
    doc_id % 7 <> 0 AND length > 0 AND NOT corrupt AS good FROM landing),
written AS (
  SELECT store, stem, arg_max(content, folder) AS content FROM files WHERE good GROUP BY store, stem)
SELECT store::VARCHAR AS store, 'processed' AS folder, stem || '.csv' AS name, sha256(content) AS sha256 FROM written
UNION ALL SELECT store::VARCHAR, 'archive', '20260417143015123456_' || stem || ending, NULL FROM files WHERE good
UNION ALL SELECT store::VARCHAR, 'errors', stem || ending, NULL FROM files WHERE NOT good"""),
    "encrypt_errors": (encrypt_errors, ENCRYPT_ERRORS_SQL),
    "encrypt_outputs": (encrypt_outputs, ENCRYPT_OUTPUTS_SQL),
    "dated_loads": (dated_loads, """WITH days AS (SELECT *, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
  strftime(ts, '%d') AS day FROM events)
SELECT event_id, event_type, 1 AS load, year, month, day FROM days WHERE extract('day' FROM ts) % 7 <> 0
UNION ALL SELECT event_id, 'late', 2, year, month, day FROM days WHERE extract('day' FROM ts) % 7 = 0 AND event_id % 2 = 0"""),
    "encrypt_files": (encrypt_on_files, ENCRYPT_RESULT_SQL),
    "decrypt_files": (decrypt_on_files, DECRYPT_SQL),
    "decrypt_resume": (decrypt_resume, DECRYPT_SQL),
    "stream_polls": (stream_polls, DECRYPT_SQL),
}
