"""The landing view: the documents table seen as files in landing folders.

File names, folders, empty and damaged files are fixed by rules on ``doc_id``, stated once for
Spark and once in SQL.
"""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealroute.functions.paths import in_folder
from sealroute.functions.text import WHITESPACE
from sealroute.operators.codec import DECRYPT_FAILED, fan_out
from sealroute.operators.keys import KeyTable

# The size limit of the two queries whose subject it is; all others run with the real one.
SIZE_CAP = 16384
# Neighbouring documents that share a batch: their number grows with the table, their size does not.
BATCH_DOCS = 60
KEY_IDS = ["key0", "key1", "key2", "key3"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def landing(spark: SparkSession, sf: str) -> DataFrame:
    return landing_of(read(spark, sf, "documents"))


def payload_landing(spark: SparkSession, sf: str) -> DataFrame:
    """The view for work on the payloads themselves, spread over all cores."""
    return landing_of(fan_out(read(spark, sf, "documents"), "doc_id"))


def landing_of(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    folder = F.concat(F.lit("inbound/"), F.col("lang"))
    name = F.concat(
        F.when(doc % 13 == 0, "_").otherwise(""), F.lit("doc_"), doc.cast("string"),
        F.when(doc % 7 == 0, ".pdf").when(doc % 7 == 1, ".csv.PGP").otherwise(".csv.pgp"))
    return documents.select(
        "doc_id", "lang", "source",
        folder.alias("folder"),
        F.when(doc % 55 == 0, F.concat(F.lit("inbound/bad/"), F.expr(f"doc_id div {55 * BATCH_DOCS}").cast("string")))
        .otherwise(F.concat(folder, F.lit("/"), F.expr(f"doc_id div {BATCH_DOCS}").cast("string"))).alias("batch"),
        in_folder(folder, name).alias("path"),
        F.when(doc % 31 == 0, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("content"),
        (doc % 11 == 0).alias("corrupt"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))


def with_targets(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "destination_folder": F.concat(F.lit("processed/"), F.col("lang")),
        "error_folder": F.concat(F.lit("errors/"), F.col("lang")),
        "archive_folder": F.concat(F.lit("archive/"), F.col("lang")),
    })


def by_rule(files: DataFrame) -> DataFrame:
    """Settle the pending files by the view's rule instead of a codec: empty and damaged ones fail."""
    fails = F.col("corrupt") | (F.col("length") == 0)
    return files.withColumns({
        "message": F.when(F.col("status").isNotNull(), F.col("message")).when(fails, DECRYPT_FAILED).otherwise(""),
        "status": F.when(F.col("status").isNotNull(), F.col("status")).when(fails, "error").otherwise("ok"),
    })


def run_keys(spark: SparkSession) -> KeyTable:
    """Key material made for this run; the last key comes wrapped as a key store returns it."""
    rows = [(key, secrets.token_hex(16)) for key in KEY_IDS[:-1]]
    rows.append((KEY_IDS[-1], f'{{"value": " {secrets.token_hex(16)} "}}'))
    return KeyTable.of(spark.createDataFrame(pa.table(dict(zip(["key_id", "material"], zip(*rows))))))


def key_of(column: str):
    """Which key a file is under: three in four files share the first one."""
    doc = F.col(column)
    return F.when(doc % 4 != 3, KEY_IDS[0]).when(doc % 8 == 3, KEY_IDS[1]).when(
        doc % 16 == 7, KEY_IDS[2]).otherwise(KEY_IDS[3])


WS_SQL = "'" + WHITESPACE + "'"

LANDING_SQL = f"""
landing AS (
  SELECT doc_id, lang, source, folder, file_name, batch, folder || '/' || file_name AS path, content, corrupt,
         octet_length(content)::BIGINT AS length
  FROM (
    SELECT doc_id, lang, source, 'inbound/' || lang AS folder,
           CASE WHEN doc_id % 55 = 0 THEN 'inbound/bad/' || (doc_id // {55 * BATCH_DOCS})
             ELSE 'inbound/' || lang || '/' || (doc_id // {BATCH_DOCS}) END AS batch,
           (CASE WHEN doc_id % 13 = 0 THEN '_' ELSE '' END) || 'doc_' || doc_id ||
             (CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv.PGP' ELSE '.csv.pgp' END) AS file_name,
           CASE WHEN doc_id % 31 = 0 THEN ''::BLOB ELSE encode(text) END AS content,
           doc_id % 11 = 0 AS corrupt
    FROM documents))"""

CLASSIFIED_SQL = LANDING_SQL + f""",
classified AS (
  SELECT *, file_name AS name,
    CASE WHEN lower(file_name) LIKE '%.pgp' THEN left(file_name, length(file_name) - 4) END AS dest_name,
    CASE WHEN lower(file_name) NOT LIKE '%.pgp' THEN 'skipped' WHEN length > {SIZE_CAP} THEN 'error' END AS listed_status,
    CASE WHEN lower(file_name) NOT LIKE '%.pgp' THEN 'file does not have .pgp extension'
         WHEN length > {SIZE_CAP} THEN 'File size ' || format('{{:,}}', length) || ' bytes exceeds limit of 16,384 bytes'
    END AS listed_message
  FROM landing)"""

RESULTS_SQL = LANDING_SQL + f""",
results AS (
  SELECT doc_id, lang, source, folder, batch, path, file_name AS name, length,
    CASE WHEN lower(file_name) LIKE '%.pgp' THEN left(file_name, length(file_name) - 4) END AS dest_name,
    CASE WHEN lower(file_name) NOT LIKE '%.pgp' THEN 'skipped' WHEN corrupt OR length = 0 THEN 'error' ELSE 'ok' END
      AS status,
    CASE WHEN lower(file_name) NOT LIKE '%.pgp' THEN 'file does not have .pgp extension'
         WHEN corrupt OR length = 0 THEN '{DECRYPT_FAILED}' ELSE '' END AS message
  FROM landing)"""

SUMMARY_SQL = """
summary AS (
  SELECT batch, count(*) AS total,
    count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed,
    count(*) FILTER (status = 'skipped') AS skipped,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (status = 'ok'), '') AS processed_files,
    coalesce(string_agg(name, '|' ORDER BY name) FILTER (status = 'skipped'), '') AS skipped_files,
    coalesce(string_agg(CASE WHEN message = '' THEN name ELSE name || ': ' || message END, '|'
      ORDER BY CASE WHEN message = '' THEN name ELSE name || ': ' || message END) FILTER (status = 'error'), '')
      AS error_files
  FROM results GROUP BY batch)"""

CODE_SQL = "CASE WHEN failed = 0 THEN 200 WHEN ok > 0 THEN 207 ELSE 500 END"
