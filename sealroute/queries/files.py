"""Queries on files: listing rules, limits, routing and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealroute.functions.paths import archive_name, dated_path, in_folder, plain_output_name, sealed_output_name
from sealroute.functions.text import LINE_BREAKS, first_line, list_entry, with_stuck_warning
from sealroute.operators.files import (
    accept_batches, batch_totals, classify, is_empty_payload, recheck_payload, staging_pick,
)
from sealroute.operators.requests import MAX_FILES, too_many
from sealroute.operators.routing import mark_collisions, plan_routes
from sealroute.operators.summary import (
    SKETCH_ERROR, byte_totals, count_batches, list_entries, list_pages, merge_profiles, profile, quantile, summarise,
)
from sealroute.queries.landing import (
    CLASSIFIED_SQL, CODE_SQL, LANDING_SQL, RESULTS_SQL, SIZE_CAP, SUMMARY_SQL, by_rule, landing, read, with_targets,
)
from sealroute.session import keep, work_folder

STAMP = "2026-04-17 14:30:15.123456"
LIST_COLUMNS = ["processed_files", "skipped_files", "error_files"]


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return landing(spark, sf).drop("content")


def joined_lists(summary: DataFrame) -> DataFrame:
    return summary.withColumns({name: F.array_join(name, "|") for name in LIST_COLUMNS})


def classify_files(spark, sf):
    return classify(listing(spark, sf), SIZE_CAP).select(
        "doc_id", "path", "name", "dest_name", "length", "status", "message")


def batch_counts(spark, sf):
    files = listing(spark, sf).drop("batch").withColumnRenamed("folder", "batch")
    return count_batches(by_rule(classify(files)))


def batch_summary(spark, sf):
    files = listing(spark, sf)
    accepted = accept_batches(files, batch_totals(files), MAX_FILES)
    return joined_lists(summarise(by_rule(classify(accepted))))


def batch_entries(spark, sf):
    return list_entries(by_rule(classify(listing(spark, sf))))


def entry_pages(spark, sf):
    """The name lists of whole folders, which have no cap, in pages of 50 entries."""
    results = by_rule(classify(listing(spark, sf).withColumn("batch", F.col("folder"))))
    return list_pages(results, page_size=50).select("batch", "list", "page", F.array_join("entries", "|").alias("entries"))


def size_profiles(spark, sf):
    """Sizes of the files of each folder, profiled in four parts and merged; whether the quantiles have the ranks that
    the sketch promises, counted on all files."""
    files = listing(spark, sf).select("folder", F.col("length").alias("size"), "path")
    parts = [profile(files.where(F.pmod(F.xxhash64("path"), F.lit(4)) == part), "size", "folder") for part in range(4)]
    merged = merge_profiles(reduce(DataFrame.unionAll, parts), "folder")
    shares = {"half": 0.5, "most": 0.9}
    known = merged.select("folder", "n", "least", "largest", "total", *[quantile(share).alias(name) for name, share in shares.items()])
    places = files.join(known, "folder").groupBy("folder").agg(*[
        F.struct(F.count_if(F.col("size") < F.col(name)).alias("below"), F.count_if(F.col("size") <= F.col(name)).alias("up")).alias(f"at_{name}")
        for name in shares])

    def right(name):
        slack = SKETCH_ERROR * F.col("n") + 1
        return (F.col(f"at_{name}.below") <= shares[name] * F.col("n") + slack) & (F.col(f"at_{name}.up") >= shares[name] * F.col("n") - slack)

    return known.join(places, "folder").select(
        "folder", "n", "least", "largest", "total", *[right(name).cast("int").alias(f"{name}_right") for name in shares])


def batch_cap(spark, sf):
    files = listing(spark, sf)
    totals = batch_totals(files, "folder").withColumn("rejected", too_many(F.col("total"), MAX_FILES).cast("int"))
    accepted = accept_batches(
        files, totals.drop("rejected"), MAX_FILES, batch="folder")
    kept = accepted.groupBy("folder").agg(F.count(F.lit(1)).alias("accepted"))
    return totals.join(kept, "folder", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)).cast("bigint"))


def empty_batch(spark, sf):
    named = F.concat(F.lit("inbound/"), F.lower("n_name"))
    control = read(spark, sf, "nation").select(named.alias("folder")).union(
        read(spark, sf, "documents").select(F.concat(F.lit("inbound/"), F.col("lang")).alias("folder")).distinct())
    totals = batch_totals(listing(spark, sf), "folder")
    total = F.coalesce("total", F.lit(0)).cast("bigint")
    message = F.when(total == 0, F.concat(F.lit("No files found in source folder: "), F.col("folder")))
    return control.join(totals, "folder", "left").select("folder", total.alias("total"), message.alias("message"))


def size_recheck(spark, sf):
    files = landing(spark, sf).withColumns(
        {"status": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    return recheck_payload(files, SIZE_CAP).select("doc_id", "status", "message")


def empty_payload(spark, sf):
    return landing(spark, sf).select("doc_id", is_empty_payload(F.col("content")).cast("int").alias("empty"))


def archive_names(spark, sf):
    name = F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit(".csv.pgp"))
    ts = F.col("ts")
    plain = plain_output_name(F.lit("data_encrypted_"), ts)
    return read(spark, sf, "events").select(
        "event_id",
        in_folder(F.lit("archive/originals"), archive_name(ts, name)).alias("archive_path"),
        in_folder(F.lit("outbound"), sealed_output_name(F.lit("data_encrypted_"), ts)).alias("output_path"),
        dated_path(F.lit("archive/sent"), ts, plain).alias("dated_path"),
    )


def message_clean(spark, sf):
    # Turns are separated by every kind of line break the rule knows.
    breaks = F.array(*[F.lit(sep) for sep in ["\n", "\r\n", "\r", " ", "\x1c", "\x85"]])
    raw = F.replace(F.col("text"), F.lit("\n"), F.get(breaks, (F.col("conv_id") % 6).cast("int")))
    message = first_line(F.when(F.col("turn") == 1, F.lit("")).otherwise(raw))
    name = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".csv.pgp"))
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", message.alias("message"), list_entry(name, message).alias("entry"))


def staging(spark: SparkSession, sf: str) -> DataFrame:
    """Staged files by request; some requests hold system files only."""
    request = F.concat(F.col("source"), F.lit("/"), F.expr("doc_id div 60").cast("string"))
    return listing(spark, sf).withColumn("request_id", request)


def staging_picks(spark, sf):
    return staging_pick(staging(spark, sf)).select(
        "request_id", "picked.path", "picked.length", "staged", "data_files",
        F.when(F.col("picked").isNull(), "NO_FILE").otherwise("PICKED").alias("state"))


def colliding(spark: SparkSession, sf: str) -> DataFrame:
    """Results in which the files of up to four documents claim one destination."""
    name = F.concat(
        F.lit("part_"), F.floor(F.col("doc_id") / 4).cast("string"),
        F.when(F.col("doc_id") % 2 == 0, ".csv.PGP").otherwise(".csv.pgp"))
    files = listing(spark, sf).withColumn("path", F.concat_ws("/", "folder", F.col("doc_id").cast("string"), name))
    return with_targets(by_rule(classify(files)))


def route_plan(spark, sf):
    # Written once: the length of a document costs a pass over its text.
    results = keep(colliding(spark, sf), work_folder(spark, "routes"), "results")
    routes = mark_collisions(plan_routes(results, stamp()))
    return routes.select(
        "doc_id", "path", "status", "dest_path", "source_target", "action",
        F.col("collision").cast("int").alias("collision"), F.col("wins_dest").cast("int").alias("wins_dest"))


def stuck_warning(spark, sf):
    stuck = F.when(F.col("doc_id") % 3 == 0, F.lit("move refused"))
    results = by_rule(classify(listing(spark, sf))).filter("status = 'error'")
    message = with_stuck_warning(F.col("message"), stuck)
    return results.select("doc_id", message.alias("message"), list_entry(F.col("name"), message).alias("entry"))


def payload_bytes(spark, sf):
    results = by_rule(classify(listing(spark, sf)))
    opened = F.col("status") == "ok"
    return byte_totals(results.withColumns({
        "bytes_in": F.when(opened, F.col("length") + 28), "bytes_out": F.when(opened, F.col("length"))}), "folder")


_BREAKS_SQL = "'^[^" + LINE_BREAKS + "]*'"
_MESSAGE_SQL = f"""
messages AS (
  SELECT conv_id, turn, left(regexp_extract(CASE WHEN turn = 1 THEN '' ELSE
    replace(text, chr(10), CASE conv_id % 6 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) WHEN 2 THEN chr(13)
      WHEN 3 THEN chr(8232) WHEN 4 THEN chr(28) ELSE chr(133) END) END, {_BREAKS_SQL}), 200) AS message
  FROM conversations)"""

QUERIES = {
    "classify_files": (classify_files, f"""WITH {CLASSIFIED_SQL}
SELECT doc_id, path, name, dest_name, length, listed_status AS status, listed_message AS message FROM classified"""),
    "batch_counts": (batch_counts, f"""WITH {RESULTS_SQL},
counted AS (SELECT folder AS batch, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'skipped') AS skipped
  FROM results GROUP BY folder)
SELECT *, {CODE_SQL} AS code FROM counted"""),
    "batch_summary": (batch_summary, f"""WITH {RESULTS_SQL}, {SUMMARY_SQL}
SELECT *, {CODE_SQL} AS code FROM summary WHERE total <= 500"""),
    "batch_entries": (batch_entries, f"""WITH {RESULTS_SQL}
SELECT batch, CASE status WHEN 'ok' THEN 'processed_files' WHEN 'skipped' THEN 'skipped_files' ELSE 'error_files' END
  AS list, CASE status WHEN 'error' THEN name || ': ' || message ELSE name END AS entry FROM results"""),
    "entry_pages": (entry_pages, f"""WITH {RESULTS_SQL},
entries AS (SELECT folder AS batch, CASE status WHEN 'ok' THEN 'processed_files' WHEN 'skipped' THEN 'skipped_files' ELSE 'error_files' END
  AS list, CASE status WHEN 'error' THEN name || ': ' || message ELSE name END AS entry FROM results),
placed AS (SELECT *, (row_number() OVER (PARTITION BY batch, list ORDER BY entry) - 1) // 50 AS page FROM entries)
SELECT batch, list, page, string_agg(entry, '|' ORDER BY entry) AS entries FROM placed GROUP BY batch, list, page"""),
    "size_profiles": (size_profiles, f"""WITH {LANDING_SQL}
SELECT folder, count(*) AS n, min(length) AS least, max(length) AS largest, sum(length)::BIGINT AS total,
  1 AS half_right, 1 AS most_right FROM landing GROUP BY folder"""),
    "batch_cap": (batch_cap, f"""WITH {LANDING_SQL}
SELECT folder, count(*) AS total, (count(*) > 500)::INTEGER AS rejected,
  CASE WHEN count(*) > 500 THEN 0 ELSE count(*) END::BIGINT AS accepted FROM landing GROUP BY folder"""),
    "empty_batch": (empty_batch, """WITH control AS (
  SELECT 'inbound/' || lower(n_name) AS folder FROM nation UNION ALL SELECT DISTINCT 'inbound/' || lang FROM documents)
SELECT c.folder, count(d.doc_id) AS total,
  CASE WHEN count(d.doc_id) = 0 THEN 'No files found in source folder: ' || c.folder END AS message
FROM control c LEFT JOIN documents d ON 'inbound/' || d.lang = c.folder GROUP BY c.folder"""),
    "size_recheck": (size_recheck, f"""WITH {LANDING_SQL}
SELECT doc_id, CASE WHEN length > {SIZE_CAP} THEN 'error' END AS status, CASE WHEN length > {SIZE_CAP}
  THEN 'Downloaded file size ' || format('{{:,}}', length) || ' bytes exceeds limit' END AS message FROM landing"""),
    "empty_payload": (empty_payload, f"""WITH {LANDING_SQL}
SELECT doc_id, (length = 0)::INTEGER AS empty FROM landing"""),
    "archive_names": (archive_names, """SELECT event_id,
  'archive/originals/' || strftime(ts, '%Y%m%d%H%M%S%f') || '_' || event_type || '_' || user_id || '.csv.pgp'
    AS archive_path,
  'outbound/data_encrypted_' || strftime(ts, '%Y%m%d%H%M%S') || '.csv.pgp' AS output_path,
  'archive/sent/' || strftime(ts, '%Y/%m/%d/') || 'data_encrypted_' || strftime(ts, '%Y%m%d%H%M%S') || '.csv'
    AS dated_path
FROM events"""),
    "message_clean": (message_clean, f"""WITH {_MESSAGE_SQL}
SELECT conv_id, turn, message,
  'conv_' || conv_id || '.csv.pgp' || CASE WHEN message = '' THEN '' ELSE ': ' || message END AS entry FROM messages"""),
    "staging_pick": (staging_picks, f"""WITH {LANDING_SQL},
staged AS (SELECT source || '/' || (doc_id // 60) AS request_id, path, length, NOT starts_with(file_name, '_') AS data
  FROM landing)
SELECT request_id, max(path) FILTER (data) AS path, arg_max(length, path) FILTER (data) AS length,
  count(*) AS staged, count(*) FILTER (data) AS data_files,
  CASE WHEN count(*) FILTER (data) = 0 THEN 'NO_FILE' ELSE 'PICKED' END AS state
FROM staged GROUP BY request_id"""),
    "route_plan": (route_plan, f"""WITH {LANDING_SQL},
named AS (
  SELECT *, 'part_' || (doc_id // 4) || CASE WHEN doc_id % 2 = 0 THEN '.csv.PGP' ELSE '.csv.pgp' END AS name
  FROM landing),
settled AS (
  SELECT doc_id, lang, name, folder || '/' || doc_id || '/' || name AS path,
    CASE WHEN length = 0 OR corrupt THEN 'error' ELSE 'ok' END AS status FROM named),
routed AS (
  SELECT doc_id, path, status,
    CASE WHEN status = 'ok' THEN 'processed/' || lang || '/' || left(name, length(name) - 4) END AS dest_path,
    CASE WHEN status = 'ok' THEN 'archive/' || lang || '/20260417143015123456_' || name
         ELSE 'errors/' || lang || '/' || name END AS source_target,
    CASE WHEN status = 'ok' THEN 'archive' ELSE 'quarantine' END AS action FROM settled)
SELECT *,
  (dest_path IS NOT NULL AND count(*) OVER (PARTITION BY dest_path) > 1)::INTEGER AS collision,
  (dest_path IS NOT NULL AND path = max(path) OVER (PARTITION BY dest_path))::INTEGER AS wins_dest
FROM routed"""),
    "stuck_warning": (stuck_warning, f"""WITH {RESULTS_SQL},
warned AS (SELECT doc_id, name, message || CASE WHEN doc_id % 3 = 0 THEN ' | WARNING: file stuck in source_folder'
  ELSE '' END AS message FROM results WHERE status = 'error')
SELECT doc_id, message, name || ': ' || message AS entry FROM warned"""),
    "payload_bytes": (payload_bytes, f"""WITH {RESULTS_SQL}
SELECT folder, count(*) FILTER (status = 'ok') AS files, (sum(length + 28) FILTER (status = 'ok'))::BIGINT AS bytes_in,
  (sum(length) FILTER (status = 'ok'))::BIGINT AS bytes_out FROM results GROUP BY folder"""),
}
