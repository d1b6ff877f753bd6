"""The registered queries of this subpackage: every operator on its whole table, in its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealroute.llm import (
    chat, decontaminate, language, lines, merkle, mixing, neardup, pii, quality, repeats, toxicity, urls, whitening,
)
from sealroute.llm.common import documents, held_out, keep, table, work

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = chat.format_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(added))
    turns = keep(turns, work(turns, "chat"), "turns")
    return chat.digests(turns, chat.expand(turns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.train_language(docs)
    return language.predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    base = F.filter("found", lambda one: one["kind"] < 4)

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda one: one["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    counts = [count(kind) for kind in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
                        pii.spans_text(F.col("found")).alias("spans"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), urls.standard_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         *[f"p_{name}" for name in toxicity.CATEGORIES], "score", "toxic",
                         F.col("toxic").cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    taken = mixing.mix(keep(sized, work(docs, "sizes"), "sized"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rules(documents(spark, sf_dir, "doc_id", "source", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = documents(spark, sf_dir, *merkle.FIELDS)
    return merkle.manifest(docs, {"text": F.when(chosen, merkle.lower_ascii(text)).otherwise(text)})


#: The first and the second half of a URL's rule, as `urls.SITE_RULES` has them.
_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urls.SITE_RULES)

OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(length('### : </turn>') + 1 + length(role) + length(text)
    + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM rows GROUP BY conv_id
"""

OP6_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
urls AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')
      AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT DISTINCT u.host, u.path, r.host || r.path AS rule, r.verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
best AS (
  SELECT host, path, rule, verdict FROM fits
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1)
SELECT u.page_id, u.host, u.path, b.rule,
  coalesce(b.verdict, CASE WHEN regexp_matches(u.host, '(^|[.-])({"|".join(urls.UNWANTED)})([.-]|$)') THEN 'block' ELSE 'allow' END)
    AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LETTER_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, {_LETTER_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM benchmark),
sized AS (SELECT *, least(len(words), 13) AS size FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM sized)),
docs AS (
  SELECT doc_id, {_LETTER_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
runs AS (
  SELECT doc_id, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS run
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT doc_id, pos, size, item_id FROM runs JOIN windows USING (run, size)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
  SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
  SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP9_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_PLAIN_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + least(len(words), 4) - 1], ' ') AS run, least(len(words), 4) AS size
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 4) + 2)) AS pos FROM docs WHERE len(words) > 0)),
counts AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b USING (run, size)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN counts x ON x.doc_id = u JOIN counts y ON y.doc_id = v
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN counts USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""

OP10_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_PLAIN_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS often
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM docs WHERE len(words) > 2)),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM windows WHERE often > 1) GROUP BY doc_id),
split AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT doc_id, source, line, {_PLAIN_WORDS.format("line")} AS held,
    array_to_string({_PLAIN_WORDS.format(_ASCII_LOWER.format("line"))}, ' ') AS norm FROM split),
copies AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE len(held) > 0 GROUP BY doc_id),
common AS (
  SELECT source, norm FROM lines WHERE len(held) > 0 GROUP BY source, norm
  HAVING count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) > {lines.LEAST}),
gone AS (SELECT doc_id, sum(len(held)) AS n FROM lines l SEMI JOIN common c
  ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(c.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_line_words
  FROM docs d LEFT JOIN copies c USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN gone g USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - n_line_words >= {lines.REMAINING} * n_words AS kept FROM failed
"""

_VALUE = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(name) for name in ("doc_id", "source", "lang", "n_chars")) + " || {})"
#: A bit of CRC-32, and a byte of it.
_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({{}}::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda c, i: {_CRC_BIT})), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF.format(_VALUE.format("text"))} AS h,
    CASE WHEN {_CRC32.format("doc_id")} % 5 = 0 THEN {_LEAF.format(_VALUE.format(_ASCII_LOWER.format("text")))}
      ELSE {_LEAF.format(_VALUE.format("text"))} END AS seen
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, level, place, n, h) AS (
  SELECT source, 0, place, n, h FROM placed
  UNION ALL SELECT source, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY source, level, place // 16, n),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops(level, place, n, h) AS (
  SELECT 0, place, n, h FROM subroots
  UNION ALL SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // 16, n),
beside AS (
  SELECT a.source, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 16 = b.place // 16
  WHERE a.n > 1 GROUP BY ALL),
above AS (
  SELECT a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.place // 16 = b.place // 16 WHERE a.n > 1 GROUP BY ALL),
climbed(doc_id, source, h, level, place, n, proof, folded) AS (
  SELECT doc_id, source, h, 0, place, n, '', seen FROM placed
  UNION ALL SELECT c.doc_id, c.source, c.h, c.level + 1, c.place // 16, (c.n + 15) // 16, c.proof || b.before || b.after,
    sha256(b.before || c.folded || b.after)
  FROM climbed c JOIN beside b ON c.source IS NOT DISTINCT FROM b.source AND c.level = b.level AND c.place = b.place
  WHERE c.n > 1),
reached(doc_id, h, subroot, level, place, n, proof, folded) AS (
  SELECT c.doc_id, c.h, s.h, 0, s.place, s.n, c.proof, c.folded
  FROM climbed c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source WHERE c.n = 1
  UNION ALL SELECT r.doc_id, r.h, r.subroot, r.level + 1, r.place // 16, (r.n + 15) // 16, r.proof || a.before || a.after,
    sha256(a.before || r.folded || a.after)
  FROM reached r JOIN above a ON r.level = a.level AND r.place = a.place WHERE r.n > 1)
SELECT r.doc_id, r.h AS leaf, r.subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root,
  r.folded = t.h AS verified
FROM reached r CROSS JOIN (SELECT h FROM tops WHERE n = 1) t WHERE r.n = 1
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_chat_formatting": (op1_chat_formatting, OP1_SQL),
    "op2_decontamination": (op2_decontamination, OP2_SQL),
    "op3_quality": (op3_quality, None),
    "op4_language": (op4_language, None),
    "op5_personal_data": (op5_personal_data, None),
    "op6_url_filters": (op6_url_filters, OP6_SQL),
    "op7_toxicity": (op7_toxicity, None),
    "op8_mixing": (op8_mixing, None),
    "op9_near_duplicates": (op9_near_duplicates, OP9_SQL),
    "op10_line_rules": (op10_line_rules, OP10_SQL),
    "op11_whitening": (op11_whitening, None),
    "op12_repeats": (op12_repeats, None),
    "op13_merkle_manifest": (op13_merkle_manifest, OP13_SQL),
}
