"""Quality rules: repetition inside a text, and lines that many documents of a host share.

A line counts once a document; lines in more documents of a host than the limit are removed, and documents that are
left with too little are rejected. Counts are combined before they are shuffled, and a line's key is a hash of host
and normalised line, so a common line is one counter and not a group of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.llm.common import carried, keep, new_length, restored, work
from sealroute.llm.sketch import word_hashes
from sealroute.operators.keyed import attach_exceptions

#: Documents of a host that may share a line, and the share of a document's words that must be left.
LEAST, REMAINING = 8, 0.5
SYMBOLS = b"#*$%&|<>"
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")
_MEASURES = ("n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
             "lines: array<struct<line: bigint, words: bigint>>")


def repeated_words(hashed: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    count = len(hashed) - 2
    if count < 2:
        return 0
    stir = np.uint64(0x9E3779B97F4A7C15)
    windows = (hashed[:count] * stir + hashed[1 : count + 1]) * stir + hashed[2:]
    _, place, often = np.unique(windows, return_inverse=True, return_counts=True)
    again = often[place] > 1
    covered = np.zeros(len(hashed), bool)
    for i in range(3):
        covered[i : i + count] |= again
    return int(covered.sum())


def normalised(line: bytes) -> bytes:
    """A to Z lower-cased, one space for white space."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normalised(line)) - (1 << 63)


def measure(text: str | None) -> tuple[int, int, int, int, int, list[dict[str, int]]]:
    """The counts of a text, and its distinct normalised lines with the words they hold together."""
    data = (text or "").encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, np.uint8)
    chars = int((~_SPACE[codes] & ((codes & 0xC0) != 0x80)).sum())
    hashed = word_hashes(data)
    seen: set[bytes] = set()
    copies, lines = 0, {}
    for line in data.split(b"\n"):
        held = len(line.split())
        if held:
            copies += line in seen
            seen.add(line)
            key = line_hash(line)
            lines[key] = lines.get(key, 0) + held
    return (len(hashed), chars, int(_SYMBOL[codes].sum()), copies, repeated_words(hashed),
            [{"line": key, "words": held} for key, held in lines.items()])


def _measured() -> Column:
    @F.arrow_udf(f"struct<{_MEASURES}>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
        for texts in batches:
            columns = list(zip(*map(measure, texts.to_pylist()))) or [()] * 6
            yield pa.StructArray.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names)

    return measured.asNondeterministic()("text")


def line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")), line)


def common_lines(rows: DataFrame, least: int) -> DataFrame:
    """Keys of the lines that more than ``least`` different documents of their host hold.

    ``rows`` has row, id, host and lines. Rows of one id are one document; a row without an id is a document of its
    own. Ids that stand on several rows are few as a rule: only their lines are made distinct before they are counted,
    spread by line and id, so neither a common line nor a common id is one task's.
    """
    repeated = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    marked = attach_exceptions(rows, repeated, "id", "row")
    lines = marked.select(F.explode("lines.line").alias("line"), "host", F.when(F.col("n") > 1, F.col("id")).alias("id"))
    keys = lines.select(line_key(F.col("host"), F.col("line")).alias("key"), "id")
    once = keys.where("id is null").select("key")
    shared = keys.where("id is not null").distinct().select("key")
    return once.unionAll(shared).groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > least).select("key")


def _held(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode("lines").alias("one"), "host").select(
        "row", line_key(F.col("host"), F.col("one.line")).alias("key"), "one.*")


def line_rules(docs: DataFrame, host: str = "source", least: int = LEAST, remaining: float = REMAINING) -> DataFrame:
    """(doc_id, counts, base_failed, n_line_words, kept) of every document.

    A line is removed if more than ``least`` documents of its host hold it, whatever the host's size; n_line_words are
    the words in such lines. A document is rejected if base_failed (under 50 words, or more than half of them in
    repeated 3-word windows) or if less than ``remaining`` of its words are left. Null and empty texts have no words
    and fail; a null host is a host of its own. Rows that repeat an id are one document where documents are counted,
    and are judged each by its own text; a row without an id counts as one document.
    """
    folder = work(docs, "lines")
    rows = keep(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").withColumn(
        "row", F.monotonically_increasing_id()).withColumn("m", _measured()).select("row", "doc_id", "host", "m.*"),
        folder, "measured")
    common = common_lines(rows.select("row", F.col("doc_id").alias("id"), "host", "lines"), least)
    removed = _held(rows).join(common, "key").groupBy("row").agg(F.sum("words").alias("n_line_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(removed, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("bigint")))
    out = out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= remaining * F.col("n_words")))
    return out.select("doc_id", *RESULTS)


def without_common_lines(docs: DataFrame, host: str = "source", least: int = LEAST, remaining: float = REMAINING) -> DataFrame:
    """The documents that the rules keep, without the removed lines; same columns (``n_chars`` counted anew)."""
    folder = work(docs, "common-lines")
    needed = tuple(dict.fromkeys(("doc_id", host, "text")))
    rows = carried(docs, *needed).withColumn("row", F.monotonically_increasing_id()).withColumn("m", _measured())
    rows = keep(rows, folder, "rows")
    found = rows.select("row", F.col("doc_id").alias("id"), F.col(host).cast("string").alias("host"), "m.lines")
    gone = _held(found).join(common_lines(found, least), "key").groupBy("row").agg(
        F.collect_list("line").alias("gone"), F.sum("words").alias("gone_words"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), lines.to_pylist()):
            if text and found:
                drop = set(found)
                kept = [one for one in text.encode("utf-8", "surrogatepass").split(b"\n") if not one.split() or line_hash(one) not in drop]
                text = b"\n".join(kept).decode("utf-8", "surrogatepass")
            out.append(text)
        return pa.array(out, pa.string())

    words, again = F.col("m.n_words"), F.col("m.n_repeat_words")
    left = words - F.coalesce("gone_words", F.lit(0))
    kept = rows.join(gone, "row", "left").where((words >= 50) & (100 * again <= 50 * words) & (left >= remaining * words))
    out = kept.withColumn("cut", cut("text", "gone"))
    length = new_length(F.col("gone").isNotNull(), F.col("cut"), docs.columns)
    return out.select(*restored(docs.columns, needed, text=F.col("cut"), **length))
