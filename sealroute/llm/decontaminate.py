"""Benchmark decontamination: documents streamed through a suffix automaton of the test items.

The automaton is made of blocks of at most about ``BLOCK_WORDS`` item words each, so what a task holds is bounded
whatever the benchmark's size; a further block is one more pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.llm.automaton import Automaton, words
from sealroute.llm.common import carried, drop_clashes, keep, new_length, restored, work

#: Item words in one automaton: about 100 MB in a Python worker.
BLOCK_WORDS = 100_000
RESULTS = ("n_words", "n_hit", "n_items", "items", "hits", "contaminated")
_FOUND = "struct<n_words: bigint, hits: array<struct<start: bigint, stop: bigint>>, items: array<string>>"
#: The same words as `words` takes, in a text of any case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _matcher(automaton):
    @F.arrow_udf(_FOUND)
    def match(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = automaton.value
        for texts, earlier, listed in batches:
            counts, hits, items = [], [], []
            for text, before, keys in zip(texts.to_pylist(), earlier.to_pylist(), listed.to_pylist()):
                stream = words(text)
                ranges, found = known.matches(stream)
                if before:
                    ranges = _merged(ranges + [(one["start"], one["stop"]) for one in before])
                counts.append(len(stream))
                hits.append([{"start": start, "stop": stop} for start, stop in ranges])
                items.append(sorted({*(key for key in found if key is not None), *(keys or ())}))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    return match.asNondeterministic()


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in parts of bounded size, one part at a time."""
    rows = benchmark.where("text is not null")
    size = F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    count = max(1, -(-total // block_words))
    for block in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == block)
        yield [(row.item_id, words(row.text)) for row in part.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items, hits and contaminated.

    ``benchmark`` has item_id and text. A word is hit if it lies inside an occurrence of ``window`` consecutive words of
    an item, or of a whole shorter item. ``hits`` are the ranges of hit words, ``items`` the ids of the items found, as
    sorted strings without repeats (items without an id mark words but are not listed). A document is contaminated if
    it has a hit and at least ``percent`` of its words are hit. Null and empty texts have no words; items without
    words and an empty benchmark find nothing. Columns of ``docs`` with the name of a result are replaced.
    """
    folder, session = work(docs, "decontaminate"), docs.sparkSession
    rows = drop_clashes(docs, *RESULTS)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    found: DataFrame | None = None
    for block, part in enumerate(_blocks(items, block_words)):
        if found is not None:
            rows = keep(found, folder, f"block-{block}")
        earlier = ([F.col("hits"), F.col("items")] if found is not None else
                   [F.lit(None).cast("array<struct<start: bigint, stop: bigint>>"), F.lit(None).cast("array<string>")])
        match = _matcher(session.sparkContext.broadcast(Automaton(part, window)))
        result = rows.withColumn("n_words", match("text", *earlier))
        found = drop_clashes(result, "hits", "items").select("*", "n_words.hits", "n_words.items").withColumn(
            "n_words", F.col("n_words.n_words"))
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, one: total + one["stop"] - one["start"])
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def _remover():
    @F.arrow_udf("string")
    def remove(texts: pa.Array, hits: pa.Array, longest: pa.Array) -> pa.Array:
        out = []
        for text, ranges, least in zip(texts.to_pylist(), hits.to_pylist(), longest.to_pylist()):
            cut = [one for one in ranges or () if one["stop"] - one["start"] >= least]
            if text and cut:
                at = [found.span() for found in _WORD.finditer(text)]
                for one in reversed(cut):
                    text = text[: at[one["start"]][0]] + text[at[one["stop"] - 1][1] :]
            out.append(text)
        return pa.array(out, pa.string())

    return remove


def without_spans(text: Column | str, hits: Column | str, least: int = 1) -> Column:
    """A text without its hit ranges of at least ``least`` words."""
    return _remover()(text, hits, F.lit(least))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, least: int = 1) -> DataFrame:
    """Documents that are not contaminated, without their hit spans of ``least`` words or more; same columns.

    ``n_chars`` is counted anew where a span was cut.
    """
    kept = find_contamination(carried(docs, "text"), benchmark, window, percent).where("not contaminated")
    cut = F.when(F.col("n_hit") > 0, without_spans("text", "hits", least)).otherwise(F.col("text"))
    length = new_length(F.col("n_hit") > 0, F.col("text"), docs.columns)
    return kept.withColumn("text", cut).select(*restored(docs.columns, ("text",), **length))
