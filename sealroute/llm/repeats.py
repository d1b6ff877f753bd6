"""Removal of long strings that occur more than once in the corpus, by run-length indexes of what may repeat.

Every string of LENGTH bytes is filed under its rarest-hashed piece of PIECE bytes (the least of its pieces' hashes,
the first of equal ones), so equal strings are filed under the same hash. Strings that begin side by side under one
piece form a context, and each string lies in exactly one context. Pieces that occur once are done. Contexts that are
equal repeat as a whole. What is left, contexts of one piece that differ, is fetched once each and indexed by runs, a few
megabytes at a time; matching statistics mark the strings that occur elsewhere. Texts are known by a hash of theirs, so
copies share their marks, whatever their number. A piece with more differing contexts than one index may hold
(``MOST``) has its strings counted one by one, by their hashes, which is exact too and has no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.llm.common import drop_clashes, keep, work
from sealroute.llm.rlbwt import build_index, matching_statistics

LENGTH = 400
PIECE = 32
#: Differing contexts of one piece that an index may hold, and the bytes after which an index is closed: it sorts faster in cache.
MOST = 4096
INDEX_BYTES = 256 << 10
#: String starts that are hashed at once, of short and of very long texts alike.
CHUNK = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEY = ["k1", "k2"]
_FOUND = pa.schema([(name, pa.int64()) for name in ("k1", "k2", "start", "size", "piece", "context")])
_FETCHED = [*[(name, pa.int64()) for name in ("k1", "k2", "start", "piece", "n")], ("bytes", pa.binary())]
_SPANS = pa.schema([(name, pa.int64()) for name in ("k1", "k2", "start", "size")])
_STRINGS = pa.schema([(name, pa.int64()) for name in ("k1", "k2", "start", "w1", "w2")])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{name} bigint" for name in names)


def rolling(codes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit hash of every string of ``length`` bytes, by doubling, its bits stirred."""
    power, size = codes.astype(np.uint64) + np.uint64(1), 1
    total, covered = None, 0
    while True:
        if length & size:
            # What is covered so far stands behind this part.
            count = len(codes) - covered - size + 1
            tail = np.uint64(pow(base, covered, 1 << 64))
            total = power[:count].copy() if total is None else power[:count] * tail + total[size : size + count]
            covered += size
        if covered == length:
            break
        power = power[: len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts_of(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, sizes and piece hashes of the contexts in texts laid end to end, which end at ``ends``."""
    bits = np.uint64(CHUNK.bit_length())
    mask = np.uint64((1 << CHUNK.bit_length()) - 1)
    begins = np.concatenate([[0], ends[:-1]])
    for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        starts = len(part) - LENGTH + 1
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + starts, "left")
        # Starts whose string ends within its text.
        edge = np.zeros(starts + 1, np.int32)
        low = np.clip(begins[first:last] - at, 0, starts)
        high = np.clip(ends[first:last] - LENGTH + 1 - at, low, starts)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        valid = np.cumsum(edge[:-1]) > 0
        if not valid.any():
            continue
        hashes = rolling(part, PIECE, _BASES[0])
        ranked = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
        chosen = (_least(ranked, LENGTH - PIECE + 1) & mask).astype(np.int64)
        new = np.ones(starts, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(valid & new)
        stop = np.ones(starts, bool)
        stop[:-1] = new[1:] | ~valid[1:]
        until = np.flatnonzero(valid & stop)
        yield at + begin, until - begin + LENGTH, hashes[chosen[begin]].view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column laid end to end, and where each value ends. Null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _merged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges in order of their starts, those that touch as one."""
    if not len(starts):
        return starts, sizes
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    first = np.flatnonzero(new)
    return starts[first], stops[np.append(first[1:], len(starts)) - 1] - starts[first]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of each text; those equal within one text are one context, and a marked range each (no piece)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = _buffers(batch.column(2))
        begins = np.concatenate([[0], ends[:-1]])
        keys = [batch.column(i).to_numpy() for i in range(2)]
        raw = data.tobytes()
        for starts, sizes, pieces in contexts_of(data, ends):
            hashes = np.array([int.from_bytes(blake2b(raw[a : a + n], digest_size=8).digest(), "little", signed=True)
                               for a, n in zip(starts.tolist(), sizes.tolist())], np.int64)
            of = np.searchsorted(ends, starts, "right")
            table = pd.DataFrame({"k1": keys[0][of], "k2": keys[1][of], "start": starts - begins[of], "size": sizes,
                                  "piece": pieces, "context": hashes, "of": of})
            again = table.duplicated(["of", "piece", "context"], keep=False)
            if again.any():
                yield from _ranges(table[again])
                table = table[~table.duplicated(["of", "piece", "context"])]
            yield pa.RecordBatch.from_pandas(table[_FOUND.names], _FOUND, preserve_index=False)


def _ranges(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    for _, held in rows.groupby("of"):
        starts, sizes = _merged(held["start"].to_numpy(), held["size"].to_numpy())
        none = pa.nulls(len(starts), pa.int64())
        columns = [pa.array(np.full(len(starts), held[name].iloc[0])) for name in _KEY]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(starts), pa.array(sizes), none, none], schema=_FOUND)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts wanted of each text."""
    for batch in batches:
        names = batch.schema.names
        for k1, k2, text, wanted in zip(*[batch.column(names.index(name)) for name in ("k1", "k2", "text", "wanted")]):
            data, rows = text.as_py(), wanted.as_py()
            yield pa.RecordBatch.from_pydict({
                "k1": [k1.as_py()] * len(rows), "k2": [k2.as_py()] * len(rows),
                **{name: [row[name] for row in rows] for name in ("start", "piece", "n")},
                "bytes": [data[row["start"] : row["start"] + row["size"]] for row in rows]}, pa.schema(_FETCHED))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked ranges of contexts that come sorted by piece: whole pieces are indexed together."""
    def marked(held: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        texts = [row[4] for row in held]
        long = matching_statistics(build_index(texts)) >= LENGTH
        bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
        out = []
        for (k1, k2, start, n, text), at in zip(held, bounds.tolist()):
            # A context that occurs again is marked as a whole already.
            if n == 1 and (hits := np.flatnonzero(long[at : at + len(text)])).size:
                starts, sizes = _merged(hits, np.full(len(hits), LENGTH))
                out += [(k1, k2, start + a, size) for a, size in zip(starts.tolist(), sizes.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*out)], schema=_SPANS)

    held, size, last = [], 0, None
    for batch in batches:
        for row in batch.select(["piece", "k1", "k2", "start", "n", "bytes"]).to_pylist():
            if size >= INDEX_BYTES and row["piece"] != last:
                yield from marked(held)
                held, size = [], 0
            held.append((row["k1"], row["k2"], row["start"], row["n"], row["bytes"]))
            size += len(row["bytes"])
            last = row["piece"]
    if held:
        yield from marked(held)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts under two hashes."""
    for batch in batches:
        for k1, k2, start, data in zip(*[batch.column(batch.schema.names.index(name)) for name in ("k1", "k2", "start", "bytes")]):
            codes = np.frombuffer(data.as_py(), np.uint8)
            hashes = [rolling(codes, LENGTH, base).view(np.int64) for base in _BASES]
            count = len(hashes[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(count, k1.as_py())), pa.array(np.full(count, k2.as_py())),
                pa.array(np.arange(count) + start.as_py()), *map(pa.array, hashes)], schema=_STRINGS)


def cut(data: bytes, spans: list[dict[str, int]]) -> tuple[int, int, bytes]:
    """How many bytes and maximal runs the spans cover, and the bytes that are left."""
    starts, sizes = _merged(*[np.array([one[name] for one in spans], np.int64) for name in ("start", "size")])
    kept, at = [], 0
    for start, size in zip(starts.tolist(), sizes.tolist()):
        kept.append(data[at:start])
        at = start + size
    return int(sizes.sum()), len(starts), b"".join([*kept, data[at:]])


def _cut_column(text: Column, spans: Column) -> Column:
    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, kept: binary>")
    def cut_texts(texts: pa.Array, marked: pa.Array) -> pa.Array:
        out = [cut(data, found) for data, found in zip(texts.to_pylist(), marked.to_pylist())]
        removed, runs, kept = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                          ["n_removed", "n_spans", "kept"])

    return cut_texts(text, spans)


def text_key(data: Column) -> list[Column]:
    """Two hashes that name a text, 128 bits."""
    return [F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).alias("k2")]


def repeated_spans(texts: DataFrame, folder: str) -> DataFrame:
    """(k1, k2, spans) of the texts with repeated strings; ``texts`` has k1, k2 and text as bytes, a row a document.

    Spans are byte ranges (start, size), which may overlap. It reads ``texts`` twice.
    """
    parts = F.col("piece").isNotNull()
    long = texts.where(F.octet_length("text") >= LENGTH).select(*_KEY, "text")
    found = keep(long.mapInArrow(_found, _ddl(_FOUND.names)), folder, "contexts")
    pieces = found.where(parts).groupBy("piece").agg(F.count("*").alias("often")).where("often > 1")
    live = keep(_of_pieces(found.where(parts), keep(pieces, folder, "pieces")), folder, "live")
    here = F.struct(*_KEY, "start", "size")
    kinds = keep(live.groupBy("piece", "context").agg(F.count("*").alias("n"), F.min(here).alias("here")), folder, "kinds")
    many = keep(kinds.groupBy("piece").agg(F.count("*").alias("often")).where("often > 1"), folder, "many")

    whole = live.join(kinds.where("n > 1").select("piece", "context"), ["piece", "context"], "left_semi").select(*_SPANS.names)
    wanted = _of_pieces(kinds, many).select("here.*", "piece", "n")
    fetched = keep(_fetched(long, wanted), folder, "fetched")
    crowded = keep(many.where(F.col("often") > MOST).select("piece"), folder, "crowded")
    few = fetched.join(crowded, "piece", "left_anti")
    by_index = few.repartition("piece").sortWithinPartitions("piece").mapInArrow(_indexed, _ddl(_SPANS.names))
    spans = [found.where(~parts).select(*_SPANS.names), whole, by_index]
    if not crowded.isEmpty():
        strings = keep(fetched.join(crowded, "piece", "left_semi").mapInArrow(_strings, _ddl(_STRINGS.names)), folder, "strings")
        again = strings.groupBy("w1", "w2").agg(F.count("*").alias("often")).where("often > 1").select("w1", "w2")
        size = F.lit(LENGTH).cast("bigint").alias("size")
        spans.append(strings.join(again, ["w1", "w2"], "left_semi").select(*_KEY, "start", size))
    marked = reduce(DataFrame.unionAll, spans)
    return marked.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def _of_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows of some pieces, which come with how often each occurs in ``rows``. Of the pieces that occur more than MOST
    times there are few: they are broadcast, so their rows stay where they are and no piece is one task's."""
    hot = F.broadcast(pieces.where(F.col("often") > MOST).select("piece"))
    others = pieces.where(F.col("often") <= MOST).select("piece")
    return rows.join(hot, "piece", "left_semi").unionByName(
        rows.join(hot, "piece", "left_anti").join(others, "piece", "left_semi"))


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted context with its bytes, taken from one of the texts with its key."""
    lists = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "size", "piece", "n")).alias("wanted"))
    one = texts.join(lists.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
    return one.join(lists, _KEY).mapInArrow(_fetch, f"{_ddl([name for name, _ in _FETCHED[:-1]])}, bytes binary")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that are left).

    Each byte covered by a string of LENGTH bytes that also starts at another place of the corpus goes, places of the
    same document included; strings are those of the texts as they are. Texts are UTF-8; null is empty, and shorter
    texts lose nothing. Rows that repeat are documents of their own, so copies of at least LENGTH bytes go as a
    whole. Results replace columns of their names; other columns stay as they are. ``docs`` is read three times, so
    it should be a stored table.
    """
    folder = work(docs, "repeats")

    def data(value: str) -> Column:
        return F.coalesce(F.col(value).cast("binary"), F.lit(b""))

    texts = docs.select(data(text).alias("text"))
    spans = keep(repeated_spans(texts.select(*text_key(F.col("text")), "text"), folder), folder, "spans")
    results = ("n_bytes", "n_removed", "n_spans", "kept")
    # The caller's columns travel in one struct, so none of theirs meets one of ours.
    kept = drop_clashes(docs, *results)
    packed = kept.select(F.struct(*[F.col(f"`{name}`") for name in kept.columns]).alias("row"), *text_key(data(text)))
    joined = packed.join(spans, _KEY, "left").select("row", data(f"row.{text}").alias("text"), "spans")
    none = F.array().cast("array<struct<start: bigint, size: bigint>>")
    done = joined.withColumn("cut", _cut_column(F.col("text"), F.coalesce("spans", none)))
    return done.select("row.*", F.octet_length("text").cast("bigint").alias("n_bytes"), "cut.*")
