"""A hash tree over a dataset: every row a leaf, a subtree per source, and a proof for each row.

Leaves are ranked within their source by one range sort of narrow rows: a source of any size spreads over many
partitions, and only the counts per (partition, source) are summed up. Each level is one window over blocks of
whole runs: lag and lead at fixed offsets, masked by a node's slot and its run's length, give its siblings, and the
first node of a run hashes the parent. A level has a sixteenth of the rows of the one below, and its rounds go on as
long as some tree has more than one node. The subroots are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealroute.llm.common import keep, work

FANOUT = 16
#: Nodes that share a window partition, whole runs only: a bound on what one key holds.
BLOCK = FANOUT * 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULTS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
_INDEX_BITS = 33
_PATH = "array<struct<siblings: binary, slot: int>>"


def digest(data: Column) -> Column:
    """SHA-256 as its 32 bytes; half of what the hex text would take in shuffles."""
    return F.unhex(F.sha2(data, 256))


def hex_text(data: Column) -> Column:
    """Digests side by side as lowercase hex text."""
    return F.lower(F.hex(data))


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes in front, so no two rows have the same text; null is `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)).cast("binary"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(leaves: DataFrame, folder: str) -> DataFrame:
    """``leaves`` with ``place``, counted from zero within each ``tree`` in the order of (``key``, hash, row), and with
    the tree's number of ``nodes``.

    The sort is by range, so a tree of any size spreads over partitions; rows that are equal in everything are told
    apart by their number, so equal rows spread as well (their order changes no hash).
    """
    order = ["tree", "key", "hash", "row"]
    sorted_rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    at = keep(sorted_rows.withColumn("at", F.monotonically_increasing_id()), folder, "sorted")
    at = at.withColumn("part", F.shiftright("at", _INDEX_BITS))
    counts = at.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # A row for each partition that a tree spans, not for each leaf.
    span = Window.partitionBy("tree")
    before = F.sum("n").over(span.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), F.sum("n").over(span).alias("nodes"),
        (F.coalesce(before, F.lit(0).cast("bigint")) - F.col("first")).alias("shift"))
    placed = at.join(keep(shifts, folder, "shifts"), F.col("of").eqNullSafe(F.col("tree")) & (F.col("part") == F.col("in")))
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("of", "in", "part", "shift", "at", "row")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, place, hash, nodes in the tree) with slot, siblings in order, and the parent's hash on the
    first node of each run (null on the others)."""
    slot = F.col("place") % FANOUT
    window = Window.partitionBy("tree", F.expr(f"place div {BLOCK}")).orderBy("place")
    run = F.least(F.lit(FANOUT), F.col("nodes") - F.col("place") + slot)
    none = F.lit(b"")
    before = [F.when(slot >= k, F.lag("hash", k).over(window)).otherwise(none) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("hash", k).over(window)).otherwise(none) for k in range(1, FANOUT)]
    windowed = nodes.withColumns({"slot": slot.cast("int"), "before": F.concat(*before), "after": F.concat(*after)})
    parent = F.when(F.col("slot") == 0, digest(hex_text(F.concat("hash", "after")).cast("binary")))
    return windowed.withColumns({"siblings": F.concat("before", "after"), "parent": parent}).drop("before", "after")


def build_trees(leaves: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves up, and (tree, hash) of their roots.

    ``leaves`` has tree, place, hash and nodes (leaves of its tree), and may carry other columns. A level has those
    trees that still have more than one node there.
    """
    levels: list[DataFrame] = []
    roots: list[DataFrame] = []
    nodes = leaves
    while True:
        name = f"level{len(levels)}"
        roots.append(nodes.where("nodes = 1").select("tree", "hash"))
        rows = keep(with_siblings(nodes.where("nodes > 1")), folder, name)
        if rows.isEmpty():
            return levels, reduce(DataFrame.unionAll, roots)
        levels.append(rows)
        nodes = rows.where("slot = 0").select(
            "tree", F.expr(f"place div {FANOUT}").alias("place"), F.col("parent").alias("hash"),
            F.expr(f"(nodes + {FANOUT - 1}) div {FANOUT}").alias("nodes"))


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest level with ``path``: slot and siblings of the node and of every node above it.

    ``tops`` has (tree, path, subroot): what stands above each tree's root, and that root. A node's path is joined
    from its parent's, so a key has at most sixteen rows, whatever the size of its tree.
    """
    own = F.struct("siblings", "slot")
    above = None
    for level in reversed(levels):
        top = level.where(F.col("nodes") <= FANOUT).join(
            tops.withColumnRenamed("tree", "of"), F.col("of").eqNullSafe(F.col("tree")))
        parts = [top.drop("of")]
        if above is not None:
            parents = above.select(F.col("tree").alias("of"), F.col("place").alias("over"), "path", "subroot")
            inner = level.where(F.col("nodes") > FANOUT).join(
                parents, F.col("of").eqNullSafe(F.col("tree")) & (F.expr(f"place div {FANOUT}") == F.col("over")))
            parts.append(inner.drop("of", "over"))
        above = reduce(DataFrame.unionByName, parts).withColumn("path", F.concat(F.array(own), "path"))
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a digest leads to: put among its siblings at its slot and hashed, level by level."""
    def step(held: Column, one: Column) -> Column:
        split = one["slot"] * 32
        left = F.substring(one["siblings"], F.lit(1), split)
        return digest(hex_text(F.concat(left, held, one["siblings"].substr(split + 1, F.octet_length(one["siblings"])))).cast("binary"))

    return F.aggregate(path, start, step)


def proof(path: Column) -> Column:
    """The hash of all siblings from the leaf to the root."""
    joined = F.aggregate(path, F.lit(b""), lambda held, one: F.concat(held, one["siblings"]))
    return F.sha2(hex_text(joined).cast("binary"), 256)


def manifest(rows: DataFrame, tampered: dict[str, Column], key: str = "doc_id", tree: str = "source",
             fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; digests as lowercase hex text.

    ``tampered`` maps a field to the value that the check of a proof sees instead; the tree is that of the fields as
    they are. Nulls in any field are values of their own (`-`); a null tree is a tree, first in order, and null keys
    come first in theirs. Rows with one key are ordered by leaf, and equal rows get equal leaves but each a place of
    its own. An empty table has no rows; other columns of the rows are not looked at.
    """
    folder = work(rows, "merkle")
    as_is = [F.col(name) for name in fields]
    seen = [tampered.get(name, F.col(name)) for name in fields]
    leaves = rows.select(
        F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), leaf(*as_is).alias("hash"), leaf(*seen).alias("seen"))
    leaves = keep(leaves.withColumn("row", F.monotonically_increasing_id()), folder, "leaves")
    placed = keep(ranked(leaves, folder), folder, "placed")
    levels, subroots = build_trees(placed, folder)
    tops, root = _top_paths(keep(subroots, folder, "subroots"), f"{folder}/top")
    tops = keep(tops, folder, "tops")

    lone = placed.where("nodes = 1").join(tops.withColumnRenamed("tree", "of"), F.col("of").eqNullSafe(F.col("tree")))
    wanted = ["key", "hash", "seen", "path", "subroot"]
    proved = lone.select(*wanted)
    if levels:
        proved = proved.unionAll(with_paths(levels, tops).select(*wanted))
    folded = proved.withColumns({"proof_sha256": proof(F.col("path")), "folded": fold(F.col("seen"), F.col("path"))})
    return folded.select(
        F.col("key").alias(key), hex_text(F.col("hash")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        F.lit(root).alias("root"), "proof_sha256", hex_text(F.col("folded")).alias("folded_root"),
        (hex_text(F.col("folded")) == F.lit(root)).alias("verified"))


def _top_paths(subroots: DataFrame, folder: str) -> tuple[DataFrame, str | None]:
    """(tree, path, subroot) of each subtree: what stands above its root, and that root; and the root of all."""
    leaves = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash", F.lit(0).alias("row"))
    placed = keep(ranked(leaves, folder), folder, "placed")
    levels, roots = build_trees(placed, folder)
    roots = keep(roots, folder, "roots")
    root = roots.select(hex_text(F.col("hash"))).first()
    nothing = [F.array().cast(_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot")]
    rows = with_paths(levels, roots.select("tree", *nothing)) if levels else placed.select("*", *nothing)
    return rows.select(F.col("key").alias("tree"), "path", F.col("hash").alias("subroot")), root and root[0]
