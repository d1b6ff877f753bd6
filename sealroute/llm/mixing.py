"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate w, as near to 1 as its source's token target allows: the rates minimise
sum b (w ln w - w + 1) under sum w * size = target and w <= ``LIMIT``, where b = size / (1 + size / (size + mean size))
charges a document for leaving rate 1. The dual has one unknown a source and is convex; its solution tilts the rates
exponentially, w = min(LIMIT, exp(lambda * size / b)). Newton steps, kept inside a bracket that holds the solution, run
for all sources at once over the table of (source, size) counts, which is exact and far smaller than the documents.

Rates become whole copies: a (source, size) group's copies are rounded by a hash of the group, then the few groups that
bring a source's words nearest to its target are corrected. Inside a group copies go by the hash of the id, ranked in
cells, so no group is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealroute.llm.common import carried, drop_clashes, keep, restored, work

WEIGHTS = (5, 2, 1)
#: Most words that a source's target or a document may have, as a multiple of its own.
LIMIT = 3
#: Cells that a (source, size) group is ranked in.
CELLS = 1024
TOLERANCE, MOST_STEPS, CORRECTIONS = 1e-9, 60, 5
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")
_KEYS = ["mix_source", "size"]


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds target: the whole size shared by weight, but for ``limit`` times the source's own, the rest shared again.

    Sources (one row each) take the weights in turn, by code point, null last. What sharing again and again ends in is
    min(limit * own size, level * weight) with one level for all, found on the sources in order of limit / weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("most").over(before), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - spent) / left)
    # The level is that of the first source that stays below its limit.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(
        (F.col("most") / F.col("weight")).alias("at"), F.col("level")))).over(everything)["level"])
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).drop(
        "weight", "most", "level")


def _tilt(size: Column, mean: Column) -> Column:
    """size / b: 1 for the shortest documents, up to 2 for the longest."""
    return 1 + size / (size + mean)


def _rate(limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.col("lam") * F.col("tilt")))


def solve(groups: DataFrame, sources: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """(mix_source, lam) by Newton steps on the dual; ``groups`` has mix_source, size, n and tilt."""
    share = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    logs = F.when(share > 0, F.ln(F.least(share, F.lit(float(limit)))))
    state = sources.select(
        "mix_source", "target", F.coalesce(logs / 1.5, F.lit(-50.0)).alias("lam"),
        F.coalesce(F.least(logs, logs / 2), F.lit(-50.0)).alias("low"), F.lit(float(limit)).alias("high"))
    words, slope = F.col("n") * F.col("size") * _rate(limit), F.col("n") * F.col("size") * F.col("tilt")
    for step in range(MOST_STEPS):
        state = keep(state, folder, f"state-{step}")
        sums = groups.join(state, "mix_source").groupBy("mix_source").agg(
            F.sum(words).alias("got"),
            F.sum(F.when(_rate(limit) < limit, slope * _rate(limit)).otherwise(0.0)).alias("slope"))
        moved = state.join(sums, "mix_source").withColumn("off", F.col("got") - F.col("target"))
        moved = moved.withColumn("low", F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("low"))).withColumn(
            "high", F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("off") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs("off") <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        moved = keep(moved.withColumn("done", done).withColumn("lam", F.when(done, F.col("lam")).when(
            inside, newton).otherwise((F.col("low") + F.col("high")) / 2)), folder, f"step-{step}")
        state = moved.select("mix_source", "target", "lam", "low", "high")
        if moved.where("not done").isEmpty():
            break
    return state.select("mix_source", "lam")


def _round(groups: DataFrame, folder: str, limit: int) -> DataFrame:
    """Adds given, the whole copies of all documents of a group together."""
    spread = F.pmod(F.xxhash64(*_KEYS, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    rows = groups.withColumn("given", F.least(limit * F.col("n"), F.floor(F.col("n") * F.col("rate") + spread)).cast("bigint"))
    for step in range(CORRECTIONS):
        rows = keep(rows, folder, f"rounded-{step}")
        gap = rows.groupBy("mix_source").agg((F.first("target") - F.sum(F.col("given") * F.col("size"))).alias("gap"))
        room = F.when(F.col("gap") > 0, limit * F.col("n") - F.col("given")).otherwise(F.col("given"))
        many = F.least(room, F.greatest(F.lit(1), F.round(F.abs("gap") / F.col("size")))).cast("bigint")
        left = F.abs(F.abs("gap") - F.col("many") * F.col("size"))
        best = rows.where("size > 0").join(gap, "mix_source").withColumn("many", many).where("many > 0").withColumn(
            "left", left).where(F.col("left") < F.abs("gap")).groupBy("mix_source").agg(
            F.min(F.struct("left", "size", (F.signum("gap") * F.col("many")).cast("bigint").alias("more"))).alias("best"))
        moves = best.select("mix_source", F.col("best.size").alias("size"), F.col("best.more").alias("more"))
        rows = rows.join(moves, _KEYS, "left").withColumn(
            "given", F.col("given") + F.coalesce("more", F.lit(0))).drop("more")
    return keep(rows, folder, "given")


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Every row with source_size, target, rate, copies and taken (words: copies times size).

    ``sized`` has doc_id, source and size; further columns pass through, those with the name of a result are replaced.
    Documents without words count as size 0; a null source is a source of its own, the last.
    Repeated rows share a source's copies as other documents do. Without any word every target is 0.
    """
    folder = work(sized, "mixing")
    needed = ("doc_id", "source", "size")
    names = drop_clashes(sized, *[name for name in RESULTS if name != "size"]).columns
    rows = carried(sized.select(*[F.col(f"`{name}`") for name in names]), *needed).withColumn(
        "mix_source", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).withColumn(
        "mix_cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    cells = keep(rows.groupBy("source", *_KEYS, "mix_cell").agg(F.count("*").alias("n")), folder, "cells")
    groups = keep(cells.groupBy("source", *_KEYS).agg(F.sum("n").alias("n")), folder, "groups")
    sources = keep(targets(groups.groupBy("source", "mix_source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents")), weights, limit),
        folder, "sources")
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1.0))
    groups = groups.join(sources.drop("source"), "mix_source").withColumn("tilt", _tilt(F.col("size"), mean))
    groups = keep(groups, folder, "tilted")
    rated = groups.join(solve(groups, sources, folder, limit), "mix_source").withColumn("rate", _rate(limit))
    given = _round(rated.select(*_KEYS, "n", "source_size", "target", "rate"), folder, limit)

    before = Window.partitionBy(*_KEYS).orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*_KEYS, "mix_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    shares = offsets.join(given, _KEYS)
    ranked = rows.withColumn("mix_rank", F.row_number().over(
        Window.partitionBy(*_KEYS, "mix_cell").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")))
    extra = (F.col("mix_before") + F.col("mix_rank") <= F.col("given") % F.col("n")).cast("bigint")
    out = ranked.join(shares, [*_KEYS, "mix_cell"]).withColumn(
        "copies", F.floor(F.col("given") / F.col("n")) + extra).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*restored(names, needed), *[name for name in RESULTS if name != "size"])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The documents that the mix takes, with copies and taken beside their own columns; these two replace columns of
    their names, no other does."""
    names = drop_clashes(docs, "copies", "taken").columns
    needed = ("doc_id", "source", "text")
    sized = keep(carried(docs.select(*[F.col(f"`{name}`") for name in names]), *needed).withColumn(
        "size", word_count("text")), work(docs, "sized"), "sized")
    return mix(sized, weights, limit).where("copies > 0").select(*restored(names, needed), "copies", "taken")
