"""Near-duplicate groups: fast similarity sketches, banding, exact verification, connected components.

Texts with equal shingle sets are one class from the start. Classes that share a band hash form a bucket. A bucket of
up to ``SMALL`` classes emits its pairs, which bounds them by the number of rows. Of larger buckets no pairs are
emitted: their classes are compared with the bucket's consensus, the shingles that most of them have. With D the
symmetric difference of a set and the consensus, |x xor y| = |Dx| + |Dy| - 2 |Dx and Dy|, so

* two classes for which |Dx| + |Dy| is small enough must be linked; all such classes hang on the one nearest to the
  consensus, one link each;
* any other link needs a known overlap of Dx and Dy, which an index on the first elements of each D finds (rare ones
  first), so work follows the edits and not the square of the group.

Every pair found either way is confirmed on its full sets. A linked pair shares no band with probability 4e-7 at a
similarity of 0.8 and less above it; nothing else can lose a link, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.llm import sketch as S
from sealroute.llm.common import carried, keep, restored, work
from sealroute.llm.components import components

#: Largest bucket whose pairs are all compared; a row then has at most this many partners.
SMALL = 16


def _sketches(width: int):
    @F.arrow_udf("struct<digest: binary, n: bigint, sketch: binary>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                found = S.shingle_set(text, width)
                rows.append((S.digest(found), len(found), S.sketch(found).tobytes()) if len(found) else (None, 0, None))
            digests, counts, sketches = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())],
                ["digest", "n", "sketch"])

    return measure.asNondeterministic()


def _full_sets(width: int):
    @F.arrow_udf("struct<digest: binary, tokens: array<bigint>>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [S.shingle_set(text, width) for text in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([S.digest(one) for one in found], pa.binary()),
                 pa.array([one.view(np.int64) for one in found], pa.list_(pa.int64()))], ["digest", "tokens"])

    return measure.asNondeterministic()


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, digest, n, members, center) of every class in a bucket that it shares."""
    step = 4 * S.BAND
    hashes = [F.xxhash64(F.lit(i), F.substring("sketch", i * step + 1, step)) for i in range(S.BANDS)]
    rows = classes.select("digest", "n", F.explode(F.array(*hashes)).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("digest").alias("center")).where("members > 1")
    return rows.join(shared, "bucket")


def _small_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs of small buckets whose sizes do not rule the link out."""
    rows = buckets.where(F.col("members") <= SMALL)
    left = rows.select("bucket", F.col("digest").alias("u"), F.col("n").alias("un"))
    right = rows.select("bucket", F.col("digest").alias("v"), F.col("n").alias("vn"))
    return left.join(right, "bucket").where(
        (F.col("u") < F.col("v")) & (100 * F.col("un") >= percent * F.col("vn"))
        & (100 * F.col("vn") >= percent * F.col("un"))).select("u", "v").distinct()


def _differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member's difference from its group's consensus: new shingles first, then missing ones, each by value."""
    members = groups.join(sets, "digest")
    sizes = groups.groupBy("center").agg(F.count("*").alias("members"))
    counts = members.select("center", F.explode("tokens").alias("token")).groupBy("center", "token").count()
    consensus = counts.join(sizes, "center").where("2 * count > members").groupBy("center").agg(
        F.collect_list("token").alias("base"))
    base = F.coalesce("base", F.array().cast("array<bigint>"))
    return members.join(consensus, "center", "left").select(
        "center", "digest", "n", F.concat(F.array_sort(F.array_except("tokens", base)),
                                          F.array_sort(F.array_except(base, "tokens"))).alias("edits"))


def _large_pairs(differences: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sure links to the member nearest to the consensus, pairs that share enough of their first edits).

    With s the similarity in percent, |x xor y| <= (|x| + |y|) (100 - s) / (100 + s) is the same as the link; slack
    is (100 + s) |D| - (100 - s) n, and the overlap a link needs is half the sum of both slacks over 100 + s.
    """
    plus, minus = 100 + percent, 100 - percent
    rows = differences.withColumn("d", F.size("edits").cast("bigint")).withColumn(
        "slack", plus * F.col("d") - minus * F.col("n"))
    nearest = rows.groupBy("center").agg(F.min(F.struct("slack", "digest")).alias("near"))
    rows = rows.join(nearest, "center").withColumn("hangs", F.col("slack") + F.col("near.slack") <= 0)
    sure = rows.where("hangs").select(F.col("digest").alias("u"), F.col("near.digest").alias("v")).where("u != v")

    # |D| of a partner is at least |D| - (|x| + |y|) minus / plus, with |y| at most n * 100 / percent.
    floor = plus * F.col("d") - F.ceil(F.col("n") * minus * (200 + percent) / percent)
    needed = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.greatest(F.col("near.slack"), floor)) / (2 * plus)))
    listed = rows.where("d > 0").withColumn("edits", F.slice("edits", 1, F.greatest(F.lit(0), F.col("d") - needed + 1).cast("int")))
    entries = listed.select("center", "digest", "n", "d", "slack", "hangs", F.posexplode("edits").alias("at", "edit"))

    def side(name: str) -> DataFrame:
        return entries.select("center", "edit", *[F.col(c).alias(name + c) for c in ("digest", "n", "d", "slack", "hangs", "at")])

    overlap = F.ceil((F.col("uslack") + F.col("vslack")) / (2 * plus))
    pairs = side("u").join(side("v"), ["center", "edit"]).where(
        (F.col("udigest") < F.col("vdigest")) & ~(F.col("uhangs") & F.col("vhangs"))
        & (100 * F.col("un") >= percent * F.col("vn")) & (100 * F.col("vn") >= percent * F.col("un"))
        & (F.col("uat") <= F.col("ud") - overlap) & (F.col("vat") <= F.col("vd") - overlap))
    return sure, pairs.select(F.col("udigest").alias("u"), F.col("vdigest").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4,
                    percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Texts are linked if the Jaccard similarity of their sets of distinct ``width``-word shingles is at least
    ``percent`` / 100; component_id is the smallest id that links reach, and kept marks the rows that carry it. A text
    with fewer words is one shingle. Null, empty and wordless texts have no shingles, are linked with nothing and are
    kept. Repeated rows of an id stay repeated rows; a null id takes part but never names a component that has another.
    """
    folder = work(docs, "neardup")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # Texts are found again by two hashes of theirs: an id may stand on any number of rows.
    place = F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    measured = keep(rows.select("id", place.alias("place"), _sketches(width)("text").alias("m")).select(
        "id", "place", "m.*"), folder, "measured")
    classes = keep(measured.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.min("place").alias("place"), F.any_value("n").alias("n"),
        F.any_value("sketch").alias("sketch")), folder, "classes")
    buckets = keep(_buckets(classes), folder, "buckets")
    small = keep(_small_pairs(buckets, percent), folder, "small")
    groups = keep(buckets.where(F.col("members") > SMALL).select("center", "digest", "n").distinct(), folder, "groups")

    wanted = small.select(F.col("u").alias("digest")).unionByName(small.select(F.col("v").alias("digest"))).unionByName(
        groups.select("digest")).distinct()
    sources = classes.join(wanted, "digest").select("place.*")
    texts = rows.select("text", place.alias("place")).select("text", "place.*").join(sources, ["k1", "k2"], "left_semi")
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    sets = keep(once.select(_full_sets(width)("text").alias("s")).select("s.*"), folder, "sets")

    sure, indexed = _large_pairs(keep(_differences(groups, sets), folder, "differences"), percent)
    pairs = small.unionByName(sure).unionByName(indexed).distinct()
    one = sets.select(F.col("digest").alias("u"), F.col("tokens").alias("us"))
    two = sets.select(F.col("digest").alias("v"), F.col("tokens").alias("vs"))
    common = F.size(F.array_intersect("us", "vs"))
    links = pairs.join(one, "u").join(two, "v").where(
        100 * common >= percent * (F.size("us") + F.size("vs") - common)).select("u", "v")

    roots = components(links, folder)
    linked = classes.select("digest", "id").join(roots, F.col("node") == F.col("digest"), "left").select(
        "digest", "id", F.coalesce("root", "digest").alias("root"))
    names = linked.groupBy("root").agg(F.min("id").alias("component_id"))
    named = linked.join(names, "root").select("digest", "component_id")
    return measured.join(named, "digest", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")).withColumn(
        "kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with its columns as they were.

    Rows are compared whatever their ids: unrelated texts under one id, or under no id, all stay. Of a group the row
    with the smallest id stays, one without an id only if no row of the group has any; of several rows with that id the
    first read stays. Rows without words all stay. Any further columns pass through.
    """
    folder = work(docs, "dedup")
    # A row's key must not change between the readings below, so it is written with the row.
    needed = ("doc_id", "text")
    rows = keep(carried(docs, *needed).withColumn("kept_id", F.monotonically_increasing_id()), folder, "rows")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "kept_id").alias("key"), "text")
    kept = near_duplicates(keyed, "key", width=width, percent=percent).where("kept").select("key.kept_id")
    return rows.join(kept, "kept_id").select(*restored(docs.columns, needed))
