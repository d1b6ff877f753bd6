"""Personal data: fixed base patterns, and identifiers found by bootstrapped contexts, in DataFrame operations only.

The base patterns' matches are the seeds. Their contexts (the two words before, the word on either side) are candidate
patterns; tokens with a digit or an at sign in such contexts, or neighbouring groups of digits together, are candidate
instances. On the graph of patterns and instances, a pattern's confidence is the scores of its instances over their
number, and an instance's score follows from its confident patterns; both are recomputed in turn until neither moves.
Instances that score high enough are identifiers that no base pattern knows, and count as seeds of further patterns
from then on.

Patterns are written so that the regular expression engine neither recurses nor starts twice in one run of characters;
they match what the plain forms beside them match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealroute.llm.common import carried, keep, new_length, restored, work

#: Not white space; a token of digits with their usual signs; the same with what ends a clause.
_INK = r"[^\x20\x09-\x0D]"
_GROUP = r"[(.+-]*+[0-9][0-9().-]*+"
_LAST = rf"{_GROUP}[,;:!?\"']*+(?!{_INK})"

KINDS = ("email", "ip", "card", "phone", "id")
#: Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
#: [0-9]([\x20-]?[0-9])+ ; \+[0-9][\x20().0-9-]+[0-9] ; groups of digits with one space between, else a run without
#: white space that holds a digit or @.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<!{_INK})(?:{_GROUP}(?!{_INK})(?:(?:\x20{_GROUP}(?!{_INK}))++(?:\x20{_LAST})?+|\x20{_LAST})|[^\x20\x09-\x0D0-9@]*+[0-9@]{_INK}*+)",
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters of context that are looked at on either side.
CONTEXT = 48
SMOOTHING, STILL = 1.0, 0.005
#: Seeds that a pattern needs, its least confidence, and an instance's least score.
SEEDS, CONFIDENT, ACCEPTED = 4, 0.7, 0.8


def _bound(text: Column, kind: int, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a text's matches and the gaps around them, each found once."""
    held = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("matches"),
                    F.split(text, PATTERNS[kind], -1).alias("gaps"))
    return F.transform(F.array(held), use)[0]


def _found(kind: int) -> Column:
    """The matches of a kind in order: what lies between them, the match, and the text around it."""
    structs = _bound(F.col("text"), kind, lambda one: F.transform(one["matches"], lambda value, at: F.struct(
        F.lit(kind).alias("kind"), at.alias("at"), F.length(one["gaps"][at]).alias("gap"), value.alias("value"),
        F.right(one["gaps"][at], F.lit(CONTEXT)).alias("before"), F.left(one["gaps"][at + 1], F.lit(CONTEXT)).alias("after"))))
    sign = {0: F.contains("text", F.lit("@")), 3: F.contains("text", F.lit("+"))}.get(kind, F.rlike("text", F.lit("[0-9@]")))
    return F.when(sign, structs).otherwise(F.array().cast(
        "array<struct<kind: int, at: int, gap: int, value: string, before: string, after: string>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: from the right, every second digit doubled."""
    turned = F.reverse(digits)

    def add(total: Column, at: Column) -> Column:
        digit = F.substr(turned, at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    length = F.length(digits)
    return (F.when(F.col("kind") == 1, F.rlike("value", F.lit(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")))
            .when(F.col("kind") == 2, F.when(length.between(14, 19), luhn(digits)).otherwise(False))
            .when(F.col("kind") == 3, length.between(10, 15)).otherwise(True))


def matches(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and the valid spans: row, kind, start, stop, value, before, after."""
    arrays = [_found(kind) for kind in range(len(PATTERNS))]
    rows = keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*arrays).alias("found")), folder, "found")
    one = rows.select("row", F.explode("found").alias("one")).select("row", "one.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    spans = one.withColumn("stop", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("stop") - size)
    return rows.select("row", "doc_id"), keep(spans.where(_valid()).drop("gap", "at"), folder, "spans")


def _contexts(spans: DataFrame) -> DataFrame:
    """The patterns that a span's surroundings are instances of."""
    left = F.split(F.concat(F.lit("^ ^ "), F.trim(F.regexp_replace(F.lower("before"), r"[\x20\x09-\x0D]+", " "))), " ")
    right = F.split(F.concat(F.trim(F.regexp_replace(F.lower("after"), r"[\x20\x09-\x0D]+", " ")), F.lit(" $")), " ")
    left = F.filter(left, lambda word: word != "")
    words = spans.withColumn("one", F.element_at(left, -1)).withColumn("two", F.element_at(left, -2)).withColumn(
        "next", F.element_at(F.filter(right, lambda word: word != ""), 1))
    return words.withColumn("pattern", F.explode(F.array(
        F.concat_ws(" ", F.lit("left"), "two", "one"), F.concat_ws(" ", F.lit("around"), "one", "next")))).drop(
        "one", "two", "next")


def _unknown(spans: DataFrame) -> DataFrame:
    """Candidate tokens that no base span touches, without the punctuation around them."""
    last, base = len(PATTERNS) - 1, len(PATTERNS) - 1
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = F.coalesce(F.max(F.when(F.col("kind") < base, F.col("stop"))).over(ahead), F.lit(0))
    following = F.min(F.when(F.col("kind") < base, F.col("start"))).over(behind)
    free = spans.withColumn("reach", reach).withColumn("following", following).where(
        (F.col("kind") == last) & (F.col("reach") <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("stop"))))
    head = F.length(F.regexp_extract("value", r"\A[^\p{L}\p{N}]*", 0))
    core = F.regexp_replace(F.regexp_replace("value", r"\A[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]++\z", "")
    trimmed = free.drop("reach", "following").withColumn("core", core).withColumn("start", F.col("start") + head)
    return trimmed.withColumn("stop", F.col("start") + F.length("core")).withColumn("value", F.col("core")).drop("core").where("value != ''")


def discover(seeds: DataFrame, unknown: DataFrame, folder: str) -> DataFrame:
    """(value, score) of the unknown instances that score high enough, from the graph of patterns and instances.

    A pattern's confidence is its base seeds and its other instances' scores over the number of all its instances and
    ``SMOOTHING``; with at least ``SEEDS`` seeds, base or accepted, and a confidence of ``CONFIDENT`` it is trusted. An
    instance's score is one less the product of its trusted patterns' doubts. Scores only rise, so the rounds end: when no
    score rose by more than ``STILL``.
    """
    known = _contexts(seeds).select("pattern", "value", F.lit(True).alias("seed"))
    others = _contexts(unknown).select("pattern", "value", F.lit(False).alias("seed"))
    edges = keep(known.unionByName(others).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), folder, "edges")
    # A pattern of fewer instances than it needs seeds is never trusted, one without unknown instances tells nothing.
    fixed = keep(edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("all")).where(
        (F.col("all") >= SEEDS) & (F.col("all") > F.col("seeds"))), folder, "fixed")
    # What seeds add to a pattern never changes, so only unknown instances travel, and of them those with a score.
    open_edges = keep(edges.where("not seed").join(fixed, "pattern", "left_semi").select("pattern", "value"), folder, "open")
    scores = open_edges.select("value", F.lit(0.0).alias("score")).limit(0)
    step, risen = 0, 1.0
    while risen > STILL:
        gained = open_edges.join(scores, "value").groupBy("pattern").agg(
            F.sum("score").alias("gained"), F.count_if(F.col("score") >= ACCEPTED).alias("sure"))
        confidence = fixed.join(gained, "pattern", "left").na.fill(0).where(F.col("seeds") + F.col("sure") >= SEEDS).select(
            "pattern", ((F.col("seeds") + F.col("gained")) / (F.col("all") + SMOOTHING)).alias("confidence"))
        trusted = keep(confidence.where(F.col("confidence") >= CONFIDENT), folder, f"trusted-{step}")
        after = keep(open_edges.join(trusted, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("score")), folder, f"scores-{step}")
        before = scores.withColumnRenamed("score", "before")
        risen = after.join(before, "value", "left").agg(F.max(F.col("score") - F.coalesce("before", F.lit(0.0)))).first()[0] or 0.0
        scores, step = after, step + 1
    return scores.where(F.col("score") >= ACCEPTED)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, row, found) of every document: all its spans by start, then kind; (start, kind, stop, value).

    kind is a place in ``KINDS``, start and stop are code points. Null and empty texts have no span; repeated rows have
    their own. Without base matches there are no seeds and nothing is discovered.
    """
    folder = work(docs, "pii")
    rows, spans = matches(docs, folder)
    seeds, unknown = spans.where(F.col("kind") < 4), keep(_unknown(spans), folder, "unknown")
    accepted = discover(seeds, unknown, folder)
    extra = unknown.join(accepted.select("value"), "value", "left_semi")
    columns = ["row", "start", "kind", "stop", "value"]
    found = seeds.select(*columns).unionByName(extra.select(*columns)).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(*columns[1:]))).alias("found"))
    none = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint, value: string>>")
    return rows.join(found, "row", "left").withColumn("found", F.coalesce("found", none))


def spans_text(found: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda one: F.concat_ws(
        ":", F.element_at(names, one["kind"] + 1), one["start"].cast("string"), one["stop"].cast("string"))), ",")


def _masked(text: Column, kind: int, hide: Callable[[Column], Column]) -> Column:
    """A text with the matches of a kind for which ``hide`` holds replaced by a mark."""
    mark = f"<{KINDS[kind].upper()}>"
    return F.array_join(_bound(text, kind, lambda one: F.transform(one["gaps"], lambda gap, at: F.when(
        at >= F.size(one["matches"]), gap).otherwise(F.concat(gap, F.when(hide(one["matches"][at]), mark).otherwise(
            one["matches"][at]))))), "")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, with a mark in place of every base match and discovered identifier; same columns.

    Kinds are masked one after the other (e-mail, phone, card, ip, discovered), so where matches overlap the first
    kind's mark stays. ``n_chars`` is counted anew where a text changed. Null texts stay null.
    """
    folder = work(docs, "pii-mask")
    # Values go back to the texts they were found in, whatever the ids of the rows: equal texts hold equal values.
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    found = personal_data(docs.select(F.struct(*key).alias("doc_id"), "text"))
    one = found.select("doc_id.*", F.explode("found").alias("one")).where("one.kind = 4")
    values = keep(one.groupBy("k1", "k2").agg(F.collect_set("one.value").alias("pii_values")), folder, "values")
    rows = carried(docs, "text").select("*", *key).join(values, ["k1", "k2"], "left")

    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "")

    text = F.col("text")
    steps = [(0, "@", lambda value: F.lit(True)), (3, "[+]", lambda value: F.length(digits(value)).between(10, 15)),
             (2, "[0-9][ -]?[0-9]", lambda value: F.when(F.length(digits(value)).between(14, 19), luhn(digits(value))).otherwise(False)),
             (1, r"[0-9]\.[0-9]", lambda value: F.rlike(value, F.lit(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")))]
    rows = rows.withColumn("pii_text", text)
    for kind, sign, hide in steps:
        rows = rows.withColumn("pii_text", F.when(F.rlike("pii_text", F.lit(sign)), _masked(F.col("pii_text"), kind, hide)).otherwise(F.col("pii_text")))
    core = lambda value: F.regexp_replace(F.regexp_replace(value, r"\A[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]++\z", "")
    rows = rows.withColumn("pii_text", F.when(F.col("pii_values").isNotNull(), _masked(
        F.col("pii_text"), 4, lambda value: F.array_contains("pii_values", core(value)))).otherwise(F.col("pii_text")))
    length = new_length(F.col("pii_text") != text, F.col("pii_text"), docs.columns)
    return rows.select(*restored(docs.columns, ("text",), text=F.col("pii_text"), **length))
