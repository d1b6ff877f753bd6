"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule needs every one of its literal tokens in a URL that it fits. It is listed under the one that the fewest URLs of
the table hold; a URL's tokens fetch candidate rules from that list, and only candidates run their regular expression.
Equal URLs are judged once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealroute.llm.common import drop_clashes, keep, work

#: Rules by host and path: (verdict, host and all below it, beginning of the path).
SITE_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Names that mark a host as unwanted where one of them is a whole part between dots and hyphens.
UNWANTED = ("adult", "bet", "bets", "betting", "casino", "gambling", "lottery", "pharmacy", "pills", "porn", "poker", "sex",
            "slots", "spam", "viagra", "warez", "xxx")
RULE_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>, weight bigint"
RESULTS = ("host", "path", "rule", "verdict")
_SPLIT = r"[^\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to a slash, question mark, hash or the end, A to Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: str) -> list[str]:
    return [part for part in re.split(r"[\W_]+", text.lower()) if part]


def site_rule(verdict: str, host: str, path: str) -> tuple[str, str, str, list[str], int]:
    """A rule for a host, all hosts below it, and paths that begin with ``path``; a longer rule weighs more."""
    label = host + path
    # The end of the path may be the middle of a URL's token.
    whole = path if not path[-1:].isalnum() else re.sub(r"[^\W_]+$", "", path)
    return (label, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", _tokens(host) + _tokens(whole), 1000 + len(label))


def name_rule(name: str) -> tuple[None, str, str, list[str], int]:
    """A rule against hosts that have ``name`` as a part of their own; it weighs less than any site rule."""
    return (None, "block", rf"^(?:[^/]*[.-])?{re.escape(name)}(?:[.-][^/]*)?(?:/|$)", _tokens(name), 1)


def standard_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*(site_rule(*one) for one in SITE_RULES), *map(name_rule, UNWANTED)], RULE_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict.

    ``rules`` has the columns of ``RULE_SCHEMA``; the heaviest rule that fits wins, at a tie the first by name and
    verdict. A rule without a name decides but is not reported; without any rule that fits the verdict is
    ``otherwise``. Rules without tokens are tried on every URL. Null URLs and URLs without ``://`` have an empty host and
    path. Columns of ``pages`` with the name of a result are replaced.
    """
    folder = work(pages, "urls")
    rows = pages.withColumn("judged_host", host_of(url)).withColumn("judged_path", path_of(url))
    rows = drop_clashes(rows, *RESULTS).withColumnsRenamed({"judged_host": "host", "judged_path": "path"})
    text = F.concat("host", "path")
    parts = F.array_distinct(F.concat(F.split(F.lower(text), _SPLIT), F.array(F.lit(""))))
    known = keep(rows.groupBy("host", "path").agg(F.count("*").alias("pages")).withColumn("text", text), folder, "known")
    held = known.select("host", "path", "text", "pages", F.explode(parts).alias("token"))

    listed = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = listed.select("token").distinct()
    # Counted before it is joined: a token of very many URLs is one row by then.
    counts = held.groupBy("token").agg(F.sum("pages").alias("pages")).join(wanted, "token", "left_semi")
    names = [F.col(name) for name in rules.columns]
    index = listed.join(counts, "token", "left").groupBy(*names).agg(
        F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), F.col("token"))).alias("rarest")).select(
        "rule", "verdict", "pattern", "weight", F.col("rarest.token").alias("token"))
    fitting = held.join(index, "token").where(F.expr("text rlike pattern"))
    first = F.min(F.struct((-F.col("weight")).alias("weight"), F.col("rule"), F.col("verdict")))
    judged = fitting.groupBy("host", "path").agg(first.alias("first")).select("host", "path", "first.rule", "first.verdict")
    return rows.join(judged, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
