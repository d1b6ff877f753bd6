"""URL rules against trying every rule on every URL."""

from __future__ import annotations

import re

from sealroute.llm import urls

SCHEMA = "page_id bigint, url string, host string, Verdict string"
URLS = [
    None, "", "example.com/en/", "http://", "http://example.com", "http://example.com/en/x?y#z", "HTTP://WWW.Example.COM/en/",
    "http://www.example.com/english", "http://a.www.example.com/en/1", "https://x.net/es/1", "https://x.net/esp", "http://net/fr/",
    "http://bad-example.com/en/", "http://free-bets.example.org/", "http://bets.org?x", "http://alphabets.org/", "ftp://casino/a b",
    "http://com/", "http://example.com:80/en/", "a://b.com/#://net/fr/", "http://CASINO.com/", "http://x.com/\nnewline",
    "http://é.net/es/ü", "http://example.com/EN/", "http://sub.casino-win.example.net/fr/", "http://" + "a." * 20_000 + "com/"]


def expected(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]) if found else ""
    path = found[2] if found else ""
    best = max(((len(h + p), h + p, verdict) for verdict, h, p in urls.SITE_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    named = set(re.split(r"[.-]", host)) & set(urls.UNWANTED)
    return (host, path, best[1] if best else None, best[2] if best else "block" if named else "allow")


def test_every_rule(spark):
    pages = spark.createDataFrame([(key, url, "clash", "clash") for key, url in enumerate(URLS * 2)], SCHEMA)
    got = urls.judge_urls(pages, urls.standard_rules(spark))
    assert sorted(name.lower() for name in got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {
        key: expected(url) for key, url in enumerate(URLS * 2)}


def test_empty_tables(spark):
    rules = urls.standard_rules(spark)
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA), rules).collect() == []
    pages = spark.createDataFrame([(1, "http://example.com/en/", "", "")], SCHEMA)
    assert urls.judge_urls(pages, rules.limit(0)).first().verdict == "allow"


def test_rules_without_tokens_and_ends_inside_a_token(spark):
    rules = spark.createDataFrame([urls.site_rule("block", "a.org", "/pre"), ("any", "flag", "^$", [], 5)], urls.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "http://a.org/prefix", "", ""), (2, "nothing", "", ""), (3, "http://a.org/x", "", "")], SCHEMA)
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()} == {
        1: ("a.org/pre", "block"), 2: ("any", "flag"), 3: (None, "allow")}
