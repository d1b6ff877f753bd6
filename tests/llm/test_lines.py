"""Quality rules against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from sealroute.llm import lines

SCHEMA = "doc_id bigint, text string, source string, n_words string, Kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def normal(line):
    return " ".join(WORD.findall("".join(c.lower() if c < "\x80" else c for c in line)))


def expected(rows, least, remaining):
    held = defaultdict(set)
    for row, (key, text, host) in enumerate(rows):
        for line in {normal(one) for one in (text or "").split("\n") if WORD.search(one)}:
            held[host, line].add(("row", row) if key is None else ("id", key))
    common = {place for place, documents in held.items() if len(documents) > least}
    out = []
    for key, text, host in rows:
        found = base(text)
        gone = sum(len(WORD.findall(one)) for one in (text or "").split("\n") if (host, normal(one)) in common)
        out.append((key, *found, gone, not found[-1] and found[0] - gone >= remaining * found[0]))
    return sorted(out, key=str)


def grown(seed):
    source = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ß", "gamma#", "a|b", "7", "8", " x", "d***"]
    shared = [" ".join(source.choices(vocabulary, k=15)) for _ in range(6)]
    rows = []
    for key in range(300):
        own = [" ".join(source.choices(vocabulary + [f"w{source.randrange(999)}"] * 9, k=source.randint(0, 25))) for _ in range(source.randint(0, 6))]
        own += source.sample(shared, source.randint(0, 4))
        source.shuffle(own)
        rows.append((key, source.choice(["\n", "\r\n", "\n\n"]).join(own), source.choice(["a", "a", "a", "b", None, ""])))
    return rows


def result(spark, rows, **options):
    frame = spark.createDataFrame([(*row, "clash", "clash") for row in rows], SCHEMA)
    got = lines.line_rules(frame, **options).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_random_lines(spark):
    rows = grown(1)
    want = expected(rows, 20, 0.5)
    assert result(spark, rows, least=20, remaining=0.5) == want
    assert {row[-1] for row in want} == {True, False} and any(row[-1] is False and not row[-2 - 1] for row in want)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "x y", "a"), (4, long, "a"), (4, long, "a"), (5, "z " * 50_000, "a"),
            (6, "one\n" * 5000, "a"), (7, "a b c a b c", None)]
    assert result(spark, rows) == expected(rows, lines.LEAST, lines.REMAINING)
    assert result(spark, []) == []


def test_rows_of_one_id_are_one_document(spark):
    body = " ".join(f"w{i}" for i in range(60))
    same = [(1, f"one line\n{body}", "a")] * 60
    assert {row[-2] for row in result(spark, same, least=5)} == {0}
    apart = same + [(key, f"one line\n{body}", "a") for key in range(10, 15)]
    assert result(spark, apart, least=5) == expected(apart, 5, 0.5)
    assert {row[-2] for row in result(spark, apart, least=5)} == {62}
    unnamed = [(None, f"own {key}\none line\n{body} {key}", None) for key in range(40)] + [(None, "one line", "a")]
    assert result(spark, unnamed, least=30) == expected(unnamed, 30, 0.5)
    assert {row[-2] for row in result(spark, unnamed, least=30)} == {0, 2}


def test_registered_query_removes_lines(spark):
    from sealroute.llm.queries import QUERIES

    rows = QUERIES["op10_line_rules"][0](spark, "/root/testdata/sf0.01").collect()
    assert sum(row.n_line_words > 0 for row in rows) > 20


def test_common_lines_are_cut(spark):
    own = [" ".join(f"d{key}x{i}" for i in range(60)) for key in range(12)]
    rows = [(key, f"Menu of home\n{own[key]}\nMENU  of home", "h", 1, "clash") for key in range(12)]
    rows += [(50, "Menu of home\n" * 30, "h", 1, "clash"), (51, None, "h", 1, "clash"), (52, f"Menu of home\n{own[0]}", "other", 1, "clash")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, gone_x string")
    got = lines.without_common_lines(frame, least=5)
    assert got.columns == frame.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {
        **{key: (own[key], len(own[key])) for key in range(12)}, 52: (f"Menu of home\n{own[0]}", 1)}
