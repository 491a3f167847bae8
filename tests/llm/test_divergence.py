from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.llm import divergence as d


def plain(rows, least, top):
    import re

    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {w[0] for w in words}:
        docs = Counter(t for la, _, ts in words if la == lang for t in set(ts))
        kept = [t for t, n in docs.items() if n >= least]
        sources = {s for la, s, _ in words if la == lang}
        count = {s: Counter(t for la, so, ts in words if (la, so) == (lang, s) for t in ts if t in kept) for s in sources}
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            over = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", over)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the CAT and É é x1x"),
    ("en", "b", "a dog and the cat\x00the dog"),
    ("en", "b", "a dog and the cat\x00the dog"),
    ("en", None, ""),
    ("en", "c", None),
    (None, "a", "dog dog"),
    ("", None, "dog 💩 cat"),
    ("fr", "a", "chat"),
    ("de", "a", None),
    ("de", "b", "12 ."),
]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 at", "2 n", "3 names", "4 docs", "5 p", "6 term")
    return sorted(map(tuple, d.divergence(df, **kw).collect()))


@pytest.mark.parametrize("least, top", [(1, 50), (2, 2), (3, 50), (9, 50)])
def test_against_a_plain_count(spark, least, top):
    assert run(spark, ROWS, least=least, top=top) == plain(ROWS, least, top)


def test_no_rows(spark):
    assert run(spark, ROWS[:0]) == []
    assert run(spark, [("en", "a", "x")], least=1) == []  # no other source, and no share above the language's


def test_shares_are_exact_beyond_longs(spark):
    big = 9_000_000_000_000_001
    got = spark.createDataFrame([(big, big + 2), (5, 7)], "c long, t long").select(d._share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * big // (big + 2), 1 + 10**9 * 5 // 7]


def test_very_long_text(spark):
    text = "ab cd " * 100_000
    got = spark.createDataFrame([(text,)], "t string").select(d.term_counts(F.col("t")).alias("c")).first().c
    assert [tuple(x) for x in got] == [("ab", 100_000), ("cd", 100_000)]


def test_sql_keeps_terms(sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert con.sql(f"select count(*) from ({d.SQL}) where part = 'term'").fetchall()[0][0] > 0
