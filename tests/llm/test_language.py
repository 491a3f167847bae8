import zlib

import numpy as np
import pytest

from spanloom.llm import language as g
from spanloom.llm import queries


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op2_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the other thing there", "en"), ("der andere dort drüben", "de")] * 12)]
    rows += [(100, None, "en"), (101, "12 34 !!", "de"), (102, "", None), (None, "the thing", "en"), (103, "the thing " * 90_000, None), (104, "theré der", "xx"), (104, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' lang_pred", "1 score", "2 held_out", "3 bucket")
    got = g.identify(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k in (100, 101, 102):
        assert by[k][0].lang_pred == "und" and by[k][0].score == 0 and not by[k][0].shares
    assert by[103][0].lang_pred == "en" and by[None][0].lang_pred == "en" and by[None][0].held_out is False
    assert g.identify(df.limit(0)).count() == 0
    none = g.identify(df.where("lang is null"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_fitted_counts_are_those_of_the_table(spark, monkeypatch):
    rows = [("aa bb aab", "x"), ("aa", "y"), (None, "x"), ("zz", None), ("aa bb", "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    counts = g.trigram_counts(df, "text", "lang").collect()
    langs, tables = g.fit(df)
    assert langs == ["x", "y"]
    for lang, table in zip(langs, tables, strict=True):
        n = np.zeros(g.BUCKETS)
        for r in counts:
            n[r.bucket] += r.n * (r.lang == lang)
        assert n.sum() > 0 and np.allclose(table, np.log((n + g.SMOOTHING) / (n.sum() + g.SMOOTHING * g.BUCKETS)), atol=1e-5)
    monkeypatch.setattr(g, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        g.fit(df)


def test_mixture_shares_and_many_languages():
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.full(g.BUCKETS, 0.001), 9) + 1e-9).astype(np.float32)
    tops = [np.argsort(-row)[:50] for row in logs]
    words = [rng.choice(tops[2], 5) for _ in range(60)] + [rng.choice(tops[7], 5) for _ in range(40)] + [rng.choice(tops[1], 5) for _ in range(30)]
    bucket, first = np.concatenate(words), np.arange(0, 650, 5)
    share, _ = g.mixtures(logs, bucket, first, np.repeat([0, 1], [100, 30]))
    found = [{k: float(s) for k, s in enumerate(own) if s > 0} for own in share]
    assert set(found[0]) == {2, 7} and abs(found[0][2] - 0.6) < 0.02
    assert found[1] == {1: 1.0}


def plain_mixture(logs, words):
    """Shares and log-likelihood of one document by the definition, a word at a time."""
    like = [[np.exp(sum(float(row[b]) for b in word) - max(sum(float(r[b]) for b in word) for r in logs)) + 1e-12 for row in logs] for word in words]

    def em(share, steps):
        for _ in range(steps):
            odds = [[p * s for p, s in zip(own, share, strict=True)] for own in like]
            share = [sum(o[k] / sum(o) for o in odds) / len(like) for k in range(len(share))]
        return share, sum(np.log(sum(p * s for p, s in zip(own, share, strict=True))) for own in like)

    share, fit = em([1 / len(logs)] * len(logs), g.STEPS)
    while sum(s > 0 for s in share) > 1:
        least = min((s, k) for k, s in enumerate(share) if s > 0)[1]
        rest = 1 - share[least]
        less, fit_less = em([0 if k == least else s / rest for k, s in enumerate(share)], g.AGAIN)
        if fit - fit_less >= g.PENALTY * np.log(len(words) + 1):
            break
        share, fit = less, fit_less
    return share, fit


def test_mixtures_agree_with_a_plain_em_over_all_languages():
    rng = np.random.default_rng(6)
    logs = np.log(rng.dirichlet(np.full(40, 0.2), 9) + 1e-4).astype(np.float32)
    docs = [[rng.integers(0, 40, rng.integers(1, 6)) for _ in range(rng.integers(1, 25))] for _ in range(12)]
    words = [w for d in docs for w in d]
    first = np.cumsum([0, *map(len, words)])[:-1]
    share, fit = g.mixtures(logs, np.concatenate(words), first, np.repeat(np.arange(12), [len(d) for d in docs]))
    for k, d in enumerate(docs):
        want, best = plain_mixture(logs, d)
        assert np.allclose(share[k], want, atol=1e-3) and abs(fit[k] - best) < 1e-2
