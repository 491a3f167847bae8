import itertools
import random
import zlib

import numpy as np

from spanloom.llm import queries
from spanloom.llm import toxicity as t


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = t.Machine(np.array([3, 5, 9]), -0.3, rng.normal(size=3), rng.normal(size=(3, 4)))
    for on in ([], [0], [0, 2], [0, 1, 2]):
        raw = m.bias + sum(m.weights[i] for i in on) + sum(m.factors[i] @ m.factors[j] for i in on for j in on if i < j)
        assert abs(m.score({int(m.terms[i]) for i in on} | {4}) - 1 / (1 + np.exp(-raw))) < 1e-12


def test_learns_a_pair_that_neither_word_tells():
    rng = random.Random(1)
    docs, labels = [], []
    for _ in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(12)]
        a, b = rng.random() < 0.4, rng.random() < 0.4
        docs.append(np.array(sorted(t.term_buckets(" ".join(words + ["insult"] * a + ["group"] * b)))))
        labels.append(int(a and b))
    m = t.fit(docs, np.array(labels))
    score = lambda x: m.score(t.term_buckets(x))
    assert score("insult group w1") > 0.9 and max(score("insult w1"), score("group w1"), score("w1")) < 0.3


def test_learns_a_pair_of_words_that_tell_nothing_alone():
    rng = random.Random(2)
    docs, labels = [], []
    for _ in range(3000):
        words = [f"w{rng.randrange(400)}" for _ in range(15)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array(sorted(t.term_buckets(" ".join(words + ["insult"] * a + ["group"] * b)))))
        labels.append(int(a != b))
    m = t.fit(docs, np.array(labels))
    score = lambda x: m.score(t.term_buckets(x))
    assert min(score("insult w1"), score("group w1")) > 0.8 and max(score("insult group w1"), score("w1")) < 0.2


def test_learns_a_pair_among_thousands_of_more_frequent_words():
    rng = random.Random(3)
    docs, labels = [], []
    for _ in range(8000):
        u = rng.random()
        a, b = u < 0.04, 0.02 <= u < 0.06  # each tells nothing of the label alone
        words = [f"w{i}" for i in rng.sample(range(3500), 175)]
        docs.append(np.array(sorted(t.term_buckets(" ".join(words + ["insult"] * a + ["group"] * b)))))
        labels.append(1 if a and b else 0 if a or b else int(rng.random() < 0.5))
    m = t.fit(docs, np.array(labels))
    score = lambda x: m.score(t.term_buckets(x))
    assert score("insult group w1") > 0.9 and max(score("insult w1"), score("group w1")) < 0.1 and 0.3 < score("w1") < 0.7


def plain_pairs(rows: list[set[int]], labels: list[int]) -> set[int]:
    """Terms of telling pairs, from each pair's four cells."""
    share = sum(labels) / len(labels)
    got = set()
    for a, b in itertools.combinations(sorted(set().union(*rows)), 2):
        gap, spread, least, odds, wide = 0.0, 0.0, len(rows), 0.0, 0.0
        for with_a, with_b in itertools.product((True, False), repeat=2):
            cell = [y for r, y in zip(rows, labels, strict=True) if (a in r) == with_a and (b in r) == with_b]
            gap += (1 if with_a == with_b else -1) * (sum(cell) + 0.5) / (len(cell) + 1)
            spread += share * (1 - share) / (len(cell) + 1)
            least = min(least, len(cell))
            yes, no = sum(cell) + 0.5, len(cell) - sum(cell) + 0.5
            odds += (1 if with_a == with_b else -1) * np.log(yes / no)
            wide += 1 / yes + 1 / no
        if least >= t.LEAST_CELL and abs(gap) >= t.PAIR_Z * spread**0.5 and abs(odds) >= t.LEAST_Z * wide**0.5:
            got |= {a, b}
    return got


def test_pairs_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [{k for k in range(12) if rng.random() < 0.4} for _ in range(400)]
        labels = [int((1 in r) ^ (2 in r) ^ (rng.random() < 0.1)) for r in rows]
        own = t.Sample([np.array(sorted(r), int) for r in rows], np.array(labels)).common()
        want = plain_pairs(rows, labels)
        assert {int(own.terms[i]) for i in own.telling_pairs()} == want and want
        assert {int(own.terms[i]) for p in range(3) for i in own.telling_pairs(p, 3)} == want
        assert t.in_tasks(spark, own).tolist() == own.telling_pairs().tolist()


def test_the_query_is_that_of_a_plain_one(spark):
    rng = random.Random(6)
    words = ["idiot", "scum", "those", "people", *[f"w{i}" for i in range(30)]]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(600)]
    toxic = [int("idiot" in x or ("scum" in x and "people" in x)) for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in t.score(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")).collect()}
    known = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [t.term_buckets(texts[i]) for i in known]
    y = np.array([toxic[i] for i in known])
    own = plain_pairs(rows, y.tolist())
    for term in set().union(*rows):
        has = np.array([term in r for r in rows])
        p = has.mean()
        z = abs(has[y == 1].mean() - has[y == 0].mean()) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / y.sum() + 1 / (1 - y).sum()))
        own |= {term} if has.sum() >= t.LEAST_DOCS and z >= t.LEAST_Z else set()
    m = t.fit([np.array(sorted(r)) for r in rows], y)
    assert set(m.terms.tolist()) == own and zlib.crc32(b"idiot") % t.BUCKETS in own
    for i in range(600):
        assert got[i].held_out == (i not in set(known)) and got[i].predicted == int(got[i].score >= 0.7)
        at = [k for k, term in enumerate(m.terms) if int(term) in t.term_buckets(texts[i])]
        raw = m.bias + sum(m.weights[k] for k in at) + sum(m.factors[j] @ m.factors[k] for j in at for k in at if j < k)
        assert abs(got[i].score - 1 / (1 + np.exp(-raw))) < 1e-6


def test_training_is_that_of_a_plain_machine(monkeypatch):
    monkeypatch.setattr(t, "STEPS", 4)
    rng = np.random.default_rng(4)
    x = rng.random((60, 6)) < 0.5
    y = (x[:, 0] | (x[:, 1] & x[:, 2])).astype(int)
    m = t.fit([np.flatnonzero(r) for r in x], y)
    use = m.terms
    bias, w, v = np.log((y.sum() + 1) / (60 - y.sum() + 1)), np.zeros(len(use)), np.random.default_rng(7).normal(0, 0.05, (len(use), t.FACTORS))
    at = np.concatenate([[bias], w, v.ravel()])
    mean, spread = np.zeros_like(at), np.zeros_like(at)

    def loss(at):
        b, w, v = at[0], at[1 : 1 + len(use)], at[1 + len(use) :].reshape(len(use), -1)
        total = t.SHRINK / 2 * ((w**2).sum() + (v**2).sum())
        for row, label in zip(x, y, strict=True):
            on = [i for i, term in enumerate(use) if row[term]]
            raw = b + sum(w[i] for i in on) + sum(v[i] @ v[j] for i in on for j in on if i < j)
            total += (np.log1p(np.exp(raw)) - label * raw) / len(y)
        return total

    for step in range(1, 5):
        slope = np.array([(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(len(at)) * 1e-5])
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        at = at - t.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    assert len(use) and np.allclose(at, np.concatenate([[m.bias], m.weights, m.factors.ravel()]), atol=5e-3)


def test_held_out_rows(spark, sf_dir):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in labels)
    toxic = np.array([got[r.doc_id].score for r in labels if r.toxic == 1])
    clean = np.array([got[r.doc_id].score for r in labels if r.toxic == 0])
    assert np.mean(toxic[:, None] > clean[None, :]) > 0.9  # a tenth of the toxic labels here are of texts turned to junk
    assert np.mean(clean >= t.THRESHOLD) < 0.01 and np.mean(toxic >= t.THRESHOLD) > 0.75


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "idiot " * 50_000), (3, "idiot")], "doc_id long, text string").selectExpr("*", "1 toxic", "2 score", "3 terms")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int").selectExpr("*", "'x' text")
    got = t.score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert t.score(docs.limit(0), labels).count() == 0
    alone = t.score(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in alone} == {0.5} and {r.predicted for r in alone} == {0}
    assert t.drop_toxic(docs, labels.limit(0)).columns == docs.columns
