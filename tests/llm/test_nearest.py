import numpy as np
import pytest

from spanloom.llm import nearest as n


def plain(rows, k=10, every=100):
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q % every:
            continue
        near = sorted((float(np.sqrt(((np.float64(w) - np.float64(v)) ** 2).sum())), i) for j, (i, w) in enumerate(ok) if j != at and len(w) == len(v))
        out += [(q, r, i, round(d, 9)) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 sid", "2 low", "3 dim", "4 d", "5 w", "6 list")
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in n.nearest(df, **kw).collect())


def floats(x):
    return [float(v) for v in np.float32(x)]


def test_edges_ties_and_repeats(spark):
    v, nan = [1.0, 2.0, 0.0], float("nan")
    rows = [(k, v) for k in range(30)] + [(100, v), (100, v), (200, [1.0, 2.0, 1.0]), (201, [1.0, 2.0, -1.0]), (300, [5.0]), (400, None), (500, [0.0] * 3)]
    rows += [(600, [None, 1.0, 1.0]), (700, [nan, 1.0, 1.0]), (800, []), (None, v), (900, [float("inf"), 1.0, 0.0]), (-100, [4.0, 4.0]), (3, [4.0, 5.0]), (100, [9.0, 9.0, 9.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (100, None)]) == []
    assert run(spark, [(100, v)]) == []


def test_blocks_and_small_lists_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, floats(rng.normal(size=6).round(1))) for k in range(700)] + [(5000 + k, floats(np.ones(6))) for k in range(300)]
    rows += [(7000 + k, floats(np.ones(6) + rng.normal(size=6) * 1e-3)) for k in range(300)]
    monkeypatch.setattr(n, "BLOCK", 50)
    assert run(spark, rows) == plain(rows)


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


@pytest.mark.parametrize("kind", ["clusters", "sphere", "copies"])
def test_recall_over_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(n, "FLAT", 256)
    rng = np.random.default_rng(4)
    if kind == "sphere":
        x = rng.normal(size=(3000, 24))
    elif kind == "clusters":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] * 3 + rng.normal(size=(3000, 24))
    else:
        x = np.where(rng.random((3000, 1)) < 0.4, np.ones((1, 24)) + rng.normal(size=(3000, 24)) * 1e-3, rng.normal(size=(3000, 24)))
    rows = [(k, floats(v)) for k, v in enumerate(x)]
    got, want = run(spark, rows, every=20), plain(rows, every=20)
    assert recall(got, want) >= 0.95
    assert len(got) == len(want)
    exact = {(q, i): d for q, _, i, d in want}
    assert all(exact.get((q, i), d) == d for q, _, i, d in got)


def test_a_query_with_too_few_vectors_in_its_lists_reads_all(spark, monkeypatch):
    monkeypatch.setattr(n, "FLAT", 64)
    monkeypatch.setattr(n, "list_count", lambda m: 64)
    monkeypatch.setattr(n, "PER_LIST", 2)
    monkeypatch.setattr(n, "LEAST_LISTS", 1)
    monkeypatch.setattr(n.Index, "_fit_ratio", lambda self, sample: 1.0)
    rng = np.random.default_rng(6)
    rows = [(k, floats(rng.normal(size=8))) for k in range(300)]
    got = run(spark, rows, every=10)
    assert len(got) == 300 and all(a[3] <= b[3] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_balanced_groups_and_graph():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 8)), np.ones((600, 8))])
    c = n.balanced_centroids(x, 64)
    assert c.shape == (64, 8)
    g = n.Graph(rng.normal(size=(500, 8)))
    hits = [g.search(q, 1.0, 1)[0][0] == ((g.centroids - q) ** 2).sum(axis=1).argmin() for q in rng.normal(size=(200, 8))]
    assert np.mean(hits) >= 0.98


def test_recall_on_the_table(spark):
    from spanloom.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in queries.op13_nearest(spark, sf).collect()]
    want = plain(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.95
