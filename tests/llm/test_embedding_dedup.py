import numpy as np

from spanloom.llm import embedding_dedup as e
from spanloom.llm.common import hashed_share
from spanloom.llm.graph import local_components


def plain(rows, threshold=e.THRESHOLD):
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in ok}
    pairs = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    label = local_components(len(rows), *(np.array([p[i] for p in pairs], int) for i in (0, 1)))
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((i, sum(a == k for a, _ in pairs), low, i is not None and i == low))
    return sorted(out, key=str)


def make(seed, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=16)
        if k % 3 == 0:
            v = np.array(rows[rng.integers(0, len(rows))][1] if rows else v) + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.3])
        rows.append((k, [float(x) for x in np.float32(v)], int(rng.integers(0, 3))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 n", "2 nid", "3 dim", "4 links", "5 component_id")


def test_all_pairs_are_found_and_nulls_link_with_nothing(spark, monkeypatch):
    rows = make(1)
    v, nan = rows[0][1], float("nan")
    rows += [(1000, v, None), (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [None, *v[1:]], rows[0][2]), (1004, [nan, *v[1:]], rows[0][2]), (1005, [float("inf"), *v[1:]], 1)]
    rows += [(1006, [], 1), (1007, v[:9], rows[0][2]), (1008, v, rows[0][2]), (1008, v, rows[0][2]), (None, v, rows[0][2]), (None, [9.0, *([-1.0] * 15)], 2)]
    df = frame(spark, rows)
    want = plain(rows)
    for block in (e.BLOCK, 40):  # also when groups are dealt over tasks
        monkeypatch.setattr(e, "BLOCK", block)
        got = sorted((tuple(r) for r in e.near_vectors(df).collect()), key=str)
        assert len(got) == len(rows)
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert found <= there and found >= 0.99 * there
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.01 * len(rows)


def test_ties_and_edges(spark):
    same = [(k, [1.0, 2.0, 3.0], 1) for k in range(30)] + [(40, [-1.0, 0.0, 0.0], 1)]
    got = {r.vec_id: tuple(r)[1:] for r in e.near_vectors(frame(spark, same)).collect()}
    assert got == {k: (29, 0, k == 0) for k in range(30)} | {40: (0, 40, True)}
    assert e.near_vectors(frame(spark, same).limit(0)).count() == 0
    bad = e.near_vectors(frame(spark, [(1, None, 1), (None, None, None)])).collect()
    assert sorted(map(tuple, bad), key=str) == [(1, 0, 1, True), (None, 0, None, False)]


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    from spanloom.llm import queries

    got = sorted((tuple(r) for r in queries.op10_embedding_dedup(spark, sf).collect()), key=lambda r: r[0])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= e.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = dict(zip([r[0] for r in rows], near.sum(axis=1).tolist(), strict=True))
    assert sum(r[1] for r in got) >= 0.99 * sum(want.values()) and all(r[1] <= want[r[0]] for r in got)


def test_a_longer_vector_does_not_narrow_the_search(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3000):  # pairs of neighbours
        v = rng.normal(size=16) if k % 2 == 0 else np.array(rows[-1][1]) + rng.normal(size=16) * 0.3
        rows.append((k, [float(x) for x in np.float32(v)], 1))
    rows.append((9999, [float(x) for x in np.float32(rng.normal(size=4096))], 1))
    x = np.array([v for _, v, _ in rows[:-1]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    there = int((x @ x.T >= e.THRESHOLD).sum()) - len(x)
    found = sum(r.n_links for r in e.near_vectors(frame(spark, rows)).collect())
    assert 0.99 * there <= found <= there


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    taken = []
    real = e.Quantiser.__init__
    monkeypatch.setattr(e.Quantiser, "__init__", lambda self, sample, n, seed=11: taken.append(sample.nbytes) or real(self, sample, n, seed))
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=768))], 1) for k in range(800)]
    monkeypatch.setattr(e, "SAMPLE_BYTES", 8 * 768 * 200)
    links = e.near_vectors(frame(spark, [*rows, *[(1000 + k, v, 1) for k, v, _ in rows[:50]]]))
    assert sum(r.n_links for r in links.collect()) == 100
    assert 0 < taken[0] <= 1.4 * 8 * 768 * 200


def test_shares_of_rows(spark):
    df = spark.range(20_000)
    assert df.where(hashed_share("id", 1.0)).count() == df.where(hashed_share("id", 7.5)).count() == 20_000
    assert 1800 < df.where(hashed_share("id", 0.1)).count() < 2200
