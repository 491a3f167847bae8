import random

import pytest

from pyspark.sql import functions as F

from spanloom.operators import segments as s

IV = "doc_id int, ord int, start int, stop int, data string"
TG = "doc_id int, ord int, start int, stop int"


def overlap(a, b):
    return b[0] <= a[0] < b[1] or a[0] <= b[0] < a[1]


def points_of(ivs, targets):
    """Targets in order take the run of intervals that they overlap from what is left."""
    left, out = sorted(ivs), []
    for t in sorted(targets, key=lambda t: t[0]):
        while left and left[0][1] <= t[0]:
            left.pop(0)
        run = []
        while left and overlap(left[0], t):
            run.append(left.pop(0))
        out += [b - 1 for _, b in run[:-1]]
    return out


def stitched(ivs, points):
    groups, join = [], False
    for iv in sorted(ivs):
        groups[-1].append(iv) if join else groups.append([iv])
        join = any(iv[0] <= p < iv[1] for p in points)
    return [(g[0][0], g[-1][1], len(g)) for g in groups]


def documents(seed, n=60):
    rng = random.Random(seed)
    for doc in range(n):
        at, ivs = 0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.randint(0, 2)
            size = rng.randint(1, 4)
            ivs.append((at, at + size))
            at += size
        targets = [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, at) for _ in range(rng.randint(0, 5)))]
        yield doc, ivs, targets


def test_stitching_follows_the_model(spark):
    docs = list(documents(1))
    ivs = spark.createDataFrame([(d, i, a, b, f"w{i}") for d, x, _ in docs for i, (a, b) in enumerate(x)], IV)
    tgs = spark.createDataFrame([(d, i, a, b) for d, _, x in docs for i, (a, b) in enumerate(x)], TG)
    points = s.stitch_points(ivs, tgs)
    got = {}
    for r in points.collect():
        got.setdefault(r.doc_id, []).append(r.point)
    assert {d: sorted(p) for d, x, t in docs if (p := points_of(x, t))} == {d: sorted(p) for d, p in got.items()}
    merged = {}
    for r in s.stitch(ivs, points).orderBy("doc_id", "grp").collect():
        merged.setdefault(r.doc_id, []).append((r.start, r.stop, len(r.data)))
    assert merged == {d: stitched(x, points_of(x, t)) for d, x, t in docs}


def test_no_points_change_nothing(spark):
    ivs = spark.createDataFrame([(1, 0, 0, 3, "a"), (1, 1, 4, 6, "b")], IV)
    none = spark.createDataFrame([], "doc_id int, point int")
    assert [(r.start, r.stop, r.data) for r in s.stitch(ivs, none).orderBy("start").collect()] == [(0, 3, ["a"]), (4, 6, ["b"])]


def test_points_outside_are_errors(spark):
    ivs = spark.createDataFrame([(1, 0, 0, 3, "a")], IV)
    for point in (-1, 3):
        with pytest.raises(Exception, match="outside"):
            s.stitch(ivs, spark.createDataFrame([(1, point)], "doc_id int, point int")).collect()


def test_buckets_give_the_same_pairs(spark):
    docs = list(documents(2))
    ivs = spark.createDataFrame([(d, i, a, b, "") for d, x, _ in docs for i, (a, b) in enumerate(x)], IV)
    tgs = spark.createDataFrame([(d, i, a, b) for d, _, x in docs for i, (a, b) in enumerate(x)], TG)
    pick = ["doc_id", "ord", "t_ord"]
    plain = sorted(map(tuple, s.overlaps(ivs, tgs).select(*pick).collect()))
    assert plain and sorted(map(tuple, s.overlaps_in_buckets(ivs, tgs, 5).select(*pick).collect())) == plain


def test_borders(spark):
    df = spark.createDataFrame([(1, 0, "amino acid"), (1, 1, "is any"), (1, 2, None), (2, 0, "")], "doc int, k int, text string")
    got = {(r.doc, r.k): (r.start, r.stop) for r in s.segment_borders(df, "doc", "k").collect()}
    assert got == {(1, 0): (0, 10), (1, 1): (10, 16), (1, 2): (16, 16), (2, 0): (0, 0)}
    got = {(r.doc, r.k): (r.start, r.stop) for r in s.sentence_borders(df, "doc", "k").collect()}
    assert got[1, 1] == (11, 17) and got[1, 2] == (18, 18)


def test_scatter_undoes_extract(spark):
    text = "ab cde  f"
    rows = [(1, i, a, b, text[a:b]) for i, (a, b) in enumerate([(3, 6), (0, 2), (8, 9)])]
    df = spark.createDataFrame(rows, IV)
    assert "".join(s.scatter(df, F.lit(" ")).first().chars) == text
    bad = spark.createDataFrame([(1, 0, 0, 9, "x" * 9), (1, 1, 1, 2, "y")], IV)
    with pytest.raises(Exception, match="reaches past"):
        s.scatter(bad, F.lit(" ")).collect()
    with pytest.raises(Exception, match="differ in length"):
        s.scatter(spark.createDataFrame([(1, 0, 0, 2, "x")], IV), F.lit(" ")).collect()
