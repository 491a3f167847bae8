import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import tensors as t
from spanloom.operators import segments


def frame(spark, arrays, kind="int"):
    rows = [(i, None if a is None else (list(map(int, a.shape)), a.ravel().tolist())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"i int, t struct<shape:array<int>,values:array<{kind}>>")


def back(x):
    return None if x is None else np.array(x["values"]).reshape(x["shape"])


def ragged(seed, ndim, n=40):
    rng = np.random.default_rng(seed)
    return [rng.integers(1, 99, rng.integers(1, 5, ndim)) for _ in range(n)]


@pytest.mark.parametrize("ndim", [1, 2, 3, 4])
def test_stacking(spark, ndim):
    arrays = [*ragged(ndim, ndim), np.zeros((0,) * ndim, int)]
    df = frame(spark, arrays)
    top = tuple(int(x) for x in np.array([a.shape for a in arrays]).max(axis=0))
    assert t.max_shape(df, "t") == top
    for asked, trim in ((None, False), ((-1,) * ndim, False), ((*(-1,) * (ndim - 1), 7), False), ((2,) * ndim, True)):
        shape = t.limits(df, "t", asked)
        got = df.select("i", t.stack(F.col("t"), shape, F.lit(-1), trim).alias("s"), t.stack_mask(F.col("t"), shape).alias("m")).collect()
        assert len(got) == len(arrays)
        for r in got:
            a = arrays[r.i]
            want, mask = np.full(shape, -1), np.zeros(shape, bool)
            cut = tuple(slice(0, min(s, l)) for s, l in zip(a.shape, shape))
            want[cut], mask[cut] = a[cut], True
            assert np.array_equal(back(r.s), want) and np.array_equal(back(r.m), mask)
            assert trim or np.array_equal(back(r.s)[mask], a.ravel())


def test_masking(spark):
    a = np.arange(24).reshape(2, 3, 4)
    mask = np.random.default_rng(1).random(a.shape) < 0.5
    df = frame(spark, [a]).join(frame(spark, [mask], "boolean").withColumnRenamed("t", "m"), "i")
    assert np.array_equal(back(df.select(t.mask_false(F.col("t"), F.col("m"), F.lit(0)).alias("x")).first().x), np.where(mask, a, 0))
    other = frame(spark, [mask[:1]], "boolean").withColumnRenamed("t", "m")
    with pytest.raises(Exception, match="differ in shape"):
        frame(spark, [a]).join(other, "i").select(t.mask_false(F.col("t"), F.col("m"), F.lit(0))).collect()


@pytest.mark.parametrize("ndim, size", [(2, 3), (3, 2), (3, 4), (4, 1)])
def test_chunks(spark, ndim, size):
    arrays = [*ragged(ndim + size, ndim), np.zeros((2, 0, *[1] * (ndim - 2)), int), np.zeros((0, 3, *[1] * (ndim - 2)), int)]
    for r in frame(spark, arrays).select("i", t.chunk_steps(F.col("t"), size, F.lit(-5), ndim).alias("c")).collect():
        a = arrays[r.i]
        steps = -(-a.shape[1] // size)
        full = np.full((a.shape[0], steps * size, *a.shape[2:]), -5)
        full[:, : a.shape[1]] = a
        want = np.split(full, steps, axis=1) if steps else []
        assert len(r.c) == steps and all(np.array_equal(back(x), w) for x, w in zip(r.c, want))


def test_nested_arrays(spark):
    df = spark.createDataFrame([(0, [[[1, 2], [3, 4]]]), (1, []), (2, None), (3, [[], []])], "i int, a array<array<array<int>>>")
    got = {r.i: r.x and (r.x.shape, r.x["values"]) for r in df.select("i", t.from_nested(F.col("a"), 3).alias("x")).collect()}
    assert got == {0: ([1, 2, 2], [1, 2, 3, 4]), 1: ([0, 0, 0], []), 2: None, 3: ([2, 0, 0], [])}
    bad = spark.createDataFrame([(0, [[[1], [3, 4]]])], "i int, a array<array<array<int>>>")
    with pytest.raises(Exception, match="ragged"):
        bad.select(t.from_nested(F.col("a"), 3)).collect()


def test_what_does_not_fit_is_an_error(spark):
    df = frame(spark, [np.ones((2, 3), int), None])
    assert df.where("i = 1").select(t.stack(F.col("t"), (2, 2), F.lit(0)).alias("x")).first().x is None
    for act, message in (
        (lambda: df.select(t.stack(F.col("t"), (2, 2), F.lit(0))).collect(), "doesn't fit"),
        (lambda: df.select(t.stack(F.col("t"), (2, 3, 1), F.lit(0))).collect(), "number of dimensions"),
        (lambda: df.select(t.tensor(F.col("t.values"), F.array(F.lit(4)))).collect(), "differ in number"),
        (lambda: t.limits(df.where("i = 0"), "t", (1, 2, 3)), "number of dimensions"),
        (lambda: t.limits(df.where("i = 0"), "t", (0, 3)), "positive"),
        (lambda: t.max_shape(df.limit(0), "t"), "no arrays"),
        (lambda: t.max_shape(frame(spark, [np.ones(2, int), np.ones((2, 2), int)]), "t"), "number of dimensions"),
        (lambda: t.chunk_steps(F.col("t"), 0, F.lit(0), 2), "at least one step"),
    ):
        with pytest.raises(Exception, match=message):
            act()


@pytest.mark.parametrize("ndim", [2, 3])
def test_scattering(spark, ndim):
    rng = np.random.default_rng(ndim)
    rows, want = [], {}
    for doc in range(12):
        rest = tuple(rng.integers(1, 4, ndim - 1))
        at, out, k = 3, [], 0
        for k in range(rng.integers(1, 4)):
            n, gap = int(rng.integers(1, 4)), int(rng.integers(0, 3)) if k else 0
            a = rng.integers(1, 99, (n, *rest))
            out += [np.full((gap, *rest), -1), a]
            at += gap
            rows.append((doc, k, at, at + n, (list(map(int, a.shape)), a.ravel().tolist())))
            at += n
        want[doc] = np.concatenate(out)
    df = spark.createDataFrame(rows, "doc_id int, ord int, start int, stop int, data struct<shape:array<int>,values:array<int>>")
    got = segments.scatter_tensors(df, F.lit(-1), ndim).collect()
    assert len(got) == 12 and all(r.start == 3 and np.array_equal(back(r.tensor), want[r.doc_id]) for r in got)
    one = df.where("doc_id = 0 and ord = 0")
    size = rows[0][4][0][1:]
    flat = one.withColumn("stop", F.col("stop") + 0).unionByName(one.withColumn("ord", F.lit(1)).withColumn("start", F.col("stop") + 1).withColumn("stop", F.col("start") + F.col("data.shape")[0]))
    fill = F.array(*[F.lit(i) for i in range(int(np.prod(size)))])
    found = back(segments.scatter_tensors(flat, fill, ndim).first().tensor)
    assert found[rows[0][4][0][0]].ravel().tolist() == list(range(int(np.prod(size))))
    with pytest.raises(Exception, match="another shape"):
        segments.scatter_tensors(flat, F.array(*[F.lit(0)] * 50), ndim).collect()
