import numpy as np
import pytest

from spanloom.operators import layers as la

KIND = "struct<shape:array<int>,values:array<double>>"
RNG = np.random.default_rng(3)


def w(*shape):
    return RNG.normal(size=shape)


def lstm(features, units, **kw):
    return la.Lstm(w(features, 4 * units), w(units, 4 * units), w(4 * units), **kw)


def frame(spark, arrays):
    rows = [(i, None if a is None else (list(a.shape), a.ravel().tolist())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"i int, t {KIND}")


def back(df):
    return {r.i: None if r.output is None else np.array(r.output["values"]).reshape(r.output.shape) for r in df.collect()}


def sample(n=25, features=3):
    return [w(int(k), features) for k in RNG.integers(1, 9, n)] + [np.zeros((0, features)), None]


def plain_cell(cell, x, state=None):
    """Step by step, number by number."""
    h = np.zeros(cell.units) if state is None else state[0]
    c = np.zeros(cell.units) if state is None else state[-1]
    out = []
    for row in x:
        z = [sum(row[f] * cell.kernel[f, j] for f in range(len(row))) + sum(h[u] * cell.recurrent[u, j] for u in range(cell.units)) + cell.bias[j] for j in range(len(cell.bias))]
        if isinstance(cell, la.Simple):
            h = np.tanh(z)
        else:
            i, f, g, o = np.split(np.array(z), 4)
            c = cell.gate(f) * c + cell.gate(i) * np.tanh(g)
            h = cell.gate(o) * np.tanh(c)
        out.append(np.array(h))
    return np.array(out).reshape(len(x), cell.units), (np.array(h), np.array(c)) if cell.states == 2 else (np.array(h),)


def plain_both(layer, x, state=None):
    ahead, after = plain_cell(layer.forward, x, state)
    if layer.backward is None:
        return ahead, after
    behind = plain_cell(layer.backward, x[::-1])[0][::-1]
    joined = {"concat": np.hstack([ahead, behind]), "sum": ahead + behind, "mul": ahead * behind, "ave": (ahead + behind) / 2}
    return joined[layer.merge], after


@pytest.mark.parametrize("padding", ["same", "valid"])
@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_convolutions(spark, padding, width):
    arrays, one, two = sample(), la.Convolution(w(width, 3, 4), w(4), padding), la.Convolution(w(2, 4, 2), w(2), "same", la.linear)
    got = back(la.apply_layers(frame(spark, arrays), "t", [one, two]))

    def plain(layer, x):
        n, k = len(x), len(layer.kernel)
        shift = (k - 1) // 2 if layer.padding == "same" else 0
        places = range(n if layer.padding == "same" else max(0, n - k + 1))
        at = lambda i: x[i] if 0 <= i < n else np.zeros(x.shape[1])
        return layer.activation(np.array([sum(at(p + j - shift) @ layer.kernel[j] for j in range(k)) + layer.bias for p in places]).reshape(len(places), len(layer.bias)))

    for i, a in enumerate(arrays):
        if a is None:
            assert got[i] is None
        else:
            first = plain(one, a)
            assert len(first) == 0 and len(got[i]) == 0 or np.allclose(got[i], plain(two, first))


@pytest.mark.parametrize("merge", [None, *la.MERGES])
def test_recurrent_layers(spark, merge, monkeypatch):
    monkeypatch.setattr(la, "BATCH_CELLS", 60)
    arrays = sample()
    make = lambda a, b: la.Recurrent(a, None if merge is None else b, merge or "sum")
    first = make(lstm(3, 2), lstm(3, 2, gate=la.sigmoid))
    second = make(la.Simple(w(4 if merge == "concat" else 2, 3), w(3, 3), w(3)), la.Simple(w(4 if merge == "concat" else 2, 3), w(3, 3), w(3)))
    got = back(la.apply_layers(frame(spark, arrays), "t", [first, second]))
    for i, a in enumerate(arrays):
        assert got[i] is None if a is None else len(a) == len(got[i]) and np.allclose(got[i].ravel(), plain_both(second, plain_both(first, a)[0])[0].ravel())


def test_embeddings(spark):
    vectors = w(5, 3)
    df = spark.createDataFrame([(0, [1, 0, 4]), (1, []), (2, None), (3, [0])], "i int, c array<int>")
    got, masked = back(la.embed(df, "c", vectors)), back(la.embed(df, "c", vectors, mask_zero=True))
    assert np.allclose(got[0], vectors[[1, 0, 4]]) and np.allclose(masked[0], vectors[[1, 4]])
    assert got[1].shape == masked[3].shape == (0, 3) and got[2] is None
    with pytest.raises(Exception, match="no vector"):
        la.embed(spark.createDataFrame([(0, [5])], "i int, c array<int>"), "c", vectors).collect()


@pytest.mark.parametrize("mask", [True, False])
def test_word_embeddings_from_characters(spark, mask):
    vectors, a, b = w(6, 3), lstm(3, 2), lstm(3, 2)
    rows = [(0, [[1, 2, 0], [3, 0, 0], [0, 0, 0]]), (1, []), (2, None), (3, [[5, 4, 1]]), (4, [[], None, [2]])]
    got = back(la.embed_words(spark.createDataFrame(rows, "i int, c array<array<int>>"), "c", vectors, a, b, mask_zero=mask))
    for i, words in rows:
        if words is None:
            assert got[i] is None
            continue
        codes = [[c for c in word or () if c or not mask] for word in words]
        want = [np.concatenate([plain_cell(a, vectors[c].reshape(-1, 3))[1][0], plain_cell(b, vectors[c[::-1]].reshape(-1, 3))[1][0]]) for c in (np.array(c, int) for c in codes)]
        assert np.allclose(got[i], np.array(want).reshape(len(words), 4))


@pytest.mark.parametrize("rows_a_batch", [3, 1000])
def test_state_goes_on_forward_only(spark, rows_a_batch):
    layer = la.Recurrent(lstm(2, 2), lstm(2, 2), "concat")
    rows, want, k = [], {}, 0
    for doc in [*range(20), None]:
        state = None
        for order in range(int(RNG.integers(1, 6))):
            chunk = None if RNG.random() < 0.1 else w(int(RNG.integers(0, 5)), 2)
            rows.append((k, doc, order, None if chunk is None else (list(chunk.shape), chunk.ravel().tolist())))
            if chunk is not None and len(chunk):
                want[k], state = plain_both(layer, chunk, state)
            else:
                want[k] = chunk
            k += 1
    RNG.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], f"i int, doc int, ord int, t {KIND}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = back(la.half_stateful(df, "doc", "ord", "t", layer))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(want[i] is None and got[i] is None or np.allclose(want[i].ravel(), got[i].ravel()) for i in want)


def test_chunks_are_as_one_pass(spark):
    layer = la.Recurrent(lstm(2, 3))
    x = w(50, 2)
    df = spark.createDataFrame([(i, 1, i, ([len(c), 2], c.ravel().tolist())) for i, c in enumerate(np.split(x, [7, 9, 30]))], f"i int, doc int, ord int, t {KIND}")
    got = back(la.half_stateful(df, "doc", "ord", "t", layer))
    assert np.allclose(np.concatenate([got[i] for i in range(4)]), plain_cell(layer.forward, x)[0])


def test_errors():
    with pytest.raises(ValueError, match="padding"):
        la.Convolution(w(1, 1, 1), w(1), "causal")
    with pytest.raises(ValueError, match="merge"):
        la.Recurrent(lstm(1, 1), merge="max")
