import random
from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from spanloom.functions import arrays as a
from spanloom.functions import encode, metrics
from spanloom.operators import binning, evaluation


@pytest.fixture(scope="module")
def ragged(spark):
    return spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [7])], "i int, a array<int>")


def test_stack_and_mask(ragged):
    rows = {r.i: r for r in ragged.select("i", a.stack(F.col("a"), 3, F.lit(0)).alias("s"), a.stack_mask(F.col("a"), 3).alias("m")).collect()}
    assert rows[0].s == [1, 2, 3] and rows[1].s == [0, 0, 0] and rows[2].m == [True, False, False]
    assert [x for x, m in zip(rows[2].s, rows[2].m, strict=True) if m] == [7]
    with pytest.raises(Exception, match="longer"):
        ragged.select(a.stack(F.col("a"), 2, F.lit(0))).collect()
    assert ragged.select(a.stack(F.col("a"), 2, F.lit(0), trim=True).alias("s")).first().s == [1, 2]
    assert a.max_shape(ragged, "a") == (3,)
    with pytest.raises(ValueError, match="no arrays"):
        a.max_shape(ragged.limit(0), "a")


def test_chunks_masks_and_zips(ragged):
    rows = {r.i: r.c for r in ragged.select("i", a.chunk_steps(F.col("a"), 2, F.lit(0)).alias("c")).collect()}
    assert rows == {0: [[1, 2], [3, 0]], 1: [], 2: [[7, 0]]}
    kept = ragged.select(a.mask_false(F.col("a"), F.transform("a", lambda x: x > 1), F.lit(0)).alias("k")).first()
    assert kept.k == [0, 2, 3]
    with pytest.raises(Exception, match="differ in length"):
        ragged.select(a.mask_false(F.col("a"), F.array(F.lit(True)), F.lit(0))).collect()
    zipped = a.flat_zip(ragged.withColumn("b", F.array(F.lit("x"), F.lit("y"))), ["i"], ["a", "b"])
    assert sorted((r.i, r.a, r.b) for r in zipped.collect()) == [(0, 1, "x"), (0, 2, "y"), (2, 7, "x")]
    with pytest.raises(ValueError, match="nested"):
        a.flat_zip(ragged, ["i"], [])
    assert not a.homogenous(ragged, F.size("a")).first().homogenous
    assert a.homogenous(ragged.limit(0), F.size("a")).first().homogenous


def test_char_codes(spark):
    corpus = spark.createDataFrame([("ba",), ("é",), (None,)], "text string")
    coder = encode.CharEncoder(corpus, word_length=3)
    df = spark.createDataFrame([("abé😀",), ("b",)], "t string")
    rows = [r.c for r in df.select(coder.encode(F.col("t")).alias("c")).collect()]
    assert rows == [[1, 2, 3, 3], [2]] and coder.oov == 3
    assert [r.c for r in df.select(coder.encode_padded(F.col("t"), 9).alias("c")).collect()] == [[1, 2, 3], [2, 0, 0]]
    with pytest.raises(Exception, match="empty strings"):
        spark.createDataFrame([("",)], "t string").select(coder.encode(F.col("t"))).collect()
    with pytest.raises(ValueError, match="ASCII"):
        encode.CharEncoder(corpus.where("text = 'é'"))


def test_word_codes(spark):
    vocabulary = spark.createDataFrame([(0, "a", [0.0]), (1, "b", [1.0]), (2, "a", [2.0]), (3, "oov", [3.0])], "idx int, word string, vector array<float>")
    words = spark.createDataFrame([("A",), ("b",), ("z",)], "word string")
    got = {r.word: (r.idx, r.vector) for r in encode.word_vectors(words, vocabulary, transform=F.lower).collect()}
    assert got == {"A": (2, [2.0]), "b": (1, [1.0]), "z": (3, [3.0])}
    with pytest.raises(Exception, match="empty words"):
        encode.word_index(spark.createDataFrame([("",)], "word string"), vocabulary).collect()


def test_words_as_a_padded_array(spark):
    coder = encode.CharEncoder(spark.createDataFrame([("abc",)], "text string"), word_length=3)
    df = spark.createDataFrame([(0, ["ab", "é", None]), (1, []), (2, None), (3, ["abcabc"] * 5)], "i int, w array<string>")
    got = {r.i: r.c for r in df.select("i", coder.encode_words(F.col("w"), 4).alias("c")).collect()}
    assert got == {0: [[1, 2, 0], [4, 0, 0], [0, 0, 0], [0, 0, 0]], 1: [[0, 0, 0]] * 4, 2: None, 3: [[1, 2, 3]] * 4}
    with pytest.raises(Exception, match="empty strings"):
        spark.createDataFrame([([""],)], "w array<string>").select(coder.encode_words(F.col("w"), 2)).collect()
    with pytest.raises(ValueError, match="width"):
        encode.CharEncoder(spark.createDataFrame([("abc",)], "text string")).encode_words(F.col("w"), 2)


def greedy(weights, nbins):
    """Item by item."""
    loads, where = [0] * nbins, {}
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        b = loads.index(min(loads))
        loads[b] += weights[i]
        where[i] = b
    return loads, where


def packed(spark, weights, nbins, kind="int"):
    items = spark.createDataFrame(list(enumerate(weights)), f"i int, w {kind}")
    rows = binning.binpack(items, nbins, F.col("w"), "i").collect()
    assert sorted(r.src_idx for r in rows) == list(range(len(weights)))
    for b in range(nbins):
        mine = sorted((r for r in rows if r.bin == b), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert [r.weight for r in mine] == sorted((r.weight for r in mine), reverse=True)
    return [sum(Fraction(r.weight) for r in rows if r.bin == b) for b in range(nbins)], {r.src_idx: r.bin for r in rows}


def test_bins(spark):
    loads, where = packed(spark, [10, 1, 1, 1], 2, "int")
    assert loads == [10, 3]
    assert packed(spark, [5, 4, 3, 3], 2)[1] == {0: 0, 1: 1, 2: 1, 3: 0}
    for seed, most, n, nbins in ((1, 5, 900, 7), (2, 1000, 500, 16), (3, 1, 400, 3), (4, 0, 20, 4)):
        rng = random.Random(seed)
        weights = [rng.randint(0, most) for _ in range(n)] + [most * 40] * 2
        assert packed(spark, weights, nbins)[0] == greedy(weights, nbins)[0]
    fractions = [random.Random(5).choice([0.1, 0.2, 0.7, 1.5]) for _ in range(300)] + [0.3]
    assert packed(spark, fractions, 4, "double")[0] == greedy([Fraction(x) for x in fractions], 4)[0]
    items = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan"))], "i int, w double")
    with pytest.raises(ValueError, match="fewer items"):
        binning.binpack(items.where("i < 2"), 2, "w", "i")
    with pytest.raises(ValueError, match="fewer items"):
        binning.binpack(items.limit(0), 1, "w", "i")
    for bad in (2, 3):
        with pytest.raises(Exception, match="missing or not finite"):
            binning.binpack(items.where(F.col("i") == bad), 1, "w", "i").collect()


def test_quotas_are_those_of_turns():
    rng = random.Random(8)
    for _ in range(300):
        loads, weight, n = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))], rng.choice([0, 1, 3, 7, -2]), rng.randint(1, 90)
        plain, now = [0] * len(loads), list(loads)
        for _ in range(n):
            b = now.index(min(now))
            now[b] += weight
            plain[b] += 1
        assert binning.quotas(loads, weight, n) == plain


def test_merge_unmerge_round_trip(spark):
    source = spark.createDataFrame([(i, [float(i)] * (i + 1)) for i in range(5)], "src_idx int, a array<float>")
    bins = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 0, 4), (1, 1, 0), (1, 2, 2)], "bin int, pos int, src_idx int")
    lengths = source.select("src_idx", F.size("a").alias("length"))
    merged = binning.merge_bins(source, bins, "a", F.lit(0.0).cast("float"))
    assert {len(r.merged) for r in merged.collect()} == {9}
    pieces = binning.unmerge_bins(merged, bins, lengths)
    back = {r.src_idx: r.piece for r in binning.unbin(pieces.drop("src_idx"), bins).collect()}
    assert back == {i: [float(i)] * (i + 1) for i in range(5)}
    with pytest.raises(Exception, match="reach past"):
        binning.unmerge_bins(merged, bins, lengths.withColumn("length", F.col("length") + 3)).collect()
    with pytest.raises(Exception, match="outside"):
        binning.bin_extract(source, bins.withColumn("src_idx", F.col("src_idx") + 1)).collect()
    points = binning.decode_predictions(spark.createDataFrame([(0, [0.5, 0.6, 0.1])], "bin int, merged array<double>"), spark.createDataFrame([(0, 0, 0)], "bin int, pos int, src_idx int"), spark.createDataFrame([(0, 3)], "src_idx int, length int"))
    assert points.first().points == [1]


def test_metrics(spark):
    rows = [(1.0, 0.5), (1.0, 1.5), (0.0, 0.6), (1.0, 0.4)]
    df = spark.createDataFrame(rows, "t double, p double")
    r = df.agg(metrics.precision(F.col("t"), F.col("p")).alias("p"), metrics.recall(F.col("t"), F.col("p")).alias("r"), metrics.fmeasure(F.col("t"), F.col("p")).alias("f")).first()
    assert (round(r.p, 5), round(r.r, 5)) == (0.5, 0.33333)  # 0.5 rounds to even
    none = df.where("t > 5").agg(metrics.fmeasure(F.col("t"), F.col("p")).alias("f")).first()
    assert none.f == 0
    with pytest.raises(ValueError, match="negative"):
        metrics.fbeta(F.col("t"), F.col("p"), -1)
    soft = spark.createDataFrame([([0.1, 0.9], [0.5, 0.5]), ([0.1, 0.9], [0.2, 0.8])], "t array<double>, p array<double>")
    assert round(soft.agg(metrics.recall_softmax(F.col("t"), F.col("p")).alias("r")).first().r, 5) == 0.5  # the first of a tie


def test_best_so_far(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.4), (2, 0.6), (3, 0.6)], "epoch int, score double")
    assert [r.improved for r in evaluation.best_so_far(df).orderBy("epoch").collect()] == [True, False, True, False]
    assert [r.best for r in evaluation.best_so_far(df, mode="min").orderBy("epoch").collect()] == [0.5, 0.4, 0.4, 0.4]
    with pytest.raises(ValueError, match="mode"):
        evaluation.best_so_far(df, mode="x")
