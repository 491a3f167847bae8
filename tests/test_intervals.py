import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spanloom.functions import intervals as iv


def overlap(a, b):
    return b[0] <= a[0] < b[1] or a[0] <= b[0] < a[1]


def test_intersects_is_the_full_predicate(spark):
    spans = [(a, b) for a in range(5) for b in range(a, 5)]
    rows = [(i, j, *x, *y) for i, x in enumerate(spans) for j, y in enumerate(spans)]
    df = spark.createDataFrame(rows, "i int, j int, a int, b int, c int, d int")
    x, y = (F.struct(F.col(s).alias("start"), F.col(e).alias("stop")) for s, e in ("ab", "cd"))
    for r in df.withColumn("hit", iv.intersects(x, y)).collect():
        assert r.hit == overlap((r.a, r.b), (r.c, r.d))


def test_scalar_forms(spark):
    df = spark.createDataFrame([(1, 4, "x"), (2, 2, None)], "a int, b int, c string")
    i = iv.interval(F.col("a"), F.col("b"), F.col("c"))
    df = df.select(i.alias("i")).select(
        iv.length(F.col("i")).alias("n"), iv.positions(F.col("i")).alias("p"), iv.render(F.col("i")).alias("s"), iv.holds(F.col("i"), F.lit("x")).alias("h"),
        iv.covers(F.col("i"), F.lit(3)).alias("c"), iv.reload(F.col("i"), F.lit(7))["data"].alias("r"), iv.same(F.col("i"), F.col("i")).alias("e"),
    )
    a, b = df.collect()
    assert (a.n, a.p, a.s, a.h, a.c, a.r, a.e) == (3, [1, 2, 3], "Interval(start=1, stop=4, data=x)", True, True, 7, True)
    assert (b.n, b.p, b.s, b.h, b.c) == (0, [], "Interval(start=2, stop=2, data=None)", False, False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=5), st.text(alphabet="aé😀z ", max_size=10))
def test_extract_slices(spark, spans, text):
    spans = [(min(s), max(s)) for s in spans]
    lit = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit("").alias("data")) for a, b in spans]) if spans else F.array().cast("array<struct<start:int,stop:int,data:string>>")
    df = spark.createDataFrame([(text,)], "t string").select(lit.alias("ivs"), "t")
    row = df.select(iv.extract(F.col("t"), F.col("ivs")).alias("x"), iv.span(F.col("ivs")).alias("s"), iv.breakpoints(F.col("ivs")).alias("b"), iv.unload(F.col("ivs")).alias("u")).first()
    assert row.x == [text[a:b] for a, b in spans]
    assert (row.s is None) == (not spans) and (not spans or (row.s.start, row.s.stop) == (spans[0][0], spans[-1][1]))
    assert row.b == [b - 1 for _, b in spans] and len(row.u) == len(spans)


def test_errors(spark):
    df = spark.createDataFrame([(3, 1)], "start int, stop int").select(F.array(F.struct("start", "stop", F.lit("").alias("data"))).alias("ivs"))
    with pytest.raises(Exception, match="stops before"):
        df.select(iv.nonempty(F.col("ivs"))).collect()
    with pytest.raises(Exception, match="before the offset"):
        df.select(iv.extract(F.lit("abc"), F.col("ivs"), offset=4)).collect()
    row = df.select(iv.extract(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)), F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("stop"))), 1, text=False).alias("x")).first()
    assert row.x == [[2, 3, 4, 5]]
