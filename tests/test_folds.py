import pytest
from pyspark.sql import functions as F

from spanloom.functions import folds
from spanloom.operators import segments as s
from spanloom.streaming import documents as stream
from test_segments import documents

KIND = "doc_id int, intervals array<struct<start:int,stop:int,data:string>>, targets array<struct<start:int,stop:int>>"


def rows(seed):
    return [(d, [(a, b, f"w{i}") for i, (a, b) in enumerate(x)][::-1], [tuple(t) for t in ts]) for d, x, ts in documents(seed)]


def long_form(df):
    ivs = df.select("doc_id", F.posexplode("intervals").alias("ord", "x")).select("doc_id", "ord", "x.*")
    tgs = df.select("doc_id", F.posexplode("targets").alias("ord", "x")).select("doc_id", "ord", "x.*")
    points = s.stitch_points(ivs, tgs)
    by_doc = {}
    for r in s.stitch(ivs, points).orderBy("doc_id", "grp").collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.stop, tuple(r.data)))
    at = {}
    for r in points.collect():
        at.setdefault(r.doc_id, []).append(r.point)
    return by_doc, {d: sorted(p) for d, p in at.items()}


def plain(found):
    return {r.doc_id: [(x.start, x.stop, tuple(x.data)) for x in r.stitched] for r in found}, {r.doc_id: sorted(r.points) for r in found if r.points}


def test_folds_give_what_the_windows_give(spark):
    df = spark.createDataFrame(rows(3), KIND)
    assert plain(stream.stitched(df).collect()) == long_form(df)


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    df = spark.createDataFrame(rows(4), KIND)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    coming = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.stitched(coming).writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
        assert plain(spark.table("stitched").collect()) == long_form(df)
    finally:
        query.stop()


def test_borders_on_a_stream_and_in_the_table(spark, tmp_path):
    texts = [(1, ["amino acid", "is any", None, "x😀"]), (2, []), (3, None), (4, [""])]
    df = spark.createDataFrame(texts, "doc_id int, texts array<string>")
    flat = df.select("doc_id", F.posexplode("texts").alias("k", "text"))
    for gap, form in ((0, s.segment_borders), (1, s.sentence_borders)):
        want = {(r.doc_id, r.k): (r.start, r.stop) for r in form(flat, "doc_id", "k").collect()}
        got = {r.doc_id: r.borders for r in stream.with_borders(df, gap=gap).collect()}
        assert {(d, k): tuple(b) for d, x in got.items() for k, b in enumerate(x or [])} == want
        assert got[2] == [] and got[3] is None
    df.write.parquet(str(tmp_path / "in"))
    query = stream.with_borders(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("borders").start()
    try:
        query.processAllAvailable()
        assert sorted(map(str, spark.table("borders").collect())) == sorted(map(str, stream.with_borders(df).collect()))
    finally:
        query.stop()


def test_tokens_are_stitched_to_targets(spark):
    df = spark.createDataFrame([(1, "IL-2 gene (x)", [(0, 4), (10, 13)]), (2, None, [(0, 1)]), (3, "a b", None)], "doc_id int, text string, targets array<struct<start:int,stop:int>>")
    got = {r.doc_id: [(x.start, x.stop, x.data) for x in r.stitched] for r in stream.stitched_tokens(df).collect()}
    assert got[1] == [(0, 4, ["IL", "-", "2"]), (5, 9, ["gene"]), (10, 13, ["(", "x", ")"])]
    assert got[2] == [] and [x[2] for x in got[3]] == [["a"], ["b"]]


def test_points_outside_are_errors(spark):
    df = spark.createDataFrame([(1, [(0, 3, "a")])], "doc_id int, iv array<struct<start:int,stop:int,data:string>>")
    for point in (-1, 3):
        with pytest.raises(Exception, match="outside"):
            df.select(folds.stitch(F.col("iv"), F.array(F.lit(point)))).collect()
    empty = spark.createDataFrame([(1, []), (2, None)], "doc_id int, iv array<struct<start:int,stop:int,data:string>>")
    got = {r.doc_id: r.x for r in empty.select("doc_id", folds.stitch(F.col("iv"), F.lit(None).cast("array<int>")).alias("x")).collect()}
    assert got == {1: [], 2: None}
