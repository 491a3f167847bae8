import datetime

from spanloom.streaming.tokens import token_counts


def test_token_counts_on_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 0)
    rows = [(at, "two words"), (at + datetime.timedelta(minutes=1), "3.5 x"), (at + datetime.timedelta(minutes=7), "one"), (at, None)]
    df = spark.createDataFrame(rows, "ts timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    want = {(r.window.start, r.n_tokens) for r in token_counts(df, "ts").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = token_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        query.processAllAvailable()
        assert {(r.window.start, r.n_tokens) for r in spark.table("counts").collect()} == want
    finally:
        query.stop()
    assert {n for _, n in want} == {4, 1}
