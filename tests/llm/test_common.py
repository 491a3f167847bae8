import pyarrow as pa

from spanloom.llm import common


def test_texts_go_in_batches_of_bytes(spark):
    before = spark.conf.get(common.BATCH_SETTING, None)
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it)
    docs = spark.range(0, 40, 1, 1).selectExpr("repeat('word ', 200000) text")  # 1 MB each
    try:
        spark.conf.unset(common.BATCH_SETTING)
        n = [r.n for r in common.map_texts(docs, sizes, "n bigint").collect()]
        assert sum(n) == 40 and 1 < max(n) <= 9
        spark.conf.set(common.BATCH_SETTING, "2m")
        n = [r.n for r in common.map_texts(docs, sizes, "n bigint").collect()]
        assert sum(n) == 40 and max(n) <= 3
        assert not common.map_texts(docs.where("false"), sizes, "n bigint").collect()
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)
