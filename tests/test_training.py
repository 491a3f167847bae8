import io

import pytest
from pyspark.sql import functions as F

from spanloom.functions import metrics
from spanloom.streaming.training import Caller, Validator

KIND = "epoch bigint, y_true double, y_pred double"
#: Recall by epoch: 0.5, 0.25, 0.75, 0.75
HITS = (2, 1, 3, 3)


def rows(epoch):
    return [(epoch, 1.0, 0.9 if k < HITS[epoch] else 0.1) for k in range(4)]


def put(spark, folder, epochs):
    spark.createDataFrame([r for e in epochs for r in rows(e)], KIND).coalesce(1).write.mode("append").parquet(folder)


def start(spark, tmp_path, sink):
    coming = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = coming.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()


def saved(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("run-0"))


def make(tmp_path, **kw):
    return Validator({"p": metrics.precision, "r": metrics.recall}, "r", prefix=str(tmp_path / "run"), stream=io.StringIO(), **kw)


def test_best_so_far_survives_a_restart(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [0])
    first = make(tmp_path)
    start(spark, tmp_path, first)
    put(spark, str(tmp_path / "in"), [1])
    put(spark, str(tmp_path / "in"), [2])
    start(spark, tmp_path, first)
    again = make(tmp_path)  # another process
    put(spark, str(tmp_path / "in"), [3])
    start(spark, tmp_path, again)
    assert saved(tmp_path) == ["run-00-0.500", "run-02-0.750"]
    assert abs(again.best(spark) - 0.75) < 1e-6
    assert again.stream.getvalue() == "p - 1.000 | r - 0.750\nr didn't improve\n"
    log = again.log(spark).orderBy("batch", "line").collect()
    assert [r.epoch for r in log] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert log[1].text.startswith("r improved from -inf to 0.4999") and log[1].text.endswith("run-00-0.500")
    assert spark.read.parquet(str(tmp_path / "run-02-0.750")).count() == 4


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    sink = make(tmp_path)
    batch = lambda *epochs: spark.createDataFrame([r for e in epochs for r in rows(e)], KIND)
    sink(batch(0), 0)
    sink(batch(1, 2), 1)
    before = saved(tmp_path), sink.log(spark).orderBy("batch", "line").collect()
    for _ in range(2):  # its own score isn't what it is compared with
        make(tmp_path)(batch(1, 2), 1)
    assert (saved(tmp_path), sink.log(spark).orderBy("batch", "line").collect()) == before
    sink(spark.createDataFrame([], KIND), 2)
    assert abs(sink.best(spark) - 0.75) < 1e-6
    for k in range(3, 16):
        sink(batch(1), k)
    assert abs(sink.best(spark) - 0.75) < 1e-6 and len(list((tmp_path / "run-best").iterdir())) <= 12


def test_modes_weights_and_errors(spark, tmp_path):
    weights = lambda spark, epoch: spark.createDataFrame([(epoch, 1.5)], "epoch int, w double")
    low = make(tmp_path, mode="min", weights=weights, transform=lambda p: 1 - p)
    low(spark.createDataFrame([*rows(0), *rows(2), *rows(3)], KIND), 0)
    assert saved(tmp_path) == ["run-00-0.500", "run-02-0.250"]
    assert spark.read.parquet(str(tmp_path / "run-02-0.250")).first().w == 1.5
    nan = Validator({"r": lambda t, p: F.avg(p)}, "r", prefix=str(tmp_path / "nan"), stream=io.StringIO())
    nan(spark.createDataFrame([(0, 1.0, float("nan")), (1, 1.0, None)], KIND), 0)
    assert nan.best(spark) == float("-inf")
    for bad in ({"mode": "x"}, {"monitor": "f"}, {"monitor": "r"}):
        with pytest.raises(ValueError):
            Validator({"r": metrics.recall}, **bad)


def test_hooks(spark, tmp_path):
    calls = []
    hooks = {h: [lambda model, h=h: calls.append((h[3:], model))] for h in Caller.HOOKS}
    caller = Caller(hooks, "model")
    put(spark, str(tmp_path / "in"), [0])
    put(spark, str(tmp_path / "in"), [0, 1])
    listener = caller.listener()
    spark.streams.addListener(listener)
    try:
        start(spark, tmp_path, caller.around(lambda rows, k: calls.append(rows.select("epoch").distinct().first()[0])))
        import time

        for _ in range(100):
            if not caller.open:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    one = [("batch_begin", "model"), 0, ("batch_end", "model")]
    want = [("epoch_begin", "model"), *one, *one, ("epoch_end", "model"), ("epoch_begin", "model"), ("batch_begin", "model"), 1, ("batch_end", "model"), ("epoch_end", "model")]
    assert calls == want
    with pytest.raises(ValueError, match="no such hooks"):
        Caller({"on_start": []})
