"""Following a training run by the predictions that it streams: scores, the best epoch so far, hooks around batches and epochs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from typing import IO, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

MODES = {"max": float("-inf"), "min": float("inf")}
#: States of this many earlier batches are kept.
KEPT = 10


def score_line(scores: Mapping[str, float]) -> str:
    """name - 0.123 | name - 0.456"""
    return " | ".join(f"{name} - {float('nan') if score is None else score:.3f}" for name, score in scores.items())


class Validator:
    """A batch function (foreachBatch): scores every epoch of a micro-batch, in order, and saves the epochs that beat all before.

    metrics: names and aggregations f(true, predicted), as in functions.metrics. Rows hold epoch, y_true and y_pred (transform is
    applied to the latter first), a micro-batch holds its epochs whole; an epoch that comes in two is scored twice. With monitor,
    an epoch whose score is above (mode max) or below (min) the best so far goes to `{prefix}-{epoch:02d}-{score:.3f}`, as Parquet:
    weights(spark, epoch), or the epoch's rows. A score that is null or NaN improves nothing. Lines of scores go to stream and, with
    prefix, to `{prefix}-log`.

    What was best is written with each batch's number beside the prefix, before the batch counts as done, and a batch starts from
    the one before it: a restarted query goes on where it stood, and a batch that is run again writes the same to the same places.
    Only scores, a row an epoch, come to the driver. An empty batch changes nothing.
    """

    def __init__(
        self,
        metrics: Mapping[str, Callable[[Column, Column], Column]],
        monitor: str | None = None,
        mode: str = "max",
        prefix: str | None = None,
        transform: Callable[[Column], Column] = lambda pred: pred,
        weights: Callable[[SparkSession, int], DataFrame] | None = None,
        columns: tuple[str, str, str] = ("epoch", "y_true", "y_pred"),
        stream: IO | None = None,
    ):
        if mode not in MODES:
            raise ValueError('mode must be "max" or "min"')
        if monitor and monitor not in metrics:
            raise ValueError("the monitored score isn't among the metrics")
        if monitor and not prefix:
            raise ValueError("saving needs a prefix")
        self.metrics, self.monitor, self.mode, self.prefix = dict(metrics), monitor, mode, prefix
        self.transform, self.weights, self.columns, self.stream = transform, weights, columns, stream

    def _improves(self, score: float | None, best: float) -> bool:
        return score is not None and (score > best if self.mode == "max" else score < best)

    def _path(self, spark: SparkSession, kind: str, batch_id: int | None = None) -> tuple[str, Any, Any]:
        path = f"{self.prefix}-{kind}" + ("" if batch_id is None else f"/batch={batch_id}")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def best(self, spark: SparkSession, before: int | None = None) -> float:
        """The best score after the last batch, or the last one before a batch's number."""
        path, hadoop, files = self._path(spark, "best")
        if not files.exists(hadoop):
            return MODES[self.mode]
        states = spark.read.schema("best double, batch bigint").parquet(path)
        if before is not None:
            states = states.where(F.col("batch") < before)
        last = states.agg(F.max_by("best", "batch")).first()[0]
        return MODES[self.mode] if last is None else last

    def _remember(self, spark: SparkSession, batch_id: int, best: float) -> None:
        spark.range(1).select(F.lit(best).cast("double").alias("best")).write.mode("overwrite").parquet(self._path(spark, "best", batch_id)[0])
        _, old, files = self._path(spark, "best", batch_id - KEPT)
        files.delete(old, True)

    def scores(self, batch: DataFrame) -> DataFrame:
        """epoch and the scores."""
        epoch, true, pred = self.columns
        found = {name: f(F.col(true), self.transform(F.col(pred))) for name, f in self.metrics.items()}
        return batch.groupBy(F.col(epoch).alias("epoch")).agg(*(c.cast("double").alias(name) for name, c in found.items()))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, self.stream or sys.stderr
        rows = sorted(self.scores(batch).collect(), key=lambda r: r.epoch)
        best = self.best(spark, batch_id) if self.monitor else None
        lines = []
        for row in rows:
            scores = {name: row[name] for name in self.metrics}
            lines.append((row.epoch, score_line(scores)))
            if not self.monitor:
                continue
            score = scores[self.monitor]
            if not self._improves(score, best):
                lines.append((row.epoch, f"{self.monitor} didn't improve"))
                continue
            path = f"{self.prefix}-{row.epoch:02d}-{score:.3f}"
            lines.append((row.epoch, f"{self.monitor} improved from {best} to {score}; saving weights to {path}"))
            saved = self.weights(spark, row.epoch) if self.weights else batch.where(F.col(self.columns[0]) == row.epoch)
            saved.write.mode("overwrite").parquet(path)
            best = score
        for _, line in lines:
            print(line, file=stream)
        stream.flush()
        if self.prefix:
            logged = spark.createDataFrame([(k, *line) for k, line in enumerate(lines)], "line int, epoch bigint, text string")
            logged.coalesce(1).write.mode("overwrite").parquet(self._path(spark, "log", batch_id)[0])
        if self.monitor:
            self._remember(spark, batch_id, best)

    def log(self, spark: SparkSession) -> DataFrame:
        """batch, line, epoch, text: all lines written so far."""
        return spark.read.schema("line int, epoch bigint, text string, batch bigint").parquet(self._path(spark, "log")[0]).select("batch", "line", "epoch", "text")


class Caller:
    """Calls functions of a model around the micro-batches of a stream and around their epochs.

    callables: lists of functions under on_epoch_begin, on_batch_begin, on_batch_end, on_epoch_end. around(f) is a batch function:
    rows of a micro-batch go to f(rows, batch_id) epoch by epoch in their order, each between the batch's calls. An epoch begins
    with the first rows of its number and ends when another one begins or at close(), which listener() calls when the stream ends.
    An empty micro-batch calls nothing. After a restart an epoch begins again.
    """

    HOOKS = ("on_epoch_begin", "on_batch_begin", "on_batch_end", "on_epoch_end")

    def __init__(self, callables: Mapping[str, Sequence[Callable[[Any], Any]]], model: Any = None, epoch: str = "epoch"):
        if unknown := set(callables) - set(self.HOOKS):
            raise ValueError(f"no such hooks: {sorted(unknown)}")
        self.callables, self.model, self.epoch = {name: list(fs) for name, fs in callables.items()}, model, epoch
        self.at: Any = None
        self.open = False

    def call(self, when: str) -> None:
        for f in self.callables.get(when, ()):
            f(self.model)

    def close(self) -> None:
        if self.open:
            self.open = False
            self.call("on_epoch_end")

    def around(self, f: Callable[[DataFrame, int], Any]) -> Callable[[DataFrame, int], None]:
        def batch_function(batch: DataFrame, batch_id: int) -> None:
            epochs = sorted(r[0] for r in batch.select(self.epoch).distinct().collect())
            for epoch in epochs:
                if not self.open or epoch != self.at:
                    self.close()
                    self.at, self.open = epoch, True
                    self.call("on_epoch_begin")
                self.call("on_batch_begin")
                f(batch.where(F.col(self.epoch) == epoch) if len(epochs) > 1 else batch, batch_id)
                self.call("on_batch_end")

        return batch_function

    def listener(self) -> StreamingQueryListener:
        """For spark.streams.addListener: ends the last epoch when a query ends."""
        caller = self

        class Ends(StreamingQueryListener):
            def onQueryStarted(self, event): ...

            def onQueryProgress(self, event): ...

            def onQueryIdle(self, event): ...

            def onQueryTerminated(self, event):
                caller.close()

        return Ends()
