"""Scores over epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_so_far(scores: DataFrame, epoch: str = "epoch", score: str = "score", mode: str = "max") -> DataFrame:
    """scores with best (of all epochs up to this one) and improved (whether it beats all before; the first does unless
    its score is null). A row per epoch, so one window over all of them is small."""
    if mode not in ("max", "min"):
        raise ValueError('mode must be "max" or "min"')
    w = W.orderBy(epoch)
    best = F.max if mode == "max" else F.min
    before = best(score).over(w.rowsBetween(W.unboundedPreceding, -1))
    beats = F.col(score) > before if mode == "max" else F.col(score) < before
    return scores.withColumn("best", best(score).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn(
        "improved", F.coalesce(beats, F.col(score).isNotNull() & before.isNull())
    )
