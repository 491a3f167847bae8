"""Row-local operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import tokenise


def token_counts(texts: DataFrame, time: str, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Tokens per window of event time, of a stream (or table) of text and time; late rows count up to the watermark."""
    tokens = tokenise(texts.select(time, "text")).withWatermark(time, lateness)
    return tokens.groupBy(F.window(time, window).alias("window")).agg(F.sum(F.size("tokens")).alias("n_tokens"))
