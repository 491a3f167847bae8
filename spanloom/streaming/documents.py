"""Documents that come on a stream, each row a whole document: what needs no other row runs without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.patterns import tokenise


def with_borders(documents: DataFrame, texts: str = "texts", gap: int = 0) -> DataFrame:
    """documents (a stream or a table) with borders of their array of texts."""
    return documents.withColumn("borders", folds.borders(F.col(texts), gap))


def stitched(documents: DataFrame, intervals: str = "intervals", targets: str = "targets", data: str = "string") -> DataFrame:
    """documents with points and stitched: intervals joined where a target spans several."""
    pointed = documents.withColumn("points", folds.stitch_points(F.col(intervals), F.col(targets)))
    return pointed.withColumn("stitched", folds.stitch(F.col(intervals), F.col("points"), data))


def stitched_tokens(documents: DataFrame, text: str = "text", targets: str = "targets") -> DataFrame:
    """documents with tokens of their text (null text: none), points, and stitched tokens that cover each of the targets
    whole (array<struct<start, stop>>)."""
    tokens = tokenise(documents.withColumnRenamed(text, "text") if text != "text" else documents)
    return stitched(tokens.withColumn("tokens", F.coalesce("tokens", F.array().cast(tokens.schema["tokens"].dataType))), "tokens", targets)
