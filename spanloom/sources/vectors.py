"""Word vectors as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import ranked


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """idx, word, vector (array<float>): lines of a word and numbers parted by single spaces, plain or compressed (by the
    file's extension). idx numbers the lines in file order, files by name, so that the last row has the largest; nothing is
    quoted and no word stands for a missing value."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = ranked(lines, F.col("file_path"), F.col("file_block_start"), F.col("line"))
    parts = lines.select(F.col("rank").cast("bigint").alias("idx"), F.split("value", " ", -1).alias("f"))
    vector = F.slice("f", F.lit(2), F.size("f") - 1).cast("array<float>")
    return parts.select("idx", F.col("f")[0].alias("word"), vector.alias("vector"))
