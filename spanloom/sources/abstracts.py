"""Tab-separated abstracts, annotations and sentence borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import rstrip, strip
from ..operators.corpus import BODY, BORDERS, SPANS, TITLE, align


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, ord: lines in file order, files by name. Spark deals files out by size, so ord names the file and the place of
    the line's block in it, and within a block its number."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("ord"))


def _fields(line: Column, n: int) -> Column:
    parts = F.split(line, "\t", -1)
    bad = F.raise_error(F.concat(F.lit(f"a line has not {n} fields: "), F.substring(line, 1, 80)))
    return F.when(F.size(parts) != n, bad).otherwise(parts)


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """id, title, body, ord. Lines of id, title and body; the line's ends and the ends of both texts are stripped, so an
    empty body, whose tab goes with the line's end, is an error."""
    parts = _lines(spark, path).select(_fields(strip(F.col("value")), 3).alias("f"), "ord")
    return parts.select(F.col("f")[0].cast("bigint").alias("id"), rstrip(F.col("f")[1]).alias("title"), rstrip(F.col("f")[2]).alias("body"), "ord")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """id, title, body (spans in order of start, then of line; the label as payload), ord. Lines of id, part, start,
    stop, text, label. Empty spans are left out; other parts than T and A count for nothing but their id's row."""
    parts = _lines(spark, path).select(_fields(strip(F.col("value")), 6).alias("f"), "ord")
    rows = parts.select(
        F.col("f")[0].cast("bigint").alias("id"), F.col("f")[1].alias("part"), F.col("f")[2].cast("int").alias("start"), F.col("f")[3].cast("int").alias("stop"), F.col("f")[5].alias("data"), "ord"
    )
    rows = rows.withColumn("stop", F.when(F.col("stop") < F.col("start"), F.raise_error(F.lit("an interval stops before it starts"))).otherwise(F.col("stop")))

    def of(code: str) -> Column:
        kept = F.when((F.col("part") == code) & (F.col("stop") != F.col("start")), F.struct("start", "ord", "stop", "data"))
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["data"].alias("data"))).cast(SPANS)

    return rows.groupBy("id").agg(of(TITLE).alias("title"), of(BODY).alias("body"), F.max("ord").alias("ord"))


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """id, title, body (borders in file order, empty ones too), ord. Lines of id, part and start:stop."""
    parts = _lines(spark, path).select(_fields(F.col("value"), 3).alias("f"), "ord")
    ends = F.split(F.col("f")[2], ":")
    rows = parts.select(F.col("f")[0].cast("bigint").alias("id"), F.col("f")[1].alias("part"), ends[0].cast("int").alias("start"), ends[1].cast("int").alias("stop"), "ord")

    def of(code: str) -> Column:
        kept = F.when(F.col("part") == code, F.struct("ord", "start", "stop"))
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).cast(BORDERS)

    return rows.groupBy("id").agg(of(TITLE).alias("title"), of(BODY).alias("body"), F.max("ord").alias("ord"))


def read_corpus(spark: SparkSession, abstracts: str, annotations: str | None = None, borders: str | None = None) -> DataFrame:
    """The three files as text, annotation, borders structs, one row per abstract."""
    a = None if annotations is None else read_annotations(spark, annotations)
    b = None if borders is None else read_borders(spark, borders)
    return align(read_abstracts(spark, abstracts).drop("ord"), a, b)
