"""Line dedup by site-relative frequency, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Trimmed from both ends before lines are compared.
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def boilerplate_lines(docs: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """One row per host that has any: __sl_host, __sl_bad (keys of its boilerplate lines).

    The shares of all lines of a host sum to its mean number of lines a page, so __sl_bad holds at most that mean
    over max_ratio keys, however large the host is.
    """
    pages = docs.select(F.col(host).alias("__sl_host"), F.col(text).alias("__sl_text"))
    totals = pages.groupBy("__sl_host").agg(F.count(F.lit(1)).alias("__sl_pages"))
    bare = F.filter(_lines(F.col("__sl_text")), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = (
        pages.select("__sl_host", F.explode(F.array_distinct(F.transform(bare, _key))).alias("k"))
        .groupBy("__sl_host", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = totals.withColumnRenamed("__sl_host", "__sl_of")
    return (
        counts.join(totals, F.col("__sl_host").eqNullSafe(F.col("__sl_of")))
        .where(F.col("n").cast("double") / F.col("__sl_pages") > max_ratio)
        .groupBy("__sl_host")
        .agg(F.collect_list(F.struct("a", "b")).alias("__sl_bad"))
    )


def drop_boilerplate_lines(
    docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """docs with the lines taken out of `text` that stand on more than max_ratio of all pages of the row's host and on
    at least min_pages of them; adds __sl_lines and __sl_dropped (lines before, lines taken out).

    A page counts a line once however often it repeats it; every row is a page, repeated rows too. Lines are compared
    without blanks at their ends. Blank lines are never boilerplate and stay. A null host is a host of its own. Null
    text stays null (0 lines), empty text is one blank line; a page that loses all its lines keeps an empty text.
    Other columns pass through; names that start with __sl_ are reserved. An empty table gives an empty table.
    """
    bad = materialise(boilerplate_lines(docs, text, host, max_ratio, min_pages), "boilerplate")
    hosts, keys = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__sl_bad")), F.lit(0))).first()
    found = docs.join(broadcast_if_small(bad, hosts + keys), F.col(host).eqNullSafe(F.col("__sl_host")), "left")
    lines = _lines(F.col(text))
    kept = F.filter(
        lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col("__sl_bad"), _key(x))
    )
    out = found.withColumn("__sl_lines", F.coalesce(F.size(lines), F.lit(0)))
    out = out.withColumn("__sl_kept", F.when(F.col("__sl_bad").isNotNull() & F.col(text).isNotNull(), kept))
    return (
        out.withColumn("__sl_dropped", F.when(F.col("__sl_kept").isNull(), 0).otherwise(F.col("__sl_lines") - F.size("__sl_kept")))
        .withColumn(text, F.when(F.col("__sl_kept").isNull(), F.col(text)).otherwise(F.array_join("__sl_kept", "\n")))
        .drop("__sl_host", "__sl_bad", "__sl_kept")
    )
