"""Balanced bins of items, and merging and unmerging of the arrays in them. Bins in long form: bin, pos, src_idx."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import max_length, stack
from ..session import written


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank, 0, 1, ... in the given total order, without a task that sees all rows: rows are range partitioned
    and sorted, and each partition adds the rows before it (a row per partition comes to one task)."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = written(spread.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    out = sorted_.join(F.broadcast(sizes), part == F.col("__of"))  # a row per partition
    return out.withColumn("rank", F.col("__before") + place).drop("__at", "__of", "__before")


#: Ranks of a bucket in which items meet the ranges of ranks that bins take.
BUCKET = 64


def quotas(loads: list, weight, n: int) -> list[int]:
    """How many of n items of one weight each bin gets, if one after another goes to the lightest bin (of several the first).
    By whole levels, so that the time doesn't grow with n. loads: exact numbers."""
    bins = range(len(loads))
    got = [0] * len(loads)
    lightest = min(bins, key=lambda b: loads[b])
    if weight <= 0:  # the lightest stays so
        got[lightest] = n
        return got
    below = lambda level: [max(0, -((loads[b] - level) // weight)) for b in bins]  # noqa: E731  items taken before a bin reaches level
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(below(loads[lightest] + mid * weight)) <= n else (low, mid - 1)
    got = [int(x) for x in below(loads[lightest] + low * weight)]
    order = sorted(bins, key=lambda b: (loads[b] + got[b] * weight, b))
    for b in order[: n - sum(got)]:
        got[b] += 1
    return got


def _dealt(nbins: int):
    """Batches of (weight, n), heaviest first, as ranges of ranks: bin, lo, hi, pos (of the item at lo in its bin)."""

    def exact(x):
        return x if isinstance(x, int) else Fraction(x)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, held, rank, out = [0] * nbins, [0] * nbins, 0, []
        heap = [(0, b) for b in range(nbins)]
        for batch in it:
            for weight, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weight = exact(weight)
                if n <= nbins:
                    taken = []
                    for _ in range(n):
                        _, b = heap[0]
                        loads[b] += weight
                        heapq.heapreplace(heap, (loads[b], b))
                        taken.append((b, 1))
                else:
                    taken = [(b, k) for b, k in enumerate(quotas(loads, weight, n)) if k]
                    for b, k in taken:
                        loads[b] += k * weight
                    heap = [(load, b) for b, load in enumerate(loads)]
                    heapq.heapify(heap)
                for b, k in taken:
                    out.append((b, rank, rank + k, held[b]))
                    rank, held[b] = rank + k, held[b] + k
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["bin", "lo", "hi", "base"])

    return batches


def binpack(items: DataFrame, nbins: int, weight: str | Column, index: str) -> DataFrame:
    """src_idx, weight, bin, pos: items packed into nbins bins, each in turn into the lightest one (the first of several),
    heaviest first, ties by index; pos numbers a bin's items in that order. weight: a column or an expression of the row.

    Items of one weight are interchangeable, so the turns are taken over the different weights with their numbers of items,
    and the bins' shares of a weight become ranges of the items' ranks, which the items are joined to in small buckets. The
    one task that takes the turns holds nbins loads and reads a row per different weight; items never come to it. Loads are
    exact for whole, decimal and binary numbers. Fewer items than bins are an error, and so is a weight that is null or NaN
    or infinite. Items of weight 0 or less all go to the bin that is lightest when they come.
    """
    if nbins < 1:
        raise ValueError("no bins")
    value = F.col(weight) if isinstance(weight, str) else weight
    rows = items.select(F.col(index).alias("src_idx"), value.alias("weight"))
    kind = rows.schema["weight"].dataType.simpleString()
    bad = F.col("weight").isNull()
    if kind in ("float", "double"):
        bad = bad | F.isnan("weight") | (F.abs("weight") == float("inf"))
    rows = rows.withColumn("weight", F.when(bad, F.raise_error(F.lit("a weight is missing or not finite")).cast(kind)).otherwise(F.col("weight")))
    rows = written(ranked(rows, F.desc("weight"), F.asc("src_idx")), "ranked")
    sizes = rows.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    ranges = sizes.repartition(1).sortWithinPartitions(F.desc("weight")).mapInArrow(_dealt(nbins), "bin bigint, lo bigint, hi bigint, base bigint")
    ranges = written(ranges, "ranges")
    if (ranges.agg(F.max("hi")).first()[0] or 0) < nbins:
        raise ValueError("fewer items than bins")
    buckets = F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"(hi - 1) div {BUCKET}"))
    ranges = ranges.select("bin", "lo", "hi", "base", F.explode(buckets).alias("__bucket"))
    met = rows.withColumn("__of", F.expr(f"rank div {BUCKET}")).join(ranges, F.expr("__of = __bucket and lo <= rank and rank < hi"))
    return met.select("src_idx", "weight", F.col("bin").cast("int").alias("bin"), (F.col("base") + F.col("rank") - F.col("lo")).alias("pos"))


def bin_extract(source: DataFrame, bins: DataFrame) -> DataFrame:
    """bins with the columns of source (src_idx, ...); an index that source hasn't is an error."""
    there = source.withColumn("__there", F.lit(True)).withColumnRenamed("src_idx", "__idx")
    out = bins.join(there, F.col("src_idx") == F.col("__idx"), "left").drop("__idx")
    missing = F.raise_error(F.lit("bins hold an index outside of the source"))
    return out.withColumn("src_idx", F.when(F.col("__there").isNull(), missing).otherwise(F.col("src_idx"))).drop("__there")


def merge_bins(source: DataFrame, bins: DataFrame, array: str, filler: Column) -> DataFrame:
    """bin, merged: the arrays of each bin one after another, filled up to the longest bin's length."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col(array).alias("a"))))
    joined = bin_extract(source, bins).groupBy("bin").agg(F.flatten(F.transform(parts, lambda x: x["a"])).alias("merged"))
    joined = written(joined, "merged")  # the longest bin's length is known after a run
    return joined.withColumn("merged", stack(F.col("merged"), max_length(joined, "merged"), filler))


def unmerge_bins(merged: DataFrame, bins: DataFrame, lengths: DataFrame) -> DataFrame:
    """bin, pos, src_idx, piece: merged (bin, merged) cut into pieces of the given lengths (src_idx, length); what is left
    of a bin is dropped, lengths beyond its end are an error."""
    w = W.partitionBy("bin").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = bin_extract(lengths, bins).withColumn("__end", F.sum("length").over(w))
    cut = cut.join(merged.withColumnRenamed("bin", "__bin"), F.col("bin") == F.col("__bin"))
    piece = F.slice("merged", (F.col("__end") - F.col("length") + 1).cast("int"), F.col("length").cast("int"))
    bad = F.raise_error(F.lit("lengths reach past the merged array"))
    return cut.select("bin", "pos", "src_idx", F.when(F.col("__end") > F.size("merged"), bad).otherwise(piece).alias("piece"))


def unbin(binned: DataFrame, bins: DataFrame) -> DataFrame:
    """binned (bin, pos, ...) by original place: src_idx and the other columns; sort by src_idx for the order."""
    at = bins.select(F.col("bin").alias("__bin"), F.col("pos").alias("__pos"), "src_idx")
    rest = [c for c in binned.columns if c not in ("bin", "pos", "src_idx")]
    return binned.drop("src_idx").join(at, (F.col("bin") == F.col("__bin")) & (F.col("pos") == F.col("__pos"))).select("src_idx", *rest)


def decode_predictions(merged: DataFrame, bins: DataFrame, lengths: DataFrame, cut: float = 0.5) -> DataFrame:
    """src_idx, points: of each item's predictions, reversed, the places of those above cut."""
    pieces = unbin(unmerge_bins(merged, bins, lengths).drop("src_idx"), bins)
    points = F.filter(F.transform(F.reverse("piece"), lambda x, i: F.when(x > cut, i)), lambda i: i.isNotNull())
    return pieces.select("src_idx", points.alias("points"))
