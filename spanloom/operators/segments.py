"""Borders of segments, and splitting and stitching of spans against targets. Long form: a row per span with doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import tensors
from ..functions.intervals import intersects


def segment_borders(segments: DataFrame, doc: str, order: str, text: str = "text", gap: int = 0) -> DataFrame:
    """segments with start and stop: cumulative lengths in code points within doc, `gap` more before each segment but the
    first. Null text has no length."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    w = W.partitionBy(doc).orderBy(order)
    stop = F.sum(n).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + gap * (F.row_number().over(w) - 1)
    return segments.withColumn("stop", stop.cast("bigint")).withColumn("start", (F.col("stop") - n).cast("bigint"))


def sentence_borders(sentences: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """segment_borders of sentences that are one character apart."""
    return segment_borders(sentences, doc, order, text, gap=1)


def overlaps(intervals: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of a document's intervals (doc_id, ord, start, stop) and targets (doc_id, ord, start, stop) that overlap:
    an equi-join on doc_id with the overlap as its condition. Target columns get the prefix t_."""
    t = targets.select(F.col("doc_id").alias("t_doc"), F.col("ord").alias("t_ord"), F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    iv = F.struct(F.col("start"), F.col("stop"))
    tv = F.struct(F.col("t_start").alias("start"), F.col("t_stop").alias("stop"))
    return intervals.join(t, (F.col("doc_id") == F.col("t_doc")) & intersects(iv, tv)).drop("t_doc")


def overlaps_in_buckets(intervals: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """As overlaps, for very long documents: spans are dealt to buckets of `width` places that they touch, so that one
    document's spans spread over tasks. A pair is told in the bucket of the later of its starts."""

    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.greatest(F.col(a), F.col(b) - 1)
        buckets = F.sequence(F.floor(F.col(a) / width), F.floor(last / width))
        return df.withColumn("__bucket", F.explode(buckets))

    t = targets.select(F.col("doc_id").alias("t_doc"), F.col("ord").alias("t_ord"), F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    t = dealt(t, "t_start", "t_stop").withColumnRenamed("__bucket", "__t_bucket")
    iv = F.struct(F.col("start"), F.col("stop"))
    tv = F.struct(F.col("t_start").alias("start"), F.col("t_stop").alias("stop"))
    met = dealt(intervals, "start", "stop").join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("__bucket") == F.col("__t_bucket")) & intersects(iv, tv))
    return met.where(F.floor(F.greatest("start", "t_start") / width) == F.col("__bucket")).drop("t_doc", "__bucket", "__t_bucket")


def stitch_points(intervals: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, point: the last place of each interval that must be joined to the next one to rebuild a target.

    An interval belongs to the first target (by start) that it overlaps; of a target's intervals all but the last give a
    point. One shuffle by doc_id serves the join and both windows.
    """
    by_start = W.partitionBy("doc_id").orderBy("start", "ord")
    ranked = targets.withColumn("ord", F.row_number().over(by_start).cast("int")) if "ord" in targets.columns else targets
    met = overlaps(intervals, ranked)
    claimed = met.groupBy("doc_id", "ord", "start", "stop").agg(F.min("t_ord").alias("t_ord"))
    last = F.row_number().over(W.partitionBy("doc_id", "t_ord").orderBy(F.desc("start"), F.desc("ord")))
    return claimed.withColumn("n", last).where("n > 1").select("doc_id", (F.col("stop") - 1).alias("point"))


def flag_points(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """intervals with flagged: whether a point (doc_id, point) lies within. A point below 0 or not below the largest stop
    of its document is an error."""
    ends = intervals.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("stop").alias("__end"))
    p = points.select(F.col("doc_id").alias("p_doc"), "point").distinct().join(ends, F.col("p_doc") == F.col("__doc"))
    bad = (F.col("point") < 0) | (F.col("point") >= F.col("__end"))
    p = p.select("p_doc", F.when(bad, F.raise_error(F.lit("a point lies outside the intervals"))).otherwise(F.col("point")).alias("point"))
    hit = intervals.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("start") <= F.col("point")) & (F.col("point") < F.col("stop")), "left_semi")
    marks = hit.select(F.col("doc_id").alias("__doc"), F.col("ord").alias("__ord"), F.lit(True).alias("__hit"))
    out = intervals.join(marks, (F.col("doc_id") == F.col("__doc")) & (F.col("ord") == F.col("__ord")), "left")
    return out.withColumn("flagged", F.coalesce("__hit", F.lit(False))).drop("__doc", "__ord", "__hit")


def merge_groups(intervals: DataFrame, group: str = "grp") -> DataFrame:
    """doc_id, group, start, stop, data: of each group the first start, the stop of the interval that starts last (which
    may lie before another one's), and the payloads in order of start as one flat array."""
    return intervals.groupBy("doc_id", group).agg(
        F.min("start").alias("start"),
        F.max_by("stop", F.struct("start", "ord")).alias("stop"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "data"))), lambda x: x["data"]).alias("data"),
    )


def stitch(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """doc_id, grp, start, stop, data: each interval that a point falls into joined to the next one by start.

    intervals: doc_id, ord, start, stop, data. Groups are numbered from 1 in order. Documents without intervals give no
    rows.
    """
    w = W.partitionBy("doc_id").orderBy("start", "ord")
    new = F.when(F.lag("flagged").over(w), 0).otherwise(1)
    marked = flag_points(intervals, points).withColumn("__new", new)
    return merge_groups(marked.withColumn("grp", F.sum("__new").over(w).cast("int")))


def document_spans(intervals: DataFrame) -> DataFrame:
    """doc_id, start, stop: from the first interval's start to the stop of the one last in order."""
    first, last = F.min_by("start", F.struct("start", "ord")), F.max_by("stop", F.struct("start", "ord"))
    return intervals.groupBy("doc_id").agg(first.alias("start"), last.alias("stop"))


def scatter(intervals: DataFrame, fill: Column, piece: str = "data") -> DataFrame:
    """doc_id, start, chars: pieces (strings or arrays as long as their intervals) put at their places from the smallest
    start on, fill elsewhere; a later interval in ord overwrites an earlier one. chars is an array of characters or of the
    pieces' elements. No rows come of no intervals.

    The buffer ends at the stop of the interval that starts last; one that reaches past it is an error, as is a piece of
    another length.
    """
    n, whole = F.col("stop") - F.col("start"), F.col(piece)
    bad = F.raise_error(F.lit("interval and piece differ in length"))
    if intervals.schema[piece].dataType.typeName() == "string":
        whole = F.when(F.char_length(whole) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, ""))
    checked = intervals.withColumn("__piece", F.when(F.size(whole) != n, bad).otherwise(whole))
    ends = document_spans(intervals).select(F.col("doc_id").alias("d"), F.col("start").alias("lo"), F.col("stop").alias("hi"))
    cells = checked.select("doc_id", "ord", "start", F.posexplode("__piece").alias("k", "c"))
    cells = cells.groupBy("doc_id", (F.col("start") + F.col("k")).alias("at")).agg(F.max_by(F.struct("c"), "ord").alias("c"))
    per_doc = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"), F.max("at").alias("top"))
    joined = ends.join(per_doc, F.col("d") == F.col("doc_id"), "left")
    over = F.raise_error(F.lit("an interval reaches past the one that starts last"))
    places = F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo"), F.col("hi") - 1)).otherwise(F.array().cast("array<int>"))
    chars = F.transform(places, lambda i: F.when(F.try_element_at("m", i).isNull(), fill).otherwise(F.try_element_at("m", i)["c"]))
    return joined.select(F.col("d").alias("doc_id"), F.col("lo").alias("start"), F.when(F.col("top") >= F.col("hi"), over).otherwise(chars).alias("chars"))


def scatter_tensors(intervals: DataFrame, fill: Column, ndim: int, piece: str = "data") -> DataFrame:
    """doc_id, start, tensor: as scatter, for tensors of ndim dimensions whose first one runs along their interval. fill: a
    value, or an array of the flat values of one place. The other dimensions have to agree within a document."""
    t = F.col(piece)
    rest = F.slice(t["shape"], 2, ndim - 1)
    flat = intervals.withColumn("__rest", rest).withColumn(piece, tensors.rows(t, ndim))
    shapes = flat.groupBy(F.col("doc_id").alias("__doc")).agg(F.min("__rest").alias("__low"), F.max("__rest").alias("__rest"))
    found = scatter(flat.drop("__rest"), F.lit(None), piece).join(shapes, F.col("doc_id") == F.col("__doc"))
    size = F.aggregate("__rest", F.lit(1), lambda a, x: a * x)
    kind = intervals.schema[piece].dataType["values"].dataType
    same = fill.cast(kind) if isinstance(kind, ArrayType) and _is_array(intervals, fill) else F.array_repeat(fill.cast(kind.elementType), size)
    filled = F.transform("chars", lambda c: F.coalesce(c, same))
    out = tensors.from_rows(filled, F.col("__rest"))
    bad = F.when(F.col("__low") != F.col("__rest"), F.raise_error(F.lit("arrays differ in shape"))).when(F.size(same) != size, F.raise_error(F.lit("fill is of another shape")))
    return found.select("doc_id", "start", bad.otherwise(out).alias("tensor"))


def _is_array(df: DataFrame, value: Column) -> bool:
    return isinstance(df.select(value.alias("v")).schema["v"].dataType, ArrayType)
