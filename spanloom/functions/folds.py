"""Borders, stitch points and stitching within a row: folds over arrays, for streams and for rows that hold a whole document.

The forms over long tables (operators/segments.py) shuffle by document; these shuffle nothing, so they also run on a stream
without state. An array is folded in time that grows with its square where spans are looked up in one another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once
from .intervals import intersects

BORDER = "struct<start:bigint,stop:bigint>"


def borders(texts: Column, gap: int = 0) -> Column:
    """array<struct<start, stop>> of an array of texts: cumulative lengths in code points, `gap` more before each but the
    first. Null texts have no length; a null array stays null, an empty one has no borders."""

    def step(acc: Column, text: Column) -> Column:
        start = acc["end"] + F.when(F.size(acc["out"]) > 0, F.lit(gap)).otherwise(F.lit(0))
        stop = (start + F.coalesce(F.char_length(text), F.lit(0))).cast("bigint")
        border = F.struct(start.cast("bigint").alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("end"), F.concat(acc["out"], F.array(border)).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast(f"array<{BORDER}>").alias("out"))
    return F.aggregate(texts, first, step, lambda acc: acc["out"])


def sentence_borders(texts: Column) -> Column:
    """borders of sentences that are one character apart."""
    return borders(texts, gap=1)


def by_start(spans: Column) -> Column:
    """Spans by start, those of one start in the order that they come in."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def claims(intervals: Column, targets: Column) -> Column:
    """array<int>, one for each of the intervals by start: the place (from 1) of the first of the targets by start that it overlaps, 0 if none."""
    first = lambda iv, ordered: F.coalesce(F.array_position(F.transform(ordered, lambda t: intersects(iv, t)), F.lit(True)), F.lit(0)).cast("int")
    return once(by_start(targets), lambda ordered: F.transform(by_start(intervals), lambda iv: first(iv, ordered)))


def stitch_points(intervals: Column, targets: Column) -> Column:
    """array<int>: the last place of each interval that must be joined to the next to rebuild a target (cf.
    operators.segments.stitch_points), by start. Null or empty arrays of either give none."""

    def step(acc: Column, now: Column) -> Column:
        # from the last interval to the first: an interval gives a point if its target was met already
        again = (now["claim"] > 0) & F.array_contains(acc["met"], now["claim"])
        met = F.when((now["claim"] > 0) & ~again, F.concat(acc["met"], F.array(now["claim"]))).otherwise(acc["met"])
        return F.struct(met.alias("met"), F.when(again, F.concat(F.array(now["point"]), acc["out"])).otherwise(acc["out"]).alias("out"))

    paired = F.zip_with(by_start(intervals), claims(intervals, targets), lambda iv, c: F.struct(c.alias("claim"), (iv["stop"] - 1).cast("int").alias("point")))
    none = F.array().cast("array<int>")
    folded = F.aggregate(F.reverse(paired), F.struct(none.alias("met"), none.alias("out")), step, lambda acc: acc["out"])
    return F.coalesce(folded, none)


def stitch(intervals: Column, points: Column, data: str = "string") -> Column:
    """array<struct<start, stop, data>>: intervals (start, stop, data of the type `data`) by start, each that a point falls into
    joined to the next; data is the array of the payloads. A group stops where its last interval does. A point below 0 or not
    below the largest stop is an error. Null intervals stay null, null points are none."""
    group = f"struct<start:int,stop:int,data:array<{data}>>"

    def one(iv: Column) -> Column:
        return F.struct(iv["start"].cast("int").alias("start"), iv["stop"].cast("int").alias("stop"), F.array(iv["data"].cast(data)).alias("data"))

    def step(acc: Column, iv: Column, known: Column) -> Column:
        open_ = acc["open"]
        joined = F.struct(open_["start"].alias("start"), iv["stop"].cast("int").alias("stop"), F.concat(open_["data"], F.array(iv["data"].cast(data))).alias("data"))
        closes = open_.isNotNull() & ~acc["join"]
        return F.struct(
            F.when(closes, F.concat(acc["out"], F.array(open_))).otherwise(acc["out"]).alias("out"),
            F.when(acc["join"], joined).otherwise(one(iv)).alias("open"),
            F.when(iv["stop"] > iv["start"], F.arrays_overlap(F.sequence(iv["start"].cast("int"), (iv["stop"] - 1).cast("int")), known)).otherwise(F.lit(False)).alias("join"),
        )

    first = F.struct(F.array().cast(f"array<{group}>").alias("out"), F.lit(None).cast(group).alias("open"), F.lit(False).alias("join"))
    last = lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))

    def folded(known: Column) -> Column:
        return F.aggregate(by_start(intervals), first, lambda acc, iv: step(acc, iv, known), last)

    def checked(known: Column) -> Column:
        end = F.array_max(F.transform(intervals, lambda iv: iv["stop"]))
        outside = F.size(F.filter(known, lambda p: p < 0)) + F.when(F.size(known) > 0, F.when(F.array_max(known) >= F.coalesce(end, F.lit(0)), 1).otherwise(0)).otherwise(0)
        return F.when(outside > 0, F.raise_error(F.lit("a point lies outside the intervals")).cast(f"array<{group}>")).otherwise(folded(known))

    return once(F.coalesce(points.cast("array<int>"), F.array().cast("array<int>")), checked)
