"""Half-open labelled spans as columns: struct<start, stop, data> and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(start: Column, stop: Column, data: Column | None = None) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), (F.lit(None).cast("string") if data is None else data).alias("data"))


def intersects(a: Column, b: Column) -> Column:
    """Overlap. An empty span inside or at the start of another overlaps it; two empty ones at one place don't."""
    (s, e), (t, f) = (a["start"], a["stop"]), (b["start"], b["stop"])
    return ((t <= s) & (s < f)) | ((s <= t) & (t < e))


def covers(iv: Column, point: Column) -> Column:
    return (iv["start"] <= point) & (point < iv["stop"])


def holds(iv: Column, value: Column) -> Column:
    """Whether the payload equals the value; a null on either side is no."""
    return F.coalesce(iv["data"] == value, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def length(iv: Column) -> Column:
    """stop - start; an error where that is negative."""
    n = iv["stop"] - iv["start"]
    return F.when(n < 0, F.raise_error(F.lit("an interval stops before it starts")).cast("int")).otherwise(n)


def positions(iv: Column) -> Column:
    empty = F.array().cast("array<int>")
    return F.when(iv["stop"] > iv["start"], F.sequence(iv["start"], iv["stop"] - 1)).otherwise(empty)


def render(iv: Column) -> Column:
    return F.format_string("Interval(start=%d, stop=%d, data=%s)", iv["start"], iv["stop"], F.coalesce(iv["data"].cast("string"), F.lit("None")))


def reload(iv: Column, value: Column) -> Column:
    return F.struct(iv["start"].alias("start"), iv["stop"].alias("stop"), value.alias("data"))


def unload(ivs: Column) -> Column:
    return F.transform(ivs, lambda iv: iv["data"])


def nonempty(ivs: Column) -> Column:
    """Without empty intervals; one that stops before it starts is an error."""
    return F.filter(ivs, lambda iv: length(iv) > 0)


def extract(sequence: Column, ivs: Column, offset: int = 0, text: bool = True) -> Column:
    """What each interval, shifted left by offset, covers of a string (or, with text=False, of an array). Cut at the end
    as slices are; an interval that starts before the offset is an error."""

    def one(iv: Column) -> Column:
        start, n = iv["start"] - offset + 1, F.greatest(iv["stop"] - iv["start"], F.lit(0))
        got = F.substring(sequence, start, n) if text else F.slice(sequence, start, n)
        return F.when(iv["start"] < offset, F.raise_error(F.lit("an interval starts before the offset"))).otherwise(got)

    return F.transform(ivs, one)


def span(ivs: Column) -> Column:
    """From the first one's start to the last one's stop, in the given order; null if there is none."""
    return F.when(F.size(ivs) > 0, interval(F.get(ivs, F.lit(0))["start"], F.element_at(ivs, -1)["stop"]))


def breakpoints(ivs: Column) -> Column:
    return F.transform(ivs, lambda iv: iv["stop"] - 1)
