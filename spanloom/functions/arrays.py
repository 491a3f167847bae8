"""Ragged arrays: padding, masks, chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use refers to it within a lambda: the optimizer would put the
    expression behind a column's name there and compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def max_length(df: DataFrame, array: str) -> int:
    """The longest array's length; no rows are an error."""
    found = df.agg(F.max(F.size(array))).first()[0]
    if found is None:
        raise ValueError("no arrays")
    return found


def max_shape(df: DataFrame, array: str, ndim: int = 1) -> tuple[int, ...]:
    """Elementwise largest shape of arrays of one or two dimensions."""
    if ndim == 1:
        return (max_length(df, array),)
    row = df.agg(F.max(F.size(array)), F.max(F.array_max(F.transform(array, F.size)))).first()
    if row[0] is None:
        raise ValueError("no arrays")
    return row[0], row[1] or 0


def stack(array: Column, length: int, filler: Column, trim: bool = False) -> Column:
    """The array filled up to length on the right; a longer one is cut with trim, else an error."""
    n = F.size(array)
    filled = F.concat(F.slice(array, 1, length), F.array_repeat(filler, F.greatest(F.lit(length) - n, F.lit(0))))
    if trim:
        return filled
    return F.when(n > length, F.raise_error(F.lit("an array is longer than the shape"))).otherwise(filled)


def stack_mask(array: Column, length: int) -> Column:
    """True where stack() has data."""
    n = F.least(F.size(array), F.lit(length))
    return F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(length) - n))


def stack_rows(rows: Column, shape: tuple[int, int], filler: Column, trim: bool = False) -> Column:
    """As stack, for arrays of arrays."""
    inner = F.transform(rows, lambda r: stack(r, shape[1], filler, trim))
    return stack(inner, shape[0], F.array_repeat(filler, shape[1]), trim)


def mask_false(array: Column, mask: Column, zero: Column) -> Column:
    """zero where the mask is false; lengths must agree."""
    kept = F.zip_with(array, mask, lambda x, m: F.when(m, x).otherwise(zero))
    return F.when(F.size(array) != F.size(mask), F.raise_error(F.lit("array and mask differ in length"))).otherwise(kept)


def chunk_steps(array: Column, size: int, filler: Column) -> Column:
    """Chunks of `size` steps in order, the last one filled up; none of an empty array."""
    if size < 1:
        raise ValueError("chunks need at least one step")
    last = F.ceil(F.size(array) / F.lit(size)).cast("int") - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: stack(F.slice(array, i * size + 1, F.lit(size)), size, filler))
    return F.when(F.size(array) > 0, chunks).otherwise(F.filter(F.array(F.slice(array, 1, 0)), lambda x: F.lit(False)))


def reverse(array: Column) -> Column:
    return F.reverse(array)


def flat_zip(df: DataFrame, flat: Sequence[str], nested: Sequence[str]) -> DataFrame:
    """One row per place of the nested arrays, as far as the shortest goes, with the flat columns repeated."""
    if not nested:
        raise ValueError("no nested column")
    n = F.least(*[F.size(c) for c in nested]) if len(nested) > 1 else F.size(nested[0])
    zipped = F.arrays_zip(*[F.slice(F.col(c), F.lit(1), n).alias(c) for c in nested])
    return df.select(*flat, F.posexplode(zipped).alias("pos", "z")).select(*flat, "pos", *[F.col("z")[c].alias(c) for c in nested])


def homogenous(df: DataFrame, value: Column) -> DataFrame:
    """One row, homogenous: whether all rows give the same value (no rows: yes); null is a value like any other."""
    return df.agg((F.count_distinct(F.struct(value)) <= 1).alias("homogenous"))
