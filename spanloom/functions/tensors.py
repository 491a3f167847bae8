"""Arrays of any number of dimensions as columns: struct<shape array<int>, values array<T>>, values in row-major order.

Everything is index arithmetic over the flat values in the JVM. The number of dimensions is that of the plan, not of the row: a
row of another one is an error when it is read. A null tensor stays null."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import once


def tensor(values: Column, shape: Column) -> Column:
    """Flat values with their shape (an array of ints), which has to fit their number."""
    n = F.aggregate(shape, F.lit(1), lambda a, x: a * x)
    fits = F.struct(shape.cast("array<int>").alias("shape"), values.alias("values"))
    checked = F.when(n != F.size(values), F.raise_error(F.lit("values and shape differ in number"))).otherwise(fits)
    return F.when(values.isNotNull() & shape.isNotNull(), checked)


def from_nested(nested: Column, ndim: int) -> Column:
    """Of arrays nested ndim deep; ragged ones are an error."""
    shape, values, ragged = [F.size(nested)], nested, F.lit(False)
    for _ in range(ndim - 1):
        sizes = F.transform(values, F.size)
        ragged = ragged | (F.size(F.array_distinct(sizes)) > 1)
        shape.append(F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)))
        values = F.flatten(values)
    found = F.struct(F.array(*shape).alias("shape"), values.alias("values"))
    return F.when(nested.isNotNull(), F.when(ragged, F.raise_error(F.lit("the arrays are ragged"))).otherwise(found))


def dim(t: Column, axis: int) -> Column:
    return F.get(t["shape"], F.lit(axis))


def max_shape(df: DataFrame, t: str) -> tuple[int, ...]:
    """Elementwise largest shape. No tensors, or tensors of different numbers of dimensions, are an error."""
    shape = F.col(t)["shape"]
    low, high = df.agg(F.min(F.size(shape)), F.max(F.size(shape))).first() if df.limit(1).count() else (None, None)
    if low is None or low < 0:
        raise ValueError("no arrays")
    if low != high:
        raise ValueError("arrays differ in their number of dimensions")
    return tuple(df.agg(*(F.max(F.get(shape, F.lit(i))).alias(f"n{i}") for i in range(low))).first())


def limits(df: DataFrame, t: str, shape: Sequence[int] | None = None) -> tuple[int, ...]:
    """The shape asked for, sizes of -1 (or all, of None) inferred from the rows."""
    found = max_shape(df, t)
    if shape is None:
        return found
    if len(shape) != len(found):
        raise ValueError("the shape's number of dimensions isn't that of the arrays")
    if any(s < 1 and s != -1 for s in shape):
        raise ValueError("sizes must be positive, or -1")
    return tuple(f if s == -1 else s for s, f in zip(shape, found, strict=True))


def _times(factors: Sequence[Column | int]) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1))


def _places(shape: Sequence[int], of) -> Column:
    """of(coordinates) for each place of the shape, in row-major order."""
    n, coordinates = 1, []
    for s in reversed(shape):
        coordinates.insert(0, (n, s))
        n *= s
    if not n:
        return F.slice(F.array(of([F.lit(0)] * len(shape))), 1, 0)
    at = lambda k: of([F.pmod(F.floor(k / step).cast("int"), F.lit(s)) for step, s in coordinates])
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def _inside(t: Column, at: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, (c < dim(t, i) for i, c in enumerate(at)))


def _value(t: Column, at: Sequence[Column]) -> Column:
    place = reduce(lambda a, b: a + b, (c * _times([dim(t, j) for j in range(i + 1, len(at))]) for i, c in enumerate(at)))
    return F.get(t["values"], place)


def _like(t: Column, ndim: int, out: Callable[[Column], Column]) -> Column:
    """out of the tensor, computed once a row, if it has ndim dimensions."""
    bad = F.raise_error(F.lit("arrays differ in their number of dimensions"))
    return once(t, lambda x: F.when(x.isNotNull(), F.when(F.size(x["shape"]) != ndim, bad).otherwise(out(x))))


def _of_shape(shape: Sequence[int], values: Column) -> Column:
    return F.struct(F.array(*(F.lit(s) for s in shape)).alias("shape"), values.alias("values"))


def stack(t: Column, shape: Sequence[int], filler: Column, trim: bool = False) -> Column:
    """The tensor brought to the shape: filled up on the far sides; what reaches beyond is cut with trim, else an error."""

    def out(x: Column) -> Column:
        values = _of_shape(shape, _places(shape, lambda at: F.when(_inside(x, at), _value(x, at)).otherwise(filler)))
        if trim:
            return values
        beyond = reduce(lambda a, b: a | b, (dim(x, i) > s for i, s in enumerate(shape)))
        return F.when(beyond, F.raise_error(F.lit("an array doesn't fit the shape"))).otherwise(values)

    return _like(t, len(shape), out)


def stack_mask(t: Column, shape: Sequence[int]) -> Column:
    """A tensor of booleans: where stack() has data."""
    return _like(t, len(shape), lambda x: _of_shape(shape, _places(shape, lambda at: _inside(x, at))))


def mask_false(t: Column, mask: Column, zero: Column) -> Column:
    """zero where the mask, a tensor of the same shape, is false."""
    kept = F.zip_with(t["values"], mask["values"], lambda x, m: F.when(m, x).otherwise(zero))
    out = F.struct(t["shape"].alias("shape"), kept.alias("values"))
    return F.when(t["shape"] != mask["shape"], F.raise_error(F.lit("array and mask differ in shape"))).otherwise(out)


def chunk_steps(t: Column, size: int, filler: Column, ndim: int) -> Column:
    """Array of tensors, chunk after chunk of `size` steps along the second dimension, the last one filled up; no steps, no chunks."""
    if size < 1:
        raise ValueError("chunks need at least one step")
    if ndim < 2:
        raise ValueError("arrays need two dimensions or more")

    def out(x: Column) -> Column:
        rest = _times([dim(x, i) for i in range(2, ndim)])
        shape = F.array(dim(x, 0), F.lit(size), *(dim(x, i) for i in range(2, ndim)))
        n = dim(x, 0) * size * rest

        def chunk(k: Column) -> Column:
            def value(p: Column) -> Column:
                row, step, inner = F.floor(p / (rest * size)).cast("int"), k * size + F.pmod(F.floor(p / rest).cast("int"), F.lit(size)), F.pmod(p, rest)
                return F.when(step < dim(x, 1), F.get(x["values"], (row * dim(x, 1) + step) * rest + inner)).otherwise(filler)

            values = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.slice(x["values"], 1, 0))
            return F.struct(shape.alias("shape"), values.alias("values"))

        chunks = F.transform(F.sequence(F.lit(0), F.ceil(dim(x, 1) / size).cast("int") - 1), chunk)
        none = F.slice(F.array(F.struct(x["shape"].alias("shape"), x["values"].alias("values"))), 1, 0)
        return F.when(dim(x, 1) > 0, chunks).otherwise(none)

    return _like(t, ndim, out)


def rows(t: Column, ndim: int) -> Column:
    """array<array<T>>: the parts along the first dimension, each flat."""

    def out(x: Column) -> Column:
        rest = _times([dim(x, i) for i in range(1, ndim)])
        parts = F.transform(F.sequence(F.lit(0), dim(x, 0) - 1), lambda i: F.slice(x["values"], i * rest + 1, rest))
        return F.when(dim(x, 0) > 0, parts).otherwise(F.slice(F.array(x["values"]), 1, 0))

    return _like(t, ndim, out)


def from_rows(parts: Column, rest: Column) -> Column:
    """The tensor of flat parts, each of the shape rest."""
    return F.struct(F.concat(F.array(F.size(parts)), rest.cast("array<int>")).alias("shape"), F.flatten(parts).alias("values"))


def exploded(df: DataFrame, keys: Sequence[str], t: str, ndim: int, value: str = "value") -> DataFrame:
    """keys, i0, i1, ..., value: a row for each place."""
    flat = df.select(*keys, F.col(t)["shape"].alias("__shape"), F.posexplode(F.col(t)["values"]).alias("__at", value))
    step = lambda i: _times([F.get("__shape", F.lit(j)) for j in range(i + 1, ndim)])
    places = [F.pmod(F.floor(F.col("__at") / step(i)).cast("int"), F.get("__shape", F.lit(i))).alias(f"i{i}") for i in range(ndim)]
    return flat.select(*keys, *places, value)
