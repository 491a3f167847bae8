"""Regular-expression passes over text: ordered masked tokenising and chained replacement."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

# The default patterns, applied in this order.
NUMERIC = r"[0-9]*\.?[0-9]+"
WORDLIKE = r"\w+"
MISC = r"[^\s\w]"
DEFAULT = (NUMERIC, WORDLIKE, MISC)

#: White space as Python's str.strip sees it, as a Java character class (Java's own \s and trim differ).
JAVA_SPACE = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"
#: Python's \w without surprises of newer Unicode versions.
JAVA_WORD = r"[\p{L}\p{N}_]"

#: Names of the default patterns' tokens, and the patterns in Java's syntax.
KINDS = {"numeric": NUMERIC, "word": f"{JAVA_WORD}+", "misc": r"[^\p{IsWhite_Space}\x{1c}-\x{1f}\p{L}\p{N}_]"}

INTERVAL = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("data", T.StringType())])
#: Bytes of text that are tokenised at once, besides the last row of them: Spark bounds a batch by its rows, however long, and a
#: token takes many times its own bytes.
TEXT_BYTES = 1 << 20
_ARROW_INTERVAL = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("data", pa.string())])


def spans(patterns: Sequence[re.Pattern], text: str, mask: str = " ") -> list[tuple[int, int]]:
    """Matches of each pattern in turn on the text in which all earlier matches are masked, in order of place."""
    taken, left = [], list(text)
    for pattern in patterns:
        for match in list(pattern.finditer("".join(left))):
            start, stop = match.span()
            left[start:stop] = mask * (stop - start)
            taken.append((start, stop))
    return sorted(taken)


def counts(text: Column) -> Column:
    """A struct of n_tokens and n_chars (code points) for each of KINDS: what tokenise finds with the default patterns,
    without its places. Null text gives nulls."""
    found, masked = [], text
    for kind, pattern in KINDS.items():
        rest = F.regexp_replace(masked, pattern, "")
        count = F.regexp_count(masked, F.lit(pattern)).cast("bigint")
        found.append(F.struct(count.alias("n_tokens"), (F.char_length(masked) - F.char_length(rest)).cast("bigint").alias("n_chars")).alias(kind))
        masked = F.regexp_replace(masked, pattern, " ")
    return F.struct(*found)


def check_patterns(patterns: Sequence[str], mask: str) -> list[re.Pattern]:
    if len(mask) != 1:
        raise ValueError("the mask must be one character, or places shift")
    compiled = [re.compile(p) for p in patterns]
    if any(p.search("") for p in compiled):
        raise ValueError("a pattern matches the empty string")
    return compiled


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TEXT_BYTES of its text column, of one row at least; an empty batch as it is."""
    total = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy()
    start = done = 0
    while start < batch.num_rows or not batch.num_rows:
        n = max(1, int(np.searchsorted(total, done + TEXT_BYTES, side="right")) - start)
        yield batch.slice(start, n)
        if start + n >= batch.num_rows:
            return
        start += n
        done = int(total[start - 1])


class _Strings:
    """Strings as they are added, held as their bytes."""

    def __init__(self):
        self.bytes, self.ends = bytearray(), array("i", [0])

    def append(self, value: str) -> None:
        self.bytes += value.encode()
        self.ends.append(len(self.bytes))

    def finish(self) -> pa.Array:
        return pa.StringArray.from_buffers(len(self.ends) - 1, pa.py_buffer(self.ends), pa.py_buffer(self.bytes))


def _ints(values: array) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])


def tokenise(df: DataFrame, text: str = "text", patterns: Sequence[str] = DEFAULT, to: str = "tokens", mask: str = " ") -> DataFrame:
    """df with column `to`: array<struct<start, stop, data>> of what the patterns match (see spans); places count code
    points and data comes from the unmasked text. Null text gives null. Row-local and without a shuffle, so it runs on
    streams too, in slices of TEXT_BYTES: Spark has no expression for the places of all matches, and one built from split() needs a window."""
    compiled = check_patterns(patterns, mask)
    fields = [f for f in df.schema.fields if f.name != to]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch, text):
                starts, stops, data, ends, null = array("i"), array("i"), _Strings(), array("i", [0]), []
                for value in part.column(text):
                    t = value.as_py()
                    null.append(t is None)
                    for a, b in spans(compiled, t or "", mask):
                        starts.append(a)
                        stops.append(b)
                        data.append(t[a:b])
                    ends.append(len(starts))
                items = pa.StructArray.from_arrays([_ints(starts), _ints(stops), data.finish()], fields=list(_ARROW_INTERVAL))
                lists = pa.ListArray.from_arrays(_ints(ends), items, mask=pa.array(null, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), lists], names=[*(f.name for f in fields), to])

    bound_batches(df.sparkSession)
    return df.mapInArrow(batches, T.StructType([*fields, T.StructField(to, T.ArrayType(INTERVAL))]))


def transform(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """The replacements in turn, each on the result of the one before; Java patterns, groups as $1."""
    for pattern, new in replacements:
        text = F.regexp_replace(text, pattern, new)
    return text


def transform_by(replacements: Sequence[tuple[str, str | Callable[[re.Match], str]]]) -> Callable[[Column], Column]:
    """As transform, with Python patterns and replacements that may be functions of the match; Arrow batches."""
    compiled = [(re.compile(p), new) for p, new in replacements]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            for pattern, new in compiled:
                t = pattern.sub(new, t)
            return t

        return texts.map(one)

    return run


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{JAVA_SPACE}+|{JAVA_SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{JAVA_SPACE}+$", "")


def codes(annotation: Column) -> Column:
    """Different codes G#code in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(annotation, F.lit(f"G#({JAVA_WORD}+)"), 1))
