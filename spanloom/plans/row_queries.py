"""Queries whose work stays within a row, each with its SQL: folds over a document's pieces, arrays of several dimensions.

Folded columns are exploded with the outer form: the optimizer puts a filter on the column before the plain one, which would fold twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, patterns, tensors
from ..functions import intervals as iv
from ..operators import segments
from ..streaming import documents as whole
from .text_queries import APART, LONG, bigints, points_sql, read, stitch_sql, tokens_sql

#: Steps of a chunk, and what fills what is missing.
STEPS, FILLER = 3, -9.0


def line_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders of each document's lines, a place apart, by a fold within the row."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("texts"))
    found = docs.select("doc_id", folds.sentence_borders(F.col("texts")).alias("borders"))
    return bigints(found.select("doc_id", F.posexplode_outer("borders").alias("line", "b")).where("line is not null").select("doc_id", "line", "b.start", "b.stop"))


LINE_BORDERS = """
with l as (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents where text is not null),
e as (select doc_id, line, length(x) n, sum(length(x)) over (partition by doc_id order by line) + line e from l)
select doc_id, cast(line as bigint) line, cast(e - n as bigint) as start, cast(e as bigint) as stop from e
"""


def _targets(text: Column) -> Column:
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(APART))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda a: F.struct(a.alias("start"), F.least(a + LONG, F.char_length(text)).alias("stop")))


def stitch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every turn stitched to spans that overlap, without a shuffle."""
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", _targets(F.col("text")).alias("targets"))
    found = whole.stitched_tokens(turns).select("doc_id", F.posexplode_outer("stitched").alias("grp", "s")).where("grp is not null")
    return bigints(found.select("doc_id", (F.col("grp") + 1).alias("grp"), "s.start", "s.stop", F.array_join("s.data", " ").alias("data")))


STITCH_ROWS = stitch_sql(points_sql("conversations", "conv_id * 1000 + turn"))


def reload_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every turn with a mark on the payloads of long ones: the payloads, and how many spans are the same as before."""
    turns = read(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    marked = lambda t: iv.reload(t, F.when(F.char_length(t["data"]) > 3, F.concat(t["data"], F.lit("+"))).otherwise(t["data"]))
    found = patterns.tokenise(turns).withColumn("loaded", F.transform("tokens", marked))
    same = F.size(F.filter(F.zip_with("tokens", "loaded", iv.same), lambda x: x))
    return bigints(found.where("size(tokens) > 0").select("doc_id", F.array_join(iv.unload(F.col("loaded")), " ").alias("data"), same.alias("n_same")))


RELOAD_SPANS = f"""with {tokens_sql("conversations", "conv_id * 1000 + turn")}
select doc_id, string_agg(case when length(data) > 3 then data || '+' else data end, ' ' order by ord) as data, count(*) filter (length(data) <= 3) n_same from tok group by doc_id"""


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, t: each vector as 1 x 8 x n, 2 x 4 x n or 4 x 2 x n; 1 x 1 x n if its length can't be divided by 8."""
    rows = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    even = F.array(*(F.expr(f"cast({x} as int)") for x in ("shiftleft(1, cast(vec_id % 3 as int))", "8 div shiftleft(1, cast(vec_id % 3 as int))", "size(e) div 8")))
    shape = F.when(F.size("e") % 8 == 0, even).otherwise(F.array(F.lit(1), F.lit(1), F.size("e")))
    return rows.select("vec_id", tensors.tensor(F.col("e"), shape).alias("t"))


_TENSORS = """e as (select vec_id, embedding e, len(embedding) n, case when len(embedding) % 8 = 0 then (1 << (vec_id % 3)::int) else 1 end a,
  case when len(embedding) % 8 = 0 then 8 // (1 << (vec_id % 3)::int) else 1 end b, case when len(embedding) % 8 = 0 then len(embedding) // 8 else len(embedding) end c
  from embeddings where embedding is not null)"""


def stack_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All brought to the largest shape; places without data hold the filler and are false in the mask."""
    rows = _tensors(spark, sf_dir)
    shape = tensors.limits(rows, "t", (-1, -1, -1))
    both = rows.select("vec_id", tensors.stack(F.col("t"), shape, F.lit(FILLER)).alias("s"), tensors.stack_mask(F.col("t"), shape).alias("m"))
    zipped = both.select("vec_id", F.struct(F.col("s.shape").alias("shape"), F.arrays_zip(F.col("s.values").alias("value"), F.col("m.values").alias("mask")).alias("values")).alias("x"))
    flat = tensors.exploded(zipped, ["vec_id"], "x", 3, "v")
    return bigints(flat.select("vec_id", "i0", "i1", "i2", "v.value", "v.mask"))


STACK_TENSORS = f"""with {_TENSORS}, m as (select max(a) a, max(b) b, max(c) c from e),
p as (select e.*, i0, i1, i2 from e, (select unnest(range(0, a)) i0 from m), (select unnest(range(0, b)) i1 from m), (select unnest(range(0, c)) i2 from m))
select vec_id, cast(i0 as bigint) i0, cast(i1 as bigint) i1, cast(i2 as bigint) i2,
  case when i0 < a and i1 < b and i2 < c then cast(e[(i0 * b + i1) * c + i2 + 1] as double) else {FILLER} end as value, i0 < a and i1 < b and i2 < c mask from p"""


def chunk_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of steps along the second dimension."""
    rows = _tensors(spark, sf_dir).select("vec_id", F.posexplode(tensors.chunk_steps(F.col("t"), STEPS, F.lit(FILLER), 3)).alias("chunk", "c"))
    return bigints(tensors.exploded(rows, ["vec_id", "chunk"], "c", 3))


CHUNK_TENSORS = f"""with {_TENSORS}, k as (select *, unnest(range(0, (b + {STEPS} - 1) // {STEPS})) chunk from e),
p as (select *, unnest(range(0, a * {STEPS} * c)) pl from k), q as (select *, pl // ({STEPS} * c) i0, (pl // c) % {STEPS} i1, pl % c i2 from p)
select vec_id, cast(chunk as bigint) chunk, cast(i0 as bigint) i0, cast(i1 as bigint) i1, cast(i2 as bigint) i2,
  case when chunk * {STEPS} + i1 < b then cast(e[(i0 * b + chunk * {STEPS} + i1) * c + i2 + 1] as double) else {FILLER} end as value from q"""


def scatter_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as n x 4 arrays (what is left of 4 is a part of its own, of another document), their halves two places apart."""
    rows = read(spark, sf_dir, "embeddings").where("size(embedding) >= 8 and size(embedding) % 4 = 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = rows.select("vec_id", "e", F.expr("size(e) div 4").cast("int").alias("n"), F.expr("size(e) div 8").cast("int").alias("h"))
    part = lambda k, start, n, values: F.struct(F.lit(k).alias("ord"), start.alias("start"), (start + n).alias("stop"), tensors.tensor(values, F.array(n, F.lit(4))).alias("data"))
    low, high = F.slice("e", F.lit(1), F.col("h") * 4), F.slice("e", F.col("h") * 4 + 1, F.size("e"))
    both = F.array(part(0, F.lit(0), F.col("h"), low), part(1, F.col("h") + 2, F.col("n") - F.col("h"), high))
    spread = segments.scatter_tensors(rows.select(F.col("vec_id").alias("doc_id"), F.inline(both)), F.lit(FILLER), 2)
    return bigints(tensors.exploded(spread, ["doc_id"], "tensor", 2))


SCATTER_HALVES = f"""with e as (select vec_id, embedding e, len(embedding) // 4 n, len(embedding) // 8 h from embeddings where len(embedding) >= 8 and len(embedding) % 4 = 0),
p as (select *, unnest(range(0, n + 2)) i0 from e), q as (select *, unnest(range(0, 4)) i1 from p)
select vec_id doc_id, cast(i0 as bigint) i0, cast(i1 as bigint) i1,
  case when i0 < h then cast(e[i0 * 4 + i1 + 1] as double) when i0 < h + 2 then {FILLER} else cast(e[(i0 - 2) * 4 + i1 + 1] as double) end as value from q"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (line_borders, stitch_rows, reload_spans, stack_tensors, chunk_tensors, scatter_halves)}


def oracle_sql() -> dict[str, str]:
    return {"line_borders": LINE_BORDERS, "stitch_rows": STITCH_ROWS, "reload_spans": RELOAD_SPANS, "stack_tensors": STACK_TENSORS, "chunk_tensors": CHUNK_TENSORS, "scatter_halves": SCATTER_HALVES}
