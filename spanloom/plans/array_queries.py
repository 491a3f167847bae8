"""Queries over codes, arrays, bins and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, encode, metrics
from ..operators import binning, corpus, evaluation
from ..session import written
from .text_queries import SQL_PATTERNS, bigints, read, token_rows, tokens_sql

WORD_LENGTH, CHUNK, BINS, PACKED = 8, 10, 8, 16


def ascii_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigints(encode.ascii_charset(read(spark, sf_dir, "documents")))


_CHARS = "ch as (select c, row_number() over (order by c) code from (select distinct unnest(string_split(text, '')) c from {}) where ascii(c) < 128 and c <> '')"
ASCII_CHARSET = f'with {_CHARS.format("documents")} select c "char", code from ch'


def char_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    coder = encode.CharEncoder(items, word_length=WORD_LENGTH)
    rows = token_rows(read(spark, sf_dir, "documents"), "doc_id").select("data").distinct()
    codes = rows.select("data", F.posexplode(coder.encode_padded(F.col("data"), WORD_LENGTH)).alias("pos", "code"))
    return bigints(codes.groupBy("pos", "code").agg(F.count(F.lit(1)).alias("n")))


CHAR_ENCODE = f"""with {tokens_sql("documents", "doc_id")}, {_CHARS.format("benchmark")},
w as (select distinct data from tok), u as (select data, unnest(range(0, {WORD_LENGTH})) pos from w),
e as (select pos, case when pos >= length(data) then 0 else coalesce(code, (select count(*) + 1 from ch)) end code
  from u left join ch on substr(data, pos + 1, 1) = c)
select cast(pos as bigint) pos, cast(code as bigint) code, count(*) n from e group by all"""


def word_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary is the benchmark's words in order; the last one stands for all others."""
    words = token_rows(read(spark, sf_dir, "benchmark"), "item_id").select(F.lower("data").alias("word")).distinct()
    ranked = binning.ranked(words, F.asc("word")).select(F.col("rank").alias("idx"), "word", F.array(F.col("rank").cast("float")).alias("vector"))
    tokens = token_rows(read(spark, sf_dir, "documents"), "doc_id").groupBy("data").agg(F.count(F.lit(1)).alias("times"))  # a word is looked up once
    found = encode.word_vectors(tokens, ranked, "data", F.lower)
    total = F.sum(F.get("vector", F.lit(0)).cast("double") * F.col("times"))
    return bigints(found.groupBy("idx").agg(F.sum("times").alias("n"), total.alias("total")))


WORD_ENCODE = f"""with {tokens_sql("benchmark", "item_id")}, v as (select word, row_number() over (order by word) - 1 idx from (select distinct lower(data) word from tok)),
d as (with {tokens_sql("documents", "doc_id")} select data from tok)
select cast(coalesce(idx, (select max(idx) from v)) as bigint) idx, count(*) n, cast(sum(coalesce(idx, (select max(idx) from v))) as double) total
from d left join v on lower(data) = word group by 1"""


def char_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every turn as an array of codes, as many rows as the longest turn has words."""
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    coder = encode.CharEncoder(read(spark, sf_dir, "benchmark"), word_length=WORD_LENGTH)
    words = written(turns.select("conv_id", "turn", F.filter(F.split("text", "[ \n]+"), lambda w: w != "").alias("words")), "words")
    n = max(1, arrays.max_length(words, "words"))
    codes = words.select("conv_id", "turn", coder.encode_words(F.col("words"), n).alias("c"))
    cells = codes.select("conv_id", "turn", F.posexplode("c").alias("word", "row")).select("conv_id", "word", F.posexplode("row").alias("pos", "code"))
    return bigints(cells.groupBy("word", "pos").agg(F.sum("code").alias("total"), F.count_if(F.col("code") == 0).alias("n_zero")))


CHAR_ENCODE_WORDS = f"""with {_CHARS.format("benchmark")},
t as materialized (select conv_id, turn, row_number() over () r, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') w from conversations where text is not null),
m as (select greatest(1, max(len(w))) m, count(*) n from t), u as (select r, unnest(w) x, generate_subscripts(w, 1) - 1 word from t),
v as (select word, x, unnest(range(0, {WORD_LENGTH})) pos from u), e as (select word, pos, coalesce(code, (select count(*) + 1 from ch)) code from v left join ch on substr(x, pos + 1, 1) = c where pos < length(x)),
s as (select word, pos, sum(code) total, count(*) k from e group by all)
select cast(g.word as bigint) word, cast(g.pos as bigint) pos, cast(coalesce(total, 0) as bigint) total, (select n from m) - coalesce(k, 0) n_zero
from (select word, unnest(range(0, {WORD_LENGTH})) pos from (select unnest(range(0, m)) word from m)) g left join s on s.word = g.word and s.pos = g.pos"""


def parse_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with the number of its last document, of items `source:doc_id`."""
    docs = read(spark, sf_dir, "documents").where("source is not null")
    items = docs.select(F.col("doc_id").alias("ord"), F.concat_ws(":", "source", "doc_id").alias("item"))
    return bigints(corpus.mapping_table(items).select("name", "code"))


PARSE_MAPPING = "select source as name, max(doc_id) code from documents where source is not null group by source"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, a: lengths of the item's tokens in order."""
    rows = token_rows(read(spark, sf_dir, "benchmark"), "item_id")
    parts = F.array_sort(F.collect_list(F.struct("ord", (F.col("stop") - F.col("start")).alias("n"))))
    return rows.groupBy(F.col("doc_id").alias("item_id")).agg(F.transform(parts, lambda x: x["n"]).alias("a"))


_LENGTHS = f"""{tokens_sql("benchmark", "item_id")}, le as (select doc_id item_id, ord, stop - "start" n, count(*) over (partition by doc_id) size from tok),
mx as (select max(size) m from le), cells as (select item_id, pos from (select distinct item_id from le), (select unnest(range(0, m)) pos from mx))"""


def stack_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir)
    (n,) = arrays.max_shape(rows, "a")
    padded = rows.select("item_id", arrays.stack(F.col("a"), n, F.lit(-1)).alias("value"), arrays.stack_mask(F.col("a"), n).alias("mask"))
    return bigints(arrays.flat_zip(padded, ["item_id"], ["value", "mask"]))


STACK_PAD = f"""with {_LENGTHS}
select c.item_id, cast(c.pos as bigint) pos, cast(coalesce(n, -1) as bigint) as value, n is not null mask from cells c left join le on le.item_id = c.item_id and le.ord = c.pos"""


def stack_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of one array per item, cut and filled to 1 x 12."""
    rows = _lengths(spark, sf_dir).select("item_id", F.array("a").alias("rows"))
    stacked = rows.select("item_id", arrays.stack_rows(F.col("rows"), (2, 12), F.lit(0), trim=True).alias("s"))
    flat = stacked.select("item_id", F.posexplode("s").alias("r", "row")).select("item_id", "r", F.posexplode("row").alias("pos", "value"))
    return bigints(flat)


STACK_TRIMMED = f"""with {_LENGTHS}, it as (select distinct item_id from le), cc as (select item_id, r, pos from it, (select unnest(range(0, 2)) r), (select unnest(range(0, 12)) pos))
select cc.item_id, cast(r as bigint) r, cast(pos as bigint) pos, cast(case when r = 0 then coalesce(n, 0) else 0 end as bigint) as value
from cc left join le on le.item_id = cc.item_id and le.ord = cc.pos"""


def maskfalse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    mask = F.transform("embedding", lambda x: x > 0)
    kept = rows.select("vec_id", arrays.mask_false(F.col("embedding"), mask, F.lit(0).cast("float")).alias("a"))
    values = kept.select("vec_id", F.posexplode("a").alias("pos", "x"))
    return bigints(values.groupBy("vec_id").agg(F.count_if(F.col("x") == 0).alias("n_zero"), F.max("x").cast("double").alias("top")))


MASKFALSE = """
with u as (select vec_id, unnest(embedding) x from embeddings)
select vec_id, count(*) filter (x <= 0) n_zero, cast(max(case when x > 0 then x else 0 end) as double) top from u group by vec_id
"""


def chunksteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", arrays.chunk_steps(F.col("embedding"), CHUNK, F.lit(-9).cast("float")).alias("c"))
    flat = rows.select("vec_id", F.posexplode("c").alias("chunk", "row")).select("vec_id", "chunk", F.posexplode("row").alias("pos", "x"))
    return bigints(flat.select("vec_id", "chunk", "pos", F.col("x").cast("double").alias("value")))


CHUNKSTEPS = f"""
with e as (select vec_id, embedding, unnest(range(0, cast(ceil(len(embedding) / {CHUNK}.0) as bigint))) chunk from embeddings), f as (select *, unnest(range(0, {CHUNK})) pos from e)
select vec_id, cast(chunk as bigint) chunk, cast(pos as bigint) pos, cast(coalesce(embedding[chunk * {CHUNK} + pos + 1], -9) as double) as value from f
"""


def reverse_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.reverse(F.col("embedding"))).alias("pos", "x"))
    return bigints(rows.select("vec_id", "pos", F.col("x").cast("double").alias("value")))


REVERSE_STEPS = """select vec_id, cast(pos as bigint) pos, cast(embedding[len(embedding) - pos] as double) as value
from (select vec_id, embedding, unnest(range(0, len(embedding))) pos from embeddings)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir)
    (n,) = arrays.max_shape(rows, "a")
    rows2 = rows.select(F.array("a", "a").alias("b"))
    same = arrays.homogenous(read(spark, sf_dir, "embeddings"), F.size("embedding"))
    (r, c) = arrays.max_shape(rows2, "b", 2)
    return bigints(same.select(F.lit(n).alias("n"), F.lit(r).alias("n_rows"), F.lit(c).alias("n_columns"), "homogenous"))


SHAPES = f"""with {_LENGTHS} select cast(m as bigint) n, cast(2 as bigint) n_rows, cast(m as bigint) n_columns, (select count(distinct len(embedding)) <= 1 from embeddings) homogenous from mx"""


def flatzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).withColumn("b", F.transform(F.slice("a", F.lit(2), F.size("a")), lambda x: x * 2))
    return bigints(arrays.flat_zip(rows, ["item_id"], ["a", "b"]))


FLATZIP = f"""with {_LENGTHS} select x.item_id, x.ord pos, x.n a, y.n * 2 b from le x join le y on x.item_id = y.item_id and y.ord = x.ord + 1"""


def _bins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole vectors, up to four components of each once more so that lengths differ."""
    again = F.slice("embedding", F.lit(1), (F.col("vec_id") % 5).cast("int"))
    source = read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("src_idx"), F.concat("embedding", again).alias("a"))
    bins = source.select((F.col("src_idx") % BINS).cast("int").alias("bin"), F.floor(F.col("src_idx") / BINS).alias("pos"), "src_idx")
    return source, bins


_BINS = f"""sr as (select vec_id src_idx, list_concat(embedding, list_slice(embedding, 1, vec_id % 5)) a, len(embedding) + least(len(embedding), vec_id % 5) n,
vec_id % {BINS} bin, vec_id // {BINS} bp from embeddings where embedding is not null)"""


def merge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, bins = _bins(spark, sf_dir)
    merged = binning.merge_bins(source, bins, "a", F.lit(0).cast("float"))
    rows = merged.select("bin", F.posexplode("merged").alias("at", "x"))
    return bigints(rows.select("bin", "at", F.col("x").cast("double").alias("value")))


MERGE_BINS = f"""with {_BINS}, f as (select bin, flatten(list(a order by bp)) m from sr group by bin), l as (select max(len(m)) z from f)
select cast(bin as bigint) bin, cast(p as bigint) as at, cast(coalesce(m[p + 1], 0) as double) as value from (select bin, m, unnest(range(0, (select z from l))) p from f)"""


def unmerge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, bins = _bins(spark, sf_dir)
    lengths = source.select("src_idx", F.size("a").alias("length"))
    cut = binning.unmerge_bins(binning.merge_bins(source, bins, "a", F.lit(0).cast("float")), bins, lengths)
    rows = cut.select("bin", "pos", "src_idx", F.posexplode("piece").alias("at", "x"))
    return bigints(rows.select("bin", "pos", "src_idx", "at", F.col("x").cast("double").alias("value")))


UNMERGE_BINS = f"""with {_BINS} select cast(bin as bigint) bin, cast(bp as bigint) pos, src_idx, cast(p as bigint) as at, cast(a[p + 1] as double) as value
from (select *, unnest(range(0, n)) p from sr)"""


def unbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, bins = _bins(spark, sf_dir)
    binned = binning.bin_extract(source, bins).select("bin", "pos", "a")
    return bigints(binning.unbin(binned, bins).select("src_idx", F.array_max("a").cast("double").alias("top"), F.array_min("a").cast("double").alias("low"), F.size("a").alias("n")))


UNBIN = f"with {_BINS} select src_idx, cast(list_max(a) as double) top, cast(list_min(a) as double) low, n from sr"


def decode_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, bins = _bins(spark, sf_dir)
    scores = source.select("src_idx", F.transform("a", lambda x: F.abs(x) * 4).alias("a"))
    lengths = source.select("src_idx", F.size("a").alias("length"))
    decoded = binning.decode_predictions(binning.merge_bins(scores, bins, "a", F.lit(0).cast("float")), bins, lengths)
    return bigints(decoded.select("src_idx", F.explode("points").alias("point")))


DECODE_PREDICTIONS = f"""with {_BINS} select src_idx, cast(p as bigint) point from (select *, unnest(range(0, n)) p from sr) where abs(a[n - p]) * 4 > 0.5"""


def binpack_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bin holds, documents weighing as much as they have characters."""
    packed = binning.binpack(read(spark, sf_dir, "documents"), PACKED, F.coalesce(F.char_length("text"), F.lit(0)), "doc_id")
    figures = F.count(F.lit(1)).alias("n_items"), F.sum("weight").alias("load"), F.max("weight").alias("heaviest"), F.min("weight").alias("lightest"), F.max("pos").alias("last_pos")
    return bigints(packed.groupBy("bin").agg(*figures))


#: Item by item.
BINPACK_BALANCE = f"""
with recursive r as materialized (select coalesce(length(text), 0) w, row_number() over (order by coalesce(length(text), 0) desc, doc_id) k from documents),
g as (
  select 0::bigint k, list_transform(range(0, {PACKED}), lambda x: 0::bigint) loads, list_transform(range(0, {PACKED}), lambda x: []::bigint[]) held
  union all
  select r.k, list_transform(loads, lambda x, i: case when i = p then x + w else x end), list_transform(held, lambda x, i: case when i = p then list_append(x, w) else x end)
  from (select *, list_position(loads, list_min(loads)) p from g) g join r on r.k = g.k + 1
), f as (select unnest(range(0, {PACKED})) bin, unnest(loads) load, unnest(held) held from (select * from g order by k desc limit 1))
select bin, cast(len(held) as bigint) n_items, load, list_max(held) heaviest, list_min(held) lightest, cast(len(held) - 1 as bigint) last_pos from f
"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("epoch"), F.col("quality").cast("double").alias("t"), ((F.col("doc_id") % 5) / F.lit(4.0)).alias("p"))


_PREDICTIONS = "pr as (select doc_id % 10 epoch, cast(quality as double) t, (doc_id % 5) / 4.0 p from labels)"


def _sums(what: str) -> str:
    return f"sum(round_even(greatest(0, least(1, {what})), 0))"


def precision_recall_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    scores = {"p": metrics.precision(t, p), "r": metrics.recall(t, p), "f1": metrics.fmeasure(t, p), "f2": metrics.fbeta(t, p, 2.0)}
    by = _predictions(spark, sf_dir).groupBy("epoch").agg(*[F.round(c, 6).alias(n) for n, c in scores.items()])
    return by.withColumn("log", metrics.score_log({"p": F.col("p"), "r": F.col("r")}))


PRECISION_RECALL_F = f"""with {_PREDICTIONS}, a as (select epoch, {_sums("t * p")} tp, {_sums("p")} pp, {_sums("t")} pt from pr group by epoch),
s as (select epoch, tp / (pp + 1e-7) p, tp / (pt + 1e-7) r from a), q as (select epoch, round(p, 6) p, round(r, 6) r, round(2 * p * r / (p + r + 1e-7), 6) f1, round(5 * p * r / (4 * p + r + 1e-7), 6) f2 from s)
select epoch, p, r, f1, f2, format('p - {{:.3f}} | r - {{:.3f}}', p, r) log from q"""


def softmax_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are the vector's first half, truth the rest."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    vectors = read(spark, sf_dir, "embeddings").where("size(embedding) > 1").select("vec_id", "embedding", half.alias("h"))
    rows = vectors.select((F.col("vec_id") % 4).alias("part"), F.slice("embedding", F.col("h") + 1, F.size("embedding")).alias("t"), F.slice("embedding", F.lit(1), F.col("h")).alias("p"))
    t, p = F.col("t"), F.col("p")
    scores = {"p": metrics.precision_softmax(t, p), "r": metrics.recall_softmax(t, p), "f": metrics.fmeasure_softmax(t, p)}
    return rows.groupBy("part").agg(*[F.round(c, 6).alias(n) for n, c in scores.items()])


SOFTMAX_METRICS = """
with e as (select vec_id % 4 part, embedding[len(embedding) // 2 + 1:] t, embedding[1:len(embedding) // 2] p from embeddings where len(embedding) > 1),
o as (select part, case when list_position(t, list_max(t)) = 2 then 1.0 else 0.0 end t, case when list_position(p, list_max(p)) = 2 then 1.0 else 0.0 end p from e),
s as (select part, (sum(t * p) + 1e-7) / (sum(p) + 1e-7) p, (sum(t * p) + 1e-7) / (sum(t) + 1e-7) r from o group by part)
select part, round(p, 6) p, round(r, 6) r, round(2 * p * r / (p + r), 6) f from s
"""


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _predictions(spark, sf_dir).groupBy("epoch").agg(F.round(metrics.recall(F.col("t"), F.col("p")), 6).alias("score"))
    return evaluation.best_so_far(scores)


BEST_EPOCH = f"""with {_PREDICTIONS}, s as (select epoch, round({_sums("t * p")} / ({_sums("t")} + 1e-7), 6) score from pr group by epoch)
select epoch, score, max(score) over (order by epoch) best, coalesce(score > max(score) over (order by epoch rows between unbounded preceding and 1 preceding), true) improved from s"""


def queries() -> dict:
    named = (
        ascii_charset, char_encode, char_encode_words, word_encode, parse_mapping, stack_pad, stack_trimmed, maskfalse, chunksteps, reverse_steps, shapes, flatzip, merge_bins,
        unmerge_bins, unbin, decode_predictions, binpack_balance, precision_recall_f, softmax_metrics, best_epoch,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "ascii_charset": ASCII_CHARSET,
        "char_encode": CHAR_ENCODE,
        "char_encode_words": CHAR_ENCODE_WORDS,
        "word_encode": WORD_ENCODE,
        "parse_mapping": PARSE_MAPPING,
        "stack_pad": STACK_PAD,
        "stack_trimmed": STACK_TRIMMED,
        "maskfalse": MASKFALSE,
        "chunksteps": CHUNKSTEPS,
        "reverse_steps": REVERSE_STEPS,
        "shapes": SHAPES,
        "flatzip": FLATZIP,
        "merge_bins": MERGE_BINS,
        "unmerge_bins": UNMERGE_BINS,
        "unbin": UNBIN,
        "decode_predictions": DECODE_PREDICTIONS,
        "binpack_balance": BINPACK_BALANCE,
        "precision_recall_f": PRECISION_RECALL_F,
        "softmax_metrics": SOFTMAX_METRICS,
        "best_epoch": BEST_EPOCH,
    }
