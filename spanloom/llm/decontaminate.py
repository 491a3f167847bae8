"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fold_case_words, let, materialise

#: A passage is leaked if WINDOW aligned words agree in all but SUBSTITUTIONS of them (a similarity of 0.84).
WINDOW, SUBSTITUTIONS = 13, 2
#: Items of fewer words than this are no evidence of a leak and are not searched for.
LEAST_WORDS = 5
#: Token offsets that a seed compares; what lies between is ignored. Whatever 2 of 13 words are substituted, one of
#: these masks fits into the 13 at some place without touching them (tests/llm proves it), so no leak is missed.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))


def _masks(short_lengths: list[int]) -> list[tuple[int, ...]]:
    """MASKS, then a full mask for each length of items that are shorter than a window."""
    return [*MASKS, *(tuple(range(n)) for n in short_lengths)]


def _n_seeds(words: Column, mask: tuple[int, ...]) -> Column:
    return F.greatest(words - mask[-1], F.lit(0))


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """keep, __sl_n (words), __sl_at (place in the seeds of all masks, mask after mask), __sl_seed."""
    hashed = df.select(*keep, F.transform("__sl_words", lambda w: F.xxhash64(w)).alias("__sl_h"))
    hashed = hashed.withColumn("__sl_n", F.size("__sl_h"))

    def of(m: int, mask: tuple[int, ...]) -> Column:
        places = F.sequence(F.lit(0), F.col("__sl_n") - 1 - mask[-1])
        seeds = F.transform(places, lambda i: F.xxhash64(F.lit(m), *[F.get("__sl_h", i + o) for o in mask]))
        return F.when(F.col("__sl_n") > mask[-1], seeds).otherwise(F.array().cast("array<bigint>"))

    seeds = F.concat(*[of(m, mask) for m, mask in enumerate(masks)])
    return hashed.select(*keep, "__sl_n", F.posexplode_outer(seeds).alias("__sl_at", "__sl_seed"))


def _place(masks: list[tuple[int, ...]], at: str, n: str, mask_id: Column) -> Column:
    """Word at which the seed starts."""
    place, before = F.lit(None).cast("int"), F.lit(0)
    for m, mask in enumerate(masks):
        place = F.when(mask_id == m, F.col(at) - before).otherwise(place)
        before = before + _n_seeds(F.col(n), mask)
    return place


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, n_windows (places where WINDOW aligned
    words of both agree but for SUBSTITUTIONS), first_word and last_word of the document's text they cover.

    Words are lower-case runs of letters and digits. An item of LEAST_WORDS to WINDOW - 1 words must be found whole
    and unchanged; shorter, empty and null ones leak nowhere, nor do null and empty documents. Rows that repeat a
    document id are one document; null is an id like any other. Other columns are not read. Empty tables give no rows.
    """
    words = items.select(F.col(item_id).alias("item_id"), fold_case_words(F.col(item_text)).alias("__sl_words"))
    words = words.where(F.size("__sl_words") >= LEAST_WORDS).distinct()
    sizes = words.select(F.size("__sl_words").alias("n")).where(F.col("n") < WINDOW).distinct()
    masks = _masks(sorted(r.n for r in sizes.collect()))  # at most WINDOW - LEAST_WORDS lengths
    wanted = _seeds(words, masks, ["item_id"])
    count = [F.lit(0)]
    for mask in masks:
        count.append(count[-1] + _n_seeds(F.col("__sl_n"), mask))
    mask_id = F.lit(0)
    for m in range(1, len(masks)):
        mask_id = mask_id + (F.col("__sl_at") >= count[m]).cast("int")
    wanted = wanted.withColumn("__sl_mask", mask_id)
    # the full mask of a length is for items of that length
    for m in range(len(MASKS), len(masks)):
        wanted = wanted.where((F.col("__sl_mask") != m) | (F.col("__sl_n") == len(masks[m])))
    wanted = wanted.select("item_id", "__sl_mask", "__sl_seed", _place(masks, "__sl_at", "__sl_n", F.col("__sl_mask")).alias("__sl_from"))
    wanted = materialise(wanted, "seeds")

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__sl_text"))
    tested = _seeds(texts.select("doc_id", fold_case_words(F.col("__sl_text")).alias("__sl_words")), masks, ["doc_id"])
    hits = tested.join(broadcast_if_small(wanted), "__sl_seed")
    shift = _place(masks, "__sl_at", "__sl_n", F.col("__sl_mask")) - F.col("__sl_from")
    hits = materialise(hits.select("doc_id", "item_id", shift.alias("__sl_shift")).distinct(), "hits")
    return _verify(texts, words, hits)


def _verify(texts: DataFrame, words: DataFrame, hits: DataFrame) -> DataFrame:
    """Aligns document and item at each hit's shift and counts the windows that agree well enough."""
    found = texts.withColumnRenamed("doc_id", "__sl_doc").join(
        broadcast_if_small(hits), F.col("__sl_doc").eqNullSafe(F.col("doc_id"))
    )
    found = found.withColumnRenamed("item_id", "__sl_hit").join(
        words.withColumnRenamed("__sl_words", "__sl_item"), F.col("__sl_hit").eqNullSafe(F.col("item_id"))
    )
    n_item, w = F.size("__sl_item"), F.least(F.lit(WINDOW), F.size("__sl_item"))
    need = F.when(w == WINDOW, WINDOW - SUBSTITUTIONS).otherwise(w)
    lo = F.greatest(F.lit(0), -F.col("__sl_shift"))

    def same(words: Column) -> Column:
        """1 or 0 for each aligned word."""
        hi = F.least(n_item, F.size(words) - F.col("__sl_shift"))
        each = F.transform(
            F.sequence(lo, hi - 1), lambda j: (F.get(words, j + F.col("__sl_shift")) == F.get("__sl_item", j)).cast("int")
        )
        return F.when(hi - lo >= w, each)

    def good(each: Column) -> Column:
        """Places in `each` at which a window agrees."""
        sums = lambda s: F.aggregate(F.slice(each, s + 1, w), F.lit(0), lambda a, x: a + x)
        return F.filter(F.sequence(F.lit(0), F.size(each) - w), lambda s: sums(s) >= need)

    places = let(fold_case_words(F.col("__sl_text")), lambda words: let(same(words), lambda e: F.when(e.isNotNull(), good(e))))
    found = found.select("doc_id", "item_id", "__sl_shift", w.alias("__sl_w"), lo.alias("__sl_lo"), F.explode(F.array(places)).alias("__sl_good"))
    found = found.where(F.size("__sl_good") > 0)
    start = F.col("__sl_lo") + F.col("__sl_shift")
    return (
        found.select(
            "doc_id",
            "item_id",
            "__sl_shift",
            F.size("__sl_good").alias("n"),
            (start + F.array_min("__sl_good")).alias("lo"),
            (start + F.array_max("__sl_good") + F.col("__sl_w") - 1).alias("hi"),
        )
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.sum("n").alias("n_windows"), F.min("lo").cast("bigint").alias("first_word"), F.max("hi").cast("bigint").alias("last_word"))
    )


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak a benchmark item (see find_leaks), with the columns they have. Rows of one doc_id, null among
    them, go together; null and empty texts stay, repeated rows too; an empty table stays empty."""
    leaked = materialise(find_leaks(docs, items, doc_id, text).select(F.col("doc_id").alias("__sl_leaked")).distinct(), "leaked")
    return docs.join(broadcast_if_small(leaked), F.col(doc_id).eqNullSafe(F.col("__sl_leaked")), "left_anti")
