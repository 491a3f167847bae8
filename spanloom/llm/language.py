"""Language mixtures: expectation-maximisation over words whose likelihoods come from character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise

#: Hash buckets of letter trigrams. The model is a table of languages x BUCKETS, whatever the corpus.
BUCKETS = 1 << 16
SMOOTHING = 0.05
#: Different values of lang that are learned at most; their tables are broadcast, 256 KB each.
MOST_LANGUAGES = 256
STEPS, AGAIN = 8, 3
#: Nats that a language must add to a document's log-likelihood for each log(words) to stay in its set.
PENALTY = 2.0
#: Characters looked at together for each few languages, which bounds memory.
CHARS, FEW = 1_500_000, 4
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _spread(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first text, end text, trigram bucket of each letter, first letter of each word, text of each
    word (from the first)."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        low = [(t or "").lower() for t in texts[at:end]]
        code = np.frombuffer(("\n".join(["", *low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, 0).astype(np.uint32)
        where = np.flatnonzero(letter)
        mixed = code[where - 1] * np.uint32(0x9E3779B1) + code[where] * np.uint32(0x85EBCA77) + code[where + 1] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        bucket = (mixed >> np.uint32(16)).astype(np.int64)
        first = np.flatnonzero(~letter[where - 1])
        borders = np.cumsum([1, *(len(t) + 1 for t in low)])
        yield at, end, bucket, first, np.searchsorted(borders, where[first], side="right") - 1
        at = end


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n over all rows of docs whose lang isn't null; a task's own table has languages x BUCKETS cells."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in it:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for at, end, bucket, first, doc in _spread(texts):
                if not len(first):
                    continue
                of_letter = np.repeat(doc, np.diff([*first, len(bucket)]))
                starts = np.searchsorted(of_letter, np.arange(end - at + 1))
                for k in range(at, end):
                    a, b = starts[k - at], starts[k - at + 1]
                    if b > a:
                        table = tables.setdefault(langs[k], np.zeros(BUCKETS, np.int64))
                        table += np.bincount(bucket[a:b], minlength=BUCKETS) if b - a > 4096 else 0
                        if b - a <= 4096:
                            np.add.at(table, bucket[a:b], 1)
        for lang_, table in tables.items():
            on = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(table[on])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    found = map_texts(rows, count, "lang string, bucket int, n bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Learned languages in order, and log-probabilities of trigram buckets in each (languages x BUCKETS, float32). A language's counts
    come to the driver as one row of BUCKETS numbers at most, one after another; more languages than MOST_LANGUAGES are an error, as the
    column then holds something else."""
    found = trigram_counts(docs, text, lang).groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n"))
    found = materialise(found, "trigrams")
    n = found.count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} different languages, {MOST_LANGUAGES} at most")
    langs, tables = [], np.zeros((n, BUCKETS), np.float32)
    for k, row in enumerate(found.orderBy("lang").toLocalIterator()):
        counts = np.zeros(BUCKETS)
        counts[row.buckets] = row.n
        langs.append(row.lang)
        tables[k] = np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))
    return langs, tables


def _mix(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from share (documents x languages): shares and the log-likelihood of each document."""
    words = np.diff([*starts, len(doc)])[:, None]
    for _ in range(steps):
        joint = like * share[doc]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / words
    return share, np.add.reduceat(np.log((like * share[doc]).sum(axis=1)), starts)


def mixtures(logs: np.ndarray, bucket: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of which each has a word (doc: 0, 1, ... ascending): shares of all languages (0 for those not in the
    chosen set; the rest sum to 1), log-likelihoods.

    The set starts with all languages. The language of least share goes if the likelihood without it falls by less
    than PENALTY x log(words + 1); then the next, until none goes.
    """
    by_word = np.stack([np.add.reduceat(one[bucket], first) for one in logs], axis=1)
    starts = np.searchsorted(doc, np.arange(doc[-1] + 1))
    n = len(starts)
    like = np.exp((by_word - by_word.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-12
    share, fit_ = _mix(like, doc, starts, np.full((n, len(logs)), 1.0 / len(logs)), STEPS)
    cost = PENALTY * np.log(np.diff([*starts, len(doc)]) + 1)
    going = np.ones(n, bool)
    for _ in range(len(logs) - 1):
        least = np.where(share > 0, share, np.inf).argmin(axis=1)
        going &= (share > 0).sum(axis=1) > 1
        less = share.copy()
        less[np.flatnonzero(going), least[going]] = 0
        less /= less.sum(axis=1, keepdims=True)
        less, fit_less = _mix(like, doc, starts, less, AGAIN)
        going &= fit_ - fit_less < cost
        if not going.any():
            break
        share, fit_ = np.where(going[:, None], less, share), np.where(going, fit_less, fit_)
    return share, fit_


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, then lang_pred (the language of the largest share; `und` without a letter or without a model),
    score (that share; 0 for und) and shares (a map of the chosen languages to their shares, ties by language name).
    One row per row; the whole text counts."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    rows = docs.select(*keep, F.col(text).alias("__sl_text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in it:
            n = batch.num_rows
            pred, score, shares = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
            for at, _, bucket, first, doc in _spread(batch.column(n_keep).to_pylist(), max(1, CHARS * FEW // max(FEW, len(names)))):
                if not len(first) or not names:
                    continue
                own, dense = np.unique(doc, return_inverse=True)
                share, _ = mixtures(table, bucket, first, dense)
                best = share.argmax(axis=1)
                for i, k in enumerate((own + at).tolist()):
                    pred[k], score[k] = names[best[i]], share[i, best[i]]
                    shares[k] = [(name, s) for name, s in zip(names, share[i].tolist(), strict=True) if s > 0]
            made = [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=[*keep, "lang_pred", "score", "shares"])

    n_keep = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_texts(rows, batches, f"{fields}, lang_pred string, score double, shares map<string,double>")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares for each row of docs (doc_id, text, lang): learned from text and
    non-null lang of all rows that aren't held out, predicted from the text alone. Null and letterless texts are `und`
    with score 0; so is everything if no row has a lang. Other columns are not read."""
    model = fit(docs.where(~held_out(F.col("doc_id"), parts, part)).select("text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
