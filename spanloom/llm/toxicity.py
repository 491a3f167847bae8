"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, release
from .language import held_out

#: Labelled documents learned from at most, of either class: those whose ids hash lowest.
SAMPLE_PER_CLASS = 8000
BUCKETS = 1 << 28
#: Terms that enter the machine: all that are in LEAST_DOCS sampled documents and tell something of the label by themselves, with a z
#: of LEAST_Z, or in a pair: the effect of both isn't the sum of their own, with a z of PAIR_Z in shares and LEAST_Z in odds. Pairs are looked for among all terms,
#: where LEAST_CELL sampled documents have both, either and neither. These are tests of the sample, and bound no number.
LEAST_DOCS, LEAST_Z = 4, 4.0
LEAST_CELL, PAIR_Z = 5, 7.0
FACTORS, STEPS, RATE, SHRINK = 8, 300, 0.05, 1e-4
THRESHOLD = 0.7
#: Letters by which words of one stem are known, whatever their ending.
STEM = 5
WORD = re.compile(r"\w+")


def term_buckets(text: str | None) -> set[int]:
    """Hash buckets of the terms of the whole text: its different lower-case words, and the beginnings of longer ones."""
    words = set(WORD.findall((text or "").lower()))
    words.update([f"{w[:STEM]}-" for w in words if len(w) > STEM])
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words}


class Machine:
    """score(x) = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place = {int(t): i for i, t in enumerate(terms)}

    def score(self, buckets: set[int]) -> float:
        at = sorted(self.place[b] for b in buckets & self.place.keys())
        raw = self.bias
        if at:
            v = self.factors[at]
            raw += self.weights[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -40, 40))))


class Sample:
    """The terms of sampled documents, ordered so that each document's lie together, with the label 0 or 1 of each document."""

    def __init__(self, buckets: list[np.ndarray], labels: np.ndarray):
        first = np.argsort(-labels, kind="stable")  # documents of label 1 come first
        sizes = np.array([len(buckets[i]) for i in first])
        self.labels, self.ends = labels[first], np.cumsum(sizes)
        self.of = np.repeat(np.arange(len(first), dtype=np.int32), sizes)
        flat = np.concatenate([np.sort(buckets[i]) for i in first])
        self.terms, place, self.found = np.unique(flat, return_inverse=True, return_counts=True)
        self.place = place.astype(np.int32)
        self.toxic = np.bincount(self.place, self.labels[self.of], minlength=len(self.terms)).astype(np.int64)

    def common(self) -> "Sample":
        """The sample with its terms that can be in a pair only: they have documents with both and either term of it."""
        out = object.__new__(Sample)
        keep = (self.found >= 2 * LEAST_CELL) & (self.found <= len(self.labels) - 2 * LEAST_CELL)
        inside = keep[self.place]
        out.terms, out.found, out.toxic, out.labels, out.of = self.terms[keep], self.found[keep], self.toxic[keep], self.labels, self.of[inside]
        out.place = (np.cumsum(keep) - 1)[self.place[inside]].astype(np.int32)
        out.ends = np.cumsum(np.bincount(out.of, minlength=len(self.labels)))
        return out

    def telling_pairs(self, part: int = 0, parts: int = 1) -> np.ndarray:
        """Places of terms with a partner such that neither the shares of label 1 with both, either and neither of them are additive
        nor, as where a share is near 0 or 1 by itself, the logarithms of their odds, which the machine adds. Of all pairs, those whose lower term is one of this part's. A term's partners are counted in the documents that have it, so
        that the work grows with pairs of terms that occur and the memory with the documents of a term."""
        n, ones, size = len(self.labels), int(self.labels.sum()), len(self.terms)
        variance = max(ones / n * (1 - ones / n), 1e-12)
        order = np.argsort(self.place, kind="stable").astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(self.found)])
        telling = np.zeros(size, bool)
        for i in range(part, size, parts):
            at = order[starts[i] : starts[i + 1]]
            after = self.ends[self.of[at]] - at - 1  # a document's terms ascend: those after i are the pairs' higher ones
            total = np.concatenate([[0], np.cumsum(after)])
            others = self.place[np.arange(total[-1]) + np.repeat(at + 1 - total[:-1], after)]
            both = np.bincount(others, minlength=size)
            k = np.bincount(others[: total[self.toxic[i]]], minlength=size)
            j = np.flatnonzero(both >= LEAST_CELL)
            both, k = both[j], k[j]
            counts = (both, self.found[i] - both, self.found[j] - both, n - self.found[i] - self.found[j] + both)
            hits = (k, self.toxic[i] - k, self.toxic[j] - k, ones - self.toxic[i] - self.toxic[j] + k)
            gap, spread = 0.0, 0.0
            for sign, m, t in zip((1, -1, -1, 1), counts, hits, strict=True):
                gap, spread = gap + sign * (t + 0.5) / (m + 1), spread + variance / (m + 1)
            at = (np.minimum.reduce(counts) >= LEAST_CELL) & (np.abs(gap) >= PAIR_Z * np.sqrt(spread))
            odds, spread = 0.0, 0.0
            for sign, m, t in zip((1, -1, -1, 1), counts, hits, strict=True):
                m, t = np.broadcast_to(m, at.shape)[at], np.broadcast_to(t, at.shape)[at]
                odds = odds + sign * np.log((t + 0.5) / (m - t + 0.5))
                spread = spread + 1 / (t + 0.5) + 1 / (m - t + 0.5)
            j = j[at][np.abs(odds) >= LEAST_Z * np.sqrt(spread)]
            telling[j] = True
            telling[i] |= len(j) > 0
        return np.flatnonzero(telling)


def in_tasks(spark: SparkSession, own: Sample) -> np.ndarray:
    """own.telling_pairs(), a part of the terms in each task. What is broadcast is bounded as the sample is."""
    shared, parts = spark.sparkContext.broadcast(own), 4 * spark.sparkContext.defaultParallelism

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.telling_pairs(part, parts), pa.int64())], names=["place"])

    rows = spark.range(0, parts, 1, parts).mapInArrow(found, "place long").distinct().toLocalIterator()
    return np.array(sorted(r.place for r in rows), np.int64)


def fit(buckets: list[np.ndarray], labels: np.ndarray, seed: int = 7, pairs: Callable[[Sample], np.ndarray] = Sample.telling_pairs) -> Machine:
    """buckets: of each document, different; labels: 0 or 1. Full-batch Adam on the logistic loss, over the occurrences of terms.
    With documents of one class, none or no terms, the machine is its bias: the smoothed share of label 1. pairs: how pairs are looked for."""
    n, ones = len(labels), float(labels.sum())
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    if not ones or ones == n:
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    own = Sample(buckets, labels)
    if not len(own.terms):
        return Machine(own.terms, bias, np.empty(0), np.empty((0, FACTORS)))
    p = own.found / n
    gap = own.toxic / ones - (own.found - own.toxic) / (n - ones)
    z = np.abs(gap) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / (n - ones)))
    keep = (own.found >= LEAST_DOCS) & (z >= LEAST_Z)
    common = own.common()
    keep |= np.isin(own.terms, common.terms[pairs(common)])
    terms, inside = own.terms[keep], keep[own.place]
    of, place = own.of[inside], (np.cumsum(keep) - 1)[own.place[inside]]
    y, size = own.labels, len(terms)
    rng = np.random.default_rng(seed)
    at = [np.array([bias]), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS))]
    mean, spread = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
    # terms of many documents as a dense table, whose columns the mean document's length bounds; occurrences of the rest as they are
    dense = np.bincount(place, minlength=size) > n / 64
    x = np.zeros((n, int(dense.sum())), np.float32)
    heavy = dense[place]
    x[of[heavy], (np.cumsum(dense) - 1)[place[heavy]]] = 1
    of, place = of[~heavy], place[~heavy]

    def by_document(a: np.ndarray) -> np.ndarray:
        return x @ a[dense].astype(np.float32) + np.stack([np.bincount(of, c[place], minlength=n) for c in a.T], axis=1)

    def by_term(a: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(place, c[of], minlength=size) for c in a.T], axis=1).astype(float)
        out[dense] += x.T @ a.astype(np.float32)
        return out

    for step in range(1, STEPS + 1):
        both = by_document(np.column_stack([at[2], at[1] - 0.5 * (at[2] ** 2).sum(axis=1)]))
        sums = both[:, :-1]
        raw = at[0] + both[:, -1] + 0.5 * (sums**2).sum(axis=1)
        off = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y) / n
        back = by_term(np.column_stack([off[:, None] * sums, off]))
        each = back[:, -1]
        slope = [np.array([off.sum()]), each + SHRINK * at[1], back[:, :-1] - at[2] * each[:, None] + SHRINK * at[2]]
        for k in range(3):
            mean[k] = 0.9 * mean[k] + 0.1 * slope[k]
            spread[k] = 0.999 * spread[k] + 0.001 * slope[k] ** 2
            at[k] = at[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(at[0][0]), at[1], at[2])


def sample(docs: DataFrame, labels: DataFrame, parts: int, part: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Term buckets and labels of at most SAMPLE_PER_CLASS training documents of either class. Only they come to the
    driver, each as at most BUCKETS numbers. A document with labels of both kinds counts as toxic."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    chosen = F.broadcast(reduce(DataFrame.unionByName, chosen))  # 2 x SAMPLE_PER_CLASS rows at most

    def terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [np.array(sorted(term_buckets(t.as_py())), "<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "toxic", "terms"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(rows, terms, f"doc_id {kind}, toxic int, terms binary").dropDuplicates(["doc_id", "terms"])
    got = sorted((r.doc_id, r.toxic, bytes(r.terms)) for r in rows.toLocalIterator())
    return [np.frombuffer(t, "<i4") for _, _, t in got], np.array([y for _, y, _ in got], np.int64)


def with_score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "__sl_score") -> DataFrame:
    """docs with column `to`: the score of the whole text. Null and empty texts have the bias's score; rows that repeat get
    the same score. Other columns pass through, no row is lost or added, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in it:
            found = pa.array([score(term_buckets(t.as_py())) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, to])
        release()

    return map_texts(docs, batches, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= THRESHOLD) for each row of docs, learned from the labels of rows that
    aren't held out and scored from the text alone. Null and empty texts have the bias's score, the smoothed share of label
    1 if nothing could be learned; a null doc_id isn't held out and teaches nothing; rows that repeat stay. Labels other than
    0 and 1 and labels without a document are passed over. Other columns are not read; an empty table gives no rows."""
    machine = fit(*sample(docs, labels, parts, part), pairs=partial(in_tasks, docs.sparkSession))
    rows = with_score(docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text"), machine)
    return rows.select("doc_id", "held_out", F.col("__sl_score").alias("score"), (F.col("__sl_score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """docs without the rows whose text scores THRESHOLD or more, with the columns they have. Null and empty texts have the
    bias's score. Rows that repeat stay or go together; an empty table stays empty."""
    machine = fit(*sample(docs, labels, parts, part), pairs=partial(in_tasks, docs.sparkSession))
    return with_score(docs, machine).where(F.col("__sl_score") < THRESHOLD).drop("__sl_score")
