"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, map_texts, materialise, release
from .graph import connected_components, local_components

SHINGLE, SEED, DIFFERENCES = 3, 42, 3
#: Fingerprints that differ in at most DIFFERENCES bits agree in one of this many blocks (pigeonhole).
BLOCKS = DIFFERENCES + 1
WIDTH = 64 // BLOCKS
#: Children of a node of the index, and the largest group that one task takes whole.
FANOUT, SEGMENT = 16, 2048
#: Node pairs looked at together, which bounds memory.
PAIRS = 1 << 18


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(spans), 65536):
        raw = b"".join([digest(flat[a:b], SEED) for a, b in spans[i : i + 65536]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, to: str = "__sl_fp") -> DataFrame:
    """docs with column `to`: the text's 64-bit fingerprint as a signed bigint."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, to])
        release()

    return map_texts(docs, batches, T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())]))


class GrayIndex:
    """A tree over fingerprints in Gray order. A node stands for a run of them and keeps the bits that all of them share
    (mask and pattern); neighbours in Gray order share most bits. Two nodes whose shared bits differ in more than the
    allowed number of places hold no pair, so the whole groups are passed over."""

    def __init__(self, prints: np.ndarray):
        """prints: uint64, ascending by Gray rank."""
        self.prints = prints
        self.levels = [(np.full(len(prints), ~np.uint64(0)), prints)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FANOUT)
            ones = np.bitwise_and.reduceat(pattern & mask, at)
            zeros = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones | zeros, ones))

    def join(self, other: GrayIndex, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place here, place in other) that differ in at most `most` bits; of an index with itself each once."""
        top = max(len(self.levels), len(other.levels)) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            (ma, pa_), (mb, pb) = (x.levels[min(level, len(x.levels) - 1)] for x in (self, other))
            near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= most
            i, j = i[near], j[near]
            if level == 0:
                far = i < j if other is self else slice(None)
                if len(i):
                    yield i[far], j[far]
                continue
            down_i, down_j = self._children(level, i), other._children(level, j)
            size = max(1, PAIRS // (FANOUT * FANOUT))
            for k in range(0, len(i), size):
                a, b = (np.asarray(d[k : k + size]) for d in (down_i, down_j))
                x = np.repeat(a, b.shape[1], axis=1).ravel()
                y = np.tile(b, (1, a.shape[1])).ravel()
                ok = (x >= 0) & (y >= 0)
                if other is self:
                    ok &= x <= y
                stack.append((level - 1, x[ok], y[ok]))

    def _children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """A row of child places for each node, -1 where there is none. A tree of fewer levels waits at its root."""
        if level >= len(self.levels):
            return nodes[:, None]
        found = nodes[:, None] * FANOUT + np.arange(FANOUT)
        return np.where(found < len(self.levels[level - 1][0]), found, -1)


def gray_rank(prints: np.ndarray) -> np.ndarray:
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def forest(prints: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within DIFFERENCES connect: among prints, or between prints and others."""
    prints = prints[np.argsort(gray_rank(prints), kind="stable")]
    here = GrayIndex(prints)
    if others is None:
        both, there, shift = prints, here, 0
    else:
        others = others[np.argsort(gray_rank(others), kind="stable")]
        both, there, shift = np.concatenate([prints, others]), GrayIndex(others), len(prints)
    label = np.arange(len(both))
    for i, j in here.join(there, DIFFERENCES):
        own = np.arange(len(both))
        label = local_components(len(both), np.concatenate([own, i]), np.concatenate([label, j + shift]))
    linked = np.flatnonzero(label != np.arange(len(both)))
    return both[linked], both[label[linked]]


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ordered by group (column 0): each whole group's links. Column 1: fingerprint, column 2: side."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((rows[1:, :-2] != rows[:-1, :-2]).any(axis=1)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            if b - a < 2:
                continue
            prints, side = rows[a:b, -2].view(np.uint64), rows[a:b, -1]
            left = np.ascontiguousarray(prints[side != 1])
            right = np.ascontiguousarray(prints[side == 1])
            out.append(forest(left, right if len(right) else None))
        if out:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in it:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        if (rows[-1, :-2] == held[0][0, :-2]).all():
            continue
        rows = np.concatenate(held)
        last = int(np.flatnonzero((rows[:, :-2] != rows[-1, :-2]).any(axis=1))[-1]) + 1
        yield from links(rows[:last])
        held = [rows[last:]]
    if held:
        yield from links(np.concatenate(held))


def _rank(of: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        of = of.bitwiseXOR(F.shiftrightunsigned(of, shift))
    return of


def fingerprint_links(prints: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """prints: different fingerprints, column fp (bigint). Links u, v that connect just what pairs within DIFFERENCES
    bits connect.

    Each fingerprint goes to BLOCKS groups, by each block's bits; a close pair shares a group. A group of at most
    `segment` is indexed by one task. A larger one is cut along Gray order at approximate quantiles of the rank; only
    segments whose shared bits allow a pair meet, two at a time, each meeting a task of its own. So no task holds more
    than about two segments and no pair is missed.
    """
    keyed = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b"))
    value = turned = F.lit(None).cast("bigint")
    for b in range(BLOCKS):
        turn = F.col("fp") if not b else F.shiftleft("fp", b * WIDTH).bitwiseOR(F.shiftrightunsigned("fp", 64 - b * WIDTH))
        turned = F.when(F.col("b") == b, turn).otherwise(turned)
        value = F.when(F.col("b") == b, F.shiftrightunsigned(turn, 64 - WIDTH)).otherwise(value)
    keyed = keyed.select("fp", (value * BLOCKS + F.col("b")).alias("k"), F.shiftrightunsigned(_rank(turned), 1).alias("rank"))
    quantiles = F.percentile_approx("rank", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000)
    large = materialise(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment), "large")
    n_large = large.count()
    small = keyed if not n_large else keyed.join(broadcast_if_small(large, n_large), "k", "left_anti")
    small = small.select("k", "fp", F.lit(0).alias("side")).repartition("k").sortWithinPartitions("k")
    links = small.mapInArrow(_groups, "u bigint, v bigint")
    if not n_large:
        return links
    rows = keyed.join(broadcast_if_small(large, n_large), "k")
    cuts = rows.groupBy("k").agg(quantiles.alias("cuts"), F.first("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(64 * segment) / F.col("n"))).cast("int")
    cuts = cuts.select("k", F.filter("cuts", lambda x, i: (i + 1) % step == 0).alias("cuts"))
    # beyond 64 segments' worth, a hash divides further
    more = large.select(F.col("k").alias("k2"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(64 * segment))).alias("parts"))
    cut = rows.join(cuts, "k").join(more, F.col("k") == F.col("k2"))
    seg = F.size(F.filter("cuts", lambda c: c < F.col("rank"))) * F.col("parts") + F.pmod(F.xxhash64("fp"), F.col("parts"))
    cut = materialise(cut.select("k", "fp", seg.alias("seg")), "segments")
    shared = materialise(cut.groupBy("k", "seg").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")), "nodes")
    a, b = shared.alias("a"), shared.alias("b")
    apart = F.bit_count(F.expr("(a.ones & b.zeros) | (a.zeros & b.ones)"))
    meet = a.join(b, F.expr("a.k = b.k and a.seg <= b.seg")).where(apart <= DIFFERENCES)
    meet = materialise(meet.selectExpr("a.k k", "a.seg x", "b.seg y"), "meet")
    meet = broadcast_if_small(meet)
    left = cut.join(meet, F.expr("seg = x") & (cut.k == meet.k)).select(cut.k, "x", "y", "fp", F.lit(0).alias("side"))
    right = cut.join(meet, F.expr("seg = y and x <> y") & (cut.k == meet.k)).select(cut.k, "x", "y", "fp", F.lit(1).alias("side"))
    pairs = left.unionByName(right).repartition("k", "x", "y").sortWithinPartitions("k", "x", "y")
    return links.unionByName(pairs.mapInArrow(_groups, "u bigint, v bigint"))


def components(prints: DataFrame, id_col: str, fp: str = "__sl_fp", segment: int = SEGMENT) -> DataFrame:
    """prints: id_col and fp of each document. One row per different fingerprint: fp, component_id (smallest id of the
    documents it is connected with, null if all of them are null), root (smallest fingerprint of the component)."""
    nodes = materialise(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("low")), "prints")
    roots = connected_components(fingerprint_links(nodes.select("fp"), segment))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    lowest = materialise(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of
    at most DIFFERENCES bits). Null and wordless texts have fingerprint zero, which links like any other. A null
    doc_id belongs to its component but never names it unless all are null. Repeated rows are kept. Other columns are
    not read. An empty table gives an empty table."""
    prints = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__sl_text"))
    prints = materialise(with_fingerprint(prints, "__sl_text").select("doc_id", "__sl_fp"), "fingerprints")
    found = materialise(components(prints, "doc_id"), "components")
    out = prints.join(found, F.col("__sl_fp") == F.col("fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("__sl_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id; of its rows that repeat this doc_id one
    stays. Rows of one doc_id may belong to different components and are told apart by their fingerprints. Of a component whose ids are all null one row stays.
    Null texts have fingerprint zero; an empty table stays empty."""
    prints = docs.select(F.col(doc_id).alias("__sl_id"), F.col(text).alias("__sl_text"))
    prints = materialise(with_fingerprint(prints, "__sl_text").select("__sl_id", "__sl_fp"), "fingerprints")
    found = materialise(components(prints, "__sl_id"), "components")
    ids = prints.join(found, F.col("__sl_fp") == F.col("fp"))
    named = F.col(doc_id).isNotNull()
    gone = ids.where((F.col("__sl_id") != F.col("component_id"))).select(F.col("__sl_id").alias("__sl_gone")).distinct()
    kept = docs.join(broadcast_if_small(materialise(gone, "gone")), F.col(doc_id) == F.col("__sl_gone"), "left_anti")
    counts = prints.groupBy(F.col("__sl_id").alias("__sl_again")).agg(F.count(F.lit(1)).alias("__sl_n"))
    again = materialise(counts.where("__sl_n > 1 or __sl_again is null").select("__sl_again"), "again")
    n = again.count()
    if not n:
        return kept
    hint, same = broadcast_if_small(again, n), F.col(doc_id).eqNullSafe(F.col("__sl_again"))
    once = kept.join(hint, same, "left_anti")
    of = found.select(F.col("fp").alias("__sl_print"), F.col("root").alias("__sl_root"), F.col("component_id").alias("__sl_low"))
    repeated = with_fingerprint(docs.where(named).join(hint, same, "left_semi"), text).join(of, F.col("__sl_fp") == F.col("__sl_print"))
    repeated = repeated.where(F.col(doc_id) == F.col("__sl_low")).dropDuplicates([doc_id, "__sl_root"]).select(*docs.columns)
    groups = found.where(F.col("component_id").isNull()).select(F.col("fp").alias("__sl_print"), F.col("root").alias("__sl_root"))
    nameless = with_fingerprint(docs.where(~named), text).join(groups, F.col("__sl_fp") == F.col("__sl_print"))
    return once.unionByName(repeated).unionByName(nameless.dropDuplicates(["__sl_root"]).select(*docs.columns))
