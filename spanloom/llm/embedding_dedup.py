"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table lookups, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, hashed_share, materialise
from .graph import connected_components, local_components

THRESHOLD = 0.93
#: Vectors that the quantisers are fitted on: those whose rows hash lowest, so many for each list, so many and so many bytes (of
#: doubles, padded to the longest vector) in all. Lists are about the square root of the vectors, up to MOST_SAMPLE / PER_LIST; beyond
#: FLAT they are fitted in two levels.
PER_LIST, LEAST_SAMPLE, MOST_SAMPLE, SAMPLE_BYTES, FLAT = 16, 20_000, 1 << 18, 1 << 27, 512
PARTS, CODES, ROUNDS = 8, 64, 8
#: Members and queries that one task compares at most.
BLOCK = 4096
#: A list is probed if the query lies within this much of its border, in units of the largest distance of a link over
#: the square root of the dimensions. A neighbour steps across a border by one such unit on average. A link is missed only
#: if neither of its vectors probes the other's list.
REACH = 1.75


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def _cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres; with fewer different rows than k, as many centres as rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(ROUNDS):
        own = np.concatenate([_nearest(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def list_count(n: int) -> int:
    """Lists for n vectors."""
    return min(max(PER_LIST, int(2 ** np.ceil(np.log2(max(n, 1)) / 2))), MOST_SAMPLE // PER_LIST)


def _centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres; of many, the centres of the rows around each of the square root of k."""
    if k <= FLAT:
        return _cluster(x, k, seed)
    top = _cluster(x, int(np.sqrt(k)), seed)
    own = np.concatenate([_nearest(x[i : i + 4096], top).argmin(axis=1) for i in range(0, len(x), 4096)])
    return np.concatenate([_cluster(x[own == t], max(1, round(k * (own == t).mean())), seed + 1) for t in range(len(top)) if (own == t).any()])


class Quantiser:
    """Coarse centres, and a codebook for each part of the residuals."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 11):
        """sample: unit vectors (shorter ones padded by zeros); n: vectors to be indexed, about sqrt(n) lists."""
        self.centres = _centres(sample, min(list_count(n), max(1, len(sample) // PER_LIST)), seed)
        self.dim = sample.shape[1]
        self.width = -(-self.dim // PARTS)
        few = sample[:LEAST_SAMPLE]
        near = np.concatenate([_nearest(few[i : i + 1024], self.centres).argmin(axis=1) for i in range(0, len(few), 1024)])
        left = self.split(few - self.centres[near])
        self.books = [_cluster(left[:, p], CODES, seed + 1 + p) for p in range(PARTS)]

    def split(self, x: np.ndarray) -> np.ndarray:
        """rows x PARTS x width"""
        return np.pad(x, ((0, 0), (0, self.width * PARTS - self.dim))).reshape(len(x), PARTS, self.width)

    def assign(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each row; rows and the lists they probe: those whose cell begins within a row's reach, not its own."""
        apart = _nearest(x, self.centres)
        own = apart.argmin(axis=1)
        first = np.arange(len(x))
        cells, which = np.unique(own, return_inverse=True)
        gap = np.sqrt(_nearest(self.centres[cells], self.centres))[which]
        probes = apart - apart[first, own][:, None] <= 2 * gap * reach[:, None]
        probes[first, own] = False
        return own, *np.nonzero(probes)

    def reaches(self, x: np.ndarray, own: np.ndarray, to: np.ndarray, reach: float) -> np.ndarray:
        """Whether row i, of the list own[i], probes the list to[i]."""
        a, b = self.centres[own], self.centres[to]
        apart = ((x - b) ** 2).sum(axis=1) - ((x - a) ** 2).sum(axis=1)
        return (own != to) & (apart <= 2 * reach * np.sqrt(((a - b) ** 2).sum(axis=1)))

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows x PARTS), squared length of what they stand for, distance of the row from that."""
        left = self.split(x - self.centres[own])
        codes = np.stack([_nearest(left[:, p], book).argmin(axis=1) for p, book in enumerate(self.books)], axis=1)
        back = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)[:, : self.dim] + self.centres[own]
        return codes.astype(np.uint8), (back**2).sum(axis=1), np.sqrt(((x - back) ** 2).sum(axis=1))

    def candidates(self, q: np.ndarray, own: int, codes: np.ndarray, size: np.ndarray, off: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member of the list own) whose table-lookup distance less the member's own quantising distance is within limit;
        by the triangle inequality that leaves out no pair whose true distance is."""
        parts = self.split(q)
        dots = np.repeat((q @ self.centres[own])[:, None], len(codes), axis=1)
        for p, book in enumerate(self.books):
            dots += (parts[:, p] @ book.T)[:, codes[:, p]]
        apart = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + size - 2 * dots, 0))
        return np.nonzero(apart <= limit + off + 1e-9)


def _unit(raw: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length one in double precision, filled up by zeros to dim."""
    raw = np.pad(raw.astype(np.float64), ((0, 0), (0, dim - raw.shape[1])))
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # squares of very small or large ones would be 0 or infinite
    return raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


BLOCKS = "array<struct<s:tinyint,a:int,b:int>>"


def _valid(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0)))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & (norm > 0), F.lit(False))


def _index(vectors: DataFrame, quantiser: Quantiser, reach: float) -> DataFrame:
    """vectors: nid, n, label, dim, v; reach: times the square root of the dimensions. Rows of a list: each vector as a member
    (side 0) of its own, with its codes, and as a query (side 1) of those that it probes. Members meet as queries too."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        step = max(64, (1 << 21) // len(q.centres))
        for batch in it:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                raw, dims = _rows(part.column("v")), part.column("dim").to_numpy()
                x = np.zeros((len(raw), q.dim))
                for d in np.unique(dims):
                    of = np.flatnonzero(dims == d)
                    x[of] = _unit(np.stack([raw[i] for i in of]), q.dim)
                own, who, lists = q.assign(x, reach / np.sqrt(dims))
                codes, size, off = q.encode(x, own)
                n, m = len(x), len(who)
                taken = part.take(pa.array(np.concatenate([np.arange(n), who])))
                packed = [r.tobytes() for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(taken.column(c) for c in ("label", "dim")),
                        pa.array(np.concatenate([own, lists]).astype(np.int32)),
                        pa.array(np.repeat(np.int8([0, 1]), [n, m])),
                        *(taken.column(c) for c in ("nid", "n")),
                        pa.array([*packed, *(packed[i] for i in who.tolist())], pa.binary()),
                        pa.array(own[np.concatenate([np.arange(n), who])].astype(np.int32)),
                        pa.array([*(r.tobytes() for r in codes), *[None] * m], pa.binary()),
                        pa.array(np.concatenate([size, np.zeros(m)]).astype(np.float32)),
                        pa.array(np.concatenate([off, np.zeros(m)]).astype(np.float32)),
                    ],
                    names=["label", "dim", "list", "side", "nid", "n", "v", "own", "codes", "size", "off"],
                )

    kinds = "label string, dim int, list int, side tinyint, nid bigint, n bigint, v binary, own int, codes binary, size float, off float"
    return vectors.withColumn("label", F.col("label").cast("string")).mapInArrow(rows, kinds)


def _compare(indexed: DataFrame, quantiser: Quantiser, threshold: float, reach: float, kind: str) -> DataFrame:
    """u, v, links: for each vector the other vectors linked in a task (weighted), and links that connect what the task found
    connected. Keys: label, dim, list, a (block of members), b (block of queries; the first holds those of the members'
    own list, which meet each other once). A link that both of its vectors' probes find counts for the query alone."""
    shared = indexed.sparkSession.sparkContext.broadcast(quantiser)
    limit = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        q = shared.value
        at, dim = rows.column("list")[0].as_py(), rows.column("dim")[0].as_py()
        side = rows.column("side").to_numpy()
        members, queries = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side > 0))
        if not len(members) or not len(queries):
            return None
        mv, qv = (_unit(np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(len(t), -1), q.dim) for t in (members, queries))
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(members), PARTS)
        size, off, mid, mn = (members.column(c).to_numpy() for c in ("size", "off", "nid", "n"))
        home, qid, qn = (queries.column(c).to_numpy() for c in ("own", "nid", "n"))
        found = []
        for i in range(0, len(qv), 256):
            a, b = q.candidates(qv[i : i + 256], at, codes, size.astype(np.float64), off.astype(np.float64) + 1e-5, limit)
            a += i
            keep = (home[a] != at) | (qid[a] < mid[b])
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                near = np.einsum("ij,ij->i", qv[x], mv[y]) >= threshold
                found.append((x[near], y[near]))
        a, b = (np.concatenate([np.empty(0, np.int64), *z]) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        if not len(a):
            return None
        back = np.ones(len(a), bool)
        far = np.flatnonzero(home[a] != at)
        back[far] = ~q.reaches(mv[b[far]], np.full(len(far), at), home[a[far]], reach / np.sqrt(dim))
        nodes, place = np.unique(np.concatenate([qid[a], mid[b]]), return_inverse=True)
        label = local_components(len(nodes), place[: len(a)], place[len(a) :])
        links = np.bincount(place[: len(a)], mn[b], minlength=len(nodes)) + np.bincount(place[len(a) :], qn[a] * back, minlength=len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label]), pa.array(links.astype(np.int64))], names=["u", "v", "links"])

    keys = ["label", "dim", "list", "a", "b"]

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in it:
            coded = [batch.column(c).dictionary_encode().indices.to_numpy() for c in keys]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1 if batch.num_rows > 1 else []
            for start, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                now = tuple(batch.column(c)[int(start)].as_py() for c in keys)
                if now != key:
                    if held and (done := group(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield done
                    held, key = [], now
                held.append(batch.slice(int(start), int(end - start)))
        if held and (done := group(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield done

    return indexed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tasks, "u bigint, v bigint, links bigint")


def _blocks(indexed: DataFrame) -> DataFrame:
    """Adds a and b: members of a list in blocks of BLOCK, each of which meets the list's queries, and the members themselves
    as queries, in blocks of BLOCK too. Only a list with more than a block has a row in more than one task."""
    counts = indexed.groupBy("label", "dim", "list").agg(F.sum(1 - F.col("side")).alias("members"), F.count(F.lit(1)).alias("all"))
    counts = materialise(counts.where("members > 0 and all > 1").select("label", "dim", "list", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(to) for c, to in (("members", "na"), ("all", "nb")))), "lists")
    rows = indexed.join(broadcast_if_small(counts), ["label", "dim", "list"])
    hashed = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
    member = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct(F.lit(0).cast("tinyint").alias("s"), hashed(F.col("na")).alias("a"), b.alias("b"))))
    query = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda a: F.struct(F.lit(1).cast("tinyint").alias("s"), a.alias("a"), hashed(F.col("nb")).alias("b")))
    rows = rows.withColumn("to", F.explode(F.concat(F.coalesce(member, F.array().cast(BLOCKS)), query)))
    return rows.select("label", "dim", "list", F.col("to.a").alias("a"), F.col("to.b").alias("b"), F.col("to.s").alias("side"), "nid", "n", "v", "own", F.when(F.col("to.s") == 0, F.col("codes")).alias("codes"), "size", "off")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: vec_id, n_links (other rows of the same label and dimension with cosine >= threshold),
    component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    Rows whose label or vector is null, or whose vector is empty, zero or holds null or non-finite components, link with
    nothing: 0, their own id, true. Equal vectors of a label are compared once and link with each other. A null vec_id
    takes part but names no component unless all are null, and isn't kept. Every vector is indexed; the sample only
    places the quantisers, and is bounded in bytes (SAMPLE_BYTES). A vector probes the lists that a link could lead to (REACH); a link is found if either of its
    vectors probes the other's list, and then for certain, as the table-lookup filter allows for each member's quantising
    distance. Rows of vectors beyond the array<float> type are compared as doubles. An empty table gives no rows.
    """
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    good = rows.where(_valid(F.col("v"), F.col("label"))).withColumn("dim", F.size("v"))
    single = good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    single = materialise(single, "vectors")
    single = materialise(single.withColumn("nid", F.monotonically_increasing_id()), "vectors")
    total, dim = single.agg(F.count(F.lit(1)), F.max("dim")).first()
    rest = rows.where(~_valid(F.col("v"), F.col("label"))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    if not total:
        return rest
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, PER_LIST * list_count(total)))
    size = min(size, max(1, SAMPLE_BYTES // (8 * dim)))
    chosen = single.where(hashed_share("nid", size / total)).select("v")
    sample = [_unit(np.array([r.v]), dim) for r in chosen.toLocalIterator()]
    quantiser = Quantiser(np.concatenate(sample or [_unit(np.array([single.first().v]), dim)]), total)
    kind = "<f4" if good.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    reach = REACH * float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    indexed = materialise(_index(single.select("label", "dim", "nid", "n", "v"), quantiser, reach), "index")
    found = materialise(_compare(_blocks(indexed), quantiser, threshold, reach, kind), "found")
    links = found.groupBy(F.col("u").alias("nid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("u", "v"))
    rooted = single.select("nid", "low").join(roots, F.col("nid") == F.col("node"), "left")
    rooted = materialise(rooted.select("nid", "low", F.coalesce("root", "nid").alias("root")), "roots")
    lowest = materialise(rooted.groupBy("root").agg(F.min("low").cast("bigint").alias("component_id")), "lowest")
    known = rooted.join(lowest, "root").join(links, "nid", "left")
    known = known.select("nid", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    known = materialise(single.join(known, "nid").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("v").alias("w"), "n", "links", "component_id"), "known")
    full = good.join(known, F.expr("label = l and dim = d and v = w"))
    full = full.select(
        "vec_id",
        (F.col("links") + F.col("n") - 1).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
    return full.unionByName(rest)
