"""Approximate nearest neighbours: balanced posting lists, a graph over their centroids, lists chosen by distance ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, hashed_share, materialise

NEIGHBOURS, EVERY = 10, 100
#: Vectors of one dimension are dealt to about the square root of their number of lists; up to FLAT of them are one list.
FLAT, MOST_LISTS = 1024, 1 << 16
#: Vectors that centroids are fitted on, for each list; no more bytes in all than SAMPLE_BYTES (of doubles).
PER_LIST, SAMPLE_BYTES = 16, 1 << 27
#: A vector also joins lists whose centroid is no more than this much farther than the nearest, no two of which lie nearer to
#: each other than to the vector; so many lists at most. Its own list always has it.
BOUNDARY, REPLICAS = 1.1, 4
#: Graph: neighbours of a centroid, candidates that a search holds at least, lists that a query reads at least.
DEGREE, BEAM, LEAST_LISTS = 24, 16, 4
#: Share of sampled neighbours that the lists within the distance ratio have to hold, and sampled vectors that it is measured on.
AIM, TRIALS = 0.99, 256
#: Members and queries of a list that meet in one task.
BLOCK = 4096


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k centroids of groups of x whose sizes differ by one at most: each group is cut in two along the line between two
    means, at the place that leaves each side as many rows as its number of centroids asks for."""
    rng = np.random.default_rng(seed)
    out, open_ = [], [(np.arange(len(x)), min(k, len(x)))]
    while open_:
        rows, n = open_.pop()
        part = x[rows]
        if n <= 1:
            out.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = ((part - a) ** 2).sum(axis=1) <= ((part - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(axis=0), part[~side].mean(axis=0)
        line = a - b if (a != b).any() else rng.normal(size=x.shape[1])
        order = np.argsort(part @ line, kind="stable")
        left = n // 2
        cut = len(rows) * left // n
        open_ += [(rows[order[:cut]], left), (rows[order[cut:]], n - left)]
    return np.stack(out)


class Graph:
    """Centroids and their nearest ones, searched from a few that are spread out."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, n = centroids, len(centroids)
        near = np.empty((n, min(DEGREE, n - 1)), np.int32)
        for at in range(0, n, 1024):
            apart = _squares(centroids[at : at + 1024], centroids)
            apart[np.arange(len(apart)), at + np.arange(len(apart))] = np.inf
            near[at : at + 1024] = np.argpartition(apart, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if n > 1 else near[at : at + 1024]
        # links go both ways, or a centroid that is no one's neighbour could not be reached
        ends = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()]), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])])], axis=1)
        ends = np.unique(ends, axis=1)
        self.start = np.searchsorted(ends[0], np.arange(n + 1))
        self.to = ends[1]
        self.entries = np.unique(np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(int))

    def search(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists in the order of their centroids' squared distance to x, with it: those within ratio times the least distance,
        at least so many. Best first: what is within the ratio, or among the best, is expanded until nothing of it is left."""
        c, seen = self.centroids, np.zeros(len(self.centroids), bool)
        ids = self.entries
        seen[ids] = True
        apart = ((c[ids] - x) ** 2).sum(axis=1)
        expanded = np.zeros(len(ids), bool)
        beam = max(least, BEAM)
        while True:
            bound = apart.min() * ratio**2
            if len(apart) <= beam:
                bound = np.inf
            else:
                bound = max(bound, np.partition(apart, beam - 1)[beam - 1])
            ahead = np.flatnonzero((apart <= bound) & ~expanded)
            if not len(ahead):
                break
            expanded[ahead] = True
            new = np.unique(np.concatenate([self.to[self.start[i] : self.start[i + 1]] for i in ids[ahead]]))
            new = new[~seen[new]]
            seen[new] = True
            ids = np.concatenate([ids, new])
            apart = np.concatenate([apart, ((c[new] - x) ** 2).sum(axis=1)])
            expanded = np.concatenate([expanded, np.zeros(len(new), bool)])
        order = np.argsort(apart, kind="stable")
        n = max(min(least, len(order)), int((apart <= apart.min() * ratio**2).sum()))
        return ids[order[:n]], apart[order[:n]]


class Index:
    """Lists of the vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.graph = Graph(balanced_centroids(sample, max(1, min(lists, len(sample) // PER_LIST))))
        self.ratio = self._fit_ratio(sample)

    def _fit_ratio(self, sample: np.ndarray) -> float:
        """The distance ratio within which AIM of the neighbours of sampled vectors have a list."""
        if len(self.graph.centroids) == 1:
            return 1.0
        q = sample[np.random.default_rng(7).choice(len(sample), min(TRIALS, len(sample)), replace=False)]
        need = []
        for x in q:
            apart = ((sample - x) ** 2).sum(axis=1)
            near = np.argsort(apart, kind="stable")[: NEIGHBOURS + 1]
            to = np.sqrt(((self.graph.centroids - x) ** 2).sum(axis=1))
            for i in near[apart[near] > 0]:
                need.append(to[self.lists_of(sample[i])].min() / max(to.min(), 1e-300))
        return float(np.quantile(need, AIM)) if need else 1.0

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Lists that hold x: its own, and as a boundary vector those of other directions about as near."""
        ids, apart = self.graph.search(x, 1.0, 2 * REPLICAS)
        chosen = [0]
        for k in range(1, int((apart <= apart[0] * BOUNDARY**2).sum())):
            if len(chosen) == REPLICAS:
                break
            between = ((self.graph.centroids[ids[chosen]] - self.graph.centroids[ids[k]]) ** 2).sum(axis=1)
            if (between >= apart[k]).all():
                chosen.append(k)
        return ids[chosen]

    def lists_for(self, x: np.ndarray, every: bool) -> np.ndarray:
        """Lists that a query of x reads."""
        return np.arange(len(self.graph.centroids)) if every else self.graph.search(x, self.ratio, LEAST_LISTS)[0]


def list_count(n: int) -> int:
    return 1 if n <= FLAT else min(MOST_LISTS, 1 << round(np.log2(np.sqrt(n))))


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dealt(vectors: DataFrame, indexes: dict[int, Index], every: bool) -> DataFrame:
    """vectors: sid, low, asks, dim, v. Rows by list: side 0, vectors that it holds (none where every is set: they stand there
    already); side 1, vectors that ask it."""
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims, asks = batch.column("dim").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            who, lists, sides = [], [], []
            for i, v in enumerate(batch.column("v")):
                index = shared.value.get(int(dims[i]))
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if index else None
                holds = np.empty(0, int) if every else index.lists_of(x) if index else np.zeros(1, int)
                reads = np.empty(0, int) if not asks[i] else index.lists_for(x, every) if index else np.zeros(1, int)
                who += [i] * (len(holds) + len(reads))
                lists += [*holds, *reads]
                sides += [0] * len(holds) + [1] * len(reads)
            taken = batch.take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("dim"), pa.array(lists, pa.int32()), pa.array(sides, pa.int8()), *(taken.column(c) for c in ("sid", "low", "v"))],
                names=["dim", "list", "side", "sid", "low", "v"],
            )

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(rows, f"dim int, list int, side tinyint, sid bigint, low bigint, v {kind}")


def _blocks(dealt: DataFrame) -> DataFrame:
    """Adds a and b: members of a list in blocks of BLOCK, its queries in blocks too; each block of the ones meets each of the
    others. Lists without members or without queries go."""
    sizes = dealt.groupBy("dim", "list").agg(F.sum(1 - F.col("side")).alias("members"), F.sum("side").cast("bigint").alias("queries"))
    sizes = sizes.where("members > 0 and queries > 0").select("dim", "list", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(to) for c, to in (("members", "na"), ("queries", "nb"))))
    rows = dealt.join(broadcast_if_small(materialise(sizes, "lists")), ["dim", "list"])
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.array(F.pmod(F.xxhash64("sid"), F.col(n)).cast("int"))
    rows = rows.withColumn("a", F.explode(F.when(F.col("side") == 0, place("na")).otherwise(every("na"))))
    return rows.withColumn("b", F.explode(F.when(F.col("side") == 0, every("nb")).otherwise(place("nb")))).drop("na", "nb")


def _closest(dealt: DataFrame, k: int) -> DataFrame:
    """sid, found: for each query and task the k + 1 nearest members (array<struct<d, low, sid>>, the vector itself among them)."""
    keys = ["dim", "list", "a", "b"]

    def group(rows: pa.Table) -> pa.RecordBatch | None:
        side = rows.column("side").to_numpy()
        members, queries = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side > 0))
        if not len(members) or not len(queries):
            return None
        x, q = (np.stack([v.values.to_numpy(zero_copy_only=False) for v in t.column("v")]).astype(np.float64) for t in (members, queries))
        sid, low = members.column("sid").to_numpy(), members.column("low").to_numpy()
        out, keep = [], min(k + 1, len(x))
        scale = (x**2).sum(axis=1).max()
        for i in range(0, len(q), 256):
            rough = _squares(q[i : i + 256], x)
            # rounding of the short form is allowed for; the distance itself comes from the differences
            slack = 1e-12 * (scale + (q[i : i + 256] ** 2).sum(axis=1)) * x.shape[1]
            within = rough <= (np.partition(rough, keep - 1, axis=1)[:, keep - 1] + slack)[:, None]
            for j in range(len(rough)):
                at = np.flatnonzero(within[j])
                d = np.sqrt(((x[at] - q[i + j]) ** 2).sum(axis=1))
                best = np.lexsort((low[at], d))[:keep]
                out.append([{"d": float(d[b]), "low": int(low[at[b]]), "sid": int(sid[at[b]])} for b in best])
        kind = pa.list_(pa.struct([("d", pa.float64()), ("low", pa.int64()), ("sid", pa.int64())]))
        return pa.RecordBatch.from_arrays([queries.column("sid").combine_chunks(), pa.array(out, kind)], names=["sid", "found"])

    def tasks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in it:
            coded = [batch.column(c).to_numpy() for c in keys]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1 if batch.num_rows > 1 else []
            for start, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                now = tuple(int(c[start]) for c in coded)
                if now != key:
                    if held and (done := group(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield done
                    held, key = [], now
                held.append(batch.slice(int(start), int(end - start)))
        if held and (done := group(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield done

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tasks, "sid bigint, found array<struct<d: double, low: bigint, sid: bigint>>")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """sid, found: the k + 1 nearest of all that the tasks found for a vector, each once, nearest first. Rows of a vector are
    merged as they come, so that no more than k + 1 and one row are held."""
    kind = pa.list_(pa.struct([("d", pa.float64()), ("low", pa.int64()), ("sid", pa.int64())]))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []
        for batch in it:
            sids, lists = batch.column("sid").to_pylist(), batch.column("found")
            ends, flat = lists.offsets.to_pylist(), list(zip(*(c.to_pylist() for c in lists.values.flatten()), strict=True))
            out = []
            for i, sid in enumerate(sids):
                if sid != now:
                    if now is not None:
                        out.append((now, best))
                    now, best = sid, []
                best = sorted({*best, *flat[ends[i] : ends[i + 1]]})[: k + 1]
            if out:
                yield batch_of(out)
        if now is not None:
            yield batch_of([(now, best)])

    def batch_of(rows):
        lists = [[dict(zip(("d", "low", "sid"), x, strict=True)) for x in best] for _, best in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(lists, kind)], names=["sid", "found"])

    return found.repartition("sid").sortWithinPartitions("sid").mapInArrow(merge, found.schema)


def nearest(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k rows nearest to it by Euclidean
    distance in double precision among all others, nearest first, ties to the smaller vec_id; fewer if there are no more.

    Rows whose vector is null, zero, empty or holds null or non-finite components take no part, nor do rows without a vec_id.
    Vectors of different dimensions do not meet. Repeated rows are rows of their own: each can be found, and a query passes over
    itself alone. Equal vectors are indexed once, with the k + 1 smallest of their vec_ids, more of which no answer can hold.
    An empty table gives no rows.

    Every vector is put into the list of its nearest centroid and, at a boundary, into others (lists_of). The sample only places
    the centroids, whose number is bounded (MOST_LISTS), and fits the ratio up to which a query reads lists (AIM). Lists are cut
    into blocks, so that one of any length is no task of its own. A query whose lists hold too few vectors reads every list.
    """
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).where(F.col(vec_id).isNotNull() & _valid(F.col(vector)))
    rows = materialise(rows.withColumn("dim", F.size("v")).withColumn("asks", F.col("vec_id") % every == 0), "rows")
    # a vector's first vec_ids, and whether a query has it
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("dim", "v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    single = first.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where("asks").groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n")).select(F.col("dim").alias("d"), F.col("v").alias("w"), F.lit(True).alias("asks"))
    single = single.join(asking, F.expr("dim = d and v = w"), "left").select("dim", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    single = materialise(single.withColumn("sid", F.monotonically_increasing_id()).withColumn("low", F.col("ids")[0]), "vectors")
    large = {r.dim: r["count"] for r in single.groupBy("dim").count().where(F.col("count") > FLAT).collect()}  # at most one of FLAT vectors each
    indexes = {}
    for dim, n in large.items():
        size = max(1, min(PER_LIST * list_count(n), SAMPLE_BYTES // (8 * dim * len(large))))
        chosen = single.where((F.col("dim") == dim) & hashed_share("sid", size / n)).select("v")
        sample = [np.array(r.v, np.float64) for r in chosen.toLocalIterator()]
        indexes[dim] = Index(np.stack(sample) if sample else np.zeros((1, dim)), list_count(n))

    vectors = single.select("sid", "low", "asks", "dim", "v")
    dealt = materialise(_dealt(vectors, indexes, False), "dealt")
    best = materialise(_merged(_closest(_blocks(dealt), k), k), "best")
    few = single.where("asks").join(best.select("sid", F.size("found").alias("n")), "sid", "left").where(F.coalesce("n", F.lit(0)) <= k)
    few = few.join(broadcast_if_small(single.groupBy("dim").agg(F.count(F.lit(1)).alias("there"))), "dim").where(F.coalesce("n", F.lit(0)) < F.col("there"))
    few = materialise(few.select("sid", "low", "asks", "dim", "v"), "few")
    if few.limit(1).count():
        again = _dealt(few, indexes, True).unionByName(dealt.where("side = 0"))
        again = _merged(_closest(_blocks(materialise(again, "dealt")), k), k)
        best = materialise(best.join(few.select("sid"), "sid", "left_anti").unionByName(again), "best")

    # each found vector stands for its rows; a query takes itself out
    found = best.select(F.col("sid").alias("of"), F.explode("found").alias("x")).select("of", "x.d", "x.sid")
    expanded = found.join(single.select("sid", "ids"), "sid").select("of", F.col("sid").alias("m"), "d", F.explode("ids").alias("vec_id"))
    nearest_ = F.array_sort(F.collect_list(F.struct("d", "vec_id", "m")))
    answers = expanded.groupBy("of").agg(nearest_.alias("near"))
    answers = materialise(single.where("asks").join(answers, F.col("sid") == F.col("of")).select(F.col("dim").alias("d"), F.col("v").alias("w"), "sid", "near"), "answers")
    queries = rows.where("asks").select("dim", "v", F.col("vec_id").alias("query_id"))
    asked = queries.join(broadcast_if_small(answers), F.expr("dim = d and v = w")).select("query_id", "sid", "near")
    own = F.array_position(F.transform("near", lambda x: (x["m"] == F.col("sid")) & (x["vec_id"] == F.col("query_id"))), True)
    left = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, k)
    ranked = asked.withColumn("own", own).select("query_id", F.posexplode(left).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score"))
