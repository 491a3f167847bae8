"""Substring dedup by compact windows: passages that repeat, nearly or exactly, across documents.

A text is a row of shingles. The compact windows of a hash over it are the nodes of its Cartesian tree: all stretches of at
least WIDTH runs that share their minimum make one window, whose signature is that minimum. A passage of WORDS words that is
alike in two texts holds an unbroken stretch of SHARED shingles, which is WIDTH runs; so the texts share a signature, with
one hash and for certain, where several hashes over whole passages would share one with some likelihood only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise
from .graph import connected_components

#: Passages have at least WORDS words, and so SPAN shingles of SHINGLE words.
WORDS, SHINGLE = 50, 5
SPAN = WORDS - SHINGLE + 1
#: Two windows of SPAN shingles are alike if all but MISSES of either are matched: a similarity of 41 / 51 = 0.804.
MISSES = 5
#: A window that is alike has one break inside at most (a changed word alone costs MISSES shingles), so one of its two
#: unbroken stretches has SHARED shingles or more. Signatures are minima of runs of RUN shingles over WIDTH of them.
SHARED, RUN = (SPAN - MISSES + 1) // 2, 3
WIDTH = SHARED - RUN + 1
#: Texts that share this many shingles in a row are alike there.
ENOUGH = SPAN - MISSES
#: Texts of a signature are compared each with each up to this number; of larger ones all that is alike is found by longer keys.
EACH = 8
#: A table of the texts' signatures is broadcast up to this many of them in all.
BROADCAST_KEYS = 1_000_000
#: Bytes of text that are hashed at once.
TEXT_BYTES = 8 << 20
#: No hash is greater; odd factor that joins hashes of neighbours.
ALL = np.uint64(2**64 - 1)
JOIN = np.array([0x9E3779B97F4A7C15], np.uint64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(base: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes."""
    if len(base) < n:
        return np.empty(0, np.uint64)
    out, done, width, power, factor = np.zeros(len(base) - n + 1, np.uint64), 0, 1, base, JOIN
    while True:  # power: of runs of `width`, joined as the bits of n ask; factor: JOIN to the power of width
        if n & width:
            out = out * factor + power[done : done + len(out)]
            done += width
        if done == n:
            return _mixed(out, n)
        power = power[:-width] * factor + power[width:]
        factor, width = factor * factor, width * 2


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of SHINGLE words of each text, and the text of each. Words are lower-cased (A-Z) runs
    without ASCII white space; null texts have none."""
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    raw = [w.lower() for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    which = coded.indices.to_numpy()
    real = np.fromiter(map(bool, raw), bool, len(raw))[which]
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[which][real]
    text = text[real]
    found = run_hashes(base, SHINGLE)
    whole = text[: len(found)] == text[SHINGLE - 1 :]
    return found[whole], text[: len(found)][whole]


def _over(values: np.ndarray, n: int, least: Callable) -> np.ndarray:
    """The least (or greatest) of each n neighbours."""
    out, width = values, 1
    while 2 * width <= n:
        out, width = least(out[:-width], out[width:]), 2 * width
    m = len(values) - n + 1
    return least(out[:m], out[n - width : n - width + m])


def minima(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Which values are the least of some n neighbours of one text (text: ascending, of each value): the places of the
    nodes of all compact windows of n values at least. Of equal values in a stretch each is one."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(len(values), bool)
    inside = text[:m] == text[n - 1 :]
    low = np.where(inside, _over(values, n, np.minimum), 0)
    far = np.zeros(n - 1, np.uint64)
    return (_over(np.concatenate([far, low, far]), n, np.maximum) == values) & (_over(np.concatenate([far > 0, inside, far > 0]), n, np.maximum))


def signatures(base: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen runs of RUN shingles, and the runs' hashes there; of texts of SPAN shingles at least."""
    if len(base) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    values = run_hashes(base, RUN)
    own = text[: len(values)]
    whole = own == text[RUN - 1 :]  # runs across two texts end the stretches of both
    at = np.flatnonzero(whole)
    size = np.bincount(text)
    at = at[minima(values[at], own[at], WIDTH) & (size[own[at]] >= SPAN)]
    return at, values[at]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about TEXT_BYTES of the text column, of one row at least; of rows of the same first column (tid) the first
    of a slice."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start = 0
    while start < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[start:]), TEXT_BYTES, side="right")))
        part = batch.slice(start, n)
        first = np.unique(part.column(0).to_numpy(), return_index=True)[1]
        yield part.take(pa.array(np.sort(first))) if len(first) < n else part
        start += n


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return heads, np.diff([*heads, len(keys)])


def _distinct(key: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """Places of one row of each key and tid, in order of both."""
    order = np.lexsort((tid, key))
    key, tid = key[order], tid[order]
    return order[np.concatenate([[True], (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])])] if len(key) else order


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tid, text: rows of kind 0: part = key = a signature of text tid; kind 1: a signature that more than EACH texts of
    the slice have (part = tid), of which EACH + 1 rows go on as kind 0 too; kind 2: key = words of tid (part = tid)."""
    for batch in it:
        for part in _parts(batch, 1):
            tids = part.column(0).to_numpy()
            base, text = shingles(part.column(1))
            size = np.bincount(text, minlength=len(tids))
            at, key = signatures(base, text)
            key, tid = key.view(np.int64), tids[text[at]]
            own = _distinct(key, tid)
            key, tid = key[own], tid[own]
            heads, n = _groups(key)
            large = np.repeat(n > EACH, n)
            go = ~large | (np.arange(len(key)) - np.repeat(heads, n) <= EACH)
            long = np.flatnonzero(size >= SPAN)
            yield _table(
                {
                    "part": np.concatenate([key[go], tid[large], tids[long]]),
                    "kind": np.repeat(np.int8([0, 1, 2]), [go.sum(), large.sum(), len(long)]),
                    "key": np.concatenate([key[go], key[large], size[long] + SHINGLE - 1]),
                    "tid": np.concatenate([tid[go], tid[large], tids[long]]),
                }
            )


def _each(tid: np.ndarray, heads: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the rows of groups of at most EACH rows."""
    left, right = [], []
    for size in range(2, EACH + 1):
        first = heads[n == size][:, None]
        i, j = np.triu_indices(size, 1)
        left.append(tid[(first + i).ravel()])
        right.append(tid[(first + j).ravel()])
    return np.concatenate(left), np.concatenate(right)


def _by_key(columns: list[str], use: Callable[[np.ndarray], Iterator[pa.RecordBatch]], packed: str | None = None):
    """A function of rows in order of their first column, given to `use` as whole groups of it; packed: a column of PACKED
    numbers of 64 bits a row, which come last."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in it:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns], axis=1)
            if packed:
                _, ends, data = batch.column(packed).buffers()
                first = int(np.frombuffer(ends, np.int32)[batch.column(packed).offset])
                rows = np.concatenate([rows, np.frombuffer(data, np.int64, len(rows) * PACKED, first).reshape(-1, PACKED)], axis=1)
            held.append(rows)
            if rows[-1, 0] == held[0][0, 0] or sum(map(len, held)) < (AT_ONCE if packed else 1 << 16):
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
            yield from use(rows[:cut])
            held = [rows[cut:]]
        if held:
            yield from use(np.concatenate(held))

    return run


def _meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, kind, key, tid: pairs u, v of texts that share a signature which at most EACH texts have (kind 0); u and the
    signature v that more have (kind 1); u and its words v (kind 2)."""
    pass_on = rows[rows[:, 1] > 0]
    _, _, key, tid = rows[rows[:, 1] == 0].T
    own = _distinct(key, tid)
    key, tid = key[own], tid[own]
    heads, n = _groups(key)
    u, v = _each(tid, heads, n)
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    large = np.repeat(n > EACH, n)
    yield _table(
        {
            "kind": np.concatenate([np.zeros(len(pairs)), np.ones(large.sum()), pass_on[:, 1]]).astype(np.int8),
            "u": np.concatenate([pairs[:, 0], tid[large], pass_on[:, 3]]),
            "v": np.concatenate([pairs[:, 1], key[large], pass_on[:, 2]]),
        }
    )


FOUND = "kind tinyint, part bigint, tid bigint, first int, last int"
#: How far a window of SPAN shingles that holds a run of RUN reaches beyond it, on either side; all that it may reach; the
#: columns of 64 bits that hold as many hashes of 32 bits.
REACH = SPAN - RUN
AROUND = 2 * REACH + RUN
PACKED = (AROUND + 1) // 2
#: Rows for which longer keys are made at once, and such keys; more if a signature alone has them.
AT_ONCE, KEYS_AT_ONCE = 1 << 12, 1 << 16


def _found(kinds: list[int], parts: list, tids: list, firsts: list, lasts: list) -> pa.RecordBatch:
    n = [len(x) for x in tids]
    return _table(
        {
            "kind": np.repeat(np.int8(kinds), n),
            "part": np.concatenate(parts).astype(np.int64),
            "tid": np.concatenate(tids).astype(np.int64),
            "first": np.concatenate(firsts).astype(np.int32),
            "last": np.concatenate(lasts).astype(np.int32),
        }
    )


def _merged(tid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each tid."""
    order = np.lexsort((first, tid))
    tid, first, last = tid[order], first[order].astype(np.int64), last[order].astype(np.int64)
    heads, n = _groups(tid)
    lift = np.repeat(np.arange(len(heads)), n) << 32
    reach = np.maximum.accumulate(last + lift) if len(tid) else last
    new = np.concatenate([[True], first[1:] + lift[1:] > reach[:-1] + 1]) if len(tid) else np.empty(0, bool)
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(tid)]]) - 1 if len(at) else at
    return tid[at], first[at], (reach - lift)[ends]


def _pairs(rows: np.ndarray) -> np.ndarray:
    """The different rows of two columns."""
    return rows[_distinct(rows[:, 0], rows[:, 1])]


class _Alike:
    """Collects spans (in shingles) and links of texts that are known to be alike."""

    def __init__(self):
        self.spans = [np.empty((0, 3), np.int64)]
        self.links = [np.empty((0, 2), np.int64)]
        self.held = 0

    def add(self, key: np.ndarray, tid: np.ndarray, first: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of which those of one key are alike from first to before end: each is linked to the key's least text. Which
        rows have a key that another text has too."""
        order = np.lexsort((tid, key))
        key, tid = key[order], tid[order]
        heads, n = _groups(key)
        several = np.repeat(tid[heads] != tid[heads + n - 1], n) if len(heads) else np.empty(0, bool)
        least, at = np.repeat(tid[heads], n)[several], order[several]
        self.links.append(_pairs(np.stack([tid[several], least], axis=1)))
        self.spans.append(np.stack(_merged(tid[several], np.maximum(first[at], 0), np.minimum(end[at], size[at]) - 1), axis=1))
        self.held += len(self.spans[-1]) + len(self.links[-1])
        if self.held > KEYS_AT_ONCE:
            self.spans, self.links = [np.stack(_merged(*np.concatenate(self.spans).T), axis=1)], [_pairs(np.concatenate(self.links))]
            self.held = 0
        met = np.zeros(len(order), bool)
        met[at] = True
        return met

    def batch(self) -> list[np.ndarray]:
        """tid, first, last (words) of the spans, and pairs of linked texts."""
        tid, first, last = _merged(*np.concatenate(self.spans).T)
        links = _pairs(np.concatenate(self.links))
        return [tid, first, last + SHINGLE - 1, links[links[:, 0] != links[:, 1]]]


def _same_around(alike: _Alike, key: np.ndarray, tid: np.ndarray, place: np.ndarray, size: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Settles rows whose surroundings (near) are all the same in several texts: no other text can add to what is alike there.
    Places of the rows that go on, of such rows one."""
    left, right = np.minimum(place, REACH), np.minimum(size - place - RUN, REACH)
    whole = _mixed(key.view(np.uint64), 7) + (left * AROUND + right).astype(np.uint64)
    for column in near.T:
        whole = _mixed(whole, 8) + column
    met = alike.add(whole, tid, place - left - MISSES, place + RUN + right + MISSES, size)
    go = ~met
    rows = np.flatnonzero(met)
    rows = rows[np.lexsort((tid[rows], whole[rows]))]
    go[rows[_groups(whole[rows])[0]]] = True
    return np.flatnonzero(go)


def _limits(values: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How far stretches reach before each run (at, of the values; low byte) and behind it in which it is the first of the least."""
    own = values[at]
    out = [np.minimum(place, REACH), np.minimum(size - place - RUN, REACH)]
    for j in range(REACH, 0, -1):
        out[0] = np.where((out[0] >= j) & (values[np.maximum(at - j, 0)] <= own), j - 1, out[0])
        out[1] = np.where((out[1] >= j) & (values[np.minimum(at + j, len(values) - 1)] < own), j - 1, out[1])
    return (out[0] + (out[1] << 8)).astype(np.uint32)


def _around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tid, text, keys (its signatures that more than EACH texts have). Rows of kind 1: part = such a signature, first =
    its place in tid, last = how many shingles tid has, near = the shingles around it, 32 bits of each; what is the same all
    around in texts of the slice goes on once. Kind 2: a span of tid that is alike; 3: tid and a text it is alike to (part)."""
    for batch in it:
        for part in _parts(batch, 1):
            tids, lists = part.column(0).to_numpy(), part.column(2)
            base, text = shingles(part.column(1))
            at, key = signatures(base, text)
            holder = np.repeat(np.arange(len(tids)), np.diff(lists.offsets.to_numpy()))
            named = _mixed(lists.flatten().to_numpy().view(np.uint64), 5) + holder.astype(np.uint64)
            large = np.isin(_mixed(key, 5) + text[at].astype(np.uint64), named)
            at, key = at[large], key[large].view(np.int64)
            sizes = np.bincount(text, minlength=len(tids))
            place, size, tid = at - (np.cumsum(sizes) - sizes)[text[at]], sizes[text[at]], tids[text[at]]
            low, values, alike = base.astype(np.uint32), run_hashes(base, RUN), _Alike()
            for a in range(0, len(at), AT_ONCE):
                now = slice(a, a + AT_ONCE)
                steps = np.arange(-REACH, RUN + REACH)
                where = place[now, None] + steps
                near = np.where((where >= 0) & (where < size[now, None]), low[np.clip(at[now, None] + steps, 0, len(low) - 1)], np.uint32(0))
                near = np.concatenate([near, _limits(values, at[now], place[now], size[now])[:, None]], axis=1).view(np.uint64)
                go = _same_around(alike, key[now], tid[now], place[now], size[now], near)
                yield _with_near(_found([1], [key[now][go]], [tid[now][go]], [place[now][go]], [size[now][go]]), near[go])
            settled = _settled(alike)
            yield _with_near(settled, np.zeros((settled.num_rows, PACKED), np.uint64))


def _with_near(rows: pa.RecordBatch, near: np.ndarray) -> pa.RecordBatch:
    near = np.ascontiguousarray(near)
    ends = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * np.int32(8 * PACKED))
    return rows.append_column("near", pa.BinaryArray.from_buffers(pa.binary(), rows.num_rows, [None, ends.buffers()[1], pa.py_buffer(near)]))


def _settled(alike: _Alike) -> pa.RecordBatch:
    tid, first, last, links = alike.batch()
    none = np.zeros(len(links), np.int64)
    return _found([2, 3], [tid, links[:, 1]], [tid, links[:, 0]], [first, none], [last, none])


def _nodes(root: np.ndarray, near: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tries of what follows (near, of reach shingles) the rows of each root: each row's node at each depth, at which
    depths it parts from another row or ends, where others have come with it, and reach."""
    n, depth = near.shape
    nodes, parts = np.empty((n, depth + 1), np.int32), np.zeros((n, depth + 1), bool)
    nodes[:, 0] = root
    for d in range(depth + 1):
        node, ends = nodes[:, d].astype(np.uint64), reach <= d
        child = np.uint64(1 << 32) if d == depth else np.where(ends, np.uint64(1 << 32), near[:, min(d, depth - 1)].astype(np.uint64))
        kinds, which = np.unique((node << np.uint64(33)) | child, return_inverse=True)
        branches = np.bincount((kinds >> np.uint64(33)).astype(np.int64), minlength=int(nodes[:, d].max()) + 1)
        rows = np.bincount(nodes[:, d])
        parts[:, d] = ((branches[nodes[:, d]] > 1) | (reach == d)) & (rows[nodes[:, d]] > 1) & (reach >= d)
        if d < depth:
            nodes[:, d + 1] = which
    return nodes, parts, reach


def _joined(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row's values."""
    out = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        out = _mixed(out, 11 + k) + c.astype(np.uint64)
    return _mixed(out, 10)


class _Texts:
    """Rows of whole signatures, read forwards or backwards."""

    def __init__(self, root: np.ndarray, tid: np.ndarray, place: np.ndarray, size: np.ndarray, near: np.ndarray, before: tuple, after: tuple):
        self.root, self.tid, self.place, self.size, self.before, self.after = root, tid, place, size, before, after
        self.reach = np.minimum(size - place - RUN, REACH)
        self.sums, self.powers = np.zeros((len(near), AROUND + 1), np.uint64), np.ones(AROUND + 1, np.uint64)
        for k in range(AROUND):
            self.sums[:, k + 1] = self.sums[:, k] * JOIN + (near[:, k].astype(np.uint64) + np.uint64(1)) * JOIN
            self.powers[k + 1 :] *= JOIN

    def stretch(self, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of the n shingles from `at`, counted from the signature."""
        return self.sums[row, at + REACH + n] - self.sums[row, at + REACH] * self.powers[n]

    def unbroken(self, alike: _Alike) -> None:
        """Stretches of ENOUGH shingles that several texts have, each told by its own signature only."""
        a = np.arange(ENOUGH - RUN + 1)
        for row, a in _where((self.before[2][:, None] >= a) & (self.after[2][:, None] >= ENOUGH - RUN - a), 1):
            first = self.place[row] - a
            alike.add(_joined(self.root[row], self.stretch(row, -a, np.full(len(a), ENOUGH))), self.tid[row], first - MISSES, first + SPAN, self.size[row])

    def one_break(self, alike: _Alike) -> None:
        """Passages of ENOUGH shingles with a break behind the signature: n shingles that end `b` behind it, at most MISSES
        that are passed over, and the rest. Two texts are unbroken just up to where they part in the tries before and after."""
        (left, parts_left, limit), (right, parts_right, _) = self.before, self.after

        def add(row: np.ndarray, n: np.ndarray, b: int, gap: np.ndarray) -> np.ndarray:
            fits = np.flatnonzero(b + gap + ENOUGH - n <= self.reach[row])
            row, n, gap = row[fits], n[fits], gap[fits]
            key = _joined(self.root[row], n, self.stretch(row, RUN + b - n, n), self.stretch(row, RUN + b + gap, ENOUGH - n))
            first = self.place[row] + RUN + b - n
            return fits[alike.add(key, self.tid[row], first - MISSES + gap, first + SPAN, self.size[row])]

        gaps = np.arange(MISSES + 1)
        for b in range(ENOUGH - RUN):
            here = np.flatnonzero(parts_right[:, b])
            low, high = max(0, SHARED - RUN - b), ENOUGH - RUN - b - 1
            if not len(here) or low > high:
                continue
            cells = parts_left[here, low : high + 1]
            cells[:, -1] |= limit[here] >= high
            most = np.full((len(here), len(gaps)), SHARED)  # of each row and gap the longest before the break that another text shares
            for row, a in _where(cells, len(gaps)):
                a += low
                _, which, n = np.unique(_joined(left[here[row], a], right[here[row], b], a), return_inverse=True, return_counts=True)
                row, a, gap = (x.ravel() for x in np.broadcast_arrays(row[n[which] > 1][:, None], a[n[which] > 1][:, None], gaps))
                met = add(here[row], a + RUN + b, b, gap)
                np.maximum.at(most, (row[met], gap[met]), a[met] + RUN + b)
            some = np.flatnonzero(most.ravel() > SHARED)  # less before the break and more behind it
            for at, n in _where(most.ravel()[some, None] > np.arange(SHARED, ENOUGH), 1):
                at = some[at]
                add(here[at // len(gaps)], n + SHARED, b, at % len(gaps))


def _where(cells: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the cells that are set, whole columns at a time, of about KEYS_AT_ONCE cells, each counted `times`."""
    total = np.cumsum(cells.sum(axis=0)) * times
    start = 0
    while start < len(total) and total[-1] > (total[start - 1] if start else 0):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + KEYS_AT_ONCE, side="right")))
        row, column = np.nonzero(cells[:, start:end])
        if len(row):
            yield row, column + start
        start = end


def _about(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, kind, tid, first, last, near of whole signatures: kinds 2 and 3 of what is alike about each, however many texts
    have it. A window that is alike and holds the signature in an unbroken stretch has all but MISSES of its shingles in that
    stretch or has one break; a key of those shingles is the same in all texts that are alike so, and in no other."""
    part, kind, tid, first, last = rows[:, :5].T
    yield _found([2, 3], *([c[kind == k] for k in (2, 3)] for c in (part, tid, first, last)))
    rows, alike = rows[rows[:, 1] == 1], _Alike()
    if not len(rows):
        return
    rows = rows[_same_around(alike, rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5:].view(np.uint64))]
    heads, n = _groups(rows[:, 0])
    cuts = [0]
    for end in np.cumsum(n).tolist():  # whole signatures, AT_ONCE rows or one signature at a time
        if end == len(rows) or end - cuts[-1] >= AT_ONCE:
            cuts.append(end)
    for a, z in zip(cuts, cuts[1:], strict=False):
        key, _, tid, place, size = rows[a:z, :5].T
        near = np.ascontiguousarray(rows[a:z, 5:]).view(np.uint32)
        near, limits = near[:, :AROUND], near[:, AROUND].astype(np.int64)
        root = np.unique(key, return_inverse=True)[1]
        after = _nodes(root, near[:, REACH + RUN :], limits >> 8)
        before = _nodes(root, near[:, :REACH][:, ::-1], limits & 255)
        there, back = _Texts(root, tid, place, size, near, before, after), _Alike()
        there.unbroken(alike)
        there.one_break(alike)
        del there
        _Texts(root, tid, size - place - RUN, size, near[:, ::-1], after, before).one_break(back)
        total = dict(zip(tid.tolist(), size.tolist(), strict=True))
        alike.links += back.links
        for spans in back.spans:
            n_of = np.array([total[t] for t in spans[:, 0].tolist()], np.int64)
            alike.spans.append(np.stack([spans[:, 0], n_of - 1 - spans[:, 2], n_of - 1 - spans[:, 1]], axis=1))
    yield _settled(alike)


def _covered(met: np.ndarray) -> np.ndarray:
    """Which places lie in a window of SPAN of which all but MISSES are met."""
    if len(met) < SPAN:
        return np.zeros(len(met), bool)
    sums = np.concatenate([[0], np.cumsum(met)])
    good = sums[SPAN:] - sums[:-SPAN] >= SPAN - MISSES
    edge = np.zeros(len(met) + 1, np.int64)
    edge[: len(good)] += good
    edge[SPAN:] -= good[: len(edge) - SPAN]
    return np.cumsum(edge)[: len(met)] > 0


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of a and of b lie in windows of SPAN shingles of which all but MISSES are found in such windows of
    the other text."""
    there = _covered(np.isin(b, a))
    here = _covered(np.isin(a, b[there])) if there.any() else np.zeros(len(a), bool)
    there = _covered(np.isin(b, a[here])) if here.any() else np.zeros(len(b), bool)
    return (here, there) if there.any() else (here & False, there)


def runs(met: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch that is met."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], met.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tid, text: the low half of the hash of each shingle, which is enough to compare two texts."""
    for batch in it:
        for part in _parts(batch, 1):
            base, text = shingles(part.column(1))
            low, ends = base.astype("<u4"), np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
            raw = [low[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["tid", "prints"])


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From u, v, a, b (their prints): spans (words; kind 2) and links (kind 3) of those that are alike."""
    for batch in it:
        for at in range(0, batch.num_rows, 4096):
            part, out, links = batch.slice(at, 4096), [], []
            for u, v, a, b in zip(*(part.column(c) for c in ("u", "v", "a", "b")), strict=True):
                here, there = alike(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4"))
                if here.any():
                    links.append((u.as_py(), v.as_py()))
                    out.extend((own, first, last + SHINGLE - 1) for own, met in ((u.as_py(), here), (v.as_py(), there)) for first, last in runs(met))
            spans, links = np.array(out, np.int64).reshape(-1, 3), np.array(links, np.int64).reshape(-1, 2)
            tid, first, last = _merged(*spans.T)
            none = np.zeros(len(links), np.int64)
            yield _found([2, 3], [tid, links[:, 1]], [tid, links[:, 0]], [first, none], [last, none])


def _texts_of(keyed: DataFrame, single: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """tid, text of the texts in need (tid; n of them), of each from the row of its least doc_id."""
    need = need.join(single, "tid").select(F.col("tid").alias("need"), F.col("low").alias("low"))
    need = broadcast_if_small(materialise(need, "need"), n)
    return keyed.join(need, (F.col("tid") == F.col("need")) & F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").select("tid", "text")


def found_alike(keyed: DataFrame, single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed: doc_id, text, tid; single: tid, low (its least doc_id). Spans and links of texts that are alike (FOUND: kind 2
    has words first to last of tid, kind 3 texts tid and part), and the words of each text (tid, n) of SPAN shingles."""
    rows = keyed.select("tid", "text").mapInArrow(_windows, "part bigint, kind tinyint, key bigint, tid bigint")
    rows = rows.repartition("part").sortWithinPartitions("part")
    met = materialise(rows.mapInArrow(_by_key(["part", "kind", "key", "tid"], _meet), "kind tinyint, u bigint, v bigint"), "met")
    pairs = met.where("kind = 0").select("u", "v")
    places = materialise(met.where("kind = 1").groupBy(F.col("u").alias("tid")).agg(F.collect_set("v").alias("keys")), "places")
    n, held = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    done = None
    if n:
        some = _texts_of(keyed, single, places.select("tid"), n)
        some = some.join(F.broadcast(places) if held <= BROADCAST_KEYS else places, "tid").select("tid", "text", "keys")
        around = some.mapInArrow(_around, FOUND + ", near binary").repartition("part").sortWithinPartitions("part")
        done = materialise(around.mapInArrow(_by_key(["part", "kind", "tid", "first", "last"], _about, "near"), FOUND), "settled")
    pairs = materialise(pairs.distinct(), "pairs")
    need = materialise(pairs.select(F.explode(F.array("u", "v")).alias("tid")).distinct(), "need")
    prints = materialise(_texts_of(keyed, single, need, need.count()).mapInArrow(_prints, "tid bigint, prints binary"), "prints")
    long = broadcast_if_small(materialise(prints.select("tid", F.length("prints").alias("long")), "long"))
    sized = pairs.join(long.toDF("u", "long_u"), "u").join(long.toDF("v", "long_v"), "v")
    swap = F.col("long_u") > F.col("long_v")  # the shorter text's prints go to the longer text
    pairs = sized.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"))
    both = pairs.join(prints.select(F.col("tid").alias("u"), F.col("prints").alias("a")), "u")
    both = both.join(prints.select(F.col("tid").alias("v"), F.col("prints").alias("b")), "v")
    found = materialise(both.mapInArrow(_compare, FOUND), "alike")
    found = found if done is None else found.unionByName(done)
    return found, met.where("kind = 2").select(F.col("u").alias("tid"), F.col("v").alias("n")).distinct()


def _union(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    tid, first, last = _merged(*rows.T)
    yield _table({"tid": tid, "first": first, "last": last})


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and maximal repeated passage: doc_id, first_word, last_word, n_words, component_id (smallest
    doc_id of the documents connected by repeated passages).

    A passage is repeated if it is made of windows of WORDS words that are found in another document with a similarity
    of 0.8 or more of their SHINGLE-word shingles (see alike). A text of at least WORDS words that several rows hold is
    repeated as a whole; such texts are searched once.

    Exact and near passages are all found. Texts that share one share a signature in it; if at most EACH texts have that, they
    are compared each with each. If more have it, what is alike about it is told by keys that texts have in common if and
    only if they are alike there: ENOUGH shingles around the signature, unbroken or with one break (see _about). So no pair is
    passed over, and a key's texts are linked by its least one, however many they are.

    Words are runs without ASCII white space, A-Z in lower case; null and short texts have no passages. A null doc_id is an
    id like any other but names no component unless all are null. Rows that repeat both id and text give one result. Texts
    are told apart by 64 bits of hash. Other columns are not read. Empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    keyed = rows.withColumn("tid", F.xxhash64("text"))
    ids = materialise(keyed.select("doc_id", "tid"), "ids")
    single = materialise(ids.groupBy("tid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "single")
    found, words = found_alike(keyed, single.select("tid", "low"))
    whole = words.withColumnRenamed("n", "words").join(single.where("n > 1"), "tid").select("tid", F.lit(0).alias("first"), (F.col("words") - 1).cast("int").alias("last"))
    spans = found.where("kind = 2").select("tid", "first", "last").unionByName(whole)
    merged = spans.repartition("tid").sortWithinPartitions("tid").mapInArrow(_by_key(["tid", "first", "last"], _union), "tid bigint, first bigint, last bigint")
    merged = materialise(merged, "merged")
    roots = connected_components(found.where("kind = 3").select(F.col("tid").alias("u"), F.col("part").alias("v")).where("u <> v").distinct())
    inside = single.join(merged.select("tid").distinct(), "tid", "left_semi").join(roots, F.col("tid") == F.col("node"), "left")
    inside = materialise(inside.select("tid", "low", F.coalesce("root", "tid").alias("root")), "roots")
    lowest = materialise(inside.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = materialise(merged.join(inside.join(lowest, "root").select("tid", "component_id"), "tid"), "named")
    out = ids.distinct().join(named, "tid")
    return out.select(
        "doc_id",
        F.col("first").alias("first_word"),
        F.col("last").alias("last_word"),
        (F.col("last") - F.col("first") + 1).alias("n_words"),
        "component_id",
    )
