"""Layers of trained networks as operators over tables: embeddings, convolutions, recurrent scans, half-stateful scans.

Steps of a row are a tensor (functions/tensors.py) of steps x features, doubles. Rows of an Arrow batch are padded to its longest
and worked on together; steps beyond a row's own are masked and never come out. Weights are arrays that the caller trained elsewhere;
they are broadcast once and do not grow with the data. Dropout belongs to training and does nothing here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KIND = "struct<shape:array<int>,values:array<double>>"
ARROW = pa.struct([("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
MERGES = ("sum", "mul", "ave", "concat")
#: Doubles that a batch holds at once, padding included.
BATCH_CELLS = 1 << 22


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def linear(x: np.ndarray) -> np.ndarray:
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.2 * x + 0.5, 0, 1)


@dataclass
class Convolution:
    """kernel: width x features x filters. Padding `same` keeps the number of steps (of an even width one more of the missing
    steps is on the right), `valid` takes whole windows only. Windows don't see other rows' steps. The activation is broadcast with the
    weights, so it is a function of a module."""

    kernel: np.ndarray
    bias: np.ndarray
    padding: str = "same"
    activation: Callable[[np.ndarray], np.ndarray] = relu

    def __post_init__(self):
        if self.padding not in ("same", "valid"):
            raise ValueError('padding must be "same" or "valid"')

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.kernel)
        before = (width - 1) // 2 if self.padding == "same" else 0
        after = width - 1 - before if self.padding == "same" else 0
        wide = np.pad(np.where(mask[:, :, None], x, 0), ((0, 0), (before, after), (0, 0)))
        steps = wide.shape[1] - width + 1
        if steps < 1:
            return np.zeros((len(x), 0, self.kernel.shape[2])), np.zeros((len(x), 0), bool)
        out = sum(wide[:, k : k + steps] @ self.kernel[k] for k in range(width)) + self.bias
        lengths = mask.sum(axis=1) - (width - 1 if self.padding == "valid" else 0)
        return self.activation(out), np.arange(steps) < lengths[:, None]


@dataclass
class Simple:
    """h = tanh(x kernel + h recurrent + bias)"""

    kernel: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    states: int = field(default=1, init=False)

    @property
    def units(self) -> int:
        return self.recurrent.shape[0]

    def step(self, x: np.ndarray, state: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
        return (np.tanh(x @ self.kernel + state[0] @ self.recurrent + self.bias),)


@dataclass
class Lstm:
    """Gates in the order input, forget, cell, output: kernel features x 4 units, recurrent units x 4 units, bias 4 units."""

    kernel: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    gate: Callable[[np.ndarray], np.ndarray] = hard_sigmoid
    states: int = field(default=2, init=False)

    @property
    def units(self) -> int:
        return self.recurrent.shape[0]

    def step(self, x: np.ndarray, state: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
        i, f, c, o = np.split(x @ self.kernel + state[0] @ self.recurrent + self.bias, 4, axis=1)
        cell = self.gate(f) * state[1] + self.gate(i) * np.tanh(c)
        return self.gate(o) * np.tanh(cell), cell


def scan(cell, x: np.ndarray, mask: np.ndarray, state: Sequence[np.ndarray] | None = None, backwards: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Outputs by step (in the order of the steps, also backwards) and the last state. A masked step keeps state and output."""
    state = tuple(state) if state is not None else tuple(np.zeros((len(x), cell.units)) for _ in range(cell.states))
    out = np.zeros((*x.shape[:2], cell.units))
    for k in range(x.shape[1])[:: -1 if backwards else 1]:
        there = mask[:, k, None]
        state = tuple(np.where(there, now, old) for now, old in zip(cell.step(x[:, k], state), state, strict=True))
        out[:, k] = state[0]
    return out, state


def merged(forward: np.ndarray, backward: np.ndarray, mode: str) -> np.ndarray:
    if mode == "concat":
        return np.concatenate([forward, backward], axis=-1)
    return {"sum": np.add, "mul": np.multiply, "ave": lambda a, b: (a + b) / 2}[mode](forward, backward)


@dataclass
class Recurrent:
    """A cell over the steps; with backward, another one from the end, merged by merge."""

    forward: Simple | Lstm
    backward: Simple | Lstm | None = None
    merge: str = "concat"

    def __post_init__(self):
        if self.merge not in MERGES:
            raise ValueError(f"merge must be one of {MERGES}")

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, _ = scan(self.forward, x, mask)
        return (merged(out, scan(self.backward, x, mask, backwards=True)[0], self.merge) if self.backward else out), mask


def _read(column: pa.Array) -> list[np.ndarray | None]:
    return [None if t is None else np.asarray(t["values"], np.float64).reshape(t["shape"]) for t in column.to_pylist()]


def _struct(x: np.ndarray | None) -> dict | None:
    return None if x is None else {"shape": list(x.shape), "values": x.ravel()}


def _padded(arrays: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len({a.shape[1:] for a in arrays if len(a)}) > 1:
        raise ValueError("rows differ in their number of features")
    steps = max(map(len, arrays))
    x = np.zeros((len(arrays), steps, *next((a.shape[1:] for a in arrays if len(a)), arrays[0].shape[1:])))
    for i, a in enumerate(arrays):
        x[i, : len(a)] = a if len(a) else 0
    return x, np.arange(steps) < np.array([len(a) for a in arrays])[:, None]


def _parts(arrays: Sequence[np.ndarray]) -> Iterator[list[int]]:
    """Places of arrays of like lengths, few enough for their padded form to stay within BATCH_CELLS."""
    part: list[int] = []
    for i in sorted(range(len(arrays)), key=lambda i: len(arrays[i])):
        if part and (len(part) + 1) * max(arrays[i].size, 1) > BATCH_CELLS:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _with(df: DataFrame, out: str) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name != out]
    return T.StructType([*kept, T.StructField(out, T._parse_datatype_string(KIND))])


def _added(batch: pa.RecordBatch, out: str, values: list) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != out]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([_struct(v) for v in values], ARROW)], names=[*kept, out])


def apply_layers(df: DataFrame, steps: str, layers: Sequence[Convolution | Recurrent], out: str = "output") -> DataFrame:
    """df with out: the tensor steps (steps x features) through the layers one after another. Null stays null; a row without
    steps, or with fewer than a valid window, has none. Another number of features than the first layer's is an error."""
    shared = df.sparkSession.sparkContext.broadcast(list(layers))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            arrays = _read(batch.column(steps))
            known = [i for i, a in enumerate(arrays) if a is not None]
            for part in _parts([arrays[i] for i in known]):
                rows = [known[i] for i in part]
                x, mask = _padded([arrays[i] for i in rows])
                for layer in shared.value:
                    x, mask = layer(x, mask)
                for i, a, m in zip(rows, x, mask, strict=True):
                    arrays[i] = a[: int(m.sum())]
            yield _added(batch, out, arrays)

    return df.mapInArrow(batches, _with(df, out))


def embed(df: DataFrame, codes: str, vectors: np.ndarray, out: str = "output", mask_zero: bool = False) -> DataFrame:
    """df with out: codes (array<int>) as the rows of vectors that they number. With mask_zero, steps of code 0 are left out.
    Null stays null; a code beyond the vectors is an error."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(vectors, np.float64))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for c in batch.column(codes).to_pylist():
                at = None if c is None else np.asarray([x for x in c if x or not mask_zero], np.int64)
                if at is not None and len(at) and not (0 <= at.min() and at.max() < len(shared.value)):
                    raise ValueError("a code has no vector")
                found.append(None if at is None else shared.value[at])
            yield _added(batch, out, found)

    return df.mapInArrow(batches, _with(df, out))


def embed_words(df: DataFrame, codes: str, vectors: np.ndarray, forward: Simple | Lstm, backward: Simple | Lstm, out: str = "output", mask_zero: bool = True) -> DataFrame:
    """df with out: words x 2 units, of words as arrays of character codes (array<array<int>>): each word's last forward state
    beside its last backward one. With mask_zero codes of 0 are left out, and a word without others has the state at the start, zeros."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(vectors, np.float64), forward, backward))

    def states(words: list[np.ndarray]) -> np.ndarray:
        table, ahead, back = shared.value
        found = np.zeros((len(words), ahead.units + back.units))
        embedded = [table[w] for w in words]
        for part in _parts(embedded):
            x, mask = _padded([embedded[i] for i in part])
            found[part] = np.concatenate([scan(ahead, x, mask)[1][0], scan(back, x, mask, backwards=True)[1][0]], axis=1)
        return found

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = batch.column(codes).to_pylist()
            words = [np.asarray([x for x in w or () if x or not mask_zero], np.int64) for row in rows if row for w in row]
            found, at, done = states(words) if words else None, 0, []
            width = forward.units + backward.units
            for row in rows:
                n = len(row or ())
                done.append(None if row is None else found[at : at + n] if n else np.zeros((0, width)))
                at += n
            yield _added(batch, out, done)

    return df.mapInArrow(batches, _with(df, out))


def half_stateful(df: DataFrame, key: str, order: str, steps: str, layer: Recurrent, out: str = "output") -> DataFrame:
    """df with out: chunks (steps) of documents (key), in order, through a recurrent layer whose forward cell goes on from the
    document's chunk before, while the backward one starts anew with each chunk.

    A document's chunks come to one task in order, as each needs the state before it; a task holds the batch and a state. Chunks of a
    batch that belong to different documents are worked on together. Chunks without steps, and null ones, leave the state as it is;
    chunks of one order are taken in any order. Null keys are one document."""
    shared = df.sparkSession.sparkContext.broadcast(layer)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = shared.value
        last, carried = None, None
        for batch in it:
            keys, arrays = batch.column(key).to_pylist(), _read(batch.column(steps))
            states, turns, turn = {}, {}, 0
            if carried is not None:
                states[(last,)] = carried
            for i, k in enumerate(keys):  # turn: how many of the document's chunks come before, in this batch
                turn = turn + 1 if i and keys[i - 1] == k else 0
                if arrays[i] is not None and len(arrays[i]):
                    turns.setdefault(turn, []).append(i)
            for turn in sorted(turns):
                whole = turns[turn]
                for part in _parts([arrays[i] for i in whole]):
                    rows = [whole[i] for i in part]
                    x, mask = _padded([arrays[i] for i in rows])
                    zero = np.zeros(cell.forward.units)
                    before = [states.get((keys[i],), (zero,) * cell.forward.states) for i in rows]
                    ahead, after = scan(cell.forward, x, mask, [np.stack(s) for s in zip(*before, strict=True)])
                    result = merged(ahead, scan(cell.backward, x, mask, backwards=True)[0], cell.merge) if cell.backward else ahead
                    for n, i in enumerate(rows):
                        states[(keys[i],)] = tuple(s[n] for s in after)
                        arrays[i] = result[n, : int(mask[n].sum())]
            if keys:
                last = keys[-1]
                carried = states.get((last,))
            yield _added(batch, out, arrays)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(batches, _with(df, out))
