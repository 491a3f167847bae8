"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_together import Together
from .common import map_texts, release

#: Pieces of up to SHORT bytes go through the transducer together, those of about AT_ONCE pieces of texts; more than MOST_PIECES are
#: remembered only if those texts hold them.
SHORT, AT_ONCE, MOST_PIECES = 128, 100_000, 60_000
#: For longer pieces, states and pairs are memoised up to these numbers, which bounds a worker's memory. States beyond are made anew
#: where they are met; after STALE of them all are forgotten, and everything is at the end of a task.
MOST_STATES, MOST_PAIRS = 20_000, 100_000
STALE = 50 * MOST_STATES
#: Ids that are decoded in one step.
STEP = 4096
NONE = 1 << 60
BYTES = [bytes([i]) for i in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64(token) rank"."""
    system, inner = pa.fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


#: The configuration before the first byte.
START = ((-1, b"", ()),)


class Transducer:
    """Maps the bytes of one piece to BPE tokens, a byte at a time.

    A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each pair of
    neighbours encodes to itself as a pair. This gives a non-deterministic transducer: a configuration is the last
    whole token and the bytes read since, which must start some token; on a byte a configuration grows these bytes,
    or closes them as a token that agrees with its left neighbour. As the encoding of any prefix is unique, at most
    one configuration ends at each earlier place, so a determinised state has no more of them than the longest token
    has bytes. States are determinised when first reached; each configuration carries the tokens not yet emitted,
    and what all of them share is emitted at once, so emission lags by less than the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.starts = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.longest = max(map(len, ranks), default=0)
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.configurations: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        """Drops all states but the start."""
        for memo in (self.configurations, self.number, self.arcs, self.ends):
            memo.clear()
        self.made = 0
        self._state(START)

    def _state(self, key: tuple) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.configurations)
            self.configurations.append(key)
        return at

    def by_merging(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: join the lowest-ranked pair of neighbours, leftmost first, until none is a token or only
        `least` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts at the left (0) or right (1) end of the token while it is merged, from its byte to itself, each
        with its rank; empty if the token's bytes don't merge to it. The last merge of a merged token has the highest
        rank, which is checked."""
        found = self.edges[side].get(token)
        if found is None:
            raw = self.bytes_of[token]
            if len(raw) == 1:
                found = [(raw, -1)]
            else:
                halves = self.by_merging(raw, 2)
                found = []
                if len(halves) == 2:
                    ids = [self.ranks.get(h, NONE) for h in halves]
                    below = self.edge(ids[side], side) if max(ids) < NONE and all(self.edge(i, 0) for i in ids) else []
                    if below and any(len(h) > 1 and i >= token for h, i in zip(halves, ids, strict=True)):
                        raise ValueError(f"token {token} ranks before its own parts")
                    found = [*below, (raw, token)] if below else []
            self.edges[side][token] = found
        return found

    def closes(self, last: int, token: int) -> bool:
        """Whether `token` merges from its bytes, and no merge crosses the border when it follows `last`."""
        key = (last + 1) << 32 | token
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            fits = self.pairs[key] = self._fits(last, token)
        return fits

    def _fits(self, last: int, token: int) -> bool:
        """Merges come in order of rank, so at any time the parts beside the border are those of the highest ranks so far."""
        right = self.edge(token, 0)
        if last < 0 or not right:
            return bool(right)
        left = self.edge(last, 1)
        i, j, m, n = 0, 0, len(left) - 1, len(right) - 1
        while True:
            across = self.ranks.get(left[i][0] + right[j][0], NONE)
            next_left = left[i + 1][1] if i < m else NONE
            next_right = right[j + 1][1] if j < n else NONE
            if across < next_left and across <= next_right and across < NONE:
                return False
            if next_left == NONE and next_right == NONE:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _closing(self, configurations: tuple) -> tuple[int, tuple[int, ...]]:
        """The last token of what was read, and all tokens not yet emitted; (-1, ()) of nothing, (-2, ()) if no sequence has
        these bytes. As the encoding is unique, one configuration closes at most."""
        ranks = self.ranks
        for last, part, waiting in configurations:
            token = ranks.get(part)
            if token is not None and self.closes(last, token):
                return token, (*waiting, token)
        return (-1 if configurations == START else -2), ()

    def _step(self, configurations: tuple, one: bytes) -> tuple[tuple, tuple[int, ...]]:
        """The configurations after a byte, and the tokens that all of them share."""
        starts, after = self.starts, []
        for last, part, waiting in configurations:
            grown = part + one
            if grown in starts:
                after.append((last, grown, waiting))
        if one in starts:
            token, waiting = self._closing(configurations)
            if token >= 0:
                after.append((token, one, waiting))
        if not after:
            raise ValueError(f"the vocabulary has no token for byte {one[0]}")
        emitted = after[0][2]
        for _, _, waiting in after[1:]:
            while waiting[: len(emitted)] != emitted:
                emitted = emitted[:-1]
        n = len(emitted)
        if n:
            after = [(last, part, waiting[n:]) for last, part, waiting in after]
        return tuple(after), emitted

    def _last(self, configurations: tuple) -> tuple[int, ...]:
        """What is still to be emitted when the piece ends."""
        token, waiting = self._closing(configurations)
        if token == -2:
            raise ValueError("no token sequence has these bytes")
        return waiting

    def _unmemoised(self, configurations: tuple, left: bytes, out: list[int]) -> list[int]:
        self.made += len(left)
        for byte in left:
            configurations, emitted = self._step(configurations, BYTES[byte])
            out.extend(emitted)
        out.extend(self._last(configurations))
        return out

    def run(self, piece: bytes) -> list[int]:
        state, out, arcs, n = 0, [], self.arcs, len(piece) - 1
        if self.made > STALE:
            self.forget()
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            if i == n:
                end = self.ends.get(key)
                if end is None:
                    after, emitted = self._step(self.configurations[state], BYTES[byte])
                    end = (*emitted, *self._last(after))
                    if len(self.ends) < MOST_STATES:
                        self.ends[key] = end
                out.extend(end)
                break
            arc = arcs.get(key)
            if arc is None:
                if len(self.configurations) >= MOST_STATES or len(arcs) >= 2 * MOST_STATES:
                    return self._unmemoised(self.configurations[state], piece[i:], out)
                after, emitted = self._step(self.configurations[state], BYTES[byte])
                arc = arcs[key] = (self._state(after), emitted)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        return out


class Encoder:
    """Splits text by a pattern and encodes each match separately; a match that is a token is that token. Other matches of up to SHORT
    bytes are run through the transducer together, longer ones by themselves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.together = Together(self.transducer)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.begun: list[int] = []

    def _learn(self, new: list[str]) -> None:
        short, raws = [], []
        for piece in new:
            raw = piece.encode()
            token = self.ranks.get(raw)
            if token is not None:
                self.pieces[piece] = (token,)
            elif len(raw) > SHORT:
                self.pieces[piece] = tuple(self.transducer.run(raw))
            else:
                short.append(piece)
                raws.append(raw)
        self.pieces.update(zip(short, self.together.encode(raws), strict=True))

    def forget(self) -> None:
        self.pieces.clear()
        self.begun = []
        self.together.forget()
        self.transducer.pairs.clear()
        self.transducer.forget()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        held, n = [], 0
        for text in texts:
            pieces = self.split(text or "")
            for at in range(0, len(pieces) or 1, AT_ONCE):
                held.append((pieces[at : at + AT_ONCE], at + AT_ONCE >= len(pieces)))
                n += len(held[-1][0])
                if n >= AT_ONCE:
                    yield from self._finished(held)
                    n = 0
        yield from self._finished(held)

    def _finished(self, held: list[tuple[list[str], bool]]) -> Iterator[list[int]]:
        """The ids of the held texts that end here; those of one that doesn't wait in `begun`."""
        different = set().union(*(pieces for pieces, _ in held))
        if len(self.pieces) > MOST_PIECES:  # what is met again stays, the rest is forgotten
            self.pieces = {p: ids for p, ids in self.pieces.items() if p in different}
        self._learn([p for p in different if p not in self.pieces])
        known = self.pieces.__getitem__
        for pieces, ends in held:
            self.begun.extend(chain.from_iterable(map(known, pieces)))
            if ends:
                ids, self.begun = self.begun, []
                yield ids
        held.clear()

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))


def _room(pending: bytes) -> tuple[int, range]:
    """Bytes of the character that pending starts, and what may come next."""
    lead = pending[0]
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    return size, range(low, high + 1)


def utf8_step(pending: bytes, raw: bytes) -> tuple[str, bytes]:
    """Feeds raw to the state machine whose state is the unfinished character's bytes: text made, next state. Each
    longest ill-formed start of a character becomes one U+FFFD. The machine itself steps at both ends of raw only, where a
    character may be unfinished: whole characters between are taken together."""
    raw = pending + raw
    for n in range(1, min(4, len(raw) + 1)):  # an unfinished character has 3 bytes at most
        byte = raw[-n]
        if byte >= 0xC0:
            left = _unfinished(raw[-n:])
            return raw[: len(raw) - len(left)].decode("utf-8", "replace"), left
        if byte < 0x80:
            break
    return raw.decode("utf-8", "replace"), b""


def _unfinished(tail: bytes) -> bytes:
    """tail, if it may still become a character, or nothing."""
    if not 0xC2 <= tail[0] <= 0xF4:
        return b""
    pending = tail[:1]
    for byte in tail[1:]:
        size, may = _room(pending)
        if byte not in may or len(pending) == size:
            return b""
        pending += bytes([byte])
    return pending if len(pending) < _room(pending)[0] else b""


class Decoder:
    """Streaming decoder: text comes as soon as its characters are complete, whatever the tokens' borders. The state is the
    bytes of an unfinished character; the bytes of STEP tokens are one step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.state = b""

    def feed(self, ids: Iterable[int]) -> str:
        out, ids = [], iter(ids)
        while raw := b"".join(map(self.bytes_of.__getitem__, islice(ids, STEP))):
            text, self.state = utf8_step(self.state, raw)
            out.append(text)
        return "".join(out)

    def finish(self) -> str:
        left, self.state = self.state, b""
        return "\ufffd" if left else ""

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(_ranks(path))


def _added(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], names=[*kept, name])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with column `to`: the token ids of the whole text (array<int>); null and empty text have none. Other
    columns pass through, a column of the name `to` is replaced. No shuffle; an empty table stays empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(path, pattern)
        for batch in it:
            ids = list(code.encode_all(t.as_py() for t in batch.column(text)))
            yield _put(batch, to, pa.array(ids, pa.list_(pa.int32())))
        code.forget()
        release()

    return map_texts(docs, batches, _added(docs, to, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """docs with column `to`: the text of the token ids; null ids give the empty text. Bytes that aren't UTF-8 become
    U+FFFD. An id that the vocabulary hasn't is an error."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _decoder(path)
        for batch in it:
            yield _put(batch, to, pa.array([code.decode(x.as_py() or ()) for x in batch.column(ids)], pa.string()))

    return map_texts(docs, batches, _added(docs, to, T.StringType()))


def round_trip_digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each whole text, decodes its ids, and returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the decoded text's UTF-8 bytes). One row per row; null text counts as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, back = _encoder(path, pattern), _decoder(path)
        names = {i: str(i) for i in code.ranks.values()}
        for batch in it:
            n, ids_sha, text_sha = [], [], []
            for ids in code.encode_all(t.as_py() for t in batch.column(1)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        code.forget()
        release()

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), batches, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
