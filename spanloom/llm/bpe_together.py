"""The transducer of byte_bpe over many short pieces at once, a byte of each at a time, with states as rows of integer arrays."""

from __future__ import annotations

import numpy as np

#: Pairs of tokens whose agreement is remembered, besides those that one call of encode() meets.
MOST_PAIRS = 400_000
NO_RANK = 1 << 60
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Different whole numbers from 0 to values of 32 bits, by open addressing over arrays; -1 for what isn't there."""

    def __init__(self, bits: int = 12):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        there = self.keys[at]
        found = there == keys
        out = np.where(found, self.values[at], np.int32(-1))
        left = np.flatnonzero(~found & (there >= 0))
        while left.size:
            at[left] = (at[left] + 1) & (self.keys.size - 1)
            there = self.keys[at[left]]
            found = there == keys[left]
            out[left[found]] = self.values[at[left[found]]]
            left = left[~found & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are all different and not there yet."""
        if (self.n + keys.size) * 3 > self.keys.size:
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self._clear(int((self.n + keys.size) * 4).bit_length())
            self.put(*old)
        self.n += keys.size
        at, left = self._places(keys), np.arange(keys.size)
        while left.size:
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # one of those that want the same place gets it
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (self.keys.size - 1)


class Ends:
    """The parts at one end of each token while it is merged, as ranges of flat arrays that end with NO_RANK. A range is made when
    its token is first asked for; a token that its bytes don't merge to has none (-2)."""

    def __init__(self, tokens: int, parts):
        self.parts, self.start = parts, np.full(tokens, -1, np.int64)
        self.ids, self.ranks = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def starts(self, tokens: np.ndarray) -> np.ndarray:
        start = self.start[tokens]
        if (start == -1).any():
            ids, ranks, n = [], [], self.ids.size
            for token in np.unique(tokens[start == -1]).tolist():
                parts = self.parts(token)
                self.start[token] = n + len(ids) if parts else -2
                if parts:
                    ids += [i for i, _ in parts] + [0]
                    ranks += [rank for _, rank in parts] + [NO_RANK]
            self.ids, self.ranks = np.append(self.ids, np.array(ids, np.int64)), np.append(self.ranks, np.array(ranks, np.int64))
            start = self.start[tokens]
        return start


class Together:
    """Runs the transducer over many pieces in step. The states that the pieces reach with a byte are determinised in one go: each
    different (state, byte) once, and states of the same configurations are one. A configuration is a last token and a node of the
    vocabulary's trie. The token that may close after a byte is a function of the state alone, so a piece's tokens are read
    off from its end; how long they wait is bounded by the length of the pieces, which the caller bounds."""

    def __init__(self, transducer):
        ranks, self.of_bytes = transducer.ranks, transducer.bytes_of
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        nodes = {b"": 0}
        for part in transducer.starts:
            nodes[part] = len(nodes)
        self.trie = Table()
        keys = [nodes[part[:-1]] << 8 | part[-1] for part in transducer.starts]
        self.trie.put(np.array(keys, np.int64), np.arange(1, len(nodes), dtype=np.int32))
        self.first = self.trie.get(np.arange(256))
        self.token = np.array([ranks.get(part, -1) for part in nodes], np.int64)
        merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for n in range(1, len(token)):
                a, b = ranks.get(token[:n]), ranks.get(token[n:])
                if a is not None and b is not None:
                    merged[a << 32 | b] = rank
        self.merges = Table()
        self.merges.put(np.array(list(merged), np.int64), np.array(list(merged.values()), np.int32))
        self.left, self.right = (
            Ends(size, lambda token, side=side: [(ranks[raw], rank) for raw, rank in transducer.edge(token, side)]) for side in (1, 0)
        )
        self.forget()

    def forget(self) -> None:
        """Drops the pairs that were met."""
        self.pairs = Table()

    def closes(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token merges from its bytes, and no merge crosses the border when it follows `last` (-1: nothing)."""
        keys = (last + 1) << 32 | token
        known = self.pairs.get(keys)
        new = np.flatnonzero(known < 0)
        if new.size:
            pairs = np.unique(keys[new])
            fits = self._fits((pairs >> 32) - 1, pairs & 0xFFFFFFFF).astype(np.int32)
            if self.pairs.n >= MOST_PAIRS:
                self.forget()
            self.pairs.put(pairs, fits)
            known[new] = fits[np.searchsorted(pairs, keys[new])]
        return known == 1

    def _fits(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Merges come in order of rank, so at any time the parts beside the border are those of the highest ranks so far."""
        right = self.right.starts(token)
        fits = (last < 0) & (right >= 0)
        at = np.flatnonzero((last >= 0) & (right >= 0))
        i, j = self.left.starts(last[at]), right[at]
        while at.size:
            across = self.merges.get(self.left.ids[i] << 32 | self.right.ids[j]).astype(np.int64)
            across[across < 0] = NO_RANK
            next_left, next_right = self.left.ranks[i + 1], self.right.ranks[j + 1]
            crossed = (across < next_left) & (across <= next_right)
            over = (next_left == NO_RANK) & (next_right == NO_RANK)
            fits[at[over & ~crossed]] = True
            on, by_left = ~(crossed | over), next_left <= next_right
            at, i, j = at[on], (i + by_left)[on], (j + ~by_left)[on]
        return fits

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each piece; no piece is empty."""
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        longest_first = np.argsort(-sizes, kind="stable")
        falling, begin = sizes[longest_first], begins[longest_first]
        closed = np.empty(raw.size, np.int64)
        states = (np.array([-1]), np.array([0]), np.array([1]), np.array([-1]))
        state = np.zeros(len(pieces), np.int64)
        for depth in range(int(falling[0])):
            n = int(np.searchsorted(-falling, -depth))
            at = begin[:n] + depth
            arcs, which = np.unique(state[:n] << 8 | raw[at], return_inverse=True)
            states, reached = self._step(states, arcs >> 8, arcs & 255)
            state = reached[which]
            closed[at] = states[3][state]
        borders = np.zeros(raw.size, bool)
        counts, left, on = np.zeros(len(pieces), np.int64), sizes.copy(), np.arange(len(pieces))
        while on.size:
            at = begins[on] + left[on] - 1
            token = closed[at]
            if (token < 0).any():
                raise ValueError("no token sequence has these bytes")
            borders[at] = True
            counts[on] += 1
            left[on] -= self.lengths[token]
            on = on[left[on] > 0]
        ids, to = closed[borders].tolist(), np.cumsum(counts).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *to], to, strict=False)]

    def _step(self, states: tuple, source: np.ndarray, byte: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The states behind arcs (state, byte), and which of them each arc leads to. States are four arrays: last tokens and nodes
        of their configurations, state by state with the one begun first in front; numbers of configurations; closing tokens."""
        last, node, count, closing = states
        n = source.size
        per = count[source]
        owner = np.repeat(np.arange(n), per)
        place = np.arange(owner.size) + np.repeat((np.cumsum(count) - count)[source] - (np.cumsum(per) - per), per)
        grown = self.trie.get(node[place] << 8 | byte[owner])
        on = grown >= 0
        begun = np.flatnonzero((closing[source] >= 0) & (self.first[byte] >= 0))
        owner = np.concatenate([owner[on], begun])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        last = np.concatenate([last[place[on]], closing[source[begun]]])[order]
        node = np.concatenate([grown[on], self.first[byte[begun]]]).astype(np.int64)[order]
        count = np.bincount(owner, minlength=n)
        if not count.all():
            raise ValueError(f"the vocabulary has no token for byte {byte[np.argmin(count)]}")
        first = np.cumsum(count) - count
        keys = (last + 1) << 32 | node
        mixed = (keys.astype(np.uint64) + np.uint64(1)) * SPREAD
        mixed = (mixed ^ (mixed >> np.uint64(29))) * SPREAD
        _, some, which = np.unique(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), first), return_index=True, return_inverse=True)
        same = some[which]
        # sums only propose that states are one: numbers and configurations decide
        apart = count != count[same]
        inside = np.flatnonzero(~apart[owner])
        there = first[same[owner[inside]]] + inside - first[owner[inside]]
        apart[owner[inside[keys[there] != keys[inside]]]] = True
        same[apart] = np.flatnonzero(apart)
        kept, reached = np.unique(same, return_inverse=True)
        own = same[owner] == owner
        last, node, count = last[own], node[own], count[kept]
        token = self.token[node]
        may = np.flatnonzero(token >= 0)
        may = may[self.closes(last[may], token[may])]
        closing = np.full(kept.size, -2, np.int64)
        closing[np.repeat(np.arange(kept.size), count)[may]] = token[may]
        return (last, node, count, closing), reached
