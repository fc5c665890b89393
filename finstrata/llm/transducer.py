"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges of a rank file are compiled into a nondeterministic transducer. It reads bytes along a trie of the vocabulary; where a token ends it may
print the token and start over, provided the pair of tokens is one that the merges leave alone: a sequence of tokens is what the merges make of
its bytes exactly if each token is what they make of its own bytes and each neighbouring pair is what they make of the pair's. Such pairs are found
out when first met.

Determinisation is by subsets: a state is the set of readings that are still possible, a reading being the token before and the trie node. Each arc
notes the token that ends with its byte; there is one at most, since the bytes so far have one encoding. A token is printed when all readings
agree on it, so it waits for as long as a longer token could still cover its bytes and no longer. States and arcs are made on demand and kept up to
``MAX_STATES``, then forgotten. The work is linear in the bytes, however long a piece is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

NEVER = 1 << 62  # rank of a union that is no token
START = -1  # in place of the token before the first
NONE = -2  # no token ends here
LONG = 4096  # bytes of a piece, and bytes between two looks
MAX_STATES = 1 << 18
MAX_PAIRS = 1 << 20
MAX_PIECES = 1 << 18
MAX_PIECE = 256  # characters of a piece that is remembered


Trace = list[tuple[int, bytes, bytes]]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank, which is its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                below = self.children[node].get(b)
                if below is None:
                    below = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.ends[node] = rank
        self.traces: dict[int, Trace | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Only the start state: number 0, one reading."""
        self.numbers: dict[tuple, int] = {}
        self.readings: list[tuple[tuple[int, int], ...]] = []  # of each state: (last token, trie node), longest first
        self.closed: list[int] = []  # the token that ends where the state is entered
        self.arcs: dict[int, int] = {}  # state * 256 + byte: state
        self._number(((START, 0),), NONE)

    def _number(self, readings: tuple[tuple[int, int], ...], closed: int) -> int:
        found = self.numbers.get(readings)
        if found is None:
            found = self.numbers[readings] = len(self.readings)
            self.readings.append(readings)
            self.closed.append(closed)
        return found

    def trace(self, token: int) -> Trace | None:
        """How the merges build a token out of its bytes: at each step the rank of the next join, the leftmost and the rightmost part.
        None if they do not build it. The neighbours whose union ranks lowest are joined, the first of equals."""
        if token in self.traces:
            return self.traces[token]
        whole = self.tokens[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        ranks = [self.ranks.get(whole[i : i + 2], NEVER) for i in range(len(whole) - 1)]
        steps = []
        while ranks and (best := min(ranks)) < NEVER:
            steps.append((best, parts[0], parts[-1]))
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.ranks.get(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = self.ranks.get(parts[at] + parts[at + 1], NEVER)
        steps.append((NEVER, parts[0], parts[-1]))
        made = self.traces[token] = steps if len(parts) == 1 else None
        return made

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges leave ``token`` whole and apart from ``before``."""
        right = self.trace(token)
        if right is None or before == START:
            return right is not None
        pair = (before, token)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(self.traces[before], right)
        return known

    def _apart(self, left: Trace, right: Trace) -> bool:
        """Both tokens are built side by side, the lower rank first. They stay apart if no step would rather join the parts that touch."""
        i = j = 0
        while True:
            rank_left, _, last = left[i]
            rank_right, first, _ = right[j]
            across = self.ranks.get(last + first, NEVER)
            if across < rank_left and across <= rank_right:
                return False
            if rank_left == rank_right == NEVER:
                return True
            if rank_left <= rank_right:
                i += 1
            else:
                j += 1

    def arc(self, state: int, byte: int) -> int:
        """The state after one byte more, made now."""
        children, ends = self.children, self.ends
        readings = []
        closed = NONE
        for last, node in self.readings[state]:
            below = children[node].get(byte)
            if below is None:
                continue
            if children[below] or last == START:  # a first token may also be the whole piece
                readings.append((last, below))
            if closed == NONE and ends[below] >= 0 and self.follows(last, ends[below]):
                closed = ends[below]
        if closed != NONE:
            readings.append((closed, 0))  # the root's reading tells states with different ends apart
        target = self.arcs[state << 8 | byte] = self._number(tuple(readings), closed)
        return target

    def settled(self, state: int, ended: list[int], at: int) -> int:
        """The last place at which every reading of ``state`` has a token's end. ``at`` is the place after the bytes read, ended[i] the token that
        ends at i + 1. What lies before can be printed; the rest is the lookahead."""
        starts = {at - self.depth[node] for _, node in self.readings[state]}
        while len(starts) > 1:
            late = max(starts)
            starts.remove(late)
            starts.add(late - len(self.tokens[ended[late - 1]]))
        return starts.pop()

    def back(self, ended: list[int], at: int) -> list[int]:
        """The tokens up to a place where one ends."""
        out = []
        while at > 0:
            token = ended[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]

    def whole(self, state: int) -> int:
        """The token that all bytes so far are, if they are one: such a piece is that token, whatever the merges say."""
        last, node = self.readings[state][0]
        return self.ends[node] if last == START else NONE

    def stream(self, piece: Iterable[int], step: int = 1) -> Iterator[int]:
        """Tokens of one piece, printed when they are settled; every ``step`` bytes the machine looks whether some are."""
        state, ended = 0, []
        n = 0
        for byte in piece:
            following = self.arcs.get(state << 8 | byte)
            state = self.arc(state, byte) if following is None else following
            ended.append(self.closed[state])
            n += 1
            if n % step == 0 and (done := self.settled(state, ended, len(ended))) > 0:
                yield from self.back(ended, done)
                del ended[:done]
            if len(self.readings) >= MAX_STATES:
                now, closed = self.readings[state], self.closed[state]
                self.reset()
                state = self._number(now, closed)
        one = self.whole(state)
        yield from (one,) if one >= 0 else self.back(ended, len(ended))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) > LONG:
            return tuple(self.stream(piece, LONG))
        if len(self.readings) >= MAX_STATES:
            self.reset()
        arcs, closed = self.arcs, self.closed
        state, ended = 0, []
        for byte in piece:
            following = arcs.get(state << 8 | byte)
            state = self.arc(state, byte) if following is None else following
            ended.append(closed[state])
        one = self.whole(state)
        return (one,) if one >= 0 else tuple(self.back(ended, len(ended)))


class Pieces(dict):
    """Ids of pieces of text, remembered up to a bound."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode(piece.encode())
        if len(piece) <= MAX_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids
