"""Counting quotient filters: exact counters of packed numbers, stored in little more than the bits that cannot be known from their order.

A key is a pair of numbers (left, right) of x and y bits, 64 at most each, such as word ids of an n-gram packed side by side. ``scramble`` permutes
all keys of these widths one to one, which spreads them evenly over the left half. Sorted, a key is cut into its shard (the highest bits), the
quotient and the whole rest, the remainder. The filter keeps how many keys each quotient has (in unary), the remainders packed in bytes, and the
counts above one. Nothing is lost: quotient and remainder give the scrambled key and ``unscramble`` the key itself.

Filters of one shard from many places are merged in sorted order; the counts of equal keys add up.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from finstrata.llm.words import mix

ROUNDS = 4
_HEAD = struct.Struct("<qBBBBq")  # keys, x, y, shard bits, quotient bits, keys counted more than once
_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


@dataclass(frozen=True)
class Widths:
    """Bits of the left half, of the right half, and of the shard number within the left half."""

    left: int
    right: int
    shard: int = 0

    def __post_init__(self) -> None:
        if not (0 < self.left <= 64 and 0 < self.right <= 64 and 0 <= self.shard <= self.left):
            raise ValueError(f"impossible widths: {self}")


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _left(a: np.ndarray, by: int) -> np.ndarray:
    return a << np.uint64(by) if by < 64 else np.zeros_like(a)


def _right(a: np.ndarray, by: int) -> np.ndarray:
    return a >> np.uint64(by) if by < 64 else np.zeros_like(a)


def scramble(left: np.ndarray, right: np.ndarray, w: Widths) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network: each half in turn is changed by a function of the other, which can be undone."""
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left ^ mix(right + _SALTS[r])) & _mask(w.left)
        else:
            right = (right ^ mix(left + _SALTS[r])) & _mask(w.right)
    return left, right


def unscramble(left: np.ndarray, right: np.ndarray, w: Widths) -> tuple[np.ndarray, np.ndarray]:
    for r in reversed(range(ROUNDS)):
        if r % 2 == 0:
            left = (left ^ mix(right + _SALTS[r])) & _mask(w.left)
        else:
            right = (right ^ mix(left + _SALTS[r])) & _mask(w.right)
    return left, right


def tally(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, w: Widths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scrambled keys in order, with the sums of their counts (of ones, if none are given)."""
    if not len(left):
        return left, right, np.empty(0, np.int64)
    if w.left + w.right <= 64:  # one number holds the key
        key = _left(left, w.right) | right
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        left, right = _right(key[heads], w.right), key[heads] & _mask(w.right)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        left, right = left[heads], right[heads]
    if counts is None:
        return left, right, np.diff(np.append(heads, len(order) if w.left + w.right > 64 else len(key)))
    return left, right, np.add.reduceat(counts[order], heads)


def _quotient_bits(n: int, w: Widths) -> int:
    """About one quotient a key, fewer where that makes the remainder whole bytes."""
    bits = min(max(n, 1).bit_length(), w.left - w.shard)
    while bits > 0 and (w.left - w.shard - bits + w.right) % 8:
        bits -= 1
    return bits


def _rest_bytes(w: Widths, quotient: int) -> int:
    return -(-(w.left - w.shard - quotient + w.right) // 8)


def dump(left: np.ndarray, right: np.ndarray, counts: np.ndarray, w: Widths) -> bytes:
    """The filter of distinct, sorted, scrambled keys of one shard."""
    n = len(left)
    q = _quotient_bits(n, w)
    low = w.left - w.shard - q  # bits of the left half that belong to the remainder
    quotients = (_right(left, low) & _mask(q)).astype(np.int64)
    unary = np.zeros(n + (1 << q), np.uint8)  # for each quotient a one per key, then a zero
    unary[quotients + np.arange(n)] = 1
    size = _rest_bytes(w, q)
    rest = left & _mask(low)
    words = np.empty((n, 2), "<u8")
    words[:, 0] = _left(rest, w.right) | right
    words[:, 1] = _right(rest, 64 - w.right) if w.right else 0
    rests = words.view(np.uint8).reshape(n, 16)[:, :size].tobytes()
    many = counts > 1
    several = counts[many].astype("<i8")
    small = np.minimum(several, 255).astype(np.uint8)
    parts = [_HEAD.pack(n, w.left, w.right, w.shard, q, len(several)), np.packbits(unary).tobytes(), rests, np.packbits(many).tobytes(), small.tobytes(), several[small == 255].tobytes()]
    return b"".join(parts)


def load(data: bytes, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scrambled keys of a filter, in order, and their counts."""
    n, x, y, s, q, several = _HEAD.unpack_from(data)
    w = Widths(x, y, s)
    at = _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    bits = n + (1 << q)
    ones = np.flatnonzero(np.unpackbits(take(-(-bits // 8)), count=bits))
    quotients = (ones - np.arange(n)).astype(np.uint64)
    size = _rest_bytes(w, q)
    padded = np.zeros((n, 16), np.uint8)
    padded[:, :size] = take(n * size).reshape(n, size)
    words = padded.view("<u8")
    low = x - s - q
    rest = (_right(words[:, 0], y) | (_left(words[:, 1], 64 - y))) & _mask(low)
    right = words[:, 0] & _mask(y)
    left = _left(np.full(n, shard, np.uint64), x - s) | _left(quotients, low) | rest
    counts = np.ones(n, np.int64)
    many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    values = take(several).astype(np.int64)
    over = values == 255
    values[over] = take(8 * int(over.sum())).view("<i8")
    counts[many] = values
    return left, right, counts


def build(left: np.ndarray, right: np.ndarray, w: Widths) -> Iterator[tuple[int, bytes]]:
    """(shard, filter) of all keys, repeated as often as they occur; only shards that hold keys."""
    left, right, counts = tally(*scramble(left, right, w), None, w)
    if not len(left):
        return
    shards = _right(left, w.left - w.shard)
    heads = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    for a, b in zip(heads, np.append(heads[1:], len(left))):
        yield int(shards[a]), dump(left[a:b], right[a:b], counts[a:b], w)


class Merger:
    """Merges filters of one shard. What waits is merged when it is as large as what has been, so each key is sorted a few times only."""

    def __init__(self) -> None:
        self.done: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.widths: Widths | None = None

    def add(self, data: bytes, shard: int) -> None:
        _, x, y, s, _, _ = _HEAD.unpack_from(data)
        self.widths = self.widths or Widths(x, y, s)
        if self.widths != Widths(x, y, s):
            raise ValueError("filters of different widths")
        keys = load(data, shard)
        self.waiting.append(keys)
        self.size += len(keys[0])
        if self.size > max(1 << 18, len(self.done[0]) if self.done else 0):
            self._merge()

    def _merge(self) -> None:
        parts = [*([self.done] if self.done else []), *self.waiting]
        self.done = tally(*(np.concatenate(column) for column in zip(*parts)), self.widths)
        self.waiting, self.size = [], 0

    def items(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """left, right and count of all keys that were counted ``least`` times or more."""
        if self.waiting:
            self._merge()
        left, right, counts = self.done
        often = counts >= least
        return (*unscramble(left[often], right[often], self.widths), counts[often])


def merge(filters: Iterable[bytes], shard: int) -> Merger:
    merger = Merger()
    for data in filters:
        merger.add(data, shard)
    return merger
