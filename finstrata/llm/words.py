"""Words of Arrow text batches as numpy arrays: places, 64-bit hashes, and rows of words per document.

Words are cut at bytes: every separator is ASCII, so no UTF-8 sequence is ever split. Hashes depend on the lower-cased (A-Z) bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes hashed at a time
CHUNK = 1 << 20  # bytes of text handled at a time, or one text
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SEGMENT + 1024)
        for base, name in ((_ODD, "_powers"), (_INVERSE, "_inverses")):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            globals()[name] = np.cumprod(step, dtype=np.uint64)
    return _powers, _inverses


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte counts as."""

    inside: np.ndarray
    code: np.ndarray

    @classmethod
    def without(cls, separators: bytes, lower: bool = True) -> Alphabet:
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        as_ = np.arange(256)
        if lower:
            as_[65:91] += 32
        return cls(inside, _BYTE_CODES[as_])


#: `[^\x20\x09-\x0D]+`
BLANK_CUT = Alphabet.without(b"\x20\x09\x0a\x0b\x0c\x0d")
#: the same with case kept
BLANK_CUT_CASED = Alphabet.without(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: capitals are lowered first, so they are inside
LETTERS_DIGITS = Alphabet.without(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Words:
    data: bytes  # the chunk's texts, a blank after each
    starts: np.ndarray  # byte places of the words
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # words of text i: rows[i] to rows[i + 1]
    texts: np.ndarray  # byte places of text i: texts[i] to texts[i + 1] - 1


def hash_words(data: bytes, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    inside = alphabet.inside[buf]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + SEGMENT, "right")), first + 1)
        part = buf[base : ends[last - 1]]
        powers, inverses = _powers_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(alphabet.code[part] * powers[: len(part)], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * inverses[s]
        first = last
    return starts, ends, mix(out)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first row, texts as bytes) of so many rows that ``most`` bytes are not passed, one at least; a null is empty."""
    held: list[bytes] = []
    first, size = 0, 0
    for at in range(0, len(column), 64):
        for value in column.slice(at, 64).cast(pa.large_binary()).to_pylist():
            value = value or b""
            if size and size + len(value) > most:
                yield first, held
                first, held, size = first + len(held), [], 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield first, held


def words_of(texts: list[bytes], alphabet: Alphabet) -> Words:
    data = b" ".join([*texts, b""])
    places = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=places[1:])
    starts, ends, hashes = hash_words(data, alphabet)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, places), places)


_SHINGLE = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 33)], np.uint64)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words; none if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _SHINGLE[k]
    return mix(out)
