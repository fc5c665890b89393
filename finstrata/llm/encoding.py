"""Token ids of Arrow text batches with a public byte-level tokenizer, many times faster than text by text.

The tokenizers library cuts a text into pieces by a fixed rule and encodes each piece alone. Here numpy cuts whole chunks of texts by that rule,
each distinct piece is encoded once by the library and kept in a table of bounded size, and the ids are put together from the table. Texts with
a character outside the Latin blocks, or the name of a special token, go to the library whole, so the Unicode version behind the rule never
matters. ``encode`` yields exactly what ``Tokenizer.encode(text, add_special_tokens=False)`` does.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from finstrata.llm.words import mix

CHARS = 1 << 20  # characters cut at a time
SLOTS = 1 << 20  # distinct pieces kept by a worker
WIDTH = 8  # ids of a kept piece at most
LONGEST = 64  # characters of a kept piece at most
_LATIN = 0x250
SPACE, LETTER, NUMBER, OTHER = range(4)


def _class_of(c: int) -> int:
    ch = chr(c)
    if ch.isspace() and c not in range(0x1C, 0x20):
        return SPACE
    kind = unicodedata.category(ch)[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


CLASSES = np.array([_class_of(c) for c in range(_LATIN)], np.uint8)
_CODES = mix(np.arange(1, _LATIN + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_ODD = 0xA0761D6478BD642F


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        step = np.full(n, base, np.uint64)
        step[0] = 1
        made.append(np.cumprod(step, dtype=np.uint64))
    return made[0], made[1]


def cut(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pieces begin. ``first`` are the places where texts begin.

    A run of letters, of digits or of other signs is a piece, together with one blank (0x20) before it. Of white space before a sign the last
    character stands alone unless it is such a blank; the rest is a piece. An apostrophe that begins a piece takes a following s, t, m, d, re, ve
    or ll along.
    """
    n = len(points)
    kind = CLASSES[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    text_start = begins.copy()
    text_start[n] = True
    begins[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space character before a sign, in the same text
    before_sign = np.flatnonzero(space[:-1] & ~space[1:] & ~text_start[1:n])
    begins[before_sign] = True
    blank = before_sign[points[before_sign] == 0x20]
    begins[blank + 1] = False
    # contractions
    quote = np.flatnonzero((points == 0x27) & begins[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two_at = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~text_start[quote + 2], points[two_at], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ~single & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[single], 2), (quote[double], 3)):
            begins[at + 1] = False
            begins[at + size] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """One per tokenizer file and Python worker; ``encoder_for`` keeps it between tasks."""

    def __init__(self, path: str, special_as_text: bool = False):
        """``special_as_text``: the names of special tokens in a text are ordinary text; else, as the library has it by default, they are those tokens."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t["content"] for t in model.get("added_tokens", [])]
        cutter = model.get("pre_tokenizer") or {}
        plain = model.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        self.by_pieces = bool(plain)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.keys = np.zeros(SLOTS, np.uint64)
        self.sizes = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, WIDTH), self.dtype)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null is empty."""
        batch: list[str] = []
        size = 0
        for at in range(0, len(column), 64):
            for text in column.slice(at, 64).to_pylist():
                text = text or ""
                if size and size + len(text) > CHARS:
                    yield from self._encode_some(batch)
                    batch, size = [], 0
                batch.append(text)
                size += len(text)
        yield from self._encode_some(batch)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_pieces:
            yield from map(self._whole, texts)
            return
        simple = [not any(s in t for s in self.special) for t in texts]
        parts: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            if simple[i]:
                for p in _segments(t):
                    parts.append(p)
                    owner.append(i)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate([[0], np.cumsum(lens)])
        odd = np.flatnonzero(points >= _LATIN)
        if len(odd):
            for k in set(np.searchsorted(first, odd, "right") - 1):
                simple[owner[k]] = False
            keep = [simple[i] for i in owner]
            parts, owner = [p for p, k in zip(parts, keep) if k], [i for i, k in zip(owner, keep) if k]
            points = points[np.repeat(np.array(keep, bool), lens)]
            lens = lens[np.array(keep, bool)]
            first = np.concatenate([[0], np.cumsum(lens)])
        flat, ends = self._pieces(points, first, lens)
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.array(owner, np.int64), np.diff(ends))
        at = 0
        for i, t in enumerate(texts):
            if simple[i]:
                yield flat[at : at + counts[i]]
                at += counts[i]
            else:
                yield self._whole(t)

    def _pieces(self, points: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and where each part's ids end (with a leading 0)."""
        if not len(points):
            return np.empty(0, self.dtype), np.zeros(len(lens) + 1, np.int64)
        starts = cut(points, first[:-1][lens > 0])
        ends = np.append(starts[1:], len(points))
        powers, inverses = _powers(1 << max(21, len(points).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_CODES[points] * powers[: len(points)], out=sums[1:])
        size = ends - starts
        key = mix((sums[ends] - sums[starts]) * inverses[starts]) | np.uint64(1)
        slot = (key >> np.uint64(44)).astype(np.int64)
        known = (self.keys[slot] == key) & (size <= LONGEST)
        rows, counts = self.ids[slot], self.sizes[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        long: dict[int, np.ndarray] = {}
        if len(missing):
            some, inverse = np.unique(key[missing], return_inverse=True)
            example = np.empty(len(some), np.int64)
            example[inverse] = missing
            short = size[example] <= LONGEST
            texts = [points[starts[p] : ends[p]].tobytes().decode("utf-32-le", "surrogatepass") for p in example[short]]
            made = self._encode_pieces(texts)
            got = np.zeros((len(some), WIDTH), self.dtype)
            n = np.zeros(len(some), np.int64)
            big: dict[int, np.ndarray] = {}
            for j, ids in zip(np.flatnonzero(short), made):
                n[j] = len(ids)
                if len(ids) <= WIDTH:
                    got[j, : len(ids)] = ids
                else:
                    big[j] = np.array(ids, self.dtype)
            fits = np.flatnonzero(short & (n <= WIDTH))
            to = (some[fits] >> np.uint64(44)).astype(np.int64)
            # of two new pieces for one slot the last stays, in all three arrays
            self.keys[to], self.sizes[to], self.ids[to] = some[fits], n[fits], got[fits]
            rows[missing], counts[missing] = got[inverse], n[inverse]
            for at in missing[np.isin(inverse, list(big))] if big else ():
                long[int(at)] = big[int(np.searchsorted(some, key[at]))]
            for at in missing[size[missing] > LONGEST]:
                long[int(at)] = self._whole(points[starts[at] : ends[at]].tobytes().decode("utf-32-le", "surrogatepass"))
                counts[at] = len(long[int(at)])
        total = np.concatenate([[0], np.cumsum(counts)])
        if long:
            flat = np.empty(total[-1], self.dtype)
            usual = counts <= WIDTH
            usual[list(long)] = False
            target = np.ones(total[-1], bool)
            for at, ids in long.items():
                flat[total[at] : total[at + 1]] = ids
                target[total[at] : total[at + 1]] = False
            flat[target] = rows[usual][np.arange(WIDTH) < counts[usual][:, None]]
        else:
            flat = rows[np.arange(WIDTH) < counts[:, None]]
        return flat, total[np.searchsorted(starts, first)]

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Each piece alone: the library encodes a list of given pieces in one call and says which piece every id is from."""
        out: list[list[int]] = [[] for _ in pieces]
        for at in range(0, len(pieces), 20_000):
            e = self.tokenizer.encode(pieces[at : at + 20_000], is_pretokenized=True, add_special_tokens=False)
            for k, i in zip(e.word_ids, e.ids):
                out[at + k].append(i)
        return out


def _segments(text: str) -> Iterator[str]:
    """A long text in parts that begin with a blank between a sign and a letter, where a piece begins whatever comes before."""
    at = 0
    while len(text) - at > CHARS:
        to = at + CHARS
        while True:
            to = text.find(" ", to)
            if to < 0 or to + 1 >= len(text):
                to = len(text)
                break
            if not text[to - 1].isspace() and text[to + 1].isascii() and text[to + 1].isalpha():
                break
            to += 1
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


@lru_cache(4)
def encoder_for(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text)
