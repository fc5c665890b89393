"""Runs in a sequence of numbers by string synchronising sets.

At scale t = 2^k a place is selected if, of the windows of t numbers that start in the t + 1 places from it on, the least hash stands first or
last. The choice depends on the next 2t numbers only, so equal surroundings give equal choices; and of every t neighbouring places one is selected,
except where the surroundings have a period of t/3 at most. Such windows get no hash: their runs are known from smaller scales.

A run of period q between 2t and 4t, three periods long at least, holds a selected place i such that i + q is the next selected place with the same
context of 3t (for q up to 3t) or 4t numbers: no nearer place can have it, or the run would have a smaller period. So neighbours of equal context
propose all periods. Chains of proposals are stretched to both sides by comparing window hashes of falling length. Periods under ``SMALL``, for which
there is no such scale, are found by comparing the sequence with itself, shifted.

Hashes have 64 bits. Every run is compared number by number before it is returned, so no collision can add one; one is missed only if two different
windows of a sequence agree in 64 bits.
"""

from __future__ import annotations

import numpy as np

from finstrata.llm.words import mix

SMALL = 8  # periods below are found directly: twice the smallest scale
LEAST = 3  # periods in a run
_DOUBLE, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _shifted(a: np.ndarray, by: int, fill: np.uint64) -> np.ndarray:
    out = np.full(len(a), fill, np.uint64)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


class _Windows:
    """Hashes of all windows of 2^k numbers. Places whose window would pass the end get hashes that equal no other."""

    def __init__(self, codes: np.ndarray):
        self.levels = [mix(codes.astype(np.uint64) + np.uint64(1))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix(last * _DOUBLE + _shifted(last, half, np.uint64(0))))
        return self.levels[k]

    def pick(self, keep: np.ndarray) -> None:
        self.levels = [h[keep] for h in self.levels]

    def forward(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """How many numbers from a and b > a on are the same. Ends inside the sequence: the last number is unique."""
        n = np.zeros(len(a), np.int64)
        size = len(self.levels[0])
        top = self.level(k)
        while True:
            same = (b + n < size) & (top[a + n] == top[np.minimum(b + n, size - 1)])
            if not same.any():
                break
            n[same] += 1 << k
        for j in range(k - 1, -1, -1):
            h = self.levels[j]
            n[(b + n < size) & (h[a + n] == h[np.minimum(b + n, size - 1)])] += 1 << j
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """How many numbers before a and b > a are the same."""
        n = np.zeros(len(a), np.int64)

        def same(j: int) -> np.ndarray:
            at = a - n - (1 << j)
            h = self.levels[j]
            return (at >= 0) & (h[np.maximum(at, 0)] == h[np.maximum(b - n - (1 << j), 0)])

        self.level(k)
        while (more := same(k)).any():
            n[more] += 1 << k
        for j in range(k - 1, -1, -1):
            n[same(j)] += 1 << j
        return n


def _selected(hashes: np.ndarray, k: int, periodic: np.ndarray) -> np.ndarray:
    none = np.uint64(2**64 - 1)
    own = np.where(periodic, none, hashes)
    least = own
    for j in range(k):
        least = np.minimum(least, _shifted(least, 1 << j, none))
    last = _shifted(own, 1 << k, none)
    least = np.minimum(least, last)
    return np.flatnonzero((least != none) & ((least == own) | (least == last)))


def _proposals(context: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring places of equal context, ``low`` to ``high`` apart."""
    hashes = context[places]
    order = np.argsort(hashes, kind="stable")
    first, second = places[order[:-1]], places[order[1:]]
    gap = second - first
    fits = (hashes[order[:-1]] == hashes[order[1:]]) & (gap >= low) & (gap <= high)
    return first[fits], gap[fits]


def _chains(first: np.ndarray, gap: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place of proposals of one period that overlap by a period and so belong to one run."""
    order = np.lexsort((first, gap))
    first, gap = first[order], gap[order]
    new = np.ones(len(first), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (np.diff(first) > reach)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(first))[: len(heads)] - 1
    return first[heads], first[tails], gap[heads]


def runs(codes: np.ndarray, ends: np.ndarray, shortest: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of all runs of at least max(``shortest``, 3 * period) numbers, by start, then period. ``shortest`` is at least 24.

    ``codes`` holds sequences one after the other, each closed by a number that occurs nowhere else; sequence i ends before place ends[i].
    """
    if shortest < LEAST * SMALL:
        raise ValueError(f"shortest must be at least {LEAST * SMALL}")
    lengths = np.diff(ends, prepend=0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(1, SMALL):
        start, end = _stretches(codes[:-q] == codes[q:]) if len(codes) > q else (np.empty(0, np.int64),) * 2
        long = end - start >= (LEAST - 1) * q
        found.append((start[long], (end - start)[long] + q, np.full(int(long.sum()), q)))
    known = _smallest(*map(np.concatenate, zip(*found)))
    windows = _Windows(codes)
    place = np.arange(len(codes))
    size = np.repeat(lengths, lengths)
    k = SMALL.bit_length() - 2
    while True:
        t = 1 << k
        stay = size >= 2 * LEAST * t
        if not stay.any():
            break
        if stay.mean() < 0.7:
            windows.level(k)
            windows.pick(stay)
            place, size = place[stay], size[stay]
        n = len(place)
        mine, doubled, fourfold = windows.level(k), windows.level(k + 1), windows.level(k + 2)
        places = _selected(mine, k, _periodic(known, place, t))
        thrice = mix(doubled * _CONTEXT + _shifted(mine, 2 * t, np.uint64(0)))
        for context, reach, low in ((thrice, 3 * t, 2 * t), (fourfold, 4 * t, 3 * t + 1)):
            head, gap = _proposals(context, places, low, reach)
            head, tail, gap = _chains(head, gap, reach)
            start = head - windows.backward(head, head + gap, k + 2)
            end = np.minimum(tail + gap + windows.forward(tail, tail + gap, k + 2), n)
            long = end - start >= LEAST * gap
            known = _smallest(*(np.concatenate(both) for both in zip(known, (place[start[long]], (end - start)[long], gap[long]))))
        k += 1
    start, length, period = known
    keep = length >= np.maximum(shortest, LEAST * period)
    start, length, period = start[keep], length[keep], period[keep]
    true = np.array([np.array_equal(codes[s : s + n - q], codes[s + q : s + n]) for s, n, q in zip(start, length, period)], bool)
    start, length, period = start[true], length[true], period[true]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _smallest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the same stretch the smallest period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def _periodic(known: tuple[np.ndarray, np.ndarray, np.ndarray], place: np.ndarray, t: int) -> np.ndarray:
    """Places whose window of t numbers has a period of t/3 at most."""
    start, length, period = known
    inside = (LEAST * period <= t) & (length >= t)
    # places are kept by whole sequences, so a run's places are all there or none is
    first = np.searchsorted(place, start[inside])
    there = (first < len(place)) & (place[np.minimum(first, len(place) - 1)] == start[inside])
    first = first[there]
    steps = np.zeros(len(place) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + (length[inside][there] - t + 1), -1)
    return np.cumsum(steps[:-1]) > 0
