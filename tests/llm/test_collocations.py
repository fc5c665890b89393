"""Filters against dictionaries, phrases against plain Python counting."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from finstrata.llm import collocations as C, quotient_filter as Q


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 64), st.integers(1, 64), st.integers(0, 6), st.integers(0, 2**32 - 1), st.integers(0, 300))
def test_filters_lose_nothing(x, y, s, seed, n):
    w = Q.Widths(x, y, min(s, x))
    draw = np.random.default_rng(seed)
    pool = [(int(draw.integers(0, 1 << 63)) * 2 + 1) % (1 << x) for _ in range(20)], [(int(draw.integers(0, 1 << 63)) * 2 + 1) % (1 << y) for _ in range(20)]
    keys = [(pool[0][i], pool[1][j]) for i, j in draw.integers(0, 20, (n, 2))] + [((1 << x) - 1, 0)] * int(draw.integers(0, 600))
    sides = [np.array(side, np.uint64) for side in zip(*keys)] if keys else [np.empty(0, np.uint64)] * 2
    back = Q.unscramble(*Q.scramble(*sides, w), w)
    assert all((a == b).all() for a, b in zip(back, sides))
    got: Counter = Counter()
    filters = dict(Q.build(*sides, w))
    half = len(keys) // 2
    pieces = [dict(Q.build(*(side[a:b] for side in sides), w)) for a, b in ((0, half), (half, len(keys)))]
    assert set(filters) == set(pieces[0]) | set(pieces[1])
    for shard, data in filters.items():
        left, right, counts = Q.merge([data], shard).items()
        got.update({(int(a), int(b)): int(c) for a, b, c in zip(left, right, counts)})
        again = Q.merge([p[shard] for p in pieces if shard in p], shard).items()
        assert all((a == b).all() for a, b in zip(again, (left, right, counts)))
    assert got == Counter(keys)


def test_filter_is_compact():
    draw = np.random.default_rng(2)
    left, right = draw.integers(0, 1 << 17, (2, 100_000)).astype(np.uint64)
    size = sum(len(data) for _, data in Q.build(left, right, Q.Widths(17, 17, 4)))
    assert size < 100_000 * 34 / 8 * 0.8
    with pytest.raises(ValueError):
        Q.merge([Q.dump(left[:1], right[:1], np.ones(1, int), Q.Widths(17, 17)), Q.dump(left[:1], right[:1], np.ones(1, int), Q.Widths(18, 17))], 0)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_packing(bits, n):
    draw = np.random.default_rng(bits)
    grams = [draw.integers(0, 1 << bits, 50) for _ in range(n)]
    assert all((a == b).all() for a, b in zip(C.unpack(*C.pack(grams, bits), n, bits), grams))


def plain(rows, top, least, longest=4):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            longer = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, totals[lang], -s)
    return out


def got(df):
    rows = df.collect()
    out = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "mine", 1.5) for i, (l, t) in enumerate(rows)], "doc_id bigint, text string, lang string, word string, w double")


@pytest.mark.parametrize("block,shard", [(C.BLOCK, C.SHARD), (60, 40)])
def test_against_plain_counting(spark, block, shard):
    draw = np.random.default_rng(block)
    words = ["a", "B", "cc", "dé", "日本", "e\x1f", "f-g", "in", "the", "of"]
    rows = [(None, None), (None, ""), ("en", " \t\n,")]
    for i in range(120):
        text = "".join(words[int(j)] + draw.choice([" ", " ", "\t ", ", ", ".\n", " The End of "]) for j in np.minimum(draw.geometric(0.25, int(draw.integers(0, 60))) - 1, 9))
        rows.append((draw.choice(["en", "und", "", None]), text))
    rows += [("de", "immer wieder und wieder das selbe! " * 500)] * 2
    rows = [(None if l is None else str(l), t) for l, t in rows]
    docs = frame(spark, rows).repartition(3)
    assert got(C.collocations(docs, 25, 5, block=block, shard=shard)) == plain(rows, 25, 5)
    assert got(C.collocations(docs, 7, 12, block=block, shard=shard)) == plain(rows, 7, 12)


def test_nothing_to_find(spark):
    assert got(C.collocations(frame(spark, [("en", "one two three")]))) == {}
    assert got(C.collocations(frame(spark, [("en", None)]).limit(0))) == {}


def test_whole_table(spark, sf):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(C.op11_collocations(spark, sf)) == plain(rows, 2000, 30)
