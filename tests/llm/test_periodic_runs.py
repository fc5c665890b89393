"""Runs against a search of every period, planted texts against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from finstrata.llm import periodic_runs
from finstrata.llm.sync_sets import runs


def brute(words, shortest=24):
    """Every period in turn: maximal stretches, of the same stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, 3 * q):
                best.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(draw, n):
    words = list(draw.integers(0, draw.choice([2, 3, 8, 1000]), n))
    for _ in range(draw.integers(0, 4)):
        if n < 30:
            break
        a = int(draw.integers(0, n - 25))
        p = int(draw.integers(1, max(2, (n - a) // 3)))
        length = int(draw.integers(3 * p, n - a + 1)) if 3 * p <= n - a else n - a
        for i in range(a + p, min(a + length, n)):
            words[i] = words[i - p]
    return [f"w{w}" for w in words]


def test_many_texts_together():
    draw = np.random.default_rng(3)
    for _ in range(40):
        texts = [random_words(draw, int(draw.integers(0, 400))) for _ in range(8)]
        got = periodic_runs.runs_of([" ".join(t).encode() for t in texts], 24)
        for words, (found, kept) in zip(texts, got):
            assert found == brute(words), words
            assert kept.decode().split() == collapse(words, found)


@pytest.mark.parametrize("period", [7, 8, 15, 16, 17, 24, 25, 31, 32, 33, 47, 48, 49, 63, 64, 65, 96, 97, 127, 128, 129, 200])
def test_every_scale_at_its_edges(period):
    draw = np.random.default_rng(period)
    base = [f"x{i}" for i in draw.integers(0, 5, period)]
    for extra in (0, 1, period - 1):
        words = ["a", "b"] + (base * 4)[: max(24, 3 * period) + extra] + ["c"]
        assert periodic_runs.runs_of([" ".join(words).encode()], 24)[0][0] == brute(words)


def test_nested_and_small_periods_inside_long_ones():
    inner = ["a"] * 30 + ["b", "a"] * 20 + ["c"] * 5
    words = ["z"] + inner * 4 + ["y"] + (["p", "q", "r"] * 30 + ["s"]) * 5
    found, kept = periodic_runs.runs_of([" ".join(words).encode()], 24)[0]
    assert found == brute(words) and len({q for _, _, q in found}) > 3
    assert kept.decode().split() == collapse(words, found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=160))
def test_two_words(words):
    assert periodic_runs.runs_of([" ".join(words).encode()], 24)[0][0] == brute(words)


def test_long_text_is_quick():
    words = (["a", "b", "c"] * 200_000) + [f"w{i % 50_021}" for i in range(300_000)]
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    line = np.array([codes[w] for w in words] + [-1])
    start, length, period = runs(line, np.array([len(line)]))
    assert list(zip(start, length, period)) == [(0, 600_000, 3), (600_000, 300_000, 50_021)]
    with pytest.raises(ValueError):
        runs(line, np.array([len(line)]), shortest=10)


def plain(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def check(rows, got):
    assert len(rows) == len(got)
    for doc_id, text in rows:
        words, r = plain(doc_id, text), got[doc_id]
        found = brute(words)
        assert r["n_runs"] == len(found)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapse(words, found)).encode()).hexdigest()


def test_whole_table(spark, sf):
    rows = [(i, t) for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    short = [(i, t) for i, t in rows if len((t or "").split()) < 1500]  # brute force is quadratic
    assert len(got) == len(rows) and any(got[i]["n_runs"] for i, _ in short)
    check(short, {i: got[i] for i, _ in short})


def test_rows(spark, tmp_path):
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rows = [(i, " ".join(f"w{j}\t" for j in range(k * 17))) for k, i in enumerate(planted)] + [(5001, None), (5002, ""), (5003, " \n "), (5004, "a\x1cb " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, runs int, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()})
    twice = spark.createDataFrame([(None, "a b " * 20), (None, "a b " * 20)], "doc_id bigint, text string")
    assert [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(twice).collect()] == [(None, [(0, 40, 2)], "a b")] * 2
    assert periodic_runs.find_runs(twice.limit(0)).count() == 0
