"""Near duplicates against a comparison of all pairs."""

import random
from collections import Counter

import pytest

from finstrata.llm import ngram_join as j
from finstrata.llm.components import components

SCHEMA = "doc_id bigint, text string, label int, sig string, n_chars int"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, len(sets[x]), least.get(root(x))) for x, (i, _) in enumerate(rows)]


def check(df, rows):
    got = df.selectExpr(f"if(_did = {j.NO_ID}, null, _did)", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(5, 60))] + passage * (i % 3 == 0))) for i in range(150)]
    for family, size in ((0, 60), (1, 25), (2, 5), (3, 2)):  # near copies, many of which link only through others
        base = [word() for _ in range(120)]
        rows += [(1000 * (family + 1) + i, edited(rng, base, rng.randrange(0, 5))) for i in range(size)]
    tail = [word() for _ in range(200)]  # same prefix and size, far or near
    rows += [(9000 + i, " ".join(tail) + f" end{i}") for i in range(40)]
    return rows


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "one two three four five"), (7, "one two three four five"), (7, "something else altogether is in here now"), (None, "ONE two three four five"), (None, "x y z"), (8, "é É é É é"), (9, "spam " * 20_000), (10, "spam " * 30)]


def test_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, j.op2_ngram_join(spark, sf).collect())) == Counter(brute(rows))


@pytest.mark.parametrize("rare,block", [(16, 512), (2, 4), (1, 1)])
def test_families_passages_and_edges(spark, monkeypatch, rare, block):
    monkeypatch.setattr(j, "RARE", rare)
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus() + EDGE
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    check(j.near_duplicates(docs), rows)


def test_shuffled_joins_where_broadcasts_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(j, "sent", lambda rows: rows)
    rows = corpus()[100:220] + EDGE
    check(j.near_duplicates(spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)), rows)


def test_one_row_of_each_component_stays(spark):
    rows = corpus() + [(i and i + 50_000, t) for i, t in EDGE]
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    wordless = sum(1 for r in EDGE if not shingles(r[1]))
    found = Counter(i for i, n, _ in brute([(r.doc_id, r.text) for r in kept.collect()]) if n)
    parts = brute(rows)
    assert sum(found.values()) == len({(c if c is not None else "null") for _, n, c in parts if n}) + 1  # one id has two texts in two components with one id
    assert kept.count() == sum(found.values()) + wordless
    assert j.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()))
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1100), 1000), 1999: 1999, 2000: 1999}
