"""Decontamination against a search of every window in every text."""

import hashlib
import random
import re

import pytest

from finstrata.llm import decontaminate as d

DOCS = "doc_id bigint, text string, n_chars bigint, item_id int, tie string, hits int"
ITEMS = "item_id bigint, text string, doc_id int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    wanted = {}
    for i, text in items:
        w = words(text)
        for at in range(max(len(w) - window + 1, 1) if w else 0):
            wanted.setdefault(tuple(w[at : at + window]), set()).add("null" if i is None else str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for at in range(len(w)):
            for n in sizes:
                found = wanted.get(tuple(w[at : at + n])) if at + n <= len(w) else None
                if found:
                    hit.update(range(at, at + n))
                    names |= found
        out.append((repr(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return sorted(out)


def shape(df):
    from pyspark.sql import functions as F

    return sorted((repr(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect())


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in d.op8_decontamination(spark, sf).collect())
    assert got == brute(docs, items)
    assert any(x[2] for x in got)


@pytest.mark.parametrize("block", [1, 40, 200_000])
def test_random_words_and_edges(spark, block):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.choice([2, 3, 7, 9, 10, 11, 14]))) for i in range(12)] + [(50, None), (51, ""), (None, "zz"), (3, "a b"), (60, "é-É x9")]
    docs = [(i, some(rng.randrange(60))) for i in range(60)] + [(7, "zz"), (7, "zz"), (None, "A, b! zz"), (100, None), (101, "é É X9 zz"), (102, "b " * 30_000)]
    frame = spark.createDataFrame([(*r, 5, 1, "clash", 2) for r in docs], DOCS)
    assert shape(d.find(frame, spark.createDataFrame([(*r, 1) for r in items], ITEMS), block_words=block)) == brute(docs, items)


def test_cleaned_texts_have_no_window_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = d.clean(docs, items)
    assert out.columns == docs.columns
    before = {r.doc_id: r.n_hit / max(r.n_words, 1) for r in d.find(docs, items).collect()}
    kept = {r.doc_id: r for r in out.collect()}
    assert set(kept) == {i for i, share in before.items() if share <= 0.5}
    assert all(r.n_hit == 0 for r in d.find(out, items).collect())
    for r in docs.collect():
        if not before[r.doc_id]:
            assert kept[r.doc_id] == r
        elif r.doc_id in kept:
            assert kept[r.doc_id].n_chars == len(kept[r.doc_id].text) < len(r.text)


def test_a_cut_that_joins_a_new_window(spark):
    item = " ".join(f"w{i}" for i in range(10))
    inner = "w0 w1 w2 w3 w4 " + item + " w5 w6 w7 w8 w9 " + "filler " * 40
    out = d.clean(spark.createDataFrame([(1, inner)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert words(out[0].text) == ["filler"] * 40


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 3, 1, "t", 2)], DOCS), spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.n_hit) for r in d.find(docs, items).collect()] == [(2, 0)]
    assert d.clean(docs, items).collect() == docs.collect()
    assert d.find(docs.limit(0), spark.createDataFrame([(1, "a", 1)], ITEMS)).count() == 0


def test_many_blocks_clean_as_one(spark):
    run = lambda c, n=10: " ".join(f"{c}{i}" for i in range(n))
    items = spark.createDataFrame([(1, run("a")), (2, run("b")), (3, run("c"))], "item_id bigint, text string")
    rows = [
        (1, run("a") + " x " + run("b") + " y " + run("z", 10)),  # 20 of 32 words, 10 by each block
        (2, run("a", 5) + " " + run("b") + " a5 a6 a7 a8 a9 " + run("z", 40)),  # a cut by block 2 joins a window of block 1
        (None, run("c") + " " + run("z", 30)), (None, run("c") + " " + run("z", 30)), (3, run("z", 20)), (4, None), (5, run("c")),
    ]
    docs = spark.createDataFrame([(i, t, len(t or ""), 1, "clash", 2) for i, t in rows], DOCS)
    one, many = [sorted(map(repr, d.clean(docs, items, block_words=n).collect())) for n in (200_000, 10)]
    assert many == one and len(one) == 5
    assert all(r.n_hit == 0 for r in d.find(d.clean(docs, items, block_words=10), items).collect())
