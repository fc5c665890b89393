"""Packing against its invariants and a bound; token counts against plain encoding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from finstrata.llm import cutting_stock, separator_scan
from finstrata.sources.landing import land, new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, sequence_id string, file int"
EDGE = [(5, "a # b"), (5, "a # b"), (None, "x"), (2, None), (3, ""), (9, "word " * 30_000), (-4, "日本"), (6, "<|endoftext|>")]


def check_packing(rows, docs, capacity):
    t = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, parts in by_doc.items():
        copies = len(ids[doc_id])
        whole = ids[doc_id][0]
        starts = sorted(p.start for p in parts)
        assert starts == sorted(list(range(0, len(whole), capacity)) * copies)
        for p in parts:
            assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    total = sum(len(x) for v in ids.values() for x in v)
    return total, len(by_seq)


def test_packing_table(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    total, n = check_packing(cutting_stock.op3_packing(spark, sf).collect(), docs, 2048)
    assert n * 2048 < total * 1.02


def test_packing_edges(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in EDGE], SCHEMA)
    pieces = land(cutting_stock.pieces_of(docs, PATH, 1, 64, keep_ids=True), "pieces")
    packed = land(cutting_stock.pack(pieces, 64), "packed")
    check_packing(packed.collect(), EDGE, 64)
    seqs = {r.sequence_id: r.ids for r in cutting_stock.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert cutting_stock.pack(land(cutting_stock.pieces_of(spark.createDataFrame([], SCHEMA), PATH, 1), "pieces")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_covers_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    classes = cutting_stock.sizes(2048)
    histogram = {int(w): int(n) for w, n in zip(classes, rng.integers(0, 500, len(classes))) if n}
    made = cutting_stock.plan(histogram)
    covered = defaultdict(int)
    for held, n in made:
        assert sum(w * k for w, k in held.items()) <= 2048
        for w, k in held.items():
            covered[w] += n * k
    assert dict(covered) == histogram
    assert sum(n for _, n in made) * 2048 < sum(w * n for w, n in histogram.items()) * 1.02


def test_size_classes():
    assert cutting_stock.sizes(2048)[-1] == 2048 and cutting_stock.sizes(10) == list(range(1, 11))
    assert all(b - a <= max(1, b / 16) for a, b in zip(cutting_stock.sizes(2048), cutting_stock.sizes(2048)[1:]))


def expected_counts(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return sorted((repr(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)


def test_counts_table(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = separator_scan.op9_token_counts(spark, sf).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == expected_counts(docs)


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_counts_across_blocks(spark, block):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in EDGE[:5] + EDGE[6:]], SCHEMA).coalesce(1)
    folder = new_folder(spark, "flat")
    names = separator_scan.write_flat(docs, folder, PATH, 50256)
    counts = separator_scan.scan(names.groupBy("file").agg({"width": "max"}).toDF("file", "width"), folder, 50256, block)
    got = names.join(counts, ["file", "ordinal"]).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == expected_counts(EDGE[:5] + EDGE[6:])


def test_unterminated_document(spark, tmp_path):
    np.array([7, 8, 9, 50256, 50256, 4, 5], "<u2").tofile(tmp_path / "f.bin")
    files = spark.createDataFrame([("f", 2)], "file string, width int")
    for block in (1, 3, 4, 100):
        got = sorted(tuple(r)[1:] for r in separator_scan.scan(files, str(tmp_path), 50256, block).collect())
        assert got == [(0, 0, 3, True), (1, 4, 0, True), (2, 5, 2, False)]


@pytest.mark.parametrize("shape", ["short", "halves", "mixed"])
def test_plan_of_skewed_histograms(shape):
    draw = np.random.default_rng(9)
    classes = np.array(cutting_stock.sizes(2048))[:-1]
    share = {"short": 1.0 / classes**1.5, "halves": np.where(classes > 900, 1.0, 1e-3), "mixed": np.where((classes < 40) | (classes > 1000), 1.0, 0.01)}[shape]
    demand = draw.multinomial(1_500, share / share.sum())
    histogram = {int(w): int(n) for w, n in zip(classes, demand) if n}
    plan = cutting_stock.plan(histogram)
    for w, n in histogram.items():
        assert sum(held.get(w, 0) * k for held, k in plan) >= n
    assert all(sum(w * k for w, k in held.items()) <= 2048 and k > 0 for held, k in plan)
    left = sorted((w for w, n in histogram.items() for _ in range(n)), reverse=True)
    rooms: list[int] = []
    for w in left:  # first fit decreasing
        at = next((i for i, r in enumerate(rooms) if r >= w), None)
        if at is None:
            rooms.append(2048 - w)
        else:
            rooms[at] -= w
    assert sum(k for _, k in plan) <= len(rooms) * 1.02 + len(histogram) / 8
