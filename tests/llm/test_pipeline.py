"""Each stage of the pipeline on its own input, against brute force."""

import re

import corpus_pipeline as p
from finstrata.llm import quality, secrets
from finstrata.sources.landing import land

from test_decontaminate import brute as brute_hits
from test_ngram_join import brute as brute_links
from test_packing_and_counts import check_packing


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def masked(text):
    spans = []
    for rule in secrets.RULES + secrets.MORE:
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.value)) >= rule.least:
                spans.append(m.span())
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], secrets.MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    before = rows_of(docs)

    kept = land(stages["quality_rules"](spark, docs, sf), "t")
    verdict = {r.doc_id: r.kept for r in quality.op5_quality(spark, sf).collect()}
    after = rows_of(kept)
    assert kept.columns == docs.columns and after == {i: r for i, r in before.items() if verdict[i]}

    unique = land(stages["near_duplicates"](spark, kept, sf), "t")
    groups = {c for _, n, c in brute_links([(r.doc_id, r.text) for r in after.values()])}
    single = rows_of(unique)
    assert unique.columns == docs.columns and single == {i: r for i, r in after.items() if i in groups}

    clean = land(stages["decontamination"](spark, unique, sf), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {int(i): (n, h) for i, n, h, *_ in brute_hits([(r.doc_id, r.text) for r in single.values()], items)}
    rest = rows_of(clean)
    assert clean.columns == docs.columns and set(rest) == {i for i, (n, h) in hits.items() if h <= 0.5 * n}
    assert all(h == 0 for _, _, h, *_ in brute_hits([(r.doc_id, r.text) for r in rest.values()], items))
    assert all(rest[i] == single[i] for i in rest if not hits[i][1])

    safe = land(stages["secret_scan"](spark, clean, sf), "t")
    final = rows_of(safe)
    assert safe.columns == docs.columns and {i: r.text for i, r in final.items()} == {i: masked(r.text) for i, r in rest.items()}
    assert all(r.n_chars == (len(r.text) if r.text != rest[i].text else rest[i].n_chars) for i, r in final.items())

    packed = stages["packing"](spark, safe, sf).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in final.values()], 2048)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, p.run(spark, sf).collect())) == sorted(map(key, packed))


def test_empty_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = land(stage(spark, docs, sf), "t")
    assert docs.count() == 0
