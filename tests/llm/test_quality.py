"""Quality counts against plain Python; the smoothed model against a direct computation; bands that keep ordinary text."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from finstrata.llm import kneser_ney, quality, word_model
from finstrata.llm.rows import NO_ID
from finstrata.sources.landing import land

SCHEMA = "doc_id bigint, lang string, text string, kept int, gram string"


def counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def expect(rows, got):
    assert sorted((repr(r.doc_id), *[r[c] for c in quality.COUNTS]) for r in got) == sorted((repr(i), *counts(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept)


def test_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expect(rows, quality.op5_quality(spark, sf).collect())


def test_edges(spark):
    rows = [(1, None), (1, None), (None, "a b c a b c"), (2, ""), (3, " \n \n"), (4, "x\nx\n y\nx"), (5, "é " * 40_000), (6, "a\x0bb\x0cc\x85d a b"), (7, "#*|<>\n\n|\n|"), (8, "日本 語 " * 30)]
    docs = spark.createDataFrame([(i, None if i == 4 else "en", t, 1, "clash") for i, t in rows], SCHEMA)
    expect(rows, quality.judge(docs).withColumn("doc_id", F.when(F.col("_did") != NO_ID, F.col("_did"))).collect())
    assert quality.filter_documents(docs).columns == docs.columns and quality.filter_documents(docs.drop("lang")).count() == 0
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_text_is_kept_and_noise_goes(spark, sf):
    got = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in got if r.quality == 1]
    assert len(clean) > 50 and all(clean)
    rng = np.random.default_rng(1)
    plain = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    noise = spark.createDataFrame([(-i - 1, "en", " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(200))) for i in range(3)], "doc_id bigint, lang string, text string")
    assert not any(r.kept for r in quality.judge(plain.unionByName(noise)).where("_did < 0").collect())


def test_model_is_modified_kneser_ney(spark):
    texts = ["banana bandana cabana", "Nab a banana 99 times!", "café naïve 日本", "anna nana ban"] * 3 + ["ab abc abcd bcd"]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    grams = Counter()
    for t in texts:
        for code in kneser_ney.grams_of(t.encode().split())[0]:
            grams[tuple(int(code) >> 6 * k & 63 for k in (3, 2, 1, 0))] += 1
    table = {4: grams}
    for n in (3, 2, 1):
        table[n] = Counter(g[1:] for g in table[n + 1])

    def p(g):
        if not g:
            return 1 / 64
        c = table[len(g)]
        times = Counter(c.values())
        n = [times[k] for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) else 0
        d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)] if min(n) else [0.75] * 3
        same = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        cut = lambda v: d[min(v, 3) - 1]
        mine = same.get(g, 0)
        return (max(mine - cut(mine), 0) if mine else 0) / sum(same.values()) + sum(map(cut, same.values())) / sum(same.values()) * p(g[1:])

    unseen = [(60, 60, 60, 25), (0, 1, 2, 61), (13, 0, 13, 13), (7, 8, 9, 10), (60, 1, 0, 3)]
    for g in [*list(grams)[::3], *unseen]:
        code = np.array([g[0] << 18 | g[1] << 12 | g[2] << 6 | g[3]], np.uint32)
        assert math.isclose(math.exp(model.log_p(code)[0]), p(g), rel_tol=1e-4)
    context = np.array([60 << 18 | 60 << 12 | 1 << 6 | s for s in range(64)], np.uint32)
    assert math.isclose(np.exp(model.log_p(context)).sum(), 1, rel_tol=1e-4)


def word_scores(docs, known, n):
    model = kneser_ney.fit(docs)
    measured = land(quality.measure(docs, model, known), "t")
    pieces = measured.where("piece is not null").select("piece", "payload")
    answered = word_model.answers(pieces, n)
    return {(r._did, r._tid): r.word_log_p for r in word_model.scores(pieces, answered, word_model.fit(answered, len(known)), n).collect()}, pieces.count()


def direct_scores(texts, share):
    """Every text's sum of log probabilities, the numbers computed one by one from the definition."""
    times = Counter(w for t in texts for w in t)
    common = {w for w, c in times.items() if c >= share * sum(times.values())}
    coded = [[w if w in common else "" for w in t] for t in texts]
    pairs = Counter(p for t in coded for p in zip([None, *t], t))
    size = len(common) + 2  # with the rare words and the start
    cut = lambda c: dict(zip((0, 1, 2, 3), (0.0, *kneser_ney.discounts([Counter(c.values())[k] for k in range(1, 5)]))))
    ends = Counter(w for _, w in pairs)
    d1, d2 = cut(ends), cut(pairs)
    spared = sum(d1[min(c, 3)] for c in ends.values())
    p1 = {w: (ends[w] - d1[min(ends[w], 3)] + spared / size) / len(pairs) for w in ends}
    total, taken = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        taken[a] += d2[min(c, 3)]
    out = []
    for t in coded:
        sum_ = 0.0
        for a, w in zip([None, *t], t):
            sum_ += math.log((pairs[a, w] - d2[min(pairs[a, w], 3)] + taken[a] * p1[w]) / total[a])
        out.append(sum_)
    return out, size


def test_word_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = "the cat sat on the mat and the dog lay by the door".split()
    lists = [line, line, sorted(line), ["the"] * 90, ["once"], [], line[:1], *[[f"w{int(k)}" for k in rng.zipf(1.5, 60)] for _ in range(40)]]
    docs = spark.createDataFrame([(None if i == 2 else i, "en", " ".join(t), 1, "") for i, t in enumerate(lists)] + [(99, "en", None, 1, "")], SCHEMA).repartition(3, "doc_id")
    for share, n in ((0.0, 3), (0.01, 1), (0.5, 7)):
        known = word_model.vocabulary(docs, share)
        want, size = direct_scores(lists, share)
        assert len(known) == size and known.n_words == sum(map(len, lists))
        got, n_pieces = word_scores(docs, known, n)
        by_id = {did: v for (did, _), v in got.items()}
        assert all(math.isclose(by_id[NO_ID if i == 2 else i], w, rel_tol=1e-5, abs_tol=1e-5) for i, w in enumerate(want)) and by_id[99] == 0 and len(by_id) == len(lists) + 1
    assert by_id[0] == by_id[1]
    full = word_model.vocabulary(docs, 0.0)
    one = word_scores(docs, full, 2)[0]
    monkeypatch.setattr(word_model, "PIECE", 100)  # the same however the texts are cut into pieces, and in however many buckets
    many, n_pieces = word_scores(docs.repartition(2), full, 5)
    assert n_pieces >= 2 and many.keys() == one.keys() and all(math.isclose(many[k], one[k], abs_tol=2e-6) for k in one)
    empty = docs.limit(0)
    none = word_model.vocabulary(empty)
    assert len(none) == 2 and word_scores(empty, none, 2) == ({}, 0)


def test_word_order_counts(spark):
    line = "the cat sat on the mat and the dog lay by the door".split()
    texts = [line] * 4 + [sorted(line, key=lambda x: (len(x), x[::-1]))] * 2  # repeated rows, two of them without an id
    docs = spark.createDataFrame([(None if i > 3 else i, "en", " ".join(t), 1, "") for i, t in enumerate(texts)], SCHEMA)
    got, _ = word_scores(docs, word_model.vocabulary(docs), 3)
    want, _ = direct_scores(texts, word_model.SHARE)
    assert len(got) == 5 and abs(want[0] - want[4]) > 1
    assert all(math.isclose(v, want[4 if did == NO_ID else 0], rel_tol=1e-5) for (did, _), v in got.items())


def test_packed_numbers():
    rng = np.random.default_rng(5)
    for a in (np.empty(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)):
        assert (word_model.unpack(word_model.pack(a)) == a).all()


def test_bands_against_numpy(spark, sf):
    """``kept`` again, from the scores alone: quartiles of the texts that pass the base rules, to a thousandth, by language."""
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    judged = got[~got.base_failed]
    for _, g in judged.groupby("_lang"):
        inside = np.ones(len(g), bool)
        for c, low in (("char_log_perplexity", quality.LOW), ("log_perplexity", quality.WORD_LOW)):
            q0, q1, q2 = [sorted(np.floor(g[c] * 1000) / 1000)[math.ceil(s * len(g)) - 1] for s in (0.25, 0.5, 0.75)]
            inside &= g[c].between(q1 - max(low * (q2 - q0), quality.FLOOR), q1 + max(quality.HIGH * (q2 - q0), quality.FLOOR)).to_numpy()
        assert (inside == g.kept.to_numpy()).all()


def test_most_labelled_junk_goes(spark, sf):
    larger = os.path.join(os.path.dirname(sf), "sf0.1")  # the small tables have too few labels
    got = quality.op5_quality(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("not base_failed").collect()
    junk, clean = [[r.kept for r in got if r.quality == k] for k in (0, 1)]
    assert len(junk) > 200 and sum(junk) <= 0.1 * len(junk) and sum(clean) >= 0.99 * len(clean)
