"""Phrase collocation mining with counting quotient filters.

1. Texts are cut into pieces and words in tasks. A block of texts of one language becomes one row: its words with their counts, and the word
   sequence as numbers within the block.
2. Words that occur ``least`` times in their language get gapless ids; other words can be in no candidate. Each block gets the ids of its own words
   by a join, so no task and no broadcast holds a dictionary that grows with the corpus.
3. Each block counts its n-grams of word ids in quotient filters, one per shard of the permuted keys. Filters of a shard meet in one task and are
   merged in order. The number of shards grows with the words of a language; a shard holds about ``SHARD`` n-grams, whatever the n-grams are.
4. Parts, scores, containment and ranks are joins and aggregates over the n-grams that occur ``least`` times.

Defined results: a null or empty text has no words; a null language is ``und``; words are cut at blanks and tabs, so other white space is part of
them; repeated rows count each; an empty table gives no rows; extra columns are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from finstrata.llm.lean import lean
from finstrata.llm.numbering import numbered
from finstrata.llm.quotient_filter import Merger, Widths, build
from finstrata.llm.rows import sent
from finstrata.session import ship
from finstrata.sources.landing import drop, land, land_at, new_folder

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
SCALE = 2_000_000
COVERED = (100, 80)  # a phrase goes if 100 * f(longer) >= 80 * f(phrase)
TOP = 2000
BLOCK = 1 << 20  # words of a block
SHARD = 1 << 21  # n-grams of a shard, occurrences counted
SALTS = 16  # copies of the counts of single words, which are parts of many phrases

_AS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_CUT = b"."  # a word that no text can hold after translation


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words with a mark between pieces."""
    return text.translate(_AS).replace(b"\n", b" . ").split()


class _Block:
    """Texts of one language: numbers by first occurrence, 0 for the mark between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_CUT]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = words_of(text)
        words.append(_CUT)
        part = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
        self.parts.append(part)
        self.size += len(part)


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, lang, words, counts, ids (little-endian unsigned 32-bit numbers: 0 between pieces, i for words[i - 1])."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        open_: dict[str, _Block] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            b = open_.pop(lang)
            ids = np.concatenate(b.parts)
            counts = np.bincount(ids, minlength=len(b.numbers))[1:]
            words = pa.array(list(b.numbers)[1:], pa.binary()).cast(pa.string())
            made += 1
            row = [pa.array([f"{partition}-{made}"]), pa.array([lang]), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())]
            return pa.record_batch(row, names=["block", "lang", "words", "counts", "ids"])

        for batch in lean(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                if text.is_valid and len(text.as_buffer()):
                    open_.setdefault(lang, _Block()).add(text.as_buffer().to_pybytes())
                    if open_[lang].size >= block:
                        yield close(lang)
            while sum(b.size for b in open_.values()) >= 2 * block:  # many languages at once
                yield close(max(open_, key=lambda lang: open_[lang].size))
        for lang in list(open_):
            yield close(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "block string, lang string, words array<string>, counts array<bigint>, ids binary")


def pack(grams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ids side by side: the first half (rounded up) in the left number, the rest in the right one."""
    half = (len(grams) + 1) // 2
    sides = []
    for side in (grams[:half], grams[half:]):
        value = side[0].astype(np.uint64)
        for ids in side[1:]:
            value = value << np.uint64(bits) | ids.astype(np.uint64)
        sides.append(value)
    return sides[0], sides[1]


def unpack(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    half, mask = (n + 1) // 2, np.uint64((1 << bits) - 1)
    take = lambda value, many: [(value >> np.uint64(bits * (many - 1 - i)) & mask).astype(np.int64) for i in range(many)]
    return take(left, half) + take(right, n - half)


def widths(n: int, bits: int, words: int, shard: int) -> Widths:
    left = bits * ((n + 1) // 2)
    return Widths(left, bits * (n // 2), min(left, max(0, (words // shard).bit_length())))


def _filters(blocks: DataFrame, longest: int, shard: int) -> DataFrame:
    """lang, n, shard, bits, filter. ``blocks``: lang, ids, places and their ids (of words that count), and of the language: bits, total."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 1):
            lang, bits, total = (batch[c][0].as_py() for c in ("lang", "bits", "total"))
            local = np.frombuffer(batch["ids"][0].as_buffer(), "<u4")
            known = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
            found = batch["found"].flatten()
            known[found.field("place").to_numpy(zero_copy_only=False)] = found.field("id").to_numpy(zero_copy_only=False)
            ids = known[local]
            for n in range(2, longest + 1):
                whole = np.ones(max(len(ids) - n + 1, 0), bool)
                for k in range(n):
                    whole &= ids[k : k + len(whole)] > 0
                at = np.flatnonzero(whole)
                w = widths(n, bits, total, shard)
                rows = list(build(*pack([ids[at + k] for k in range(n)], bits), w))
                for a in range(0, len(rows), 256):
                    some = rows[a : a + 256]
                    columns = [[lang] * len(some), [n] * len(some), [s for s, _ in some], [bits] * len(some), [f for _, f in some]]
                    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "n", "shard", "bits", "filter"])

    return blocks.mapInArrow(count, "lang string, n int, shard bigint, bits int, filter binary")


def _merged(filters: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, w (word ids), f of all n-grams that occur ``least`` times. Rows of a shard come one after the other."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merger = None, Merger()

        def out() -> Iterator[pa.RecordBatch]:
            lang, n, _, bits = now
            left, right, counts = merger.items(least)
            flat = np.stack(unpack(left, right, n, bits), axis=1)
            for a in range(0, len(counts), 1 << 16):
                part = flat[a : a + (1 << 16)]
                w = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, n, dtype=np.int32)), pa.array(part.ravel()))
                yield pa.record_batch([pa.array([lang] * len(part)), w, pa.array(counts[a : a + len(part)])], names=["lang", "w", "f"])

        for batch in lean(batches, 64):
            keys = zip(*(batch[c].to_pylist() for c in ("lang", "n", "shard", "bits")))
            for key, data in zip(keys, batch["filter"]):
                if key != now:
                    if now is not None:
                        yield from out()
                    now, merger = key, Merger()
                merger.add(data.as_buffer().to_pybytes(), key[2])
        if now is not None:
            yield from out()

    key = ["lang", "n", "shard"]
    return filters.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(merge, "lang string, w array<bigint>, f bigint")


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed tables: languages (lang, total: words), words (lang, id, word, f) and grams (lang, w: ids, f), the last two of those that occur
    ``least`` times within a language."""
    spark = docs.sparkSession
    folder = new_folder(spark, "collocation-blocks")
    blocks = land_at(blocks_of(docs, block), folder)
    entries = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "e")).select(
        "block", "lang", (F.col("place") + 1).alias("place"), F.col("e.words").alias("word"), F.col("e.counts").alias("f")
    )
    counted = land(entries.groupBy("lang", "word").agg(F.sum("f").alias("f")), "collocation-counts")
    words = land(numbered(counted.filter(F.col("f") >= least), ["lang"], ["word"], "id").withColumn("id", F.col("id") + 1), "collocation-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("total"))
    highest = words.groupBy("lang").agg(F.max("id").alias("highest"))
    width = F.greatest(F.lit(1), F.ceil(F.log2(F.coalesce("highest", F.lit(0)) + 1)).cast("int")).alias("bits")
    langs = land(totals.join(highest, "lang", "left").select("lang", "total", width), "collocation-languages")
    ids = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("found"))
    known = blocks.select("block", "lang", "ids").join(ids, "block").join(sent(langs), "lang")
    shards = langs.select(F.sum((longest - 1) * (1 + F.col("total") / shard))).first()[0]
    parts = max(int(shards or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    grams = land(_merged(_filters(known.select("lang", "ids", "found", "bits", "total"), longest, shard), parts, least), "collocation-grams")
    drop(spark, folder)
    return langs, words, grams


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _parts(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Counts of all possible parts, those of single words in ``SALTS`` copies."""
    single = words.select("lang", F.array("id").alias("w"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return single.unionByName(grams.select("lang", "w", "f", F.lit(0).alias("salt")))


def score(words: DataFrame, grams: DataFrame) -> DataFrame:
    """lang, w, a, l, r, score of all grams: the lowest score of all cuts, ties to the shortest first part."""
    n = F.size("w")
    cuts = grams.select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    first, rest = F.slice("w", F.lit(1), F.col("k")), F.slice("w", F.col("k") + 1, n - F.col("k"))
    salt = F.pmod(F.xxhash64("w"), F.lit(SALTS)).cast("int")
    cuts = cuts.select("lang", "w", "a", "k", first.alias("first"), rest.alias("rest"), F.when(F.col("k") == 1, salt).otherwise(0).alias("s1"), F.when(F.col("k") == n - 1, salt).otherwise(0).alias("s2"))
    parts = _parts(words, grams)
    cuts = cuts.join(parts.select("lang", F.col("w").alias("first"), F.col("salt").alias("s1"), F.col("f").alias("l")), ["lang", "first", "s1"])
    cuts = cuts.join(parts.select("lang", F.col("w").alias("rest"), F.col("salt").alias("s2"), F.col("f").alias("r")), ["lang", "rest", "s2"])
    value = F.expr(f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = F.min(F.struct(value.cast("bigint").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "w", "a").agg(best).select("lang", "w", "a", "best.l", "best.r", "best.score")


def uncovered(scored: DataFrame, grams: DataFrame) -> DataFrame:
    """Without phrases that lie within a longer gram nearly as frequent."""
    n = F.size("w")
    spots = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("w", i, m))))
    inside = grams.filter(n > 2).select("lang", "f", F.explode(F.array_distinct(spots)).alias("w")).groupBy("lang", "w").agg(F.max("f").alias("longer"))
    left, right = COVERED
    covers = F.lit(left) * _exact(F.col("longer")) >= F.lit(right) * _exact(F.col("a"))
    return scored.join(inside, ["lang", "w"], "left").filter(~F.coalesce(covers, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    langs, words, grams = count_phrases(docs, least, longest, block, shard)
    kept = uncovered(score(words, grams), grams)
    order = [F.desc("score"), F.desc("a")]
    for group in (["lang", F.pmod(F.xxhash64("w"), F.lit(64))], ["lang"]):  # first within parts of a language; ties stay until phrases are known
        kept = kept.withColumn("_rank", F.rank().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rank") <= top).drop("_rank")
    kept = land(kept, "collocation-kept")
    spelled = kept.select("*", F.posexplode("w").alias("i", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    phrases = spelled.groupBy("lang", "w", "a", "l", "r", "score").agg(phrase)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase"))).cast("bigint").alias("rank")
    ranked = phrases.select("*", rank).filter(F.col("rank") <= top)
    return ranked.join(sent(langs), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k))
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE k > 1 AND f >= {LEAST}),
cuts AS (
  SELECT lang, size, phrase, a, c, array_to_string(list_slice(ws, 1, c), ' ') AS p1, array_to_string(list_slice(ws, c + 1, size), ' ') AS p2
  FROM (SELECT *, unnest(range(1, size)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST({SCALE}::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = p1 AND x.k = c JOIN grams y ON y.lang = cuts.lang AND y.phrase = p2 AND y.k = size - c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates WHERE size > 2))
  GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR {COVERED[0]} * longer::HUGEINT < {COVERED[1]} * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": ORACLE}
