"""A modified Kneser-Ney model of word pairs over all documents, counted, asked and answered in sorted arrays: no row per pair, no join on a word.

Words that make up 2^-16 of the corpus or more have a number each (at most 2^16 of them, whatever the corpus); all rarer ones share the number ``RARE``,
since how they are spelled is the character model's concern. A pair is a word's number after that of the word before it (``START`` for the first).
Everything about single numbers is bounded and may be collected; the pairs, up to 2^32, grow with the corpus and stay in Spark.

Texts are numbered once and kept as pieces of ``PIECE`` words. A piece asks: one row for each bucket with its different pairs, sorted, and how often it has
them. A bucket adds up what all pieces have and answers each piece in the order it was asked. A piece then scores its texts.

A text is scored by the counts of the whole corpus, its own among them. That makes every text a little likelier than it is: by little in a large
corpus, since numbered words occur often; in a small one by as much as texts are short. Taking a text's own counts off was tried: it made copies, which
see each other's pairs, stand apart from single texts, and clean copies fell out of the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from finstrata.llm.kneser_ney import discounts
from finstrata.llm.lean import lean
from finstrata.llm.words import BLANK_CUT_CASED, chunks, mix, words_of
from finstrata.session import ship
from finstrata.sources.landing import land

SHARE = 2.0**-16  # of all words: so common a word has a number of its own
RARE = 0
START = 1
BITS = 17  # of a number: 2^16 words, RARE and START
PIECE = 2_000_000  # words of a piece, and different words held by a counting task
BUCKET = 8_000_000  # words of the corpus for each bucket
_LOW = np.uint64((1 << BITS) - 1)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: what is always 0 takes no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has some of the sorted keys, with their places in order."""
    bucket = mix(keys) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    some, at = np.unique(bucket[order], return_index=True)
    yield from zip(some.tolist(), np.split(order, at[1:]))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of each hash; small for common words
    n_words: int  # in the corpus

    def __len__(self) -> int:
        return START + 1 + len(self.hashes)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), RARE, np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], RARE).astype(np.uint32)


def vocabulary(docs: DataFrame, share: float = SHARE) -> Vocabulary:
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        got = [(b, pack(np.diff(keys[i], prepend=np.uint64(0))), pack(counts[i]), int(counts[i].sum())) for b, i in _dealt(keys, n)]
        types = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), types)], names=["bucket", "words", "counts", "n_words"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in lean(batches):
            for _, texts in chunks(batch["text"]):
                more = np.unique(words_of(texts, BLANK_CUT_CASED).hashes, return_counts=True)
                keys, counts = _added(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))
                if len(keys) > PIECE:
                    yield rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield rows(keys, counts)

    def unite(part: pa.Table) -> pa.Table:
        """The bucket's words that are common enough."""
        keys, counts = _added(
            np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in part["words"].to_pylist()]), np.concatenate([unpack(x) for x in part["counts"].to_pylist()]).astype(np.int64)
        )
        some = counts >= share * total
        return pa.table([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["word", "c"])

    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, "bucket int, words binary, counts binary, n_words bigint")
    dealt = land(dealt, "word-counts")  # their sum decides what is common
    total = dealt.agg(F.sum("n_words")).first()[0] or 0
    common = dealt.groupBy("bucket").applyInArrow(unite, "word bigint, c bigint").toArrow()  # at most 1 / share rows
    hashes, counts = common["word"].to_numpy().view(np.uint64), common["c"].to_numpy()
    rank = np.empty(len(hashes), np.uint32)
    rank[np.lexsort((hashes, -counts))] = np.arange(START + 1, START + 1 + len(hashes))
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], rank[order], total)


def piece_of(dids: np.ndarray, tids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[int, bytes]:
    """(name, payload): the name depends on the rows alone, so that it is the same when a task runs again."""
    name = (mix(mix(dids.view(np.uint64)) + tids.view(np.uint64)) * mix(np.arange(1, len(dids) + 1, dtype=np.uint64))).sum(dtype=np.uint64)
    parts = [pack(x) for x in (dids.view(np.uint64), tids.view(np.uint64), sizes, numbers)]
    return int(name.view(np.int64)), b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _opened(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        size = int.from_bytes(payload[at : at + 8], "little")
        out.append(unpack(payload[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _pairs(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair of every word, text of every word)"""
    earlier = np.concatenate([[np.uint64(START)], numbers[:-1]])[: len(numbers)]
    places = np.cumsum(sizes.astype(np.int64)) - sizes.astype(np.int64)
    earlier[places[sizes > 0]] = START
    return earlier << np.uint64(BITS) | numbers, np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))


def buckets(docs: DataFrame, known: Vocabulary) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known.n_words // BUCKET + 1)


def answers(pieces: DataFrame, n: int) -> DataFrame:
    """From piece, payload: for every piece and bucket the corpus's counts of the pairs it asked for, and for every bucket (piece null) its figures:
    the number of pairs seen once to four times; for each number the pairs it begins (once, twice, more often, occurrences) and those it ends."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches, 1):
            _, _, sizes, numbers = _opened(batch["payload"][0].as_py())
            keys, counts = np.unique(_pairs(sizes, numbers)[0], return_counts=True)
            got = [(b, batch["piece"][0].as_py(), pack(np.diff(keys[i], prepend=np.uint64(0))), pack(counts[i])) for b, i in _dealt(keys, n)]
            if got:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "piece", "pairs", "counts"])

    def answer(part: pa.Table) -> pa.Table:
        asked = [np.cumsum(unpack(x), dtype=np.uint64) for x in part["pairs"].to_pylist()]
        had = [unpack(x).astype(np.int64) for x in part["counts"].to_pylist()]
        keys, totals = _added(np.concatenate(asked), np.concatenate(had))
        back = [pack(totals[np.searchsorted(keys, x)]) for x in asked]
        first, last = keys >> np.uint64(BITS), keys & _LOW
        begins, at = np.unique(first, return_inverse=True)
        held = [np.bincount(at, w, len(begins)) for w in (totals == 1, totals == 2, totals > 2, totals)]
        ends, of = np.unique(last, return_counts=True)
        times = [int((totals == k).sum()) for k in range(1, 5)]
        bucket = part["bucket"][0].as_py()
        none = [None] * len(back)
        return pa.table({
            "bucket": pa.array([bucket] * (len(back) + 1), pa.int32()), "piece": pa.array([*part["piece"].to_pylist(), None], pa.int64()), "totals": pa.array([*back, None], pa.binary()),
            "times": pa.array([*none, times], pa.list_(pa.int64())), "begins": pa.array([*none, [pack(x) for x in (begins, *held)]], pa.list_(pa.binary())), "ends": pa.array([*none, [pack(ends), pack(of)]], pa.list_(pa.binary())),
        })

    asked = pieces.mapInArrow(ask, "bucket int, piece bigint, pairs binary, counts binary")
    return land(asked.groupBy("bucket").applyInArrow(answer, "bucket int, piece bigint, totals binary, times array<bigint>, begins array<binary>, ends array<binary>"), "pair-answers")


@dataclass
class Pairs:
    """What is known of each number; the pairs themselves come with the answers."""

    cut: np.ndarray  # discount of a pair seen 0, 1, 2, more often
    total: np.ndarray  # occurrences as the word before
    back_off: np.ndarray  # share of them taken by the discounts
    p: np.ndarray  # probability of the number whatever comes before


def fit(answered: DataFrame, size: int) -> Pairs:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "once", "twice", "more", "total", "ends"]
        for batch in lean(batches, 1):
            begins, ends = [[unpack(x).astype(np.int64) for x in batch[c][0].as_py()] for c in ("begins", "ends")]
            yield pa.record_batch([*map(pa.array, begins), pa.array(np.zeros(len(begins[0]), np.int64))], names=names)
            zero = pa.array(np.zeros(len(ends[0]), np.int64))
            yield pa.record_batch([pa.array(ends[0]), zero, zero, zero, zero, pa.array(ends[1])], names=names)

    figures = answered.where("piece is null")
    times = figures.agg(*[F.sum(F.col("times")[k]) for k in range(4)]).first()
    sums = ["once", "twice", "more", "total", "ends"]
    table = figures.select("begins", "ends").mapInArrow(spread, "number bigint, once bigint, twice bigint, more bigint, total bigint, ends bigint")
    rows = table.groupBy("number").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()  # one for each number
    once, twice, more, total, ends = np.zeros((5, size))
    for to, name in zip((once, twice, more, total, ends), sums):
        to[rows["number"].to_numpy()] = rows[name].to_numpy()
    d = discounts([t or 0 for t in times])
    e = np.array([0.0, *discounts([int((ends == k).sum()) for k in range(1, 5)])])[np.minimum(ends, 3).astype(int)]
    p = (ends - e + e.sum() / size) / max(ends.sum(), 1)
    return Pairs(np.array([0.0, *d]), total, (d[0] * once + d[1] * twice + d[2] * more) / np.maximum(total, 1), p)


def scores(pieces: DataFrame, answered: DataFrame, model: Pairs, n: int) -> DataFrame:
    """_did, _tid (names of the row), word_log_p: the sum of log probabilities of the numbers of the text's words, each after the one before it."""
    sent = pieces.sparkSession.sparkContext.broadcast(model)

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        m, out = sent.value, []
        totals_of = dict(zip(got["bucket"].to_pylist(), got["totals"].to_pylist()))
        for payload in own["payload"].to_pylist():
            dids, tids, sizes, numbers = _opened(payload)
            pair, text = _pairs(sizes, numbers)
            keys, at = np.unique(pair, return_inverse=True)
            totals = np.zeros(len(keys), np.int64)
            for b, i in _dealt(keys, n):
                totals[i] = unpack(totals_of[b])
            first, last = (keys >> np.uint64(BITS)).astype(np.int64), (keys & _LOW).astype(np.int64)
            log_p = np.log(m.back_off[first] * m.p[last] + (totals - m.cut[np.minimum(totals, 3)]) / np.maximum(m.total[first], 1))
            out.append([dids.view(np.int64), tids.view(np.int64), np.round(np.bincount(text, log_p[at], len(sizes)), 6)])
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 3
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["_did", "_tid", "word_log_p"])

    sums = pieces.groupBy("piece").cogroup(answered.where("piece is not null").select("piece", "bucket", "totals").groupBy("piece")).applyInArrow(score, "_did bigint, _tid bigint, word_log_p double")
    return sums.groupBy("_did", "_tid").agg(F.max("word_log_p").alias("word_log_p"))
