"""A modified Kneser-Ney model of character n-grams within words: counted and smoothed by Spark, kept in sorted arrays.

Characters fold to 64 symbols (6 bits): a-z and A-Z (accents dropped), digits, groups of signs, word start and word end; letters of other scripts are
hashed to a-z. An n-gram of order 4 is thus a number below 2^24, which bounds the model whatever the corpus: at most 2^24 + 2^18 + 2^12 + 2^6
probabilities and as many back-off weights less the first, 200 MB; a few MB in practice. That is why it may be collected and broadcast.
Words never reach the driver: tasks count the n-grams of the words they read, Spark adds the counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from finstrata.llm.lean import lean
from finstrata.llm.words import BLANK_CUT_CASED, Words, chunks, words_of
from finstrata.session import ship
from finstrata.sources.landing import land

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
START, END, DIGIT, OTHER = 60, 61, 52, 59
_SIGNS = {c: 53 + i for i, group in enumerate([".,", ";:", "!?", "'\"’“”«»()[]{}", "-_/\\@", "#*$%&|<>+=^~`"]) for c in group}
_KNOWN = 0x250


def _symbol(c: int) -> int:
    ch = chr(c)
    base = unicodedata.normalize("NFKD", ch)[:1]
    if base.isascii() and base.isalpha():
        return ord(base) - 97 if base.islower() else 26 + ord(base) - 65
    return DIGIT if base.isdigit() else _SIGNS.get(ch, _SIGNS.get(base, OTHER)) if not ch.isalpha() else c * 7 % 26


_TABLE = np.array([_symbol(c) for c in range(_KNOWN)], np.uint32)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all words one after another, number of n-grams of each word): one per character and one for the end."""
    points = np.frombuffer(b" ".join(words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    symbols = np.where(points < _KNOWN, _TABLE[np.minimum(points, _KNOWN - 1)], points * np.uint32(7) % np.uint32(26))
    blanks = np.append(np.flatnonzero(points == 0x20), len(points))
    symbols = np.append(symbols, 0).astype(np.uint32)
    symbols[blanks] = END
    first = np.concatenate([[0], blanks[:-1] + 1])
    sizes = blanks - first + 1
    place = np.arange(len(symbols)) - np.repeat(first, sizes)
    code = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(symbols), START, np.uint32)
        earlier[back:] = symbols[:-back]
        code |= np.where(place >= back, earlier, np.uint32(START)) << np.uint32(BITS * back)
    return code, sizes


def distinct_words(w: Words) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The chunk's distinct words, which of them every word is, and how often each occurs."""
    _, first, inverse, counts = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    return [w.data[s:e] for s, e in zip(w.starts[first], w.ends[first])], inverse, counts


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes.astype(np.int64), prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count(docs: DataFrame) -> DataFrame:
    """gram, c over every word of every text."""
    ship(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in lean(batches):
            for _, texts in chunks(batch["text"]):
                w = words_of(texts, BLANK_CUT_CASED)
                if len(w.starts):
                    words, _, times = distinct_words(w)
                    grams, sizes = grams_of(words)
                    more = _added(grams, np.repeat(times, sizes))
                    codes, counts = _added(np.concatenate([codes, more[0]]), np.concatenate([counts, more[1]]))
        yield pa.record_batch([pa.array(codes.astype(np.int32)), pa.array(counts)], names=["gram", "c"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, "gram int, c bigint")
    return rows.groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen once to four times; 0.75 where they are not defined."""
    if min(n) == 0:
        return [0.75] * 3
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]


@dataclass
class Model:
    """For each order from 1 on: sorted n-grams with log probabilities, sorted contexts with log back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def log_p(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each n-gram after the others."""
        if order == 0:
            return np.full(len(codes), -np.log(SYMBOLS))
        codes = codes & np.uint32((1 << BITS * order) - 1)
        out, seen = _look_up(self.grams[order - 1], codes)
        if not seen.all():
            rest = codes[~seen]
            weight, _ = _look_up(self.contexts[order - 1], rest >> np.uint32(BITS))
            out[~seen] = weight + self.log_p(rest, order - 1)
        return out


def _look_up(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    if not len(keys):
        return np.zeros(len(codes)), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    seen = keys[at] == codes
    return np.where(seen, values[at], 0.0), seen


def fit(docs: DataFrame) -> Model:
    """Counts of the highest order as they are; of each lower order, the number of symbols seen before the n-gram."""
    spark = docs.sparkSession
    counted = {ORDER: land(count(docs), "gram-counts")}
    for n in range(ORDER - 1, 0, -1):
        counted[n] = counted[n + 1].groupBy((F.col("gram") % (1 << BITS * n)).alias("gram")).agg(F.count("*").alias("c"))
    lower = spark.createDataFrame([(0, 1.0 / SYMBOLS)], "gram int, p double")
    grams, contexts = [], []
    for n in range(1, ORDER + 1):
        table = counted[n]
        times = {r["c"]: r["n"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts([times.get(k, 0) for k in range(1, 5)])
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", BITS).alias("context")
        weights = table.groupBy(context).agg(F.sum("c").alias("total"), F.sum(discount).alias("taken")).withColumn("back_off", F.col("taken") / F.col("total"))
        shorter = lower.select(F.col("gram").alias("shorter"), F.col("p").alias("p_shorter"))
        p = (F.col("c") - discount) / F.col("total") + F.col("back_off") * F.col("p_shorter")
        made = table.withColumns({"context": context, "shorter": F.col("gram") % (1 << BITS * (n - 1))}).join(weights, "context").join(shorter, "shorter")
        lower = land(made.select("gram", p.alias("p")), "gram-model")
        for frame, key, value, to in ((lower, "gram", "p", grams), (weights, "context", "back_off", contexts)):
            rows = frame.select(key, F.log(value).cast("float").alias("v")).toArrow()  # at most 2^24 rows
            keys, values = rows[key].to_numpy().astype(np.uint32), rows["v"].to_numpy()
            order = np.argsort(keys)
            to.append((keys[order], values[order]))
    return Model(grams, contexts)


def quantiles(scored: DataFrame, group: str, value: str, shares: list[float], bins: int = 1000) -> DataFrame:
    """Per group, values below which these shares of the rows lie, to 1 / ``bins``: from a histogram, so no group is ever gathered or sorted whole."""
    binned = scored.where(F.col(value).isNotNull()).groupBy(group, F.floor(F.col(value) * bins).alias("bin")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row per bin
    steps = binned.withColumns({"seen": F.sum("n").over(up_to), "all": F.sum("n").over(Window.partitionBy(group))})
    return steps.groupBy(group).agg(*[F.min(F.when(F.col("seen") >= s * F.col("all"), F.col("bin") / bins)).alias(f"q{i}") for i, s in enumerate(shares)])
