"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. The automaton holds every run of words of every
item. A text's words stream through it, and it tracks the longest item run that ends at each word: where that reaches ``window`` words, or a
whole shorter item, those words are hit. Stretches in which no two neighbours are neighbours in any item are skipped in numpy beforehand;
they could not take the automaton past one word.

The automaton of one block of items is broadcast; a block has at most ``BLOCK_WORDS`` words (or one item), about 60 MB. Larger benchmarks are several
blocks, each a pass over the texts, whose hits are united.

Defined results: a null text has no words; an item without words matches nothing; a null item_id is named ``null``; repeated texts are judged
each; with an empty benchmark nothing is hit; ``clean`` keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.lean import lean
from finstrata.llm.rows import NO_ID, keyed, sent
from finstrata.llm.words import LETTERS_DIGITS, Words, chunks, words_of
from finstrata.session import ship
from finstrata.sources.landing import land

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000
CUT = b"\n"


@dataclass
class Automaton:
    """States are numbers; ``moves`` maps state << 32 | word to a state."""

    window: int = WINDOW
    moves: dict[int, int] = field(default_factory=dict)
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    out: list[list[int]] = field(default_factory=lambda: [[]])  # words that leave a state, while building

    def add(self, words: list[int]) -> None:
        at = 0
        for w in words:
            at = self._extend(at, w)

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        made = len(self.length) - 1
        if like is not None:
            for w in self.out[like]:
                self._move(made, w, self.moves[like << 32 | w])
        return made

    def _move(self, state: int, w: int, to: int) -> None:
        if (state << 32 | w) not in self.moves:
            self.out[state].append(w)
        self.moves[state << 32 | w] = to

    def _split(self, state: int, w: int, to: int) -> int:
        """The state of exactly the runs that end in ``state`` followed by ``w``: ``to``, or the part of it that is short enough."""
        if self.length[state] + 1 == self.length[to]:
            return to
        part = self._new(self.length[state] + 1, self.link[to], like=to)
        self.link[to] = part
        while state >= 0 and self.moves.get(state << 32 | w) == to:
            self.moves[state << 32 | w] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, w: int) -> int:
        known = self.moves.get(last << 32 | w)
        if known is not None:  # an earlier item has this run
            return self._split(last, w, known)
        made = self._new(self.length[last] + 1, 0)
        state = last
        while state >= 0 and (state << 32 | w) not in self.moves:
            self._move(state, w, made)
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, w, self.moves[state << 32 | w])
        return made

    def close(self, items: list[tuple[str, list[int]]]) -> None:
        """Which items hold each window, and which short item each whole run is."""
        top = [0] * len(self.length)  # the shortest-suffix state that still has ``window`` words
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            top[s] = top[self.link[s]] if self.length[self.link[s]] >= self.window else s
        self.top = top
        self.holders: dict[int, set[str]] = {}
        self.whole: dict[tuple[int, int], set[str]] = {}
        pairs = set()
        for name, words in items:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.moves[state << 32 | w]
                if n >= self.window:
                    self.holders.setdefault(top[state], set()).add(name)
            if 0 < len(words) < self.window:
                self.whole.setdefault((state, len(words)), set()).add(name)
            pairs.update(zip(words, words[1:]))
        self.short = sorted({n for _, n in self.whole})
        self.least = min([*self.short, self.window])
        self.out = []
        return pairs

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit runs (first word, past the last), items, and the longest match."""
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        state = matched = longest = 0
        for i, w in enumerate(words):
            to = self.moves.get(state << 32 | w)
            while to is None and state:
                state = self.link[state]
                matched = self.length[state]
                to = self.moves.get(state << 32 | w)
            if to is None:
                continue
            state, matched = to, matched + 1
            longest = max(longest, matched)
            if matched >= self.window:
                hits.append((i - self.window + 1, i + 1))
                names |= self.holders[self.top[state]]
            for n in self.short:
                if n > matched:
                    break
                at = state
                while self.length[self.link[at]] >= n:
                    at = self.link[at]
                found = self.whole.get((at, n))
                if found:
                    hits.append((i - n + 1, i + 1))
                    names |= found
        return hits, names, longest


@dataclass
class Index:
    """One block of items, ready to meet texts."""

    vocabulary: np.ndarray  # sorted word hashes
    pairs: np.ndarray  # sorted codes of neighbouring words
    automaton: Automaton

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]], window: int) -> Index:
        vocabulary = np.unique(np.concatenate([h for _, h in items]))
        numbered = [(name, np.searchsorted(vocabulary, h).tolist()) for name, h in items]
        automaton = Automaton(window)
        for _, words in numbered:
            automaton.add(words)
        pairs = automaton.close(numbered)
        return cls(vocabulary, np.array(sorted(a * len(vocabulary) + b for a, b in pairs), np.int64), automaton)

    def matches(self, w: Words) -> Iterator[tuple[int, list[tuple[int, int]], set[str], int]]:
        """(text, hit runs of its words, items, longest match) for the texts that have any."""
        if not len(w.hashes):
            return
        ids = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == w.hashes
        text = np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
        tied = known[:-1] & known[1:] & (text[:-1] == text[1:])
        if len(self.pairs):
            some = np.flatnonzero(tied)
            codes = ids[some].astype(np.int64) * len(self.vocabulary) + ids[some + 1]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            tied[some[self.pairs[at] != codes]] = False
        else:
            tied[:] = False
        # runs of words tied to the next
        edges = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
        first, past = edges[::2], edges[1::2] + 1
        if self.automaton.least == 1:  # single words count as well
            lone = np.flatnonzero(known & ~np.concatenate([tied, [False]]) & ~np.concatenate([[False], tied]))
            first, past = np.concatenate([first, lone]), np.concatenate([past, lone + 1])
            order = np.argsort(first)
            first, past = first[order], past[order]
        enough = past - first >= self.automaton.least
        state: dict[int, tuple] = {}
        for a, b in zip(first[enough].tolist(), past[enough].tolist()):
            hits, names, longest = self.automaton.stream(ids[a:b].tolist())
            if hits:
                t = int(text[a])
                old = state.get(t, ([], set(), 0))
                base = a - int(w.rows[t])
                state[t] = (old[0] + [(x + base, y + base) for x, y in hits], old[1] | names, max(old[2], longest))
        for t, (hits, names, longest) in state.items():
            yield t, united(hits), names, longest


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def indexes(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """One index per block of items. Items stream through the driver; it holds one block at a time."""
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for name, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string")).toLocalIterator():
        hashes = words_of([(text or "").encode()], LETTERS_DIGITS).hashes
        if not len(hashes):
            continue
        if block and size + len(hashes) > block_words:
            yield Index.of(block, window)
            block, size = [], 0
        block.append((name, hashes))
        size += len(hashes)
    if block:
        yield Index.of(block, window)


def _find(docs: DataFrame, block: Broadcast | None) -> DataFrame:
    ship(docs.sparkSession)
    hit = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            n = batch.num_rows
            words, longest, hits, names = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for first, texts in chunks(batch["text"]):
                w = words_of(texts, LETTERS_DIGITS)
                words[first : first + len(texts)] = np.diff(w.rows)
                for t, runs, found, most in block.value.matches(w) if block else ():
                    hits[first + t] = [{"first": a, "past": b} for a, b in runs]
                    names[first + t], longest[first + t] = sorted(found), most
            columns = [batch["doc_id"], batch["tie"], pa.array(words), pa.array(longest), pa.array(hits, hit), pa.array(names, pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["doc_id", "tie", "n_words", "longest", "hits", "items"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(match, "doc_id bigint, tie bigint, n_words bigint, longest bigint, hits array<struct<first:bigint,past:bigint>>, items array<string>")


def _covered(hits: Column) -> Column:
    """Words in sorted runs that may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(h["past"] - F.greatest(h["first"], a["reach"]), F.lit(0))).alias("n"), F.greatest(a["reach"], h["past"]).alias("reach"))
    return F.aggregate(hits, zero, step, lambda a: a["n"])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, longest, hits (runs of word numbers), items (sorted names) for every row of ``docs``."""
    passes = [_find(docs, docs.sparkSession.sparkContext.broadcast(i)) for i in indexes(items, window, block_words)] or [_find(docs, None)]
    found = passes[0]
    if len(passes) > 1:
        # equal rows have equal hits: they are united as one and dealt out again
        every = reduce(DataFrame.unionAll, passes).groupBy("doc_id", "tie").agg(
            F.first("n_words").alias("n_words"), F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / len(passes)).cast("int").alias("copies"),
        )
        found = every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), "longest", "hits", "items")


def _without(text: bytes, w: Words, t: int, runs: list[tuple[int, int]]) -> bytes:
    """Text ``t`` of ``w`` with these runs of its words cut out."""
    at, out = int(w.texts[t]), []
    for a, b in runs:
        out.append(w.data[at : w.starts[w.rows[t] + a]])
        at = int(w.ends[w.rows[t] + b - 1])
    return CUT.join([*out, w.data[at : w.texts[t] + len(text)]])


def _replaced(batch: pa.RecordBatch, new: dict[int, bytes | None]) -> pa.RecordBatch:
    """The batch with new texts in these rows, without the rows whose new text is None."""
    keep = np.ones(batch.num_rows, bool)
    keep[[i for i, x in new.items() if x is None]] = False
    has_length = "n_chars" in batch.schema.names
    texts = batch["text"].to_pylist()
    lengths = batch["n_chars"].to_pylist() if has_length else None
    for i, x in new.items():
        if x is not None:
            texts[i] = x.decode("utf-8", "replace")
            if lengths:
                lengths[i] = len(texts[i])
    columns = {"text": texts} | ({"n_chars": lengths} if has_length else {})
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else batch[f.name] for f in batch.schema]
    return pa.record_batch(arrays, names=batch.schema.names).filter(pa.array(keep))


def _clean(docs: DataFrame, block: Broadcast, max_coverage: float) -> DataFrame:
    """One block: each text is cut until nothing is hit, where it is read."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            new: dict[int, bytes | None] = {}
            for first, texts in chunks(batch["text"]):
                w = words_of(texts, LETTERS_DIGITS)
                for t, runs, _, _ in block.value.matches(w):
                    n = int(w.rows[t + 1] - w.rows[t])
                    left = None if sum(b - a for a, b in runs) > max_coverage * n else _without(texts[t], w, t, runs)
                    while left is not None:  # what a cut brings together may be a hit again
                        again = words_of([left], LETTERS_DIGITS)
                        more = next(iter(block.value.matches(again)), None)
                        if more is None:
                            break
                        left = _without(left, again, 0, more[1])
                    new[first + t] = left
            yield _replaced(batch, new) if new else batch

    return docs.mapInArrow(clean, docs.schema)


def _cut(docs: DataFrame, hits: DataFrame, max_coverage: float) -> DataFrame:
    """The rows of ``docs`` that ``hits`` names, cut once; those that consist of hits to more than ``max_coverage`` go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            new: dict[int, bytes | None] = {}
            hit = batch["_hits"]
            batch = batch.select([n for n in batch.schema.names if n != "_hits"])
            for first, texts in chunks(batch["text"]):
                w = words_of(texts, LETTERS_DIGITS)
                for t, text in enumerate(texts):
                    runs = united([(r["first"], r["past"]) for r in hit[first + t].as_py()])
                    gone = sum(b - a for a, b in runs) > max_coverage * int(w.rows[t + 1] - w.rows[t])
                    new[first + t] = None if gone else _without(text, w, t, runs)
            yield _replaced(batch, new)

    return keyed(docs).join(sent(hits), ["_did", "_tid"]).select(*docs.columns, "_hits").mapInArrow(cut, docs.schema)


def _hits(docs: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """_did, _tid (names of the row), _hits: the hit runs by all blocks, landed; rows that nothing hits are left out."""
    passes = [_find(docs, b).where(F.size("hits") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_did"), F.col("tie").alias("_tid"), "hits") for b in blocks]
    return land(reduce(DataFrame.unionAll, passes).groupBy("_did", "_tid").agg(F.flatten(F.collect_set("hits")).alias("_hits")), "hits")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans that hold ``window`` consecutive words of an item or a whole shorter one; documents that consist of them to more
    than ``max_coverage`` go. n_chars follows where it exists. With several blocks, what all of them hit is decided on and cut at once, and the texts
    that were cut are searched by all of them again until nothing is hit."""
    ship(docs.sparkSession)
    blocks = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes(items, window, block_words)]
    if len(blocks) < 2:
        return _clean(docs, blocks[0], max_coverage) if blocks else docs
    done, rest, most = [], docs, max_coverage
    while not (hits := _hits(rest, blocks)).isEmpty():
        done.append(keyed(rest).join(sent(hits), ["_did", "_tid"], "left_anti").select(docs.columns))
        rest, most = land(_cut(rest, hits, most), "cut"), 1.0  # the share counts on the text as it came
    return reduce(DataFrame.unionAll, [*done, rest])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
