"""Periodic runs of words within documents, found by string synchronising sets, and texts with each run cut to its first period.

Texts of an Arrow batch are numbered word by word, joined with unique numbers between them and searched together; nothing is exchanged. A run is a
stretch of words with smallest period q, at least max(``shortest``, 3q) words long, that neither neighbour extends. A word is dropped if it lies in
any run after that run's first q words.

Defined results: a null or empty text has no runs and collapses to the empty text; repeated rows are searched each; null doc_ids are kept; an empty
table gives no rows; extra columns are ignored. Memory is about 250 bytes a word of the texts handled together, about 1 MB of text or one text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.expressions import let
from finstrata.llm.lean import lean
from finstrata.llm.sync_sets import runs
from finstrata.llm.words import chunks
from finstrata.session import ship

SHORTEST = 24
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SEPARATORS = r"[\x20\x09-\x0D]+"


def runs_of(texts: list[bytes], shortest: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Of each text its runs (start, length, period) and its words that stay, joined by blanks."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [text.split() for text in texts]  # of bytes: at ASCII white space only
    codes = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
    closed = [np.append(c, len(number) + i) for i, c in enumerate(codes)]
    ends = np.cumsum([len(c) for c in closed])
    joined = np.concatenate(closed)
    start, length, period = runs(joined, ends, shortest)
    steps = np.zeros(len(joined) + 1, np.int32)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    dropped = np.cumsum(steps[:-1]) > 0
    bounds = np.searchsorted(start, np.append(0, ends))
    out = []
    for i, ws in enumerate(words):
        a, b, base = bounds[i], bounds[i + 1], int(ends[i]) - len(ws) - 1
        if a < b:
            ws = [w for w, gone in zip(ws, dropped[base : base + len(ws)].tolist()) if not gone]
        out.append((list(zip((start[a:b] - base).tolist(), length[a:b].tolist(), period[a:b].tolist())), b" ".join(ws)))
    return out


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, runs (by start, then period), strongest (the run of the greatest length / period; ties: start, period; or null), collapsed text."""
    ship(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            ids = batch["doc_id"]
            for first, texts in chunks(batch["text"]):
                found = runs_of(texts, shortest)
                ends = np.cumsum([0, *(len(r) for r, _ in found)], dtype=np.int32)
                flat = [run for r, _ in found for run in r]
                columns = [pa.array([run[c] for run in flat], pa.int64()) for c in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
                best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else None for r, _ in found]
                strongest = pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], listed.type.value_type)
                texts_out = pa.array([t.decode() for _, t in found], pa.string())
                yield pa.record_batch([ids.slice(first, len(texts)), listed, strongest, texts_out], names=["doc_id", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, f"doc_id bigint, runs {RUNS}, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string")


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, or with h = crc32(decimal doc_id) divisible by 10 its words with a part repeated: word i >= a is word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)).cast("bigint") + 1
        place = lambda a, p: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), lambda ap: place(ap["a"], ap["p"])), " ")).otherwise("")

    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    return F.when(doc_id.isNotNull() & (h % 10 == 0) & text.isNotNull(), let(words, repeat)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.col("strongest")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return find_runs(docs).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: Comparing every word with the words at every distance is quadratic in SQL; tests/llm does it on small texts.
ORACLES: dict[str, str] = {}
