"""Packing of documents into sequences by cutting-stock column generation.

1. Documents are encoded, closed by ``end_id`` and cut into pieces of at most ``capacity`` ids. Only the last piece of a document is shorter.
2. Spark counts the pieces by size class (``sizes``: single lengths while short, then steps): a histogram of bounded length, the only thing the
   driver sees.
3. A linear program over patterns, multisets of size classes that fit a sequence, covers the histogram with the fewest sequences. A simplex
   method with column generation solves it: a knapsack dynamic program over the capacity prices new patterns by the dual values. It stops when
   the dual bound says that less than ``GAP`` can be gained.
4. Pattern counts are rounded down; the few pieces left over are placed first-fit decreasing, again as patterns.
5. Pieces are numbered within their size class (a distributed numbering) and look up the pattern, sequence and turn of their number.

Defined results: a null or empty text is a document of ``end_id`` alone; repeated rows are packed each; null doc_ids are kept; an empty table gives
no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from finstrata.llm.encoding import encoder_for
from finstrata.llm.lean import lean
from finstrata.llm.numbering import numbered
from finstrata.session import ship
from finstrata.sources.landing import land

CAPACITY = 2048
GAP = 1e-2
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def sizes(capacity: int) -> list[int]:
    """The size classes: every length to 64, then 32 steps to the next power of two, so that rounding a piece up wastes 1 in 32 at most and about 1 in 100 on average."""
    out, at = list(range(1, min(64, capacity) + 1)), 64
    while at < capacity:
        at += max(1, 1 << (at.bit_length() - 6))
        out.append(min(at, capacity))
    return out


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece; with ``keep_ids`` also its ids."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], encoder.dtype)
        for batch in lean(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                ids = np.concatenate([ids, end]).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if keep_ids else [])))
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * keep_ids
            names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * keep_ids
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE + ", ids array<bigint>" * keep_ids)


def _price(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset that fits, by dynamic programming over the capacity (each class as often as wanted)."""
    best = np.zeros(capacity + 1)
    for w, v in zip(weights, values):  # any number of this class: a running maximum over each residue of the capacity
        rows = -(-(capacity + 1) // w)
        bonus = (np.arange(rows) * v)[:, None]
        grid = np.concatenate([best, np.full(rows * w - capacity - 1, -np.inf)]).reshape(rows, w) - bonus
        best = (np.maximum.accumulate(grid, axis=0) + bonus).ravel()[: capacity + 1]
    counts, c = np.zeros(len(weights)), capacity
    weights, values, kept = weights[values > 0], values[values > 0], np.flatnonzero(values > 0)  # a class without value is no gain
    while c > 0 and best[c] > 1e-12:
        fit = int(np.searchsorted(weights, c, "right"))
        short = best[c] - best[c - weights[:fit]] - values[:fit]
        k = int(short.argmin()) if fit else 0
        if not fit or short[k] > best[c] - best[c - 1]:
            c -= 1
        else:
            counts[kept[k]] += 1
            c -= weights[k]
    return float(values @ counts[kept]), counts


def solve(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each is used), fractional, covering the demand; weights ascending. Starts from one-class patterns.

    ``safe`` is the best dual solution so far that prices no pattern above 1, so ``safe @ demand`` bounds the sequences from below; lengths over the
    capacity are one to begin with. New patterns are priced between it and the duals of the current basis, which keeps those from swinging. A class
    with a negative dual is covered more often than asked for: its surplus enters the basis, as the column that takes one such piece away at no cost.
    It is no pattern and is left out of the result.
    """
    m = len(weights)
    basis = np.diag((capacity // weights).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    cost = np.ones(m)
    x = inverse @ demand
    safe = weights / capacity
    for turn in range(40 * m):  # a safety net: every basis is a valid cover
        if cost @ x <= safe @ demand * (1 + gap):
            break
        dual = cost @ inverse
        if dual.min() < -1e-9:
            column, price = np.zeros(m), 0.0
            column[dual.argmin()] = -1.0
        else:
            price = 1.0
            for share in (0.8, 0.4, 0.0):
                point = np.maximum(share * safe + (1 - share) * dual, 0)
                value, column = _price(point, weights, capacity)
                if value > 0 and point @ demand / value > safe @ demand:
                    safe = point / value
                if dual @ column > 1 + 1e-9:
                    break
            else:
                break
        step = inverse @ column
        open_ = np.flatnonzero(step > 1e-9)
        ratios = x[open_] / step[open_]
        leave = int(open_[ratios.argmin()])
        basis[:, leave], cost[leave] = column, price
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        if turn % 50 == 49:  # a Newton step takes back the rounding errors; einsum needs no threads of a linear algebra library
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
        x = np.maximum(inverse @ demand, 0)
    return basis.T[cost > 0], x[cost > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each size class in a sequence, number of such sequences), enough for every piece of the histogram."""
    full = histogram.get(capacity, 0)
    weights = np.array(sorted(w for w, n in histogram.items() if n and w < capacity), dtype=np.int64)
    out = [({capacity: 1}, full)] if full else []
    if not len(weights):
        return out
    left = {int(w): histogram[w] for w in weights}
    patterns, used = solve(weights, np.array([histogram[w] for w in weights], float), capacity)
    for pattern, n in zip(patterns, np.floor(used + 1e-6).astype(int)):
        held = {int(w): int(round(k)) for w, k in zip(weights, pattern) if round(k)}
        n = int(min([n, *(left[w] // k for w, k in held.items())]))
        if n > 0:
            out.append((held, n))
            for w, k in held.items():
                left[w] -= n * k
    while any(left.values()):  # fewer than a pattern for each class is left
        held, room = {}, capacity
        for w in sorted(left, reverse=True):
            k = min(left[w], room // w)
            if k:
                held[w], room = k, room - k * w
        n = min(left[w] // k for w, k in held.items())
        out.append((held, n))
        for w, k in held.items():
            left[w] -= n * k
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read twice: land it first."""
    spark = pieces.sparkSession
    classes = sizes(capacity)
    size = F.element_at(F.filter(F.array(*map(F.lit, classes)), lambda s: s >= F.col("length")), 1)
    sized = pieces.withColumn("_size", F.when(F.col("length") == capacity, capacity).otherwise(size))
    histogram = {r["_size"]: r["count"] for r in sized.groupBy("_size").count().collect()}  # a row per size class
    slots, taken, first = [], dict.fromkeys(histogram, 0), 0
    for held, n in plan(histogram, capacity):
        for turn, (w, k) in enumerate(sorted(held.items(), reverse=True)):
            slots.append((w, taken[w], taken[w] + n * k, first, k, turn))
            taken[w] += n * k
        first += n
    table = spark.createDataFrame(slots, "_size int, _from bigint, _to bigint, _first bigint, _each int, _turn int")
    order = [c for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns]
    ranked = numbered(sized, ["_size"], order, "_rank")
    at = F.col("_rank") - F.col("_from")
    met = ranked.join(F.broadcast(table), "_size").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))  # a few rows per size class and pattern: bounded by the classes
    placed = met.withColumns({"sequence_id": F.col("_first") + F.floor(at / F.col("_each")), "_at": F.pmod(at, F.col("_each"))})
    alone = placed.where(F.col("_size") == capacity).withColumn("offset", F.lit(0).cast("bigint"))
    together = Window.partitionBy("sequence_id").orderBy("_turn", "_at").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds ``capacity`` pieces at most
    mixed = placed.where(F.col("_size") != capacity).withColumn("offset", F.coalesce(F.sum("length").over(together), F.lit(0)))
    return mixed.unionByName(alone).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed ids themselves, for pieces that keep theirs."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(land(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1), "pieces"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
