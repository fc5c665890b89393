"""Comparing scoring systems: DeLong, bootstraps over samples, clusters and classes.

Bootstrap weights are Poisson(1) counts computed from (draw, key) hashes: every task knows the weight of its own rows, so
no draw list is built or joined, a lost task recomputes the same weights, and a cluster bootstrap is the same plan with the
cluster as key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import N_BOOT, SEED
from ..functions.draws import PRIME, poisson_bounds
from ..functions.ordered import running_totals
from ..functions.tails import normal_two_sided
from ..session import ship
from ..sources.landing import land
from .metrics import rank_metrics, safe


def placements(df: DataFrame, by: Sequence[str] = ("system",), p: str = "p", y: str = "y") -> DataFrame:
    """Per distinct score: v10 (share of negatives below, ties half) and v01 (share of positives above, ties half)."""
    sc = df.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(y).alias("k1"), (F.count(F.lit(1)) - F.sum(y)).alias("k0"))
    t = running_totals(sc, "p", ["k1", "k0"], by)
    v10 = (F.col("k0_cum") - F.col("k0") + F.col("k0") / 2.0) / F.col("k0_tot")
    v01 = (F.col("k1_tot") - F.col("k1_cum") + F.col("k1") / 2.0) / F.col("k1_tot")
    return t.select(*by, "p", v10.alias("v10"), v01.alias("v01"), F.col("k1_tot").alias("n_pos"), F.col("k0_tot").alias("n_neg"))


def system_pairs(wide: DataFrame, systems: Sequence[str], y: str = "y") -> DataFrame:
    """(a, b, y, pa, pb, n): rows of every pair of systems, folded to distinct score pairs."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("pa"), F.col(b).cast("double").alias("pb"))
             for i, a in enumerate(systems) for b in systems[i + 1:]]
    t = wide.select(F.col(y).alias("y"), F.explode(F.array(*pairs)).alias("s")).select("y", "s.*")
    return t.groupBy("a", "b", "y", "pa", "pb").agg(F.count(F.lit(1)).alias("n"))


def delong(wide: DataFrame, systems: Sequence[str], y: str = "y") -> DataFrame:
    """DeLong's test for every pair: AUCs, difference, standard error, z, two-sided p."""
    arr = F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).cast("double").alias("p")) for s in systems])
    long = wide.select(F.col(y).alias("y"), F.explode(arr).alias("s")).select("y", "s.*")
    pl = placements(long)
    side = lambda n: pl.select(F.col("system").alias(n), F.col("p").alias(f"p{n}"), F.col("v10").alias(f"v10{n}"), F.col("v01").alias(f"v01{n}"))
    t = system_pairs(wide, systems, y).join(side("a"), ["a", "pa"]).join(side("b"), ["b", "pb"])
    x = F.when(F.col("y") == 1, F.col("v10a")).otherwise(F.col("v01a"))
    z = F.when(F.col("y") == 1, F.col("v10b")).otherwise(F.col("v01b"))
    w = F.col("n").cast("double")
    m = t.select("a", "b", "y", w.alias("w"), x.alias("x"), z.alias("z")).groupBy("a", "b").agg(*[
        F.sum(F.when(F.col("y") == k, e)).alias(f"{name}{k}")
        for k in (0, 1) for name, e in {
            "w": F.col("w"), "x": F.col("w") * F.col("x"), "z": F.col("w") * F.col("z"), "xx": F.col("w") * F.col("x") * F.col("x"),
            "zz": F.col("w") * F.col("z") * F.col("z"), "xz": F.col("w") * F.col("x") * F.col("z")}.items()])

    def cov(k: int, s: str, u: str, v: str) -> Column:
        n = F.col(f"w{k}")
        return (F.col(f"{s}{k}") - F.col(f"{u}{k}") * F.col(f"{v}{k}") / n) / (n - 1.0) / n

    var = sum((cov(k, "xx", "x", "x") + cov(k, "zz", "z", "z") - 2.0 * cov(k, "xz", "x", "z") for k in (0, 1)), F.lit(0.0))
    enough = (F.col("w0") >= 2) & (F.col("w1") >= 2)
    auc_a, auc_b = F.col("x1") / F.col("w1"), F.col("z1") / F.col("w1")
    r = m.select("a", "b", F.when(enough, auc_a).alias("auc_a"), F.when(enough, auc_b).alias("auc_b"), F.when(enough, auc_a - auc_b).alias("delta"),
                 F.when(enough & (var > 1e-18), F.sqrt(var)).alias("std_err"))
    r = r.withColumn("z", F.col("delta") / F.col("std_err"))
    return r.withColumn("p_value", normal_two_sided(F.col("z")))


# ---- bootstraps ---------------------------------------------------------------------------------------------
#
# Rows are dealt once by ranges of the score; what is exchanged does not depend on the number of draws. Tasks compute the weights of all draws
# for a few rows at a time, as a matrix of rows x draws, and add it up by runs of equal scores, so the rest is matrix arithmetic. A first pass gives the
# totals of each range. Spark adds them up over the ranges below (a window over ranges, for each draw apart) and hands every range its own sums as one
# more row, first in its order; a second pass then adds up AUROC, average precision and the confusion counts. Neither the driver nor a broadcast
# holds anything that grows with ranges x draws.

BLOCK = 64  # rows whose weights are held at a time
FOLD = 8  # equal scores among the rows a task gathers from which on they are folded before the exchange
GATHER, PIECE = 1 << 20, 1 << 13  # rows, a few bytes each, that a task gathers to fold; rows it hands on at a time
HELD = 1 << 27  # bytes of sums that a folding task holds: the most frequent scores are folded, others are handed on as rows
ADDED = 1 << 27  # rows after which a folding task hands on its sums, so that they stay below 2^31
SUMS = ["auc", "ap", "tp", "fp", "fn", "tn"]


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME = 2^31 - 1, for 0 <= x < 2^62: the upper bits are worth as much as the lower ones."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    x[x >= PRIME] -= PRIME
    return x


def _parted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder by PRIME, for 0 <= key < 2^62, without a division."""
    high = key >> 31
    rest = (key & PRIME) + high
    over = (rest >= PRIME).astype(np.int64) + (rest >= 2 * PRIME)
    return high + over, rest - PRIME * over


def _mix(key: np.ndarray, seed: int) -> np.ndarray:
    """``draws.with_mix`` for arrays of non-negative keys."""
    times, rest = _parted(key)
    x = _mod(rest * 48271 + (seed * 7919 + 12345))
    x = _mod(x * (x + 1) + 1013904223 + _mod(times))
    x = _mod(x * (x + 3) + 374761393)
    return _mod(x * 16807)


#: The smallest number in [0, PRIME) that counts once, twice, ...; and the counts by the upper 16 bits, -1 where a limit lies between.
_LIMITS = np.array([next(x for x in range(int(b * PRIME) - 2, int(b * PRIME) + 3) if x / float(PRIME) >= b) for b in poisson_bounds()], np.int64)
_FIRST = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.int64) << 15, "right")
_COUNTS = np.where(_FIRST == np.searchsorted(_LIMITS, ((np.arange(1 << 16, dtype=np.int64) + 1) << 15) - 1, "right"), _FIRST, -1).astype(np.int8)


class _Draws:
    """Counts of keys in all draws, ``rows`` keys at a time. What depends on the draw or on the key alone is computed once for each; remainders modulo PRIME
    stay partly reduced as long as products fit into 64 bits. All steps run in place, on arrays that fit into a core's cache."""

    def __init__(self, n_boot: int, seed: int):
        self.n_boot, self.seed, self.rows = n_boot, seed, max(1, (1 << 15) // n_boot)
        self.pair = _mix(np.arange(n_boot, dtype=np.int64), 17)[None, :] * 40503
        times, rest = np.divmod(self.pair, PRIME)
        self.start = ((rest * 48271 + (seed * 7919 + 12345)) % PRIME).astype(np.uint64)
        self.times = (((times + 1013904223) << 31) + rest + 1).astype(np.uint64)
        self.x, self.y, self.t = (np.empty((self.rows, n_boot), np.uint64) for _ in range(3))
        self.out = np.empty((self.rows, n_boot), np.int32)
        # from PRIME on, which is worth 0, up to 2^16 more
        self.counts = np.concatenate([_COUNTS[:-1], [-1, 0, 0, 0]]).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Keys x draws, at most ``rows`` keys; overwritten by the next call."""
        if keys.min() < 0 or keys.max() >= 1 << 61:
            return self._any(keys)
        n, mask, half = len(keys), np.uint64(PRIME), np.uint64(31)
        x, y, t, out = self.x[:n], self.y[:n], self.t[:n], self.out[:n]
        times, rest = np.divmod(keys, PRIME)
        column = lambda v: v.astype(np.uint64)[:, None]

        def reduced() -> None:
            np.bitwise_and(x, mask, out=t)
            np.right_shift(x, half, out=x)
            np.add(x, t, out=x)

        np.add(self.start, column(rest * 48271 % PRIME), out=x)  # below 2^32: its product with its successor fits
        np.add(self.times, column((times << 31) + rest), out=t)
        np.right_shift(t, half, out=t)  # one more where the two remainders reach PRIME
        np.add(x, np.uint64(1), out=y)
        np.multiply(x, y, out=x)
        np.add(x, t, out=x)
        reduced()
        reduced()
        np.add(x, np.uint64(3), out=y)
        np.multiply(x, y, out=x)
        np.add(x, np.uint64(374761393), out=x)
        reduced()
        np.multiply(x, np.uint64(16807), out=x)
        reduced()
        np.right_shift(x, np.uint64(15), out=t)
        np.take(self.counts, t.view(np.int64), out=out, mode="clip")
        near = np.flatnonzero(out.ravel() < 0)
        out.ravel()[near] = np.searchsorted(_LIMITS, x.ravel()[near].astype(np.int64) % PRIME, "right")
        return out

    def _any(self, keys: np.ndarray) -> np.ndarray:
        x = _mix(self.pair + keys.astype(np.int64)[:, None], self.seed)
        out = _COUNTS[x >> 15].astype(np.int32)
        near = out < 0
        out[near] = np.searchsorted(_LIMITS, x[near], "right")
        return out

    def all_of(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty((len(keys), self.n_boot), np.int32)
        for at in range(0, len(keys), self.rows):
            out[at : at + self.rows] = self.of(keys[at : at + self.rows])
        return out


def poisson_weights(keys: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Counts of each key in each draw (keys x draws), the same as ``poisson_one`` of ``with_pair_uniform(draw, key)``."""
    return _Draws(n_boot, seed).all_of(keys)


class _Folded:
    """Sums of the weights of equal scores, for one of the scores that rows have."""

    def __init__(self, most: int, n_boot: int):
        self.most, self.n_boot = most, n_boot
        self.places: dict[tuple[str, float], int] = {}
        self.sums: list[np.ndarray] = []  # negatives and positives

    def placed(self, g: pa.ChunkedArray, p: pa.ChunkedArray) -> np.ndarray:
        """The place of each row's sums, -1 if the row stays as it is, -2 if it has no score."""
        t = pd.DataFrame({"g": g.to_pandas(), "p": p.to_pandas()})
        known = p.is_valid().to_numpy(zero_copy_only=False) if isinstance(p, pa.Array) else p.is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        code = np.where(known, t.groupby(["g", "p"], sort=False, dropna=False).ngroup().to_numpy(), -1)
        found, first, sizes = np.unique(code, return_index=True, return_counts=True)
        place = np.full(int(found.max()) + 2, -1)  # the last one is for rows without a score
        for at in np.argsort(-sizes, kind="stable"):
            if found[at] < 0:
                continue
            key = (t["g"].iat[first[at]], t["p"].iat[first[at]])
            if key not in self.places and sizes[at] >= FOLD and len(self.places) < self.most:
                self.places[key] = len(self.sums)
                self.sums.append(np.zeros((2, self.n_boot), np.int32))
            place[found[at]] = self.places.get(key, -1)
        place[-1] = -2
        return place[code]

    def add(self, runs: np.ndarray, weights: np.ndarray) -> None:
        """``runs``: twice the place, and one more for positives; of each row of weights."""
        starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        for s, e in zip(starts, np.append(starts[1:], len(runs))):
            if runs[s] >= 0:
                held = self.sums[runs[s] >> 1][runs[s] & 1]
                held += weights[s] if e == s + 1 else np.add.reduce(weights[s:e], axis=0, dtype=np.int32)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """All sums, a few megabytes at a time; none is held afterwards."""
        keys, step = list(self.places), max(1, (1 << 22) // self.n_boot // 16)
        for at in range(0, len(keys), step):
            some, sums = keys[at : at + step], self.sums[at : at + step]
            listed = [pa.array([s[i] for s in sums], pa.list_(pa.int64())) for i in (1, 0)]
            yield _rows([k[0] for k in some], [k[1] for k in some], [0] * len(some), [0] * len(some), *listed)
        self.places, self.sums = {}, []


def _rows(g: list | pa.Array, p: list | pa.Array, k: list | pa.Array, y: list | pa.Array, w1: pa.Array, w0: pa.Array) -> pa.RecordBatch:
    """All batches of a task have one schema: fields may be null, whatever those were that came in."""
    columns = [pa.array(g, pa.string()), pa.array(p, pa.float64()), pa.array(k, pa.int64()), pa.array(y, pa.int32()), w1, w0]
    return pa.record_batch(columns, names=["g", "p", "k", "y", "w1", "w0"])


def _fold(rows: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(g, p, k, y, w1, w0): rows as they are, but scores that many of a task's rows have as one row with its weights per draw, so that a score which a
    third of all rows have does not send them to one task, and weights of scores that repeat are computed once, not by each pass. Rows may have
    several scores, (g, p), (g1, p1), ...: their weights are computed once for all of them."""
    scores = [("g", "p"), *[(f"g{i}", f"p{i}") for i in range(1, len(rows.columns) // 2 - 1)]]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GATHER:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, added = _Draws(n_boot, seed), 0
        folded = [_Folded(max(1, HELD // (8 * n_boot * len(scores))), n_boot) for _ in scores]
        for table in gathered(batches):
            k, y = table["k"].to_numpy(), table["y"].to_numpy()
            places = [f.placed(table[g], table[p]) for f, (g, p) in zip(folded, scores)]
            for place, (g, p) in zip(places, scores):
                for plain in table.filter(pa.array(place == -1)).to_batches(max_chunksize=PIECE):
                    none = pa.nulls(plain.num_rows, pa.list_(pa.int64()))
                    yield _rows(plain[g], plain[p], plain["k"], plain["y"], none, none)
            runs = [2 * place + (y == 1) for place in places]
            hot = np.flatnonzero(np.any([place >= 0 for place in places], axis=0))
            order = hot[np.lexsort([r[hot] for r in reversed(runs)])]
            for at in range(0, len(order), draws.rows):
                some = order[at : at + draws.rows]
                weights = draws.of(k[some])
                for f, r in zip(folded, runs):
                    f.add(r[some], weights)
            added += len(order)
            if added >= ADDED:
                added = 0
                for f in folded:
                    yield from f.taken()
        for f in folded:
            yield from f.taken()

    return rows.mapInArrow(run, "g string, p double, k bigint, y int, w1 array<bigint>, w0 array<bigint>")


def _weights(batch: pa.RecordBatch, at: int, to: int, draws: _Draws) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the positives and of the negatives among rows ``at`` to ``to``: two matrices of rows x draws. Folded rows bring theirs along."""
    folded = batch["w1"].slice(at, to - at).is_valid().to_numpy(zero_copy_only=False)
    w1, w0 = np.zeros((to - at, draws.n_boot), np.int64), np.zeros((to - at, draws.n_boot), np.int64)
    plain = np.flatnonzero(~folded)
    if len(plain):
        weights = draws.all_of(batch["k"].slice(at, to - at).to_numpy()[plain])
        rare = batch["y"].slice(at, to - at).to_numpy()[plain] == 1
        w1[plain[rare]], w0[plain[~rare]] = weights[rare], weights[~rare]
    for i in np.flatnonzero(folded):
        w1[i], w0[i] = batch["w1"][at + int(i)].values.to_numpy(), batch["w0"][at + int(i)].values.to_numpy()
    return w1, w0


class _Range:
    """Sums of one group within one range of scores, run after run in ascending order."""

    def __init__(self, below: tuple[np.ndarray, np.ndarray], whole: tuple[np.ndarray, np.ndarray], size: tuple[int, int] | None, threshold: float):
        self.low1, self.low0 = (x.astype(float) for x in below)
        self.pos, self.neg = (x.astype(float) for x in whole)
        with np.errstate(divide="ignore", invalid="ignore"):  # a draw may hold one class only
            self.scale1, self.scale0 = (size[0] / self.pos, size[1] / self.neg) if size else (1.0, 1.0)
        self.threshold = threshold
        self.sums = np.zeros((len(SUMS), len(self.pos)))

    def add(self, scores: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> None:
        """Runs x draws."""
        under1, under0 = self.low1 + (w1.cumsum(axis=0) - w1), self.low0 + (w0.cumsum(axis=0) - w0)
        with np.errstate(divide="ignore", invalid="ignore"):
            tp, fp = (self.pos - under1) * self.scale1, (self.neg - under0) * self.scale0
            self.sums[1] += np.where(w1 > 0, w1 / self.pos * (tp / (tp + fp)), 0.0).sum(axis=0)
        self.sums[0] += (w1 * (under0 + w0 / 2.0)).sum(axis=0)
        high = scores >= self.threshold
        for at, w in ((2, w1), (3, w0)):
            called = w[high].sum(axis=0)
            self.sums[at] += called
            self.sums[at + 2] += w.sum(axis=0) - called
        self.low1 += w1.sum(axis=0)
        self.low0 += w0.sum(axis=0)


def _totals(ranged: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(part, g, w1, w0): weights per draw of each range, as one task sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], np.ndarray] = {}
        draws = _Draws(n_boot, seed)
        for batch in batches:
            keys = list(zip(batch["part"].to_pylist(), batch["g"].to_pylist()))
            for at in range(0, batch.num_rows, BLOCK):
                to = min(at + BLOCK, batch.num_rows)
                both = _weights(batch, at, to, draws)
                some = keys[at:to]
                for key in dict.fromkeys(some):
                    rows = np.array([k == key for k in some])
                    held = found.setdefault(key, np.zeros((2, n_boot), np.int64))
                    for i, w in enumerate(both):
                        held[i] += w[rows].sum(axis=0)
        columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.string()), *[pa.array([h[i] for h in found.values()], pa.list_(pa.int64())) for i in (0, 1)]]
        yield pa.record_batch(columns, names=["part", "g", "w1", "w0"])

    return ranged.mapInArrow(run, "part int, g string, w1 array<bigint>, w0 array<bigint>")


def _below(totals: DataFrame) -> DataFrame:
    """(part, g, w1, w0, pos, neg): weights per draw in the ranges below, and in all ranges."""
    each = totals.select("part", "g", F.posexplode(F.arrays_zip("w1", "w0")).alias("draw", "w")).groupBy("part", "g", "draw").agg(F.sum("w.w1").alias("a"), F.sum("w.w0").alias("b"))
    whole = W.partitionBy("g", "draw")  # as many rows as there are ranges
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = {"w1": F.coalesce(F.sum("a").over(before), F.lit(0)), "w0": F.coalesce(F.sum("b").over(before), F.lit(0)), "pos": F.sum("a").over(whole), "neg": F.sum("b").over(whole)}
    listed = each.select("part", "g", "draw", *[c.alias(n) for n, c in sums.items()]).groupBy("part", "g").agg(F.array_sort(F.collect_list(F.struct("draw", *sums))).alias("s"))
    return listed.select("part", "g", *[F.col(f"s.{n}").alias(n) for n in sums])


def bootstrap_sums(df: DataFrame, key: str, group: Column, threshold: float, n_boot: int, seed: int, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(g, draw, pos, neg, auc, ap, tp, fp, fn, tn): sums over all rows with their weights. ``sizes``: positives and negatives to which each
    draw's weights are scaled for average precision."""
    ship(df.sparkSession)
    rows = df.select(group.cast("string").alias("g"), F.col("p").cast("double").alias("p"), F.col(key).cast("bigint").alias("k"), F.col("y").cast("int").alias("y"))
    return _sums(rows, threshold, n_boot, seed, sizes)


def _sums(rows: DataFrame, threshold: float, n_boot: int, seed: int, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``bootstrap_sums`` of rows (k, y, g, p), with further scores as g1, p1, ..."""
    scored = reduce(Column.__or__, [F.col(c).isNotNull() for c in rows.columns if c.startswith("p")])
    rows = rows.where(scored & F.col("y").isNotNull() & F.col("k").isNotNull())  # without a key there is no draw, so no weight
    tasks = 4 * max(4, rows.sparkSession.sparkContext.defaultParallelism)  # rows are small and much work: files do not say how many tasks they need
    folded = land(_fold(rows.repartition(tasks, "k", "p"), n_boot, seed), "folded-scores")  # read twice: to find ranges, and to deal them out
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: small rows are much work here and must not be coalesced
    ranged = land(folded.repartitionByRange(ranges, "g", "p").withColumn("part", F.spark_partition_id()), "ranged-scores")
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    offsets = land(_below(_totals(ranged, n_boot, seed)), "score-offsets")
    dealt = ranged.unionByName(offsets, allowMissingColumns=True).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "g", F.asc_nulls_first("p"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, np.ndarray]] = []
        draws = _Draws(n_boot, seed)
        name: str | None = None
        now: _Range | None = None
        held: tuple[float, np.ndarray, np.ndarray] | None = None  # a run that may go on in the next block

        def close() -> None:
            if held is not None:
                now.add(np.array([held[0]]), held[1], held[2])

        for batch in batches:
            g, p = np.array(batch["g"].to_pylist(), object), batch["p"].to_numpy(zero_copy_only=False)
            heads = batch["pos"].is_valid().to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if heads[at]:
                    close()
                    held, name = None, g[at]
                    read = lambda c: batch[c][at].values.to_numpy()  # noqa: B023, E731
                    now = _Range((read("w1"), read("w0")), (read("pos"), read("neg")), sizes[name] if sizes else None, threshold)
                    done.append((name, now.sums))
                    at += 1
                    continue
                to = min(at + BLOCK, batch.num_rows)
                following = np.flatnonzero(heads[at:to])
                to = at + int(following[0]) if len(following) else to
                w1, w0 = _weights(batch, at, to, draws)
                scores = p[at:to]
                starts = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
                scores, w1, w0 = scores[starts], np.add.reduceat(w1, starts, axis=0), np.add.reduceat(w0, starts, axis=0)
                if held is not None and held[0] == scores[0]:
                    w1[0] += held[1][0]
                    w0[0] += held[2][0]
                elif held is not None:
                    close()
                now.add(scores[:-1], w1[:-1], w0[:-1])
                held = (scores[-1], w1[-1:], w0[-1:])
                at = to
        close()
        columns = [pa.array([n for n, _ in done], pa.string()), *[pa.array([x[i] for _, x in done], pa.list_(pa.float64())) for i in range(len(SUMS))]]
        yield pa.record_batch(columns, names=["g", *SUMS])

    measured = dealt.mapInArrow(measure, "g string, " + ", ".join(f"{c} array<double>" for c in SUMS))
    per = measured.select("g", F.posexplode(F.arrays_zip(*SUMS)).alias("draw", "s")).groupBy("g", "draw").agg(*[F.sum(f"s.{c}").alias(c) for c in SUMS])
    return per.withColumns({"pos": F.col("tp") + F.col("fn"), "neg": F.col("fp") + F.col("tn")})


def draw_metrics(df: DataFrame, key: str, by: Sequence[str] = (), threshold: float = 0.5, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """(by, draw, auroc, average_precision, f1, macro_f1); draws with one class are skipped."""
    types = {b: df.schema[b].dataType for b in by}
    per = bootstrap_sums(df, key, F.to_json(F.struct(*by)) if by else F.lit("{}"), threshold, n_boot, seed).where("pos > 0 and neg > 0")
    for b, kind in types.items():
        per = per.withColumn(b, F.get_json_object("g", f"$.{b}").cast(kind))
    f1, f0 = safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), safe(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn"))
    return per.select(*by, "draw", (F.col("auc") / (F.col("pos") * F.col("neg"))).alias("auroc"), F.col("ap").alias("average_precision"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"))


def interval(draws: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval per metric; a group holds at most one value per draw."""
    long = draws.unpivot([F.col(b) for b in by], list(names), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.percentile("value", 0.025).alias("ci_low"), F.percentile("value", 0.975).alias("ci_high"), F.avg("value").alias("mean"), F.count("value").alias("n_draws"))


BOOT_METRICS = ["auroc", "average_precision", "f1", "macro_f1"]


def bootstrap_interval(df: DataFrame, key: str = "row_id", by: Sequence[str] = (), threshold: float = 0.5, n_boot: int = N_BOOT, seed: int = SEED,
                       names: Sequence[str] = tuple(BOOT_METRICS)) -> DataFrame:
    """Intervals from resampled rows; with ``key`` set to a group column, from resampled groups."""
    return interval(draw_metrics(df, key, by, threshold, n_boot, seed), names, by)


def _system_draws(wide: DataFrame, systems: Sequence[str], key: str, n_boot: int, seed: int) -> DataFrame:
    """(draw, s, auroc, average_precision) of all systems on the same draws, stratified by class: the weights of a row are computed once.

    Stratification: in every draw the weights of each class are scaled back to the size of the class.
    """
    ship(wide.sparkSession)
    size = wide.agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg")).first()
    scores = [c for i, s in enumerate(systems) for c in (F.lit(s).alias(f"g{i or ''}"), F.col(s).cast("double").alias(f"p{i or ''}"))]
    rows = wide.select(F.col(key).cast("bigint").alias("k"), F.col("y").cast("int").alias("y"), *scores)
    per = _sums(rows, 0.5, n_boot, seed, {s: (size["pos"] or 0, size["neg"] or 0) for s in systems}).where("pos > 0 and neg > 0")
    return per.select("draw", F.col("g").alias("s"), (F.col("auc") / (F.col("pos") * F.col("neg"))).alias("auroc"), F.col("ap").alias("average_precision"))


def _observed(wide: DataFrame, systems: Sequence[str]) -> DataFrame:
    """(s, auroc, average_precision) of all rows."""
    arr = F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).cast("double").alias("p")) for s in systems])
    return rank_metrics(wide.select("y", F.explode(arr).alias("q")).select("y", "q.*"), ["s"])


def _difference(draws: DataFrame, observed: DataFrame, a: str, b: str) -> DataFrame:
    pick = lambda c, s: F.max(F.when(F.col("s") == s, F.col(c)))
    less = [(pick(c, a) - pick(c, b)).alias(c) for c in ("auroc", "average_precision")]
    long = draws.where(F.col("s").isin(a, b)).groupBy("draw").agg(*less).unpivot([F.col("draw")], ["auroc", "average_precision"], "metric", "delta")
    obs = observed.where(F.col("s").isin(a, b)).agg(*less).unpivot([], ["auroc", "average_precision"], "metric", "observed")
    share = lambda c: F.avg(c.cast("double"))
    out = long.join(obs, "metric").groupBy("metric", "observed").agg(
        F.percentile("delta", 0.025).alias("ci_low"), F.percentile("delta", 0.975).alias("ci_high"),
        F.least(F.lit(1.0), 2.0 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0))).alias("p_value"),
        share(F.signum("delta") == F.signum("observed")).alias("same_sign"), F.count(F.lit(1)).alias("n_draws"))
    return out.withColumn("significant", (F.col("p_value") < 0.05).cast("int"))


def paired_bootstrap(wide: DataFrame, a: str, b: str, key: str = "row_id", n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Difference of AUROC and AP between two systems on the same draws, stratified by class."""
    return _difference(_system_draws(wide, [a, b], key, n_boot, seed), _observed(wide, [a, b]), a, b)


def compare_systems(wide: DataFrame, systems: Sequence[str], n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """All pairs: DeLong beside the paired bootstrap of AUROC and AP. A system's draws are computed once, whatever the number of pairs."""
    draws, observed = land(_system_draws(wide, systems, "row_id", n_boot, seed), "system-draws"), land(_observed(wide, systems), "system-metrics")
    boots = [_difference(draws, observed, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "metric", "ci_low", "ci_high", F.col("p_value").alias("boot_p"))
             for i, a in enumerate(systems) for b in systems[i + 1:]]
    return delong(wide, systems).join(reduce(DataFrame.unionByName, boots), ["a", "b"])
