"""Histogram gradient boosting with a custom objective, on Spark.

1. Quantile bins of all features come from one aggregation. Rows become blocks: a byte per feature (0 stands for a missing value), label, weight and
   key, landed once. Everything after that reads blocks only.
2. A tree grows level by level. Tasks add up gradients, curvatures and counts per node, feature and bin over their blocks; histograms are exchanged
   by feature, summed by as many tasks as their size asks for, and the best split of each node and feature comes back: nodes x features entries,
   whatever the table's size.
3. A split says on which side missing values go: the side that gains more, or the larger side where none are missing.

The margin of a row is the sum of the trees so far. Tasks recompute it from the latest trees; every ``REFRESH`` trees the blocks are landed again with
their margins. Rows and columns of a round are drawn by arithmetic on keys, so a task that is run again sees the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import SEED
from ..session import ship
from ..sources.landing import land
from .inference import PRIME, _mix

BINS = 254  # of known values; a bin number fits a byte
BLOCK = 8192  # rows of a block
REFRESH = 25  # trees after which margins are landed
ADDED = 16 << 20  # bytes of histograms that one task adds up
EPS, HESS_FLOOR, MIN_GAIN = 1e-7, 1e-6, 1e-9

#: (labels, margins) -> (gradients, curvatures, losses) with respect to the margin
Objective = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _probability(margin: np.ndarray) -> np.ndarray:
    return np.clip(1.0 / (1.0 + np.exp(-np.clip(margin, -60.0, 60.0))), EPS, 1.0 - EPS)


def log_loss(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = _probability(margin)
    return p - y, p * (1.0 - p), -np.where(y > 0.5, np.log(p), np.log1p(-p))


@dataclass(frozen=True)
class FocalLoss:
    """-alpha (1-p)^gamma ln p of a positive; a negative is the mirror image with p and 1-p exchanged and weight 1 - alpha."""

    gamma: float
    alpha: float

    def __call__(self, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = _probability(margin)
        own = np.where(y > 0.5, p, 1.0 - p)  # probability of the true class
        sign, share = np.where(y > 0.5, 1.0, -1.0), np.where(y > 0.5, self.alpha, 1.0 - self.alpha)
        rest, log = 1.0 - own, np.log(own)
        inner = self.gamma * own * log + own - 1.0
        grad = share * sign * rest**self.gamma * inner
        curve = share * own * rest * (rest**self.gamma * (self.gamma * log + self.gamma + 1.0) - self.gamma * rest ** (self.gamma - 1.0) * inner)
        return grad, np.maximum(curve, HESS_FLOOR), -share * rest**self.gamma * log


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. A row goes left if its bin is at most ``cut``; missing values go where ``gap_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    gap_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gap_left: bool, gain: float, values: tuple[float, float]) -> int:
        """Gives the node two leaves, side by side; returns the left one."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.gap_left[node], self.left[node], self.gain[node] = feature, cut, gap_left, at, gain
        for value in values:
            for column, entry in zip((self.feature, self.cut, self.gap_left, self.left, self.value, self.gain), (-1, 0, True, 0, value, 0.0)):
                column.append(entry)
        return at

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        feature, cut, gap_left, left = (np.array(c) for c in (self.feature, self.cut, self.gap_left, self.left))
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            b = bins[inner, feature[at]]
            goes_left = np.where(b == 0, gap_left[at], b <= cut[at])
            node[inner] = left[at] + ~goes_left

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def bin_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins 1, 2, ... by upper edges that belong to their bin, the last one open; 0 for missing values."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left") + 1)
    return out


def quantile_edges(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper bin edges per feature of the array column ``x``: distinct quantiles without the largest value."""
    probs = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    known = df.select(F.posexplode("x").alias("j", "v")).where(~F.isnan("v"))
    found = {r["j"]: r["q"] for r in known.groupBy("j").agg(F.percentile_approx("v", probs, F.lit(50 * bins)).alias("q")).collect()}  # a row per feature
    return [np.unique(np.array(found[j], float))[:-1] if j in found else np.empty(0) for j in range(width)]


def _rows_drawn(keys: np.ndarray, share: float, seed: int) -> np.ndarray:
    return _mix(np.abs(keys), seed) < share * PRIME if share < 1 else np.ones(len(keys), bool)


def _columns_drawn(width: int, share: float, seed: int) -> np.ndarray:
    many = width if share >= 1 else max(1, round(share * width))
    return np.sort(np.argsort(_mix(np.arange(width, dtype=np.int64), seed), kind="stable")[:many])


@dataclass(frozen=True)
class Growth:
    depth: int = 3
    leaves: int = 31
    l2: float = 1.0
    min_rows: int = 1
    min_curve: float = 1e-3
    rate: float = 0.05
    subsample: float = 1.0
    colsample: float = 1.0


def best_splits(sums: np.ndarray, growth: Growth) -> list[tuple[float, int, bool, np.ndarray]]:
    """(gain, cut, gap_left, sums of the left side) of each node. ``sums``: gradients, curvatures, counts x nodes x bins, bin 0 missing values."""
    total = sums.sum(axis=2)
    gap, known = sums[:, :, :1], sums[:, :, 1:].cumsum(axis=2)  # the last cut parts known from missing values
    score = lambda s: s[0] ** 2 / (s[1] + growth.l2)
    whole = score(total)[:, None]
    tries = []
    for left in (known + gap, known):  # missing values left, missing values right
        right = total[:, :, None] - left
        fits = (np.minimum(left[2], right[2]) >= max(growth.min_rows, 1)) & (np.minimum(left[1], right[1]) >= growth.min_curve)
        with np.errstate(divide="ignore", invalid="ignore"):
            tries.append(np.where(fits, score(left) + score(right) - whole, -np.inf))
    out = []
    for n in range(sums.shape[1]):
        gain = np.maximum(tries[0][n], tries[1][n])
        cut = int(gain.argmax())
        on_left, on_right = tries[0][n][cut], tries[1][n][cut]
        if gap[2, n, 0] > 0:
            gap_left = bool(on_left >= on_right)
        else:
            gap_left = bool(2 * known[2, n, cut] >= total[2, n])
        left = known[:, n, cut] + (gap[:, n, 0] if gap_left else 0)
        out.append((float(gain[cut]), cut + 1, gap_left, left))
    return out


def _level(blocks: RDD, trees: list[Tree], tree: Tree, open_: list[int], columns: np.ndarray, bins: list[int], growth: Growth, objective: Objective,
           seed: int) -> RDD:
    """(feature, node, gain, cut, gap_left, left, total): the best split of each open node per drawn feature, and an entry of feature -1 with the held-out loss and weight.

    Two stages of plain tasks: a level has little to compute, so what a query's planning costs would be most of it. As many tasks add up as the histograms need.
    """
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))

    def histograms(part: int, rows: Iterator[tuple[bytes, ...]]) -> Iterator[tuple[int, tuple[int, bytes]]]:
        sums = {int(j): np.zeros((3, len(open_), bins[j] + 1)) for j in columns}
        held = np.zeros(2)
        for row in rows:
            x, y, w, keys, out, margin = _unpacked(row)
            for t in trees:
                margin = margin + t.margins(x)
            g, h, loss = objective(y, margin)
            held += (loss * w)[out].sum(), w[out].sum()
            node = place[tree.leaves(x)]
            use = np.flatnonzero((node >= 0) & ~out & _rows_drawn(keys, growth.subsample, seed))
            node, gw, hw = node[use], (g * w)[use], (h * w)[use]
            seen = np.ascontiguousarray(x[use].T)
            for j, s in sums.items():
                at = node * s.shape[2] + seen[j]
                for k, weights in enumerate((gw, hw, None)):
                    s[k] += np.bincount(at, weights, s[k].size).reshape(s[k].shape)
        for j, s in {**sums, -1: held}.items():
            yield j, (part, s.tobytes())

    def choose(parts: Iterator[tuple[int, tuple[int, bytes]]]) -> Iterator[tuple]:
        given: dict[int, list[tuple[int, bytes]]] = {}
        for j, one in parts:
            given.setdefault(j, []).append(one)
        for j, ones in given.items():
            flat = sum(np.frombuffer(data) for _, data in sorted(ones))  # in the order of the blocks, so that rounding does not depend on which came first
            if j < 0:
                yield j, 0, 0.0, 0, True, flat.tolist(), flat.tolist()
                continue
            s = flat.reshape(3, len(open_), bins[j] + 1)
            for n, (gain, cut, gap_left, left) in enumerate(best_splits(s, growth)):
                yield j, n, gain, cut, gap_left, left.tolist(), s[:, n].sum(axis=1).tolist()

    size = sum(3 * 8 * len(open_) * (bins[j] + 1) for j in columns) * blocks.getNumPartitions()
    adders = min(len(columns) + 1, 1 + size // ADDED)
    return blocks.mapPartitionsWithIndex(histograms, True).partitionBy(adders, lambda j: j).mapPartitions(choose)


def _unpacked(row: Sequence[bytes]) -> tuple[np.ndarray, ...]:
    x, y, w, key, held, margin = row
    y = np.frombuffer(y, "<f8")
    return np.frombuffer(x, np.uint8).reshape(len(y), -1), y, np.frombuffer(w, "<f8"), np.frombuffer(key, "<i8"), np.frombuffer(held, np.bool_), np.frombuffer(margin, "<f8")


COLUMNS = ["x", "y", "w", "key", "held", "margin"]
BLOCKS = ", ".join(f"{c} binary" for c in COLUMNS)


def _blocks(rows: DataFrame, edges: list[np.ndarray], start: float) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                columns = [bin_rows(x, edges), *(b[c].to_numpy(zero_copy_only=False).astype(t) for c, t in (("y", "<f8"), ("w", "<f8"), ("key", "<i8"), ("held", bool))), np.full(b.num_rows, start)]
                yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in columns], names=COLUMNS)

    return rows.mapInArrow(cut, BLOCKS)


def _with_margins(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for i in range(batch.num_rows):
                x, *_, margin = _unpacked([batch[c][i].as_buffer() for c in COLUMNS])
                margins.append(sum((t.margins(x) for t in trees), margin).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(add, BLOCKS)


class _BoostingParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)


class HistogramBoosting(Estimator, _BoostingParams):
    """``objective``: "log", or a callable (custom loss). ``held``: a boolean column of rows that only measure the loss; ``patience`` rounds without a
    lower one end the fit, and the trees up to the lowest are kept. ``key``: the column rows are drawn by."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "y", weightCol: str | None = None, maxIter: int = 300, stepSize: float = 0.05,
                 maxDepth: int = 3, maxLeaves: int = 31, maxBins: int = BINS, l2: float = 1.0, minRows: int = 1, minCurvature: float = 1e-3,
                 subsample: float = 1.0, colsample: float = 1.0, objective: str | Objective = "log", start: float | None = None,
                 held: str | None = None, patience: int | None = None, key: str | None = None, seed: int = SEED):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(featuresCol=featuresCol)
        self.columns = (labelCol, weightCol, held, key)
        self.rounds, self.bins, self.patience, self.start, self.seed = maxIter, min(maxBins, BINS), patience, start, seed
        self.objective: Objective = log_loss if objective == "log" else objective
        self.growth = Growth(maxDepth, maxLeaves, l2, minRows, minCurvature, stepSize, subsample, colsample)

    def _rows(self, df: DataFrame) -> DataFrame:
        label, weight, held, key = self.columns
        x = F.col(self.getOrDefault("featuresCol"))
        x = x if dict(df.dtypes)[self.getOrDefault("featuresCol")].startswith("array") else vector_to_array(x)
        x = F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
        weight_ = F.col(weight).cast("double") if weight else F.lit(1.0)
        held_ = F.col(held).cast("boolean") if held else F.lit(False)
        # without a key rows are drawn by a hash of their content: equal rows are drawn together
        key_ = F.col(key).cast("bigint") if key else F.xxhash64(x)
        return df.select(x.alias("x"), F.col(label).cast("double").alias("y"), weight_.alias("w"), key_.alias("key"), F.coalesce(held_, F.lit(False)).alias("held"))

    def _fit(self, df: DataFrame) -> BoostedTrees:
        ship(df.sparkSession)
        rows = self._rows(df)
        fitted = rows.where(~F.col("held"))
        head = fitted.agg(F.max(F.size("x")).alias("width"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("pos")).first()
        if not head["w"]:
            raise ValueError("no rows to fit")
        edges = quantile_edges(fitted, head["width"], self.bins)
        share = min(max(head["pos"] / head["w"], EPS), 1 - EPS)
        start = float(np.log(share / (1 - share))) if self.start is None else self.start
        landed = land(_blocks(rows, edges, start), "boosting-blocks")
        blocks = landed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)  # a lost copy is read again
        trees: list[Tree] = []
        waiting = 0  # trees that the landed margins do not hold
        losses: list[float] = []
        for r in range(self.rounds + (self.patience is not None)):
            tree, loss = self._grow(blocks, trees[len(trees) - waiting :], edges, r)
            if loss is not None:  # of the trees so far, without this one
                losses.append(loss)
                best = int(np.argmin(losses))
                if self.patience is not None and (len(losses) - 1 - best >= self.patience or r == self.rounds):
                    trees = trees[:best]
                    break
            if r == self.rounds:
                break
            trees.append(tree)
            waiting += 1
            if len(tree.feature) == 1 and self.growth.subsample >= 1 and self.growth.colsample >= 1:
                break  # nothing gains any more
            if waiting == REFRESH:
                landed = land(_with_margins(landed, trees[-waiting:]), "boosting-blocks")
                blocks.unpersist()
                blocks, waiting = landed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK), 0
        blocks.unpersist()
        model = BoostedTrees()
        model._set(featuresCol=self.getOrDefault("featuresCol"), trees=json.dumps([vars(t) for t in trees]), edges=json.dumps([e.tolist() for e in edges]), start=start, losses=losses)
        return model

    def _grow(self, blocks: RDD, recent: list[Tree], edges: list[np.ndarray], r: int) -> tuple[Tree, float | None]:
        growth, tree, open_, loss = self.growth, Tree(), [0], None
        columns = _columns_drawn(len(edges), growth.colsample, self.seed * 1009 + 2 * r)
        bins = [len(e) + 1 for e in edges]
        for _ in range(growth.depth):
            found = _level(blocks, recent, tree, open_, columns, bins, growth, self.objective, self.seed * 1009 + 2 * r + 1).collect()  # nodes x features entries
            best: dict[int, tuple] = {}
            for s in sorted(found, key=lambda s: s[0]):
                feature, node, gain, _, _, left, _ = s
                if feature < 0:
                    loss = loss if loss is not None else (left[0] / left[1] if left[1] else None)
                elif gain > MIN_GAIN and (node not in best or gain > best[node][2]):
                    best[node] = s
            chosen = sorted(best.values(), key=lambda s: (-s[2], s[1]))[: growth.leaves - (len(tree.feature) + 1) // 2]
            following = []
            for feature, node, gain, cut, gap_left, left, total in sorted(chosen, key=lambda s: s[1]):
                left, total = np.array(left), np.array(total)
                values = tuple(float(-growth.rate * side[0] / (side[1] + growth.l2)) for side in (left, total - left))
                at = tree.split(open_[node], feature, cut, gap_left, gain, values)
                following += [at, at + 1]
            open_ = following
            if not open_:
                break
        return tree, loss


class BoostedTrees(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction. All it has learned are parameters, so it is saved and loaded like any stage."""

    trees = Param(Params._dummy(), "trees", "nodes of all trees, as JSON", TypeConverters.toString)
    edges = Param(Params._dummy(), "edges", "upper bin edges per feature, as JSON", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)
    losses = Param(Params._dummy(), "losses", "held-out loss before each round", TypeConverters.toListFloat)

    def learned(self) -> list[Tree]:
        return [Tree(**t) for t in json.loads(self.getOrDefault("trees"))]

    def importance(self) -> list[float]:
        """Total gain per feature."""
        out = [0.0] * len(json.loads(self.getOrDefault("edges")))
        for t in self.learned():
            for j, gain in zip(t.feature, t.gain):
                if j >= 0:
                    out[j] += gain
        return out

    def margin(self, x: Column) -> Column:
        trees, edges, start = self.learned(), [np.array(e) for e in json.loads(self.getOrDefault("edges"))], self.getOrDefault("start")

        @pandas_udf("double")
        def sums(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            bins = bin_rows(np.array(rows.tolist(), float).reshape(len(rows), len(edges)), edges)
            return pd.Series(sum((t.margins(bins) for t in trees), np.full(len(rows), start)))

        return sums(x)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        c = self.getOrDefault("featuresCol")
        x = F.col(c) if dict(df.dtypes)[c].startswith("array") else vector_to_array(F.col(c))
        margin = self.margin(F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))))
        out = df.withColumn("_margin", margin)
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))), "probability": array_to_vector(F.array(1.0 - p, p)),
            "prediction": (F.col("_margin") > 0).cast("double"),
        }).drop("_margin")
