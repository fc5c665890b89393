"""Exact k-nearest-neighbour join over two levels of pivots.

1. Equal vectors are searched once and, on the side searched, stand for as many of their lowest ids as any query can need.
2. About sqrt(n) pivots, a hash sample of the base, split the space; about sqrt(pivots) of them are centres of groups of pivots. A row goes to the
   nearest group, then to the group's nearest pivot: 2 * n^(1/4) distances a row. The assignment need not be the nearest of all pivots, because
   what is pruned by are the radii measured afterwards.
3. Neighbouring cells are packed into slices of at most ``block`` rows; a larger cell is several slices. Each query searches its own slice; the k-th
   distance found bounds its radius.
4. It then goes to those other slices that hold a cell which the triangle inequality cannot rule out within that radius: the closest first, in rounds that
   each hand on a bounded number of copies of the queries, and no further than the radius that the rounds before have left.

Tables of all sizes take this path. What is exchanged are rows x slices, not rows x cells, so it stays small even where dimensions are many and little can be
ruled out. A task sees one slice and at most ``block`` queries as arrays, goes through the slice cell by cell, skips the queries that a cell cannot serve, screens
the others by a matrix product and measures what is left exactly. It returns the best candidates of a query: pairs are never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.draws import with_mix
from ..session import ship
from ..sources.landing import drop_landed, land

MAX_PIVOTS, LEAST_CELL = 1 << 16, 256
LEAST_BLOCK, MOST_BLOCK, TILE = 2048, 1 << 15, 2048
SCREEN = 1e-9  # of the squared lengths: far above what a matrix product rounds
SLACK = 1e-12  # rounding of distances
COPIES = 8  # of all queries that a round hands on to other slices


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row Euclidean distances in slices that stay within a few megabytes."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


@dataclass
class Pivots:
    """Pivots in the order of their groups: group g holds the pivots first[g] to first[g + 1]."""

    groups: np.ndarray
    pivots: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Pivots:
        heads = points[:max(1, math.isqrt(len(points)))]
        home = _distances(points, heads).argmin(axis=1)
        used, sizes = np.unique(home, return_counts=True)
        return cls(heads[used], points[np.argsort(home, kind="stable")], np.append(0, sizes.cumsum()))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, its distance to the cell's pivot and to the group's centre."""
        far = _distances(x, self.groups)
        group = far.argmin(axis=1)
        cell, near = np.empty(len(x), np.int64), np.empty(len(x))
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            d = _distances(x[rows], self.pivots[self.first[g]:self.first[g + 1]])
            cell[rows], near[rows] = self.first[g] + d.argmin(axis=1), d.min(axis=1)
        return cell, near, far[np.arange(len(x)), group]

    def cells_of(self, groups: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in groups]) if len(groups) else np.empty(0, np.int64)


@dataclass
class Cells:
    """Rows and radius of every cell, and of every group."""

    at: Pivots
    sizes: np.ndarray
    radii: np.ndarray
    group_sizes: np.ndarray
    group_radii: np.ndarray

    @classmethod
    def of(cls, at: Pivots, rows: list) -> Cells:
        sizes, radii, reach = np.zeros(len(at.pivots), np.int64), np.zeros(len(at.pivots)), np.zeros(len(at.pivots))
        for r in rows:
            sizes[r["cell"]], radii[r["cell"]], reach[r["cell"]] = r["n"], r["near"], r["far"]
        return cls(at, sizes, radii, np.add.reduceat(sizes, at.first[:-1]), np.maximum.reduceat(reach, at.first[:-1]))

    def nearest_to(self, x: np.ndarray, need: int) -> list[np.ndarray]:
        """For each row the closest cells that hold ``need`` rows together (all if there are fewer), taken from the closest groups that do."""
        far = _distances(x, self.at.groups)
        out = []
        for row, d in zip(x, far):
            order = np.argsort(d, kind="stable")
            groups = order[:int(np.searchsorted(self.group_sizes[order].cumsum(), need)) + 1]
            cells = self.at.cells_of(groups)
            cells = cells[self.sizes[cells] > 0]
            cells = cells[np.argsort(_distances(row[None, :], self.at.pivots[cells])[0], kind="stable")]
            out.append(cells[:int(np.searchsorted(self.sizes[cells].cumsum(), need)) + 1])
        return out

    def within(self, x: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
        """For each row the cells that may hold a row at most ``limit`` away."""
        far = _distances(x, self.at.groups)
        out = []
        for row, d, limit in zip(x, far, limits):
            cells = self.at.cells_of(np.flatnonzero((self.group_sizes > 0) & (d * (1 - SLACK) - self.group_radii <= limit * (1 + SLACK))))
            near = _distances(row[None, :], self.at.pivots[cells])[0]
            out.append(cells[(self.sizes[cells] > 0) & (near * (1 - SLACK) - self.radii[cells] <= limit * (1 + SLACK))])
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class _Top:
    """The closest rows found for each query, ties by id; ``limits`` are distances beyond which nothing is wanted."""

    def __init__(self, limits: np.ndarray, most: int):
        self.limits, self.most = limits.copy(), most
        self.dist, self.at = np.full((len(limits), most), np.inf), np.full((len(limits), most), -1)

    def add(self, rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> None:
        """``at``: places of base rows, in the order of their ids."""
        some, back = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(some)), self.most), back])
        at, dist = np.concatenate([self.at[some].ravel(), at]), np.concatenate([self.dist[some].ravel(), dist])
        order = np.lexsort((at, dist, row))
        row, at, dist = row[order], at[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.most
        self.at[some[row[keep]], place[keep]], self.dist[some[row[keep]], place[keep]] = at[keep], dist[keep]
        self.limits[some] = np.minimum(self.limits[some], self.dist[some, -1])


def _screened(x: np.ndarray, y: np.ndarray, limits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be within their limits, and among the closest of their query."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    near = x @ y.T
    near -= yy / 2.0  # the squared distance is xx - 2 near
    slack = SCREEN * (xx + yy.max())
    bound = limits * limits * (1 + SCREEN)
    free = np.isinf(limits)
    if most < len(y) and free.any():  # a query has ``most`` rows at least as close as the one at this place
        bound[free] = xx[free] - 2.0 * np.partition(near[free], len(y) - most, axis=1)[:, len(y) - most] + slack[free]
    return np.nonzero(near >= ((xx - bound - slack) / 2.0)[:, None])


def _search(most: int, cells: Broadcast):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("nid", "ascending")])
        x, y = (_matrix(t[c]) if t.num_rows else np.empty((0, 0)) for t, c in ((left, "qx"), (right, "x")))
        q, home, n, cell = (t[c].to_numpy() for t, c in ((left, "qid"), (left, "home"), (right, "nid"), (right, "cell")))
        top = _Top(left["radius"].to_numpy().astype(float), most)
        if len(x) and len(y):
            usable = np.isfinite(x).all(axis=1)  # other rows are at no finite distance from any
            middle = cells.value.at.pivots[cell[0]]
            middle = np.where(np.isfinite(middle), middle, 0.0)
            near_x, near_y = x - middle, y - middle
            runs = {int(c): np.flatnonzero((cell == c) & np.isfinite(y).all(axis=1)) for c in np.unique(cell)}
            for at_home in (True, False):  # the rows of its own cell give a query its first bound
                for c, rows in runs.items():
                    asked = usable & ((home == c) == at_home)
                    if not at_home:
                        reach = _distances(x, cells.value.at.pivots[c][None, :])[:, 0] * (1 - SLACK) - cells.value.radii[c]
                        asked &= ~(reach > top.limits * (1 + SLACK))
                    asked = np.flatnonzero(asked)
                    for i in range(0, len(asked), TILE):
                        for j in range(0, len(rows), TILE):
                            some, part = asked[i:i + TILE], rows[j:j + TILE]
                            a, b = _screened(near_x[some], near_y[part], top.limits[some], most)
                            a, b = some[a], part[b]
                            dist = np.concatenate([np.sqrt(((x[a[s:s + 65536]] - y[b[s:s + 65536]]) ** 2).sum(axis=1)) for s in range(0, len(a), 65536)] or [np.empty(0)])
                            fits = np.isfinite(dist) & (dist <= top.limits[a])
                            top.add(a[fits], b[fits], dist[fits])
        found = top.at >= 0
        at = top.at[found]
        return pa.table({"qid": pa.array(np.repeat(q, found.sum(axis=1)), pa.int64()), "nid": pa.array(n[at], pa.int64()), "dist": pa.array(top.dist[found], pa.float64()),
                         "copies": pa.array(right["copies"].to_numpy()[at], pa.int64())})

    return run


def _slices(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First slice and number of slices of each cell, and the cell and slice of every pair of them (slices ascending): cells of at most ``block`` rows share
    a slice with those beside them."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    at, held = -1, block
    for c, size in enumerate(sizes):
        if held + size > block:
            at, held = at + 1, 0
        first[c] = at
        at, held = at + int(parts[c]) - 1, block if parts[c] > 1 else held + size
    owners = np.repeat(np.arange(len(sizes)), parts)
    return first, parts, np.stack([owners, first[owners] + np.arange(len(owners)) - np.repeat(parts.cumsum() - parts, parts)])


def _best(cands: DataFrame, k: int) -> DataFrame:
    """The k closest candidates of each query, ties by id, with their rank. Spark limits the ranks in every task before it exchanges rows."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist", "nid"))
    return cands.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass
class Index:
    """The rows of a base, landed cell by cell; searches that find up to ``need`` rows for each query share it."""

    placed: DataFrame | None
    need: int
    block: int
    cells: Broadcast | None
    layout: Broadcast | None
    where: DataFrame | None

    @classmethod
    def of(cls, base: DataFrame, k: int, exclude_self: bool = True, block: int | None = None, pivots: int | None = None) -> Index:
        """The driver holds the pivots with a count and two radii of each cell: sqrt(n) of them, at most ``MAX_PIVOTS``."""
        spark = base.sparkSession
        ship(spark)
        single = base.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies"))
        need = k
        if exclude_self:  # a query passes over as many rows as bear its id
            need += single.where("id is not null").groupBy("id").count().agg(F.max("count")).first()[0] or 0
        lowest = F.row_number().over(W.partitionBy(F.xxhash64("x"), "x").orderBy("id"))
        with _Landed() as own:
            kept = own.land(single.withColumn("_r", lowest).where(F.col("_r") <= need).select("id", "x", "copies"), "searched-rows")
            n = kept.count()
            p = pivots or max(1, min(math.isqrt(n), n // LEAST_CELL, MAX_PIVOTS))
            block = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // spark.sparkContext.defaultParallelism)))
            picked = with_mix(kept.select("id", "x"), "_h", F.col("id"), 23).orderBy("_h", "id").limit(p).collect()
            if not picked:
                return cls(None, need, block, None, None, None)
            at = spark.sparkContext.broadcast(Pivots.of(np.array([r["x"] for r in picked], dtype=float)))
            home = _home(at)
            placed = land(kept.select(F.col("id").alias("nid"), "x", "copies", home("x").alias("h")).select("nid", "x", "copies", "h.*"), "placed-rows")
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("near"), F.max("far").alias("far")).collect()
        held = Cells.of(at.value, stats)
        first, parts, pairs = _slices(held.sizes, block)
        layout = (pairs[0], np.flatnonzero(np.append(True, np.diff(pairs[1]) > 0)))
        where = spark.createDataFrame([(c, int(f), int(m)) for c, (f, m) in enumerate(zip(first, parts))], "cell int, first int, parts int")  # a row a cell
        return cls(placed, need, block, spark.sparkContext.broadcast(held), spark.sparkContext.broadcast(layout), F.broadcast(where))

    def in_slice(self, rows: DataFrame, key: Column) -> DataFrame:
        mixed = with_mix(rows.join(self.where, "cell"), "_m", F.abs(key), 29)
        return mixed.withColumn("slice", (F.col("first") + F.col("_m") % F.col("parts")).cast("int")).drop("_m", "first", "parts")

    def search(self, asked: DataFrame, counted: DataFrame) -> DataFrame:
        """``asked``: qid, qx, home, radius, slice. ``counted``: the same slices, without what is dear."""
        crowds = F.broadcast(counted.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.block)).cast("int").alias("crowds")))  # a row a slice
        left = with_mix(asked.join(crowds, "slice"), "_m", F.abs("qid"), 31).withColumn("crowd", (F.col("_m") % F.col("crowds")).cast("int"))
        right = self.in_slice(self.placed.select("nid", "x", "copies", "cell"), F.col("nid")).join(crowds, "slice").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
        left = left.select("qid", "qx", "home", "radius", F.col("slice").alias("qslice"), F.col("crowd").alias("qcrowd"))
        right = right.select("nid", "x", "copies", "cell", "slice", "crowd")
        return left.groupBy("qslice", "qcrowd").cogroup(right.groupBy("slice", "crowd")).applyInArrow(_search(self.need, self.cells), "qid long, nid long, dist double, copies long")

    def drop(self) -> None:
        if self.placed is not None:
            drop_landed(self.placed)


class _Landed:
    """Landed tables that are deleted at the end: what is left must not read them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def land(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(land(df, name))
        return self.tables[-1]

    def drop(self, keep: int = 0) -> None:
        while len(self.tables) > keep:
            drop_landed(self.tables.pop(0))

    def __enter__(self) -> _Landed:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()


def _home(at: Broadcast):
    @pandas_udf("cell int, near double, far double")
    def home(x: pd.Series) -> pd.DataFrame:
        cell, near, far = at.value.home(np.stack(x.to_numpy()))
        return pd.DataFrame({"cell": cell.astype("int32"), "near": near, "far": far})

    return home


def _further(cells: Broadcast, layout: Broadcast):
    @pandas_udf("array<struct<least:double,slice:int>>")
    def further(x: pd.Series, seen: pd.Series, radius: pd.Series) -> pd.Series:
        """The slices with a cell that may hold a row within the radius, by the least distance such a row may have."""
        owners, starts = layout.value
        points, limits, done, out = np.stack(x.to_numpy()), radius.to_numpy(), seen.to_numpy(), []
        step = max(1, 4_000_000 // len(owners))
        for i in range(0, len(points), step):
            reach = _distances(points[i:i + step], cells.value.at.pivots) * (1 - SLACK) - cells.value.radii
            reach[:, cells.value.sizes == 0] = np.inf
            reach[reach > limits[i:i + step, None] * (1 + SLACK)] = np.inf
            reach = np.where(np.isnan(reach), -np.inf, reach)  # nothing is known of such a cell
            least = np.minimum.reduceat(reach[:, owners], starts, axis=1)
            least[np.arange(len(least)), done[i:i + step]] = np.inf
            for row in least:
                order = np.argsort(row, kind="stable")[:int((row < np.inf).sum())]
                out.append([{"least": float(row[s]), "slice": int(s)} for s in order])
        return pd.Series(out)

    return further


def nearest(query: DataFrame, base: DataFrame | Index, k: int, exclude_self: bool = True, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """(id, nid, rank, dist) for the k nearest base rows of every query row; both have ``id`` and ``x`` (array<double>).

    Ties by id. The result is landed: samplers read it several times. All else that is landed on the way is deleted; an index that is given stays.
    """
    spark = query.sparkSession
    ship(spark)
    index = base if isinstance(base, Index) else Index.of(base, k, exclude_self, block, pivots)
    if index.placed is None:
        return spark.createDataFrame([], "id long, nid long, rank int, dist double")
    need = index.need
    home = _home(spark.sparkContext.broadcast(index.cells.value.at))
    with _Landed() as own, _Landed() as rounds:
        distinct = query.select(F.col("x").alias("qx")).distinct().select(F.monotonically_increasing_id().alias("qid"), "qx", home("qx")["cell"].alias("cell"))
        asked = own.land(index.in_slice(distinct.withColumn("home", F.col("cell")), F.col("qid")).select("qid", "qx", "home", "slice"), "asked-rows")
        found = rounds.land(_best(index.search(asked.withColumn("radius", F.lit(math.inf)), asked), need), "near-rows")
        radius = lambda: F.coalesce("radius", F.lit(math.inf)).alias("radius")
        bound = lambda: found.where(F.col("rank") == need).select("qid", F.col("dist").alias("radius"))
        wider = asked.join(bound(), "qid", "left").withColumn("radius", F.coalesce("radius", F.lit(math.inf)))
        left = land(wider.select("qid", _further(index.cells, index.layout)("qx", "slice", "radius").alias("slices")).where(F.size("slices") > 0), "asked-further")
        queries = None
        while open_ := left.count():
            queries = queries or asked.count()
            many = max(1, COPIES * queries // open_)  # slices a query goes to in this round
            now = left.select("qid", F.explode(F.slice("slices", 1, many)).alias("_s")).select("qid", F.col("_s").getField("slice").alias("slice"))
            near = asked.select("qid", "qx", "home").join(now, "qid").join(bound(), "qid", "left").select("qid", "qx", "home", radius(), "slice")
            found = rounds.land(_best(found.drop("rank").unionByName(index.search(near, now)), need), "found-rows")
            rest = F.slice("slices", F.lit(many + 1), F.greatest(F.size("slices") - many, F.lit(0)))
            narrowed = left.select("qid", rest.alias("slices")).where(F.size("slices") > 0).join(bound(), "qid", "left").withColumn("radius", F.coalesce("radius", F.lit(math.inf)))
            within = F.filter("slices", lambda s: s["least"] <= F.col("radius") * (1 + SLACK))
            left = rounds.land(narrowed.select("qid", within.alias("slices")).where(F.size("slices") > 0), "still-asked")
            rounds.drop(keep=2)  # what was found and what is left stay
            spark._jvm.System.gc()  # Spark deletes an exchange when its plan is collected
        members = query.select("id", F.col("x").alias("qx")).join(asked.select("qid", "qx"), "qx").select("id", "qid")
        each = members.join(found.drop("rank"), "qid")
        if exclude_self:
            each = each.where(F.col("id") != F.col("nid"))
        each = each.withColumn("_c", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k))))).select(F.col("id").alias("qid"), "nid", "dist")
        out = land(_best(each, k).select(F.col("qid").alias("id"), "nid", "rank", "dist"), "neighbours")
    if index is not base:
        index.drop()
    return out
