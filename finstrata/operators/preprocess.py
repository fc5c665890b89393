"""Column-wise preparation as Spark ML stages: clipping, power and quantile transforms.

Bounds, exponents and quantile tables are learned from the rows given to ``fit`` only; they are a few numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import RobustScaler, StandardScaler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.ordered import quantile_columns, quantile_grid
from ..session import ship

WINSOR_METHODS = ("none", "iqr", "p1p99")
SCALERS = ("none", "standard", "robust", "power", "quantile")


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to transform in place", TypeConverters.toListString)

    def _long(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("inputCols")
        return df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "feature", "value")


class _WinsorParams(_Columns):
    method = Param(Params._dummy(), "method", "none | iqr | p1p99", TypeConverters.toString)
    factor = Param(Params._dummy(), "factor", "multiple of the quartile range", TypeConverters.toFloat)
    low = Param(Params._dummy(), "low", "lower percentile", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "upper percentile", TypeConverters.toFloat)


class Winsorizer(Estimator, _WinsorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Clip to bounds learned from the fitted rows: quartiles +- factor * range, or two percentiles."""

    @keyword_only
    def __init__(self, *, inputCols=None, method="iqr", factor=1.5, low=1.0, high=99.0):
        super().__init__()
        self._setDefault(method="iqr", factor=1.5, low=1.0, high=99.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "WinsorizerModel":
        cols, method = self.getOrDefault("inputCols"), self.getOrDefault("method")
        if method not in WINSOR_METHODS:
            raise ValueError(f"unknown method {method!r}; known: {WINSOR_METHODS}")
        lower, upper = [-math.inf] * len(cols), [math.inf] * len(cols)
        if method != "none":
            probs = {"a": 0.25, "b": 0.75} if method == "iqr" else {"a": self.getOrDefault("low") / 100, "b": self.getOrDefault("high") / 100}
            for r in quantile_columns(self._long(df), "value", probs, ["feature"]).collect():
                spread = (r["b"] - r["a"]) * self.getOrDefault("factor") if method == "iqr" else 0.0
                i = cols.index(r["feature"])
                lower[i], upper[i] = r["a"] - spread, r["b"] + spread
        model = WinsorizerModel()
        model._set(inputCols=cols, lower=lower, upper=upper)
        return model


class WinsorizerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    lower = Param(Params._dummy(), "lower", "lower bounds", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "upper bounds", TypeConverters.toListFloat)

    def bounds(self) -> list[tuple[str, float, float]]:
        return list(zip(self.getOrDefault("inputCols"), self.getOrDefault("lower"), self.getOrDefault("upper")))

    def _transform(self, df: DataFrame) -> DataFrame:
        # greatest and least skip NULL, so a missing value is kept apart
        clip = lambda c, lo, hi: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)))
        return df.withColumns({c: clip(c, lo, hi) for c, lo, hi in self.bounds()})

    def clip_share(self, df: DataFrame) -> DataFrame:
        """Share of known values outside the bounds, per column."""
        aggs = [F.try_divide(F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("double")), F.count(c).cast("double")).alias(c) for c, lo, hi in self.bounds()]
        return df.agg(*aggs).unpivot([], self.getOrDefault("inputCols"), "feature", "clip_share")


#: Values of a column that a task holds before it sums them up, and the points that stand for them: each for at most HELD / POINTS values.
HELD, POINTS = 1 << 18, 10_000


def _points(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in order with how many each stands for: all of them while they are few, else the middles of equal stretches."""
    v = np.sort(v)
    edges = np.linspace(0, len(v), min(len(v), POINTS) + 1).astype(np.int64)
    return v[(edges[:-1] + edges[1:] - 1) // 2], np.diff(edges)


def _value_points(batches):
    """(j, v, n) of Arrow batches: column number, value, weight. A task holds at most HELD values of a column, besides a batch."""
    held: list[pa.RecordBatch] = []

    def flush():
        whole = pa.Table.from_batches(held)
        held.clear()
        for j, c in enumerate(whole.columns):
            v, n = _points(c.drop_null().to_numpy())
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(n)], ["j", "v", "n"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD:
            yield from flush()
    if held:
        yield from flush()


def sketched_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The lower median of each column, exact up to POINTS rows a task, else off by at most a share of 1 / (2 * POINTS) of the rows.

    Tasks sort their values and hand on points; a column's points are put in order apart from the other columns'. NaN counts as the largest value.
    """
    ship(df.sparkSession)
    points = df.select([F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(cols)]).mapInArrow(_value_points, "j int, v double, n bigint")
    return {cols[r["j"]]: r["m"] for r in _weighted_medians(points).collect()}


def _weighted_medians(points: DataFrame) -> DataFrame:
    """(j, m): the smallest value at or below which lies half of the weight. A column has at most POINTS rows per task or HELD values."""
    t = points.groupBy("j", "v").agg(F.sum("n").alias("n"))
    w = W.partitionBy("j")
    t = t.select("j", "v", F.sum("n").over(w.orderBy("v").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
    return t.where(2 * F.col("upto") >= F.col("all")).groupBy("j").agg(F.min("v").alias("m"))


class MedianFill(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing values with the column's median; a column without any known value gets 0 (the built-in imputer fails there).

    One pass with points that stand for each task's values, or exact interpolated medians on request.
    """

    outputCols = Param(Params._dummy(), "outputCols", "columns to add", TypeConverters.toListString)
    exact = Param(Params._dummy(), "exact", "interpolated median", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, exact=False):
        super().__init__()
        self._setDefault(exact=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "MedianFillModel":
        cols = self.getOrDefault("inputCols")
        if self.getOrDefault("exact"):
            got = {r["feature"]: r["m"] for r in quantile_columns(self._long(df), "value", {"m": 0.5}, ["feature"]).collect()}
        else:
            got = sketched_medians(df, cols)
        model = MedianFillModel()
        model._set(inputCols=cols, outputCols=self.getOrDefault("outputCols"), medians=[float(got.get(c) or 0.0) for c in cols])
        return model


class MedianFillModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    outputCols = Param(Params._dummy(), "outputCols", "columns to add", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "fill values", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = zip(*(self.getOrDefault(p) for p in ("inputCols", "outputCols", "medians")))
        known = lambda c: F.when(~F.isnan(c), c)
        return df.withColumns({o: F.coalesce(known(F.col(c).cast("double")), F.lit(m)) for c, o, m in rows})


def yeo_johnson(c: Column, lam: Column | float) -> Column:
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(c)).otherwise((F.pow(c + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, F.lit(1.0)).otherwise(lam))
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < 1e-12, -F.log1p(-c)).otherwise(-(F.pow(1 - c, two) - 1) / F.when(F.abs(two) < 1e-12, F.lit(1.0)).otherwise(two))
    return F.when(c >= 0, pos).otherwise(neg)


class PowerNormal(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Yeo-Johnson with the exponent of highest likelihood, found on a grid refined twice; one pass over the data per grid."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "PowerNormalModel":
        cols = self.getOrDefault("inputCols")
        known = self._long(df).where("value is not null")
        best, step = {c: 1.0 for c in cols}, 0.5
        grids = {c: [x * 0.5 for x in range(-6, 11)] for c in cols}
        moments: dict[str, tuple[float, float]] = {}
        for _ in range(3):
            arr = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in grids[c]]))])
            t = known.select("feature", "value", F.explode(arr[F.col("feature")]).alias("lam"))
            t = t.withColumn("z", yeo_johnson(F.col("value"), F.col("lam")))
            jac = F.signum("value") * F.log1p(F.abs("value"))
            g = t.groupBy("feature", "lam").agg(F.count(F.lit(1)).alias("n"), F.var_pop("z").alias("v"), F.avg("z").alias("m"), F.sum(jac).alias("j"))
            g = g.where("v > 0").withColumn("ll", -F.col("n") / 2.0 * F.ln("v") + (F.col("lam") - 1.0) * F.col("j"))
            for r in g.groupBy("feature").agg(F.max_by(F.struct("lam", "m", "v"), "ll").alias("b")).collect():
                best[r["feature"]] = r["b"]["lam"]
                moments[r["feature"]] = (r["b"]["m"], math.sqrt(r["b"]["v"]))
            grids = {c: [best[c] + step * k / 4 for k in range(-4, 5)] for c in cols}
            step /= 4
        model = PowerNormalModel()
        model._set(inputCols=cols, lambdas=[best[c] for c in cols], means=[moments.get(c, (0.0, 1.0))[0] for c in cols],
                   sds=[moments.get(c, (0.0, 1.0))[1] or 1.0 for c in cols])
        return model


class PowerNormalModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    lambdas = Param(Params._dummy(), "lambdas", "exponents", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means after the transform", TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "deviations after the transform", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = zip(*(self.getOrDefault(p) for p in ("inputCols", "lambdas", "means", "sds")))
        return df.withColumns({c: (yeo_johnson(F.col(c).cast("double"), lam) - m) / s for c, lam, m, s in rows})


class QuantileNormal(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Map values to normal scores through the quantiles of the fitted rows."""

    steps = Param(Params._dummy(), "steps", "quantile steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, steps=199):
        super().__init__()
        self._setDefault(steps=199)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "QuantileNormalModel":
        cols, steps = self.getOrDefault("inputCols"), self.getOrDefault("steps")
        flat: dict[str, list[float]] = {c: [] for c in cols}
        grid = quantile_grid(self._long(df), "value", steps, ["feature"])
        for r in grid.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("q")).collect():
            flat[r["feature"]] = [x["q"] for x in r["q"]]
        model = QuantileNormalModel()
        model._set(inputCols=cols, table=[v for c in cols for v in (flat[c] or [0.0] * (steps + 1))], width=steps + 1)
        return model


class QuantileNormalModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    table = Param(Params._dummy(), "table", "quantiles of all columns, one after the other", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "quantiles per column", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, w = self.getOrDefault("inputCols"), self.getOrDefault("width")
        tab = np.array(self.getOrDefault("table")).reshape(len(cols), w)

        def stage(q: np.ndarray):
            levels = np.linspace(0.0, 1.0, len(q))
            ppf = NormalDist().inv_cdf

            @pandas_udf("double")
            def score(v: pd.Series) -> pd.Series:
                x = v.to_numpy(dtype=float)
                # the mean of both interpolation directions treats runs of equal quantiles evenly
                u = 0.5 * (np.interp(x, q, levels) - np.interp(-x, -q[::-1], -levels[::-1]))
                u = np.clip(u, 1e-7, 1 - 1e-7)
                return pd.Series([None if np.isnan(a) else ppf(b) for a, b in zip(x, u)], dtype="float64")

            return score

        return df.withColumns({c: stage(tab[i])(F.col(c).cast("double")) for i, c in enumerate(cols)})


def column_scaler(kind: str, cols: Sequence[str]) -> Estimator | None:
    """Scalers that work on columns, before assembly."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; known: {SCALERS}")
    return {"power": lambda: PowerNormal(inputCols=list(cols)), "quantile": lambda: QuantileNormal(inputCols=list(cols))}.get(kind, lambda: None)()


def vector_scaler(kind: str, source: str, target: str) -> Estimator | None:
    """Scalers that work on the assembled vector."""
    if kind == "standard":
        return StandardScaler(inputCol=source, outputCol=target, withMean=True, withStd=True)
    if kind == "robust":
        return RobustScaler(inputCol=source, outputCol=target, withCentering=True, withScaling=True, lower=0.25, upper=0.75)
    return None
