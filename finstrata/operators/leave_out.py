"""Leave-one-entity-out logistic models from shared sums, without a fit per entity.

1. One model is fitted on all training rows. One pass adds up, at its coefficients, the gradient and curvature of all rows, and the moments of the
   features that the scaling of each left-out fit follows from.
2. Rows meet by entity once. Each entity subtracts its own sums from the totals and solves for its left-out coefficients: the loss of the other
   entities is taken to second order around the joint fit, its own rows are subtracted exactly, Newton steps follow. Its later rows are scored there and then.
3. With ``MAX_REFINED`` entities at most, passes over all rows replace the second-order term by the true gradient of every left-out model, so the result
   equals separate fits. Beyond that, leaving out one of E entities moves coefficients by about 1/E, and what is neglected is of the order of its square.

Missing values take the medians of all training rows. An entity's rows are its quarters, so no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from ..sources.landing import land
from .preprocess import MedianFill

MAX_REFINED = 1024  # entities whose models are refined by passes over all rows: their coefficients are sent to all tasks
PASSES, STEPS = 8, 12


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -60.0, 60.0)))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of features with a leading one for the intercept."""
    x = np.array(rows.tolist(), float).reshape(len(rows), width)
    return np.hstack([np.ones((len(x), 1)), x])


class _Problem:
    """Totals over all training rows at the joint coefficients; features are in units of their joint spread."""

    def __init__(self, beta: np.ndarray, reg: float, n: float, grad: np.ndarray, curve: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.beta, self.reg, self.n, self.grad, self.curve, self.first, self.second = beta, reg, n, grad, curve, first, second

    def penalty(self, x: np.ndarray) -> np.ndarray:
        """Penalty per coefficient once the rows ``x`` are out: it applies to features in units of the remaining rows' spread."""
        n = self.n - len(x)
        first, second = self.first - x[:, 1:].sum(axis=0), self.second - (x[:, 1:] ** 2).sum(axis=0)
        return np.append(0.0, self.reg * np.maximum(second - first**2 / n, 0.0) / max(n - 1, 1))

    def without(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, inverse curvature, penalty) once these rows are out. Sums are divided by the rows that remain."""
        n, penalty = self.n - len(x), self.penalty(x)
        beta = self.beta.copy()
        for _ in range(STEPS):
            p = _sigmoid(x @ beta)
            grad = (self.grad + self.curve @ (beta - self.beta) - x.T @ (p - y)) / n + penalty * beta
            own = p * (1 - p)
            curve = (self.curve - x.T @ (x * own[:, None])) / n + np.diag(penalty + 1e-12)
            step = np.linalg.solve(curve, grad)
            beta = beta - step
            if np.abs(step).max() < 1e-10:
                break
        return beta, np.linalg.pinv(curve), penalty


def _totals(train: DataFrame, beta: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows, gradient, curvature, sums and sums of squares: width^2 numbers a task, added up by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + (width + 1) + (width + 1) ** 2 + 2 * width
        out = np.zeros(size)
        for batch in batches:
            t = batch.to_pandas()
            x, y = _matrix(t["x"], width), t["y"].to_numpy(float)
            p = _sigmoid(x @ beta)
            out += np.concatenate([[len(x)], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel(), x[:, 1:].sum(axis=0), (x[:, 1:] ** 2).sum(axis=0)])
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["i", "v"])

    parts = train.select("x", "y").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r["v"] for r in sorted(parts.collect(), key=lambda r: r["i"])])
    n, grad, curve, first, second = np.split(flat, np.cumsum([1, width + 1, (width + 1) ** 2, width]))
    return float(n[0]), grad, curve.reshape(width + 1, width + 1), first, second


def _refine(train: DataFrame, state: DataFrame, entity: str, width: int) -> DataFrame:
    """One pass over all rows: the true gradient of every left-out model, and a step with the curvature at hand."""
    models = state.select(entity, "beta").collect()  # ``MAX_REFINED`` rows at most
    names, betas = {r[entity]: i for i, r in enumerate(models)}, np.array([r["beta"] for r in models])
    keys = [r[entity] for r in models]

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros_like(betas), np.zeros(len(betas))
        for batch in batches:
            t = batch.to_pandas()
            x, y = _matrix(t["x"], width), t["y"].to_numpy(float)
            off = _sigmoid(x @ betas.T) - y[:, None]
            own = np.array([names.get(e, -1) for e in t[entity]])
            known = np.flatnonzero(own >= 0)
            off[known, own[known]] = 0.0
            out += off.T @ x
            n += len(x)
            np.subtract.at(n, own[known], 1)
        yield pa.record_batch([pa.array(range(len(keys)), pa.int32()), pa.array(list(out), pa.list_(pa.float64())), pa.array(n)], names=["m", "g", "n"])

    parts = train.select(entity, "x", "y").mapInArrow(gradients, "m int, g array<double>, n double")
    each = parts.select("m", "n", F.posexplode("g").alias("j", "v")).groupBy("m", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    summed = each.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("g"), F.first("n").alias("n")).select("m", F.col("g.v").alias("g"), "n")
    numbered = train.sparkSession.createDataFrame(list(names.items()), f"{entity} {dict(state.dtypes)[entity]}, m int")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for beta, inverse, penalty, g, n in zip(t["beta"], t["inverse"], t["penalty"], t["g"], t["n"]):
                beta = np.array(beta)
                out.append(beta - np.array(inverse).reshape(len(beta), -1) @ (np.array(g) / n + np.array(penalty) * beta))
            yield t[[entity]].assign(beta=out, inverse=t["inverse"], penalty=t["penalty"])

    joined = state.join(numbered, entity).join(summed, "m").drop("m")
    return land(joined.mapInPandas(step, state.select(entity, "beta", "inverse", "penalty").schema), "left-out")


def leave_one_entity_out(df: DataFrame, cols: Sequence[str], reg: float = 0.05, entity: str = "entity", min_test: int = 4, passes: int = PASSES) -> DataFrame:
    """(entity, y, p, n_test, skipped): rows of validation and test, scored by the model of the training rows of all other entities.

    ``df``: entity, split, y, columns. An entity of the training rows with fewer than ``min_test`` later rows, or without which one class is left, is
    reported once with ``skipped``; entities without training rows are not left out of anything and not reported.
    """
    ship(df.sparkSession)
    cols, width = list(cols), len(cols)
    known = df.where(F.col("split").isin("train", "validation", "test"))
    train = known.where("split = 'train'")
    fill = MedianFill(inputCols=cols, outputCols=[f"{c}__f" for c in cols]).fit(train)
    filled = fill.transform(known).select(entity, "split", F.col("y").cast("double").alias("y"), F.array(*[f"{c}__f" for c in cols]).alias("x"))
    spread = filled.where("split = 'train'").agg(*[F.struct(F.avg(F.get("x", F.lit(j))).alias("m"), F.stddev_samp(F.get("x", F.lit(j))).alias("s")).alias(f"c{j}") for j in range(width)]).first()
    scale = F.array(*[F.struct(F.lit(float(c["m"] or 0.0)).alias("m"), F.lit(float(c["s"] or 0.0) or 1.0).alias("s")) for c in spread])
    rows = land(filled.withColumn("x", F.zip_with("x", scale, lambda v, c: (v - c["m"]) / c["s"])), "left-out-rows")
    fit_rows = rows.where("split = 'train'")
    joint = LogisticRegression(featuresCol="v", labelCol="y", regParam=reg, maxIter=500, tol=1e-10, standardization=True).fit(fit_rows.withColumn("v", array_to_vector("x")))
    beta = np.append(joint.intercept, joint.coefficients.toArray())
    n, grad, curve, first, second = _totals(fit_rows, beta, width)
    problem = _Problem(beta, reg, n, grad, curve, first, second)
    kind = dict(rows.dtypes)[entity]
    positives = float(fit_rows.agg(F.sum("y")).first()[0] or 0)

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        own = t[t["split"] == "train"]
        n_test, left = len(t) - len(own), positives - own["y"].sum()
        row = {entity: [t[entity].iloc[0]], "skipped": [bool(n_test < min_test or left <= 0 or left >= n - len(own))], "n_test": [n_test]}
        if row["skipped"][0]:
            return pd.DataFrame({**row, "beta": [None], "inverse": [None], "penalty": [None]})
        found, inverse, penalty = problem.without(_matrix(own["x"], width), own["y"].to_numpy())
        return pd.DataFrame({**row, "beta": [found], "inverse": [inverse.ravel()], "penalty": [penalty]})

    numbers = "beta array<double>, inverse array<double>, penalty array<double>"
    taught = rows.join(fit_rows.select(F.col(entity)).distinct(), entity, "left_semi")
    solved = land(taught.groupBy(entity).applyInPandas(solve, f"{entity} {kind}, skipped boolean, n_test long, {numbers}"), "left-out")
    state = solved.where("not skipped").select(entity, "beta", "inverse", "penalty")
    if passes and 0 < state.count() <= MAX_REFINED:
        for _ in range(passes):
            state = _refine(fit_rows, state, entity, width)
    margin = F.aggregate(F.zip_with("x", F.slice("beta", F.lit(2), F.lit(width)), lambda v, w: v * w), F.get("beta", F.lit(0)), lambda a, v: a + v)
    later = rows.where("split <> 'train'").join(state.select(entity, "beta"), entity).select(entity, "y", (1.0 / (1.0 + F.exp(-margin))).alias("p"))
    out = solved.select(entity, "skipped", "n_test").join(later, entity, "left")
    return out.select(entity, F.col("y").cast("int").alias("y"), "p", "n_test", "skipped")
