"""Repeatable pseudo-random draws computed from row keys.

``rand()`` depends on partitioning and on task retries, so a lost executor could change a sample. These draws
depend on the key only. The arithmetic stays inside signed 64-bit and inside code generation, and any SQL engine
can repeat it, which makes samplers and bootstraps checkable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRIME = 2147483647


def _rounds(key: str, seed: int) -> list[str]:
    """The steps of the scramble as SQL over the previous step; two multiplications of neighbours make it non-linear.

    The part of the key beyond PRIME enters between them, so that keys PRIME apart do not repeat each other's draws.
    """
    return [
        f"(pmod({key}, {PRIME}) * 48271 + {seed * 7919 + 12345}) % {PRIME}",
        f"(_x * (_x + 1) + 1013904223 + pmod({key} div {PRIME}, {PRIME})) % {PRIME}",
        f"(_x * (_x + 3) + 374761393) % {PRIME}",
        f"(_x * 16807) % {PRIME}",
    ]


def with_mix(df: DataFrame, name: str, key: Column, seed: int = 0) -> DataFrame:
    """Add an integer in [0, PRIME) drawn from a non-negative integer key.

    One projection per step keeps the expression small: written as a single tree, each step would double it.
    """
    df = df.withColumn("_k", key.cast("bigint"))
    for i, step in enumerate(_rounds("_k", seed)):
        df = df.withColumn("_x", F.expr(step))
    return df.withColumnRenamed("_x", name).drop("_k")


def with_uniform(df: DataFrame, name: str, key: Column, seed: int = 0) -> DataFrame:
    """Add a double in [0, 1)."""
    return with_mix(df, "_m", key, seed).withColumn(name, F.col("_m") / F.lit(float(PRIME))).drop("_m")


def with_pair_uniform(df: DataFrame, name: str, a: Column, b: Column, seed: int = 0) -> DataFrame:
    """Add a double in [0, 1) from two keys; the first is scrambled so that neighbouring keys do not overlap."""
    df = with_mix(df, "_p", a, 17).withColumn("_q", F.col("_p") * 40503 + b.cast("bigint"))
    return with_uniform(df, name, F.col("_q"), seed).drop("_p", "_q")


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution."""
    out = F.lit(0)
    for bound in poisson_bounds():
        out = out + (u >= F.lit(bound)).cast("int")
    return out


def poisson_bounds() -> list[float]:
    """Cumulative probabilities of the counts 0, 1, ... to twelve digits, as far as they are below 1: no draw is finer than that."""
    bounds, cum, term, k = [], 0.0, 0.36787944117144233, 0
    while round(cum + term, 12) < 1.0:
        cum += term
        bounds.append(round(cum, 12))
        k += 1
        term /= k
    return bounds


