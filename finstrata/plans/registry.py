"""Where query modules register a Spark query together with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import ship
from .views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def canonical(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: integers as BIGINT, flags as 0/1, doubles rounded, as the last projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # adding 0.0 turns a rounded negative zero into zero
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint") if f.dataType.scale == 0 else F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | list[str] = (), digits: int = 6):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the views named in ``needs``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: (ship(spark), canonical(fn(spark, sf), digits))[1]
        if sql is not None:
            ORACLES[name] = oracle(sql, *needs)
        return fn

    return wrap
