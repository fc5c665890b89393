"""Connected components of an edge table by alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from finstrata.session import ship
from finstrata.sources.landing import drop, land_at, new_folder


def _contract(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges by stars of the same components: long chains within a task are gone before the first exchange."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = np.array([(x, root(x)) for x in parent], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return edges.mapInArrow(stars, "a bigint, b bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node with an edge to another. ``edges``: a, b bigint.

    A round is two joins on node; the number of rounds grows with the logarithm of the longest chain. Each round is landed and the one before deleted.
    """
    spark = edges.sparkSession
    ship(spark)
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    path = new_folder(spark, "edges")
    current = land_at(_contract(oriented), path)
    seen = state(current)
    while True:
        following = new_folder(spark, "edges")
        current = land_at(_small_star(_large_star(current)), following)
        drop(spark, path)
        path, now = following, state(current)
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = now
