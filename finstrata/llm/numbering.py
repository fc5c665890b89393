"""Gapless numbers within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from finstrata.sources.landing import land

PLACE_BITS = 33  # of the place within a partition, as documented for monotonically_increasing_id


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a bigint column ``name``: 0, 1, 2, ... within each group, in the order given.

    One range exchange; the sorted rows are then numbered where they lie. The id that Spark hands out holds the partition and the place in it,
    so all that remains is a running sum of one count for each group and partition. The rows are landed first, which fixes those ids.
    """
    by = [*group, *order]
    placed = land(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PLACE_BITS).alias("_part")
    counts = placed.groupBy(*group, part).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*group, "_part", (before - F.col("_first")).alias("_offset"))
    joined = placed.withColumn("_part", F.shiftright("_place", PLACE_BITS)).join(offsets, [*group, "_part"])
    return joined.select(*df.columns, (F.col("_place") + F.col("_offset")).alias(name))
