"""Global order statistics without a single-task window.

A window ordered over a whole table runs in one task. Here values are first reduced to one row per distinct value,
spread over range buckets, and only per-bucket totals (buckets x groups rows) are ordered globally:

* ``running_totals``  cumulative sums in value order
* ``quantiles``       exact, linearly interpolated quantiles
* ``mid_ranks``       ranks with ties averaged
* ``hash_rank``       position of every row in a repeatable random order
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STEP = 32


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def position(value: Column, bounds: Column, strict: bool = True) -> Column:
    """How many entries of a sorted array lie below (or at) a value; two-level so long arrays stay cheap."""
    below = (lambda b: b < value) if strict else (lambda b: b <= value)
    coarse = F.filter(bounds, lambda b, i: (i + 1) % STEP == 0)
    jump = F.size(F.filter(coarse, below))
    rest = F.slice(bounds, jump * STEP + 1, STEP - 1)
    return jump * STEP + F.size(F.filter(rest, below))


def with_position(df: DataFrame, name: str, value: Column, bounds: str, most: int, strict: bool = True) -> DataFrame:
    """Add ``position`` in a sorted array column of at most ``most`` entries (0 where there is no array).

    A binary search, one projection per halving: all of it is compiled, while a filter over an array is interpreted, entry by entry, for every row.
    The result is never NULL, so that no optimizer rule copies the steps into a test for NULL.
    """
    below = (lambda b: b < value) if strict else (lambda b: b <= value)
    df = df.withColumn(name, F.lit(0))
    step = 1 << most.bit_length() >> 1
    while step:  # an entry beyond the end is NULL, hence not below
        df = df.withColumn(name, F.col(name) + F.when(below(F.get(F.col(bounds), F.col(name) + (step - 1))), step).otherwise(0))
        step >>= 1
    return df


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column result as an expression (scalar subquery, no join)."""
    return df.scalar()


def _bucketed(df: DataFrame, by: Sequence[str], order: str, buckets: int, few: bool = False) -> DataFrame:
    probs = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = F.array_distinct(F.percentile_approx(F.col(order), probs, F.lit(max(1000, 4 * buckets))))
    if by:
        bounds = df.groupBy(*by).agg(cuts.alias("_cuts")).where(F.col("_cuts").isNotNull())
        df = df.join(F.broadcast(bounds) if few else bounds, list(by))
    else:
        df = df.withColumn("_cuts", scalar(df.agg(cuts.alias("_cuts")))).where(F.col("_cuts").isNotNull())
    return with_position(df, "_b", F.col(order), "_cuts", buckets - 1).drop("_cuts")


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), buckets: int | None = None, few: bool = False
) -> DataFrame:
    """Add ``<s>_cum`` (inclusive, ascending in ``order``) and ``<s>_tot`` for every column in ``sums``.

    ``df`` holds one row per (``by``, ``order``) value, so a value that covers a third of the input is one row here.
    ``few`` says that the groups are the columns of a table: bounds and bucket totals, columns x buckets rows, are then broadcast, and the
    values move once, to their buckets. Else both are joined as they come, since the number of groups may grow with the data.
    """
    by, n = list(by), buckets or bucket_count(df)
    bucketed = _bucketed(df, by, order, n, few)
    spread = bucketed.repartition(*[F.col(c) for c in [*by, "_b"]])
    # The bucket table has at most n rows per group. It is added up before the exchange: what it reads is narrower than the main branch,
    # so the two could not share one, and the values would move twice.
    per_bucket = bucketed.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    ahead = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_{s}").over(ahead), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_tot") for s in sums],
    )
    local = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = spread.select("*", *[F.sum(s).over(local).alias(f"_{s}_loc") for s in sums]).join(F.broadcast(offsets) if few else offsets, [*by, "_b"])
    for s in sums:
        out = out.withColumn(f"{s}_cum", F.col(f"_{s}_loc") + F.col(f"_{s}_off")).drop(f"_{s}_loc", f"_{s}_off")
    return out.drop("_b")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias(n))


def quantiles_from_totals(
    totals: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), n: str = "n"
) -> DataFrame:
    """(by, prob, q) from a table that carries ``n``, ``n_cum`` and ``n_tot`` per distinct value."""
    first, last = F.col(f"{n}_cum") - F.col(n), F.col(f"{n}_cum") - 1
    span = F.col(f"{n}_tot") - 1
    ps = F.array(*[F.lit(float(p)) for p in probs])
    inside = lambda pos: (pos >= first) & (pos <= last)
    lo = lambda p: F.floor(p * span)
    hi = lambda p: F.least(F.floor(p * span) + 1, span)
    hits = F.filter(ps, lambda p: inside(lo(p)) | inside(hi(p)))
    rows = totals.where(F.size(hits) > 0).select(
        *by, F.col(value).cast("double").alias("_v"), first.alias("_f"), last.alias("_l"), span.alias("_s"),
        F.explode(hits).alias("prob"),
    )
    pos_lo = F.floor(F.col("prob") * F.col("_s"))
    pos_hi = F.least(pos_lo + 1, F.col("_s"))
    at = lambda pos: F.max(F.when((pos >= F.col("_f")) & (pos <= F.col("_l")), F.col("_v")))
    got = rows.groupBy(*by, "prob").agg(
        at(pos_lo).alias("_a"), at(pos_hi).alias("_b"), F.max(F.col("prob") * F.col("_s") - pos_lo).alias("_w")
    )
    return got.select(*by, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("q"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles as rows (by, prob, q)."""
    counts = value_counts(df, value, by)
    return quantiles_from_totals(running_totals(counts, value, ["n"], by), value, probs, by)


def quantile_agg(prob: float, value: str, n: str = "n") -> Column:
    """One exact quantile as an aggregate over ``running_totals`` rows: the two neighbouring positions are found by
    conditional maxima, so any number of quantiles (and other aggregates) share one pass."""
    first, last = F.col(f"{n}_cum") - F.col(n), F.col(f"{n}_cum") - 1
    span = F.col(f"{n}_tot") - 1
    lo = F.floor(F.lit(float(prob)) * span)
    hi = F.least(lo + 1, span)
    at = lambda pos: F.max(F.when((pos >= first) & (pos <= last), F.col(value).cast("double")))
    return at(lo) + (at(hi) - at(lo)) * F.max(F.lit(float(prob)) * span - lo)


def at_least_quantile(prob: float, n: str = "n") -> Column:
    """Whether a ``running_totals`` row holds values at or above the interpolated quantile, decided by positions alone."""
    last, span = F.col(f"{n}_cum") - 1, F.col(f"{n}_tot") - 1
    exact = F.lit(float(prob)) * span
    lo = F.floor(exact)
    return (last >= F.least(lo + 1, span)) | ((last >= lo) & (exact == lo))


def quantile_columns(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), few: bool = False
) -> DataFrame:
    """Exact quantiles, one column per named probability."""
    totals = running_totals(value_counts(df, value, by), value, ["n"], by, few=few)
    return totals.groupBy(*by).agg(*[quantile_agg(p, value).alias(name) for name, p in probs.items()])


def quantile_grid(df: DataFrame, value: str, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, q) for the evenly spaced probabilities k/steps, k = 0..steps, without scanning a grid per row."""
    totals = running_totals(value_counts(df, value, by), value, ["n"], by)
    span = F.col("n_tot") - 1
    first, last = F.col("n_cum") - F.col("n"), F.col("n_cum") - 1
    # k hits this value when floor(k*span/steps), or that plus one, lies in [first, last]
    k_from = F.greatest(F.lit(0).cast("bigint"), F.when(span > 0, F.ceil(F.try_divide((first - 1) * steps, span))).otherwise(0))
    k_to = F.least(
        F.lit(steps).cast("bigint"),
        F.when(span > 0, F.ceil(F.try_divide((last + 1) * steps, span))).otherwise(steps),
    )
    rows = totals.where(k_from <= k_to).select(
        *by, F.col(value).cast("double").alias("_v"), first.alias("_f"), last.alias("_l"), span.alias("_s"),
        F.explode(F.sequence(k_from, k_to)).alias("k"),
    )
    pos_lo = F.floor(F.col("k") * F.col("_s") / steps)
    pos_hi = F.least(pos_lo + 1, F.col("_s"))
    at = lambda pos: F.max(F.when((pos >= F.col("_f")) & (pos <= F.col("_l")), F.col("_v")))
    got = rows.groupBy(*by, "k").agg(
        at(pos_lo).alias("_a"), at(pos_hi).alias("_b"), F.max(F.col("k") * F.col("_s") / steps - pos_lo).alias("_w")
    )
    return got.select(*by, "k", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("q"))


def mid_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, mid_rank): average rank shared by the rows that hold a value."""
    t = running_totals(value_counts(df, value, by), value, ["n"], by)
    return t.select(*by, value, "n", "n_tot", (F.col("n_cum") - (F.col("n") - 1) / F.lit(2.0)).alias("mid_rank"))


def hash_rank(df: DataFrame, u: Column, tie: str, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Add the 1-based position of every row in the order of ``u`` (uniform on [0, 1)) then ``tie``.

    ``u`` is uniform by construction, so equal-width buckets are even and no bounds pass is needed.
    """
    by, n = list(by), bucket_count(df)
    spread = (
        df.withColumn("_u", u)
        .withColumn("_b", F.floor(F.col("_u") * n))
        .repartition(*[F.col(c) for c in [*by, "_b"]])
    )
    ahead = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    )
    local = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_u", tie))
    return (
        spread.withColumn("_loc", local).join(offsets, [*by, "_b"])
        .withColumn(name, (F.col("_loc") + F.col("_off")).cast("bigint"))
        .drop("_u", "_b", "_loc", "_off")
    )


def sorted_position(df: DataFrame, order: str, tie: str, name: str = "pos") -> DataFrame:
    """Add the 1-based position of every row in ascending (``order``, ``tie``), for columns of any distribution."""
    spread = _bucketed(df, [], order, bucket_count(df)).repartition(F.col("_b"))
    ahead = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    offsets = spread.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo")).select(
        "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy("_b").orderBy(order, tie))
    return spread.withColumn("_loc", local).join(offsets, "_b").withColumn(name, F.col("_loc") + F.col("_off")).drop("_b", "_loc", "_off")
