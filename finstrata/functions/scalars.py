"""Null-safe scalar Column builders. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(c: Column) -> Column:
    """Text or number to double; anything unreadable or not finite becomes NULL."""
    d = c.try_cast("double")
    return F.when(finite(d), d)


def finite(c: Column) -> Column:
    """True for a real number: not NULL, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def growth(current: Column, past: Column) -> Column:
    """Change relative to the size of the base; NULL when the base is zero or missing."""
    return F.try_divide((current - past).cast("double"), F.abs(past).cast("double"))


def close(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """Equal within a tolerance; two missing values are equal, one missing value is not."""
    both = a.isNull() & b.isNull()
    return F.coalesce(F.abs(a - b) <= F.lit(tol), both)


def stable(c: Column, digits: int = 6) -> Column:
    """Rounded for output; values that are not finite become NULL."""
    return F.round(F.when(finite(c), c), digits)


def total_liabilities(liabilities: Column, assets: Column, equity: Column) -> Column:
    return F.coalesce(liabilities, assets - equity)


def altman_z(prefix: str = "") -> Column:
    """Z'' score of one quarter; NULL when any part is missing or a base is zero."""
    c = lambda name: F.col(prefix + name).cast("double")
    ta = F.nullif(c("total_assets"), F.lit(0.0))
    tl = F.nullif(total_liabilities(c("liabilities"), c("total_assets"), c("stockholders_equity")), F.lit(0.0))
    return (
        6.56 * ratio(c("current_assets") - c("current_liabilities"), ta)
        + 3.26 * ratio(c("retained_earnings"), ta)
        + 6.72 * ratio(c("operating_income"), ta)
        + 1.05 * ratio(c("stockholders_equity"), tl)
    )


def altman_probability(z: Column, cut: float = 1.1, scale: float = 0.5) -> Column:
    """Score decreasing in Z; 0.5 where Z is missing."""
    return F.coalesce(1.0 / (1.0 + F.exp((z - cut) / scale)), F.lit(0.5))


def imbalance_level(minority_pct: Column) -> Column:
    return (
        F.when(minority_pct <= 0, "single_class").when(minority_pct >= 40, "balanced")
        .when(minority_pct >= 20, "slightly_imbalanced").otherwise("severely_imbalanced")
    )


def filing_url(cik: Column, accn: Column) -> Column:
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"),
        F.regexp_replace(accn, "-", ""), F.lit("/"), accn, F.lit("-index.html"),
    )
