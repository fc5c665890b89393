"""Forecast samples, label rules and time splits over the panel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    ALTMAN_CUT, FORWARD_HORIZON, N_PURGE, N_TEST, N_VALIDATION, STRESS_MIN_SIGNALS, STRESS_SIGNALS,
)
from ..functions.panel import entity_rows, rows_so_far, whole_entity, row_index
from ..functions.scalars import altman_z, growth


def sample_id(year: str = "fiscal_year", quarter: str = "fiscal_quarter") -> Column:
    return F.concat(F.col("entity").cast("string"), F.lit("-"), F.col(year), F.lit("Q"), F.col(quarter))


def parse_sample_id(c: Column) -> list[Column]:
    """entity, year, quarter of ``<entity_rows()>-YYYYQn`` and whether the id is well formed."""
    pat = r"^([A-Z0-9]+)-(\d{4})Q([1-4])$"
    part = lambda i: F.nullif(F.regexp_extract(c, pat, i), F.lit(""))
    return [
        part(1).alias("id_entity"), part(2).cast("bigint").alias("id_year"), part(3).cast("bigint").alias("id_quarter"),
        F.when(c.rlike(pat), 1).otherwise(0).alias("well_formed"),
    ]


def make_samples(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per quarter that has a successor: history up to this row, target = next row.

    No history array is copied: window features of the row are the features of the sample.
    """
    nxt = lambda c: F.lead(c).over(entity_rows()).alias(f"target_{c}")
    cols = ["fiscal_year", "fiscal_quarter", "period_start", "period_end", "available_on"]
    out = panel.select(
        "entity", "period_end", *[k for k in keep if k not in ("entity", "period_end")],
        F.col("available_on").alias("as_of"), row_index().alias("n_history"), *[nxt(c) for c in cols],
    ).where(F.col("target_period_end").isNotNull())
    return out.withColumn("sample_id", sample_id("target_fiscal_year", "target_fiscal_quarter")).withColumnRenamed(
        "target_available_on", "label_available_on"
    )


def history_periods() -> Column:
    """Period ends seen so far (bounded by the number of quarters)."""
    return F.collect_list("period_end").over(rows_so_far())


def with_history(panel: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Samples with an explicit history array, for consumers that need the nested layout."""
    item = F.struct("period_start", "period_end", "available_on", *fields)
    return make_samples(panel.withColumn("history", F.collect_list(item).over(rows_so_far())), ["history"])


# ---- labels -----------------------------------------------------------------------------------------

def signal_columns(yoy_threshold: float = -0.05) -> dict[str, Column]:
    """The six stress signals of a quarter; a missing input is 'not fired'."""
    past = F.lag("revenue", 4).over(entity_rows())
    flags = {
        "net_income<0": F.col("net_income") < 0,
        "operating_cash_flow<0": F.col("operating_cash_flow") < 0,
        "operating_income<0": F.col("operating_income") < 0,
        "current_liabilities>current_assets": F.col("current_liabilities") > F.col("current_assets"),
        "stockholders_equity<0": F.col("stockholders_equity") < 0,
        "revenue_yoy<-5%": growth(F.col("revenue"), past) < yoy_threshold,
    }
    return {k: F.coalesce(flags[k], F.lit(False)) for k in STRESS_SIGNALS}


def with_signals(panel: DataFrame, yoy_threshold: float = -0.05) -> DataFrame:
    flags = signal_columns(yoy_threshold)
    fired = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))
    return panel.withColumn("fired", fired).withColumn("n_signals", F.size("fired"))


def stress_label(panel: DataFrame, min_signals: int = STRESS_MIN_SIGNALS) -> DataFrame:
    return with_signals(panel).withColumn("label", (F.col("n_signals") >= min_signals).cast("int"))


def altman_label(panel: DataFrame, min_signals: int = STRESS_MIN_SIGNALS) -> DataFrame:
    """1 below the cut; a missing score counts as 0 and is marked."""
    z = altman_z()
    return (
        panel.withColumn("z", z)
        .withColumn("label", F.coalesce((F.col("z") < ALTMAN_CUT).cast("int"), F.lit(0)))
        .withColumn("z_missing", F.col("z").isNull().cast("int"))
    )


def forward_label(panel: DataFrame, min_signals: int = STRESS_MIN_SIGNALS, horizon: int = FORWARD_HORIZON) -> DataFrame:
    """1 when any of the next ``horizon`` quarters is stressed; also how many could be observed, which fired,
    and when the last of them was published (the label is not known earlier)."""
    ahead = entity_rows().rowsBetween(1, horizon)
    hit = (F.col("n_signals") >= min_signals).cast("int")
    steps = [
        F.when(F.lead(hit, k).over(entity_rows()) == 1,
               F.concat(F.lit(f"q+{k}:"), F.array_join(F.lead("fired", k).over(entity_rows()), ",")))
        for k in range(1, horizon + 1)
    ]
    return (
        with_signals(panel)
        .withColumn("label", F.coalesce(F.max(hit).over(ahead), F.lit(0)))
        .withColumn("observed_quarters", F.count(F.lit(1)).over(ahead))
        .withColumn("label_known_on", F.max("available_on").over(ahead))
        .withColumn("fired_ahead", F.array_compact(F.array(*steps)))
    )


LABEL_RULES: dict[str, Callable[..., DataFrame]] = {
    "stress_signals": stress_label,
    "altman_z": altman_label,
    "forward_4q": forward_label,
}


def label_by_rule(rule: str, panel: DataFrame, min_signals: int = STRESS_MIN_SIGNALS) -> DataFrame:
    if rule not in LABEL_RULES:
        raise KeyError(f"unknown label rule {rule!r}; known: {sorted(LABEL_RULES)}")
    return LABEL_RULES[rule](panel, min_signals)


def rule_samples(panel: DataFrame, rule: str = "stress_signals", min_signals: int = STRESS_MIN_SIGNALS) -> DataFrame:
    """Samples whose label is the rule applied to the target quarter (the next row)."""
    labelled = label_by_rule(rule, panel, min_signals)
    labelled = labelled.withColumn("is_distressed", F.lead("label").over(entity_rows()))
    return make_samples(labelled, ["is_distressed"])


def carry_over_labels(samples: DataFrame, existing: DataFrame, fallback: Column) -> DataFrame:
    """A stored label wins, with missing details filled from the target; new rows get the fallback rule.

    ``existing`` has sample_id, old_label, old_label_available_on.
    """
    known = F.col("old_label").isNotNull()
    return samples.join(existing, "sample_id", "left").select(
        *samples.columns,
        F.when(known, F.col("old_label")).otherwise(F.coalesce(fallback.cast("int"), F.lit(0))).alias("carried_label"),
        F.when(known, F.coalesce("old_label_available_on", "label_available_on"))
        .otherwise(F.col("label_available_on")).alias("carried_on"),
        known.cast("int").alias("was_known"),
    )


# ---- splits -----------------------------------------------------------------------------------------

def split_column(position: Column, size: Column) -> Column:
    """Oldest rows train, then one purged, four validation, one purged, eight test; short entities train only."""
    held = N_TEST + N_VALIDATION + 2 * N_PURGE
    left = size - position  # rows after this one
    return (
        F.when((size <= held) | (left >= held), "train")
        .when(left < N_TEST, "test")
        .when(left < N_TEST + N_PURGE, "purged")
        .when(left < N_TEST + N_PURGE + N_VALIDATION, "validation")
        .otherwise("purged")
    )


def time_split(samples: DataFrame) -> DataFrame:
    return samples.withColumn("split", split_column(row_index(), F.count(F.lit(1)).over(whole_entity())))


def test_ranges(samples: DataFrame) -> DataFrame:
    return (
        samples.where(F.col("split") == "test").groupBy("entity")
        .agg(F.min("target_period_start").alias("first_start"), F.max("target_period_end").alias("last_end"),
             F.count(F.lit(1)).alias("n_test"))
    )


def filter_by_history(samples: DataFrame, min_quarters: int) -> DataFrame:
    return samples.where(F.col("n_history") >= min_quarters)


def find_sample(samples: DataFrame, wanted: str | None = None, entity: str | None = None, quarter: str | None = None) -> DataFrame:
    """By id, or by entity and quarter suffix, without regard to case; test first, then validation, train, purged."""
    if wanted is not None:
        hit = F.upper("sample_id") == wanted.upper()
    else:
        hit = (F.upper(F.col("entity").cast("string")) == str(entity).upper()) & F.upper("sample_id").endswith(str(quarter).upper())
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).when(F.col("split") == "train", 2).otherwise(3)
    return samples.where(hit).orderBy(rank, "sample_id").limit(1)
