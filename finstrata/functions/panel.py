"""Window specifications of the entity-by-quarter panel.

The panel holds one row per (entity, quarter), so a window partition is bounded by the number of calendar quarters
(a century is 400 rows) however many raw facts an entity has. All operators share these specs, so that one
exchange and one sort serve every windowed column.
"""

from __future__ import annotations

from pyspark.sql import Column, Window as W, WindowSpec, functions as F

from ..constants import LOOKBACK

def entity_rows() -> WindowSpec:
    """Rows of an entity in time order. (Functions, because a window needs a running session.)"""
    return W.partitionBy("entity").orderBy("period_end")


def recent_rows() -> WindowSpec:
    return entity_rows().rowsBetween(-(LOOKBACK - 1), 0)


def earlier_rows() -> WindowSpec:
    """The look-back window without its last four rows."""
    return entity_rows().rowsBetween(-(LOOKBACK - 1), -4)


def rows_so_far() -> WindowSpec:
    return entity_rows().rowsBetween(W.unboundedPreceding, 0)


def whole_entity() -> WindowSpec:
    return W.partitionBy("entity")


def last_finite(c: Column, frame: WindowSpec | None = None) -> Column:
    return F.last(c, ignorenulls=True).over(frame if frame is not None else recent_rows())


def row_index() -> Column:
    return F.row_number().over(entity_rows())


def trailing_streak(holds: Column, cap: int = LOOKBACK) -> Column:
    """Length of the newest run of quarters where ``holds``; NULL (missing) breaks the run."""
    rn = row_index()
    broken = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col("_rn"))).over(rows_so_far())
    return F.least(F.lit(cap), rn - F.coalesce(broken, F.lit(0))).cast("double")
