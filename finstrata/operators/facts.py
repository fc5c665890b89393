"""Long filing facts to an indicator panel with provenance, and the checks of that panel against the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..constants import (
    BALANCE_TAGS, BANKRUPTCY_ITEM, DISTRESS_ITEMS, DURATION_INDICATORS, FALLBACK_TAGS, FX_RATE, INDICATORS,
    QUARTER_DAYS, QUARTER_TAGS, TAGS, YEAR_DAYS, YEAR_TAGS,
)
from ..functions.scalars import filing_url

CELL = ["entity", "fiscal_year", "fiscal_quarter"]
PERIOD = [*CELL, "period_start", "period_end", "available_on"]


def tag_table(spark: SparkSession, extended: bool = False) -> DataFrame:
    """(indicator, kind, tag, prio): the registry, at most a few dozen rows whatever the data."""
    rows = []
    for ind in INDICATORS:
        tags = TAGS[ind] + (FALLBACK_TAGS.get(ind, []) if extended else [])
        kind = "duration" if ind in DURATION_INDICATORS else "instant"
        rows += [(ind, kind, t, i) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "indicator string, kind string, tag string, prio int")


def usd_facts(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("unit") == "USD") & F.col("val").isNotNull())


def published_pick(cands: DataFrame, keys: Sequence[str], available_on: str = "available_on", allow_late: bool = False) -> DataFrame:
    """Per key, the earliest filing (filed, accn) among those public at ``available_on``; later ones only on request.

    An aggregate, not a window: partial minima combine map-side, so a key with very many filings stays cheap.
    """
    late = (F.col("filed") > F.col(available_on)).cast("int")
    rest = [c for c in cands.columns if c not in {*keys, "filed", "accn", "_late"}]
    rows = cands.withColumn("_late", F.coalesce(late, F.lit(0)))
    if not allow_late:
        rows = rows.where("_late = 0")
    best = F.min(F.struct("_late", "filed", "accn", *rest)).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.filed", "b.accn", *[f"b.{c}" for c in rest])


def fact_struct(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return F.struct(
        c("tag").alias("tag"), c("start_d").alias("start_d"), c("end_d").alias("end_d"), c("val").alias("val"),
        c("accn").alias("accn"), c("filed").alias("filed"),
    )


def derive_cells(facts: DataFrame, periods: DataFrame, extended: bool = False, allow_late: bool = False) -> DataFrame:
    """One row per (entity, quarter, indicator): value, method and the facts it rests on.

    Per indicator the tags are tried in order and within a tag the balance, the exact quarter, then the difference of
    two year-to-date values; the winner is one minimum over (tag order, branch, filed, accn).
    All joins are equalities on (entity, period end) or (entity, tag, start).
    """
    usd = usd_facts(facts).join(tag_table(facts.sparkSession, extended), "tag")
    usd = usd.select("entity", "tag", "start_d", "end_d", "val", "accn", "filed", "indicator", "kind", "prio")
    late_ok = F.lit(True) if allow_late else F.coalesce(F.col("filed") <= F.col("available_on"), F.lit(True))  # no date: no limit
    here = usd.join(periods.select(*PERIOD).withColumnRenamed("entity", "_pe"),
                    (F.col("entity") == F.col("_pe")) & (F.col("end_d") == F.col("period_end"))).drop("_pe")
    here = here.where(late_ok).withColumn("_late", F.coalesce((F.col("filed") > F.col("available_on")).cast("int"), F.lit(0)))
    none = F.lit(None).cast("date")
    exact = here.where(
        ((F.col("kind") == "instant") & F.col("start_d").isNull())
        | ((F.col("kind") == "duration") & (F.col("start_d") == F.col("period_start")))
    ).select(
        *PERIOD, "indicator", "prio", F.lit(0).alias("branch"), "_late", "filed", "accn",
        F.when(F.col("kind") == "instant", "instant").when(F.col("fiscal_quarter") == 1, "reported_first_quarter")
        .otherwise("reported_quarter").alias("method"),
        F.col("val").alias("value"), F.array(fact_struct()).alias("facts"),
    )
    # year-to-date: the current cumulative fact first ...
    cum = here.where((F.col("kind") == "duration") & (F.col("start_d") < F.col("period_start")))
    keys = [*PERIOD, "indicator", "prio", "tag"]
    cum = cum.groupBy(*keys).agg(F.min(F.struct("_late", "filed", "accn", "start_d", "end_d", "val")).alias("c"))
    cum = cum.select(*keys, *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("_late", "filed", "accn", "start_d", "end_d", "val")])
    # ... then the latest earlier end with the same start, chosen before looking at publication dates ...
    ends = usd.where("kind = 'duration' and start_d is not null").select(
        F.col("entity").alias("_e"), F.col("tag").alias("_t"), F.col("start_d").alias("_s"), F.col("end_d").alias("_end")
    ).distinct()
    prev_end = (
        cum.join(ends, (F.col("entity") == F.col("_e")) & (F.col("tag") == F.col("_t")) & (F.col("c_start_d") == F.col("_s")))
        .where(F.col("_end") < F.col("period_end"))
        .groupBy(*keys, "c__late", "c_filed", "c_accn", "c_start_d", "c_end_d", "c_val").agg(F.max("_end").alias("prev_end"))
    )
    # ... then the filing of that earlier value that was already public.
    prev = usd.where("kind = 'duration'").select(
        F.col("entity").alias("_e"), F.col("tag").alias("_t"), F.col("start_d").alias("_s"), F.col("end_d").alias("_end"),
        F.col("val").alias("q_val"), F.col("accn").alias("q_accn"), F.col("filed").alias("q_filed"),
    )
    joined = prev_end.join(
        prev, (F.col("entity") == F.col("_e")) & (F.col("tag") == F.col("_t")) & (F.col("c_start_d") == F.col("_s"))
        & (F.col("prev_end") == F.col("_end")),
    )
    q_late = F.coalesce((F.col("q_filed") > F.col("available_on")).cast("int"), F.lit(0))
    if not allow_late:
        joined = joined.where(q_late == 0)
    ytd = joined.groupBy(*keys, "c__late", "c_filed", "c_accn", "c_start_d", "c_end_d", "c_val").agg(
        F.min(F.struct(q_late.alias("l"), F.col("q_filed").alias("filed"), F.col("q_accn").alias("accn"),
                       F.col("_end").alias("end_d"), F.col("q_val").alias("val"))).alias("q")
    ).select(
        *PERIOD, "indicator", "prio", F.lit(1).alias("branch"), F.col("c__late").alias("_late"),
        F.col("c_filed").alias("filed"), F.col("c_accn").alias("accn"), F.lit("current_ytd_minus_previous_ytd").alias("method"),
        (F.col("c_val") - F.col("q.val")).alias("value"),
        F.array(
            F.struct(F.col("tag").alias("tag"), F.col("c_start_d").alias("start_d"), F.col("c_end_d").alias("end_d"),
                     F.col("c_val").alias("val"), F.col("c_accn").alias("accn"), F.col("c_filed").alias("filed")),
            F.struct(F.col("tag").alias("tag"), F.col("c_start_d").alias("start_d"), F.col("q.end_d").alias("end_d"),
                     F.col("q.val").alias("val"), F.col("q.accn").alias("accn"), F.col("q.filed").alias("filed")),
        ).alias("facts"),
    )
    best = exact.unionByName(ytd).groupBy(*CELL, "indicator").agg(
        F.min(F.struct("prio", "branch", "_late", "filed", "accn", "method", "value", "facts")).alias("b")
    )
    grid = periods.select(*PERIOD, F.explode(F.array(*[F.lit(i) for i in INDICATORS])).alias("indicator"))
    return grid.join(best, [*CELL, "indicator"], "left").select(
        *PERIOD, "indicator", F.coalesce("b.method", F.lit("absent")).alias("method"), F.col("b.value").alias("value"),
        F.coalesce("b.facts", F.array().cast("array<struct<tag:string,start_d:date,end_d:date,val:bigint,accn:string,filed:date>>")).alias("facts"),
    )


def rebuild_rows(cells: DataFrame, rate: int = FX_RATE) -> DataFrame:
    """Sixteen converted values per quarter plus the method of each; conditional aggregates instead of a pivot scan."""
    value = lambda i: F.max(F.when(F.col("indicator") == i, F.col("value") * rate)).alias(i)
    source = F.map_from_entries(F.collect_list(F.struct("indicator", F.struct("method", "facts"))))
    return cells.groupBy(*PERIOD).agg(*[value(i) for i in INDICATORS], source.alias("sources"))


def public_facts(cells: DataFrame, cik: Column) -> DataFrame:
    """Provenance rows: one per fact used, with the address of the filing."""
    return cells.select(*CELL, "indicator", "method", F.posexplode("facts").alias("fact_pos", "f")).select(
        *CELL, "indicator", "method", "fact_pos", "f.*", filing_url(cik, F.col("f.accn")).alias("source_url")
    )


def derived_value(facts: Column, rate: Column | int, method: Column) -> Column:
    """The value a cell must hold under its declared method; NULL when the method is not supported."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    vals = F.transform(facts, lambda f: F.coalesce(f["val"], F.lit(0).cast("bigint")))
    total = F.aggregate(vals, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    ytd = F.when(F.size(facts) >= 2, (F.get(vals, F.lit(0)) - F.get(vals, F.lit(1))) * rate)
    simple = method.isin("instant", "reported_quarter", "reported_first_quarter")
    return F.when(F.size(facts) > 0, F.when(method == "current_ytd_minus_previous_ytd", ytd).when(simple, total * rate))


def discover_periods(facts: DataFrame) -> DataFrame:
    """Quarters found in the facts alone; the fourth quarter is filled from annual facts where missing."""
    usd = usd_facts(facts)
    balance_ends = usd.where(F.col("tag").isin(BALANCE_TAGS) & F.col("start_d").isNull()).select("entity", "end_d").distinct()
    days = F.datediff("end_d", "start_d")
    pos = lambda tags: F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    dated = usd.where(F.col("start_d").isNotNull() & F.col("fy").isNotNull() & (F.col("fy") != 0)).join(balance_ends, ["entity", "end_d"], "left_semi")
    found = (
        dated.where(F.col("tag").isin(QUARTER_TAGS) & F.col("fp").isin("Q1", "Q2", "Q3", "Q4") & days.between(*QUARTER_DAYS))
        .groupBy("entity", F.col("fy").alias("fiscal_year"), F.substring("fp", 2, 1).try_cast("int").alias("fiscal_quarter"))
        .agg(F.min(F.struct("filed", pos(QUARTER_TAGS).alias("t"), "end_d", "accn", "start_d")).alias("b"))
        .select("entity", "fiscal_year", "fiscal_quarter", F.col("b.start_d").alias("period_start"),
                F.col("b.end_d").alias("period_end"), F.col("b.filed").alias("available_on"))
    )
    year = (
        dated.where(F.col("tag").isin(YEAR_TAGS) & (F.col("fp") == "FY") & days.between(*YEAR_DAYS))
        .groupBy("entity", F.col("fy").alias("fiscal_year"))
        .agg(F.min(F.struct(pos(YEAR_TAGS).alias("t"), "end_d", "filed", "accn", "start_d")).alias("b"))
        .select("entity", "fiscal_year", F.lit(4).alias("fiscal_quarter"), F.col("b.start_d").alias("_start"),
                F.col("b.end_d").alias("period_end"), F.col("b.filed").alias("available_on"))
    )
    third = found.where("fiscal_quarter = 3").select("entity", "fiscal_year", F.col("period_end").alias("_third"))
    filled = (
        year.join(found.where("fiscal_quarter = 4"), ["entity", "fiscal_year"], "left_anti")
        .join(third, ["entity", "fiscal_year"], "left")
        .select("entity", "fiscal_year", "fiscal_quarter", F.coalesce("_third", "_start").alias("period_start"),
                "period_end", "available_on")
    )
    return found.withColumn("from_year", F.lit(0)).unionByName(filled.withColumn("from_year", F.lit(1)))


def long_cells(rows: DataFrame, keys: Sequence[str] = tuple(CELL), fields: Sequence[str] = tuple(INDICATORS)) -> DataFrame:
    return rows.unpivot([F.col(k) for k in keys], [F.col(f).cast("decimal(38,0)").alias(f) for f in fields], "indicator", "value")


def compare_cells(cells: DataFrame, shipped: DataFrame, rate: int = FX_RATE) -> DataFrame:
    """Rebuilt against shipped value per cell; missing equals missing."""
    ship = long_cells(shipped).withColumnRenamed("value", "shipped")
    mine = cells.select(*CELL, "indicator", "method", (F.col("value") * rate).cast("decimal(38,0)").alias("rebuilt"),
                        F.get(F.col("facts"), F.lit(0))["tag"].alias("tag"))
    return mine.join(ship, [*CELL, "indicator"], "full").select(
        *CELL, "indicator", "method", "tag", "rebuilt", "shipped",
        F.col("rebuilt").eqNullSafe(F.col("shipped")).cast("int").alias("same"),
        (F.col("rebuilt").isNull() & F.col("shipped").isNull()).cast("int").alias("absent_both"),
    )


def match_summary(compared: DataFrame) -> DataFrame:
    """Counts by method, by indicator, by tag and overall in one pass."""
    c = {k: F.col(k) for k in ("method", "indicator", "tag")}
    sets = [[c["method"]], [c["indicator"]], [c["tag"]], []]
    axis = (F.when(F.grouping("method") == 0, "by_method").when(F.grouping("indicator") == 0, "by_indicator")
            .when(F.grouping("tag") == 0, "by_tag").otherwise("all"))
    return (
        compared.groupingSets(sets, *c.values())
        .agg(axis.alias("axis"), F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_match"), F.sum("absent_both").alias("n_absent_both"))
        .select("axis", F.coalesce("method", "indicator", "tag", F.lit("None")).alias("bucket"), "n", "n_match", "n_absent_both")
    )


def mismatch_examples(compared: DataFrame, limit: int = 25) -> DataFrame:
    """The first mismatches in (entity, year, quarter, indicator) order: a top-k report."""
    return compared.where("same = 0").orderBy(*CELL, "indicator").limit(limit)


def compare_tables(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Shared keys and fields of two panels: cells compared and equal, per field."""
    left = long_cells(a, CELL, fields).withColumnRenamed("value", "a")
    right = long_cells(b, CELL, fields).withColumnRenamed("value", "b")
    both = left.join(right, [*CELL, "indicator"])
    return both.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("a").eqNullSafe(F.col("b")).cast("int")).alias("n_equal")
    )


def tag_coverage(facts: DataFrame, periods: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Per tag and entity: share of quarters whose end the tag reports, and with the exact period.

    ``tags`` maps tag -> 'instant' | 'duration' (a registry), exploded per quarter instead of a cross join.
    """
    listed = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(k).alias("kind")) for t, k in tags.items()])
    grid = periods.select("entity", "period_start", "period_end", F.explode(listed).alias("t")).select(
        "entity", "period_start", "period_end", "t.tag", "t.kind",
        F.when(F.col("t.kind") == "duration", F.col("period_start")).alias("want_start"))
    wanted = facts.where(F.col("tag").isin(list(tags)))
    ends = wanted.select("entity", "tag", F.col("end_d").alias("period_end"), F.lit(1).alias("hit")).distinct()
    exact = wanted.select("entity", "tag", F.col("end_d").alias("period_end"), F.col("start_d").alias("_s"), F.lit(1).alias("ex")).distinct()
    g = grid.join(ends, ["entity", "tag", "period_end"], "left")
    g = g.alias("g").join(
        exact.alias("x"),
        (F.col("g.entity") == F.col("x.entity")) & (F.col("g.tag") == F.col("x.tag"))
        & (F.col("g.period_end") == F.col("x.period_end")) & F.col("g.want_start").eqNullSafe(F.col("x._s")), "left",
    ).select("g.*", F.col("x.ex").alias("ex"))
    return g.groupBy("tag", "kind", "entity").agg(
        (100.0 * F.count("hit") / F.count(F.lit(1))).alias("cov"), (100.0 * F.count("ex") / F.count(F.lit(1))).alias("exact")
    )


def tag_coverage_summary(per_entity: DataFrame) -> DataFrame:
    return per_entity.groupBy("tag", "kind").agg(
        F.min("cov").alias("min_cov"), F.avg("cov").alias("mean_cov"), F.min("exact").alias("min_exact"),
        F.sum((F.col("cov") == 0).cast("int")).alias("n_missing"),
    )


def coverage_matrix(panel: DataFrame, fields: Sequence[str] = tuple(INDICATORS)) -> DataFrame:
    return panel.groupBy("entity").agg(*[(100.0 * F.count(f) / F.count(F.lit(1))).alias(f) for f in fields])


def coverage_summary(matrix: DataFrame, fields: Sequence[str] = tuple(INDICATORS)) -> DataFrame:
    long = matrix.unpivot(["entity"], list(fields), "indicator", "pct")
    return long.groupBy("indicator").agg(F.min("pct").alias("min_pct"), F.avg("pct").alias("mean_pct"))


def scaled_values(panel: DataFrame, scale: float = 1e12, fields: Sequence[str] = tuple(INDICATORS)) -> DataFrame:
    long = panel.unpivot([F.col("entity"), F.col("period_end")], [F.col(f).cast("double").alias(f) for f in fields], "indicator", "value")
    return long.withColumn("value", F.col("value") / scale)


def facts_missing(used: DataFrame, facts: DataFrame) -> DataFrame:
    """Recorded facts with no matching filing record; accn, form and start count only where they were recorded."""
    u, f = used.alias("u"), facts.alias("f")
    optional = [c for c in ("accn", "form", "start_d") if c in used.columns and c in facts.columns]
    cond = (F.col("u.entity") == F.col("f.entity")) & (F.col("u.tag") == F.col("f.tag")) & (F.col("u.end_d") == F.col("f.end_d")) \
        & (F.col("u.val") == F.col("f.val"))
    for c in optional:
        cond = cond & (F.col(f"u.{c}").isNull() | (F.col(f"u.{c}") == F.col(f"f.{c}")))
    return u.join(f, cond, "left_anti")


def verify_cells(recorded: DataFrame, facts: DataFrame, rate: int = FX_RATE) -> DataFrame:
    """Per entity: cells traced, facts missing in the filings, wrong conversions, filled although absent,
    unsupported methods. ``recorded``: cell key, indicator, value, method, facts."""
    key = [*CELL, "indicator"]
    used = recorded.select(*key, F.explode("facts").alias("f")).select(*key, "f.*")
    lost = facts_missing(used, facts).groupBy(*key).agg(F.count(F.lit(1)).alias("lost"))
    want = derived_value(F.col("facts"), rate, F.col("method")).cast("decimal(38,0)")
    traced = F.size("facts") > 0
    cells = recorded.join(lost, key, "left").select(
        "entity", traced.alias("traced"), F.coalesce("lost", F.lit(0)).alias("lost"), want.alias("want"),
        F.col("value").cast("decimal(38,0)").alias("have"),
    )
    yes = lambda c: F.sum(c.cast("int"))
    return cells.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_cells"), yes(~F.col("traced")).alias("n_absent_cells"),
        yes(F.col("traced")).alias("n_facts_checked"), F.sum("lost").alias("n_facts_missing"),
        yes(F.col("traced") & F.col("want").isNotNull() & ~F.col("want").eqNullSafe(F.col("have"))).alias("n_value_mismatch"),
        yes(~F.col("traced") & F.col("have").isNotNull()).alias("n_absent_but_filled"),
        yes(F.col("traced") & F.col("want").isNull()).alias("n_unsupported_method"),
    )


def filing_events(filings: DataFrame, keys: Sequence[str] = ("entity", "event_id", "filing_date")) -> DataFrame:
    """Distress events of filings: item 1.03 excludes the others, else one row per distress item."""
    items = F.array_distinct(F.filter(F.transform(F.split("items", ","), lambda s: F.trim(s)), lambda s: s != ""))
    bad = F.array_sort(F.filter(F.col("item_list"), lambda s: s.isin(DISTRESS_ITEMS)))
    kinds = F.when(F.array_contains("item_list", BANKRUPTCY_ITEM), F.array(F.lit("bankruptcy"))).otherwise(
        F.transform(bad, lambda s: F.concat(F.lit("distress_item_"), s)))
    t = filings.withColumn("item_list", F.array_sort(items))
    return t.select(*keys, "item_list", F.explode(kinds).alias("kind"))


def event_summary(events: DataFrame, entities: DataFrame) -> DataFrame:
    per = events.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum((F.col("kind") == "bankruptcy").cast("int")).alias("n_bankruptcy"),
        F.min("filing_date").alias("first"), F.max("filing_date").alias("last"),
    )
    return entities.join(per, "entity", "left").select(
        "entity", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_bankruptcy", F.lit(0)).alias("n_bankruptcy"),
        "first", "last", (F.coalesce("n_bankruptcy", F.lit(0)) > 0).cast("int").alias("has_bankruptcy"),
    )
