"""Label balance, multi-axis profiles, label sequences, history overlap, top-k and comparison tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.panel import entity_rows
from ..functions.scalars import imbalance_level


def entropy_bits(counts: Sequence[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    out = F.lit(0.0)
    for c in counts:
        share = F.try_divide(c.cast("double"), total)
        out = out - F.when(c > 0, share * F.log2(share)).otherwise(0.0)
    return out


def gini(counts: Sequence[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    out = F.lit(1.0)
    for c in counts:
        out = out - F.pow(F.try_divide(c.cast("double"), total), 2.0)
    return out


def imbalance_ratio(pos: Column, neg: Column) -> Column:
    """Larger over smaller class; NULL when a class is empty."""
    return F.try_divide(F.greatest(pos, neg).cast("double"), F.least(pos, neg))


def balance_columns(n: Column, pos: Column) -> list[Column]:
    neg = n - pos
    minority_pct = 100.0 * F.least(pos, neg) / n
    bits = entropy_bits([pos, neg])
    return [
        n.alias("n"), pos.alias("positive"), neg.alias("negative"), (100.0 * pos / n).alias("positive_pct"),
        F.when(pos >= neg, 0).otherwise(1).alias("minority_class"), minority_pct.alias("minority_pct"),
        imbalance_ratio(pos, neg).alias("imbalance_ratio"), imbalance_level(minority_pct).alias("level"),
        bits.alias("entropy_bits"), F.when(F.least(pos, neg) > 0, bits).otherwise(0.0).alias("entropy_normalized"),
        gini([pos, neg]).alias("gini"), (100.0 * F.greatest(pos, neg) / n).alias("majority_baseline_pct"),
    ]


def class_balance(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))
    return c.select(*by, *balance_columns(F.col("_n"), F.col("_p")))


def label_profile(samples: DataFrame, axes: Sequence[str], y: str = "is_distressed") -> DataFrame:
    """Balance along every axis and overall, in one pass over grouping sets."""
    cols = [F.col(a) for a in axes]
    axis = F.lit("overall")
    for a in axes:
        axis = F.when(F.grouping(a) == 0, a).otherwise(axis)
    key = F.coalesce(*[F.when(F.grouping(a) == 0, F.col(a).cast("string")) for a in axes], F.lit("all"))
    g = samples.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        axis.alias("axis"), key.alias("key"), F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p"))
    return g.select("axis", "key", *balance_columns(F.col("_n"), F.col("_p")))


def effective_number(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """1 / sum of squared shares of the groups."""
    per = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*by).agg((F.pow(F.sum("c"), 2.0) / F.sum(F.pow(F.col("c").cast("double"), 2.0))).alias("effective_n"), F.count(F.lit(1)).alias("n_groups"))


def label_shares(samples: DataFrame, y: str = "is_distressed") -> DataFrame:
    s = samples.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("share"))
    return s.withColumn("kind", F.when(F.col("share") == 1, "all_one").when(F.col("share") == 0, "all_zero").otherwise("mixed"))


def label_matrix(samples: DataFrame, periods: Sequence[str], y: str = "is_distressed") -> DataFrame:
    """One row per entity, one column per listed period."""
    cell = lambda p: F.max(F.when(F.col("period") == p, F.col(y))).alias(p)
    return samples.groupBy("entity").agg(*[cell(p) for p in periods])


def history_length_stats(lengths: DataFrame, n: str = "n_history", floor: int = 5) -> DataFrame:
    """Lengths are small integers, so the exact percentile keeps one counter per distinct length."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        F.percentile(n, 0.5).alias("median_len"), F.sum((F.col(n) < floor).cast("int")).alias("n_below"),
        F.avg((F.col(n) < floor).cast("double")).alias("share_below"),
    )


def entity_prior(samples: DataFrame, y: str = "is_distressed") -> DataFrame:
    return samples.where("split = 'train'").groupBy("entity").agg(F.avg(y).alias("prior"), F.count(F.lit(1)).alias("n_train"))


def with_prior(samples: DataFrame, prior: DataFrame, default: float | Column = 0.5) -> DataFrame:
    """Left join without a hint: the optimizer broadcasts the prior only when its size is small enough."""
    default = F.lit(default) if isinstance(default, (int, float)) else default
    return samples.join(prior.select("entity", "prior"), "entity", "left").withColumn("prior", F.coalesce("prior", default))


def prior_band(prior: Column) -> Column:
    return F.when(prior >= 0.95, "leak").when(prior <= 0.10, "reverse_leak").otherwise("mixed")


def published_bounds(samples: DataFrame) -> DataFrame:
    """Per split: latest publication inside any history, earliest decision time. The history of a sample ends
    at its own row, and publication dates of earlier rows are covered by a running maximum."""
    seen = F.max("available_on").over(entity_rows().rowsBetween(W.unboundedPreceding, 0))
    return samples.withColumn("_seen", seen).groupBy("split").agg(F.max("_seen").alias("max_published"), F.min("as_of").alias("min_as_of"))


def range_overlap(df: DataFrame, features: Sequence[str], y: str = "is_distressed") -> DataFrame:
    """Overlap of the two classes' value ranges relative to the joint range."""
    long = df.unpivot([F.col(y)], [F.col(f).cast("double").alias(f) for f in features], "feature", "value").where("value is not null")
    at = lambda fn, k: fn(F.when(F.col(y) == k, F.col("value")))
    g = long.groupBy("feature").agg(at(F.min, 0).alias("lo0"), at(F.max, 0).alias("hi0"), at(F.min, 1).alias("lo1"), at(F.max, 1).alias("hi1"))
    lo, hi = F.least("lo0", "lo1"), F.greatest("hi0", "hi1")
    over = F.least("hi0", "hi1") - F.greatest("lo0", "lo1")
    return g.where("lo0 is not null and lo1 is not null").select("feature", F.when(hi > lo, over / (hi - lo)).alias("overlap"))


def group_stats(metrics: DataFrame, group: str, names: Sequence[str], baseline: str) -> DataFrame:
    """Group means and their distance to the baseline group (one row, joined as a scalar)."""
    means = metrics.groupBy(group).agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n"))
    base = means.where(F.col(group) == baseline)
    return means.select(group, "n", *names, *[(F.col(n) - base.select(n).scalar()).alias(f"{n}_delta") for n in names])


def top(df: DataFrame, key: str, count: int, tie: str, reverse: bool = True) -> DataFrame:
    col = F.col(key).desc_nulls_last() if reverse else F.col(key).asc_nulls_last()
    return df.where(F.col(key).isNotNull()).orderBy(col, tie).limit(count)


def ranking_table(results: DataFrame, metric: str, name: str, baseline: str) -> DataFrame:
    """Rank by a metric with the distance to the baseline; one row per technique, so the window is small."""
    base = results.where(F.col(name) == baseline).select(metric).scalar()
    rank = F.row_number().over(W.orderBy(F.col(metric).desc_nulls_last(), name))
    return results.select(name, metric, rank.alias("rank"), (F.col(metric) - base).alias("delta"))


def extremes(results: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """Best and worst technique per metric."""
    long = results.unpivot([name], list(metrics), "metric", "value").where("value is not null")
    return long.groupBy("metric").agg(
        F.max(F.struct("value", name))[name].alias("best"), F.max("value").alias("best_value"),
        F.min(F.struct("value", name))[name].alias("worst"), F.min("value").alias("worst_value"))


def select_model(rows: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "model") -> DataFrame:
    """The first model by several keys, (column, higher is better); missing counts as -1."""
    order = [(F.coalesce(c, F.lit(-1.0)).desc() if up else F.coalesce(c, F.lit(-1.0)).asc()) for c, up in keys]
    return rows.orderBy(*order, name).limit(1)


def union_sources(parts: dict[str, DataFrame], key: str = "system") -> DataFrame:
    """Rows of several tables with a source column; later tables add only systems not yet present."""
    out = None
    for source, df in parts.items():
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df.join(out.select(key), key, "left_anti"), allowMissingColumns=True)
    return out


def label_agreement(rules: dict[str, DataFrame], base: DataFrame) -> DataFrame:
    """Agreement of rule labels with a base label on common samples, positive rate and imbalance."""
    out = None
    for r, df in rules.items():
        one = df.select("sample_id", "is_distressed").join(base, "sample_id").select(F.lit(r).alias("rule"), "is_distressed", "base")
        out = one if out is None else out.unionByName(one)
    p, n = F.sum("is_distressed"), F.count(F.lit(1))
    return out.groupBy("rule").agg(
        n.alias("n"), F.avg((F.col("is_distressed") == F.col("base")).cast("double")).alias("agreement"),
        F.avg("is_distressed").alias("positive_rate"), imbalance_ratio(p, n - p).alias("imbalance_ratio"))


def accounting_rules(shift: int = 0) -> dict[str, Column]:
    """Seven simple rules on the current quarter, or ``shift`` quarters earlier."""
    def c(name: str) -> Column:
        col = F.lag(name, shift).over(entity_rows()) if shift else F.col(name)
        return F.coalesce(col, F.lit(0))

    return {
        "net_income<0": c("net_income") < 0, "operating_income<0": c("operating_income") < 0,
        "operating_cash_flow<0": c("operating_cash_flow") < 0,
        "ocf_or_ni<0": (c("operating_cash_flow") < 0) | (c("net_income") < 0),
        "current_liabilities>current_assets": c("current_liabilities") > c("current_assets"),
        "stockholders_equity<0": c("stockholders_equity") < 0, "retained_earnings<0": c("retained_earnings") < 0,
    }


Rules = Callable[[int], dict[str, Column]]


def rule_agreement(labelled: DataFrame, label: str = "label", rules: Rules = accounting_rules) -> DataFrame:
    """Share of samples where a rule equals the label, on the target quarter and on the quarter before it. ``rules`` gives named conditions for
    a shift of 0 or 1 quarters; any can be passed."""
    now, before = rules(0), rules(1)
    names = list(now)
    t = labelled.select(
        F.row_number().over(entity_rows()).alias("rn"), F.col(label).alias("y"), "n_signals",
        *[now[k].cast("int").alias(f"t{i}") for i, k in enumerate(names)],
        *[before[k].cast("int").alias(f"h{i}") for i, k in enumerate(names)],
    ).where("rn > 1")
    agree = lambda c: F.avg((c == F.col("y")).cast("double"))
    one = t.agg(
        *[agree(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(names))],
        *[agree(F.col(f"h{i}")).alias(f"h{i}") for i in range(len(names))],
        *[agree((F.col("n_signals") >= k).cast("int")).alias(f"s{k}") for k in (1, 2)],
    )
    rows = [F.struct(F.lit(k).alias("rule"), F.col(f"t{i}").alias("target_agreement"), F.col(f"h{i}").alias("history_agreement"))
            for i, k in enumerate(names)]
    rows += [F.struct(F.lit(f"stress_signals>={k}").alias("rule"), F.col(f"s{k}").alias("target_agreement"), F.lit(None).cast("double").alias("history_agreement"))
             for k in (1, 2)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- label sequences -----------------------------------------------------------------------------------

def label_sequences(samples: DataFrame, y: str = "is_distressed", order: str = "target_period_end") -> DataFrame:
    """Flips and longest runs per entity (gaps and islands)."""
    w = W.partitionBy("entity").orderBy(order)
    by_value = W.partitionBy("entity", y).orderBy(order)
    t = samples.select(
        "entity", y, order, (F.col(y) != F.lag(y).over(w)).cast("int").alias("flip"),
        (F.row_number().over(w) - F.row_number().over(by_value)).alias("island"))
    runs = t.groupBy("entity", y, "island").agg(F.count(F.lit(1)).alias("run"), F.sum("flip").alias("flips"),
                                                F.min(order).alias("lo"), F.max(order).alias("hi"))
    longest = lambda v: F.coalesce(F.max(F.when(F.col(y) == v, F.col("run"))), F.lit(0))
    return runs.groupBy("entity").agg(
        F.coalesce(F.sum("flips"), F.lit(0)).alias("n_switches"), longest(1).alias("max_run_one"), longest(0).alias("max_run_zero"),
        F.min("lo").alias("first_target"), F.max("hi").alias("last_target"))


def transitions(samples: DataFrame, y: str = "is_distressed", order: str = "target_period_end") -> DataFrame:
    nxt = F.lead(y).over(W.partitionBy("entity").orderBy(order))
    t = samples.select(F.col(y).alias("a"), nxt.alias("b")).where("b is not null")
    c = lambda a, b: F.sum(((F.col("a") == a) & (F.col("b") == b)).cast("int"))
    n = t.agg(c(0, 0).alias("n00"), c(0, 1).alias("n01"), c(1, 0).alias("n10"), c(1, 1).alias("n11"))
    return n.select(
        "*", F.try_divide(F.col("n11").cast("double"), F.col("n10") + F.col("n11")).alias("p_one_given_one"),
        F.try_divide(F.col("n01").cast("double"), F.col("n00") + F.col("n01")).alias("p_one_given_zero"),
        F.try_divide(100.0 * (F.col("n00") + F.col("n11")), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).alias("persistence_pct"))


def history_jaccard(samples: DataFrame, history: str = "periods", order: str = "target_period_end") -> DataFrame:
    """Jaccard of the histories of consecutive samples of an entity."""
    prev = F.lag(history).over(W.partitionBy("entity").orderBy(order))
    t = samples.select(F.col(history).alias("h"), prev.alias("g")).where("g is not null")
    j = t.select((F.size(F.array_intersect("h", "g")) / F.size(F.array_union("h", "g"))).alias("j"))
    # distinct values are bounded by (history length)^2, so the exact percentile stays small
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("j").alias("mean_j"), F.percentile("j", 0.5).alias("median_j"), F.min("j").alias("min_j"))


def split_overlap(samples: DataFrame, history: str = "periods") -> DataFrame:
    """History periods shared by train and test, and targets of one split seen in the other's history."""
    hist = samples.select("split", "entity", F.explode(history).alias("period")).distinct()
    hist = hist.where(F.col("split").isin("train", "test"))
    target = samples.where(F.col("split").isin("train", "test")).select("split", "entity", F.col("target_period_end").alias("period")).distinct()
    key = ["entity", "period"]
    pick = lambda df, s: df.where(F.col("split") == s).select(*key)
    shared = pick(hist, "train").intersect(pick(hist, "test")).agg(F.count(F.lit(1)).alias("n_shared"))
    tests = pick(hist, "test").agg(F.count(F.lit(1)).alias("n_test_periods"))
    seen = pick(target, "test").join(pick(hist, "train"), key, "left_semi").agg(F.count(F.lit(1)).alias("test_targets_in_train"))
    back = pick(target, "train").join(pick(hist, "test"), key, "left_semi").agg(F.count(F.lit(1)).alias("train_targets_in_test"))
    return shared.select(
        "n_shared", tests.scalar().alias("n_test_periods"), seen.scalar().alias("test_targets_in_train"),
        back.scalar().alias("train_targets_in_test"))


def row_key(cols: Sequence[str], digits: int = 6) -> Column:
    """Hash of a row rounded to ``digits``; missing equals missing."""
    return F.sha2(F.to_json(F.struct(*[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in cols]), {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame, cols: Sequence[str], ref: str = "train", new: str = "test", split: str = "split") -> DataFrame:
    k = df.where(F.col(split).isin(ref, new)).select(split, row_key(cols).alias("k"))
    n = lambda s: F.count(F.when(F.col(split) == s, 1))
    per = k.groupBy("k").agg(n(ref).alias("r"), n(new).alias("w"))
    return per.agg(
        F.sum("r").alias("n_ref_rows"), F.sum("w").alias("n_new_rows"),
        F.sum(F.when(F.col("r") > 0, F.col("w")).otherwise(0)).alias("n_new_in_ref"),
        F.sum(F.greatest(F.col("r") - 1, F.lit(0))).alias("dup_in_ref"), F.sum(F.greatest(F.col("w") - 1, F.lit(0))).alias("dup_in_new"))


def label_availability(samples: DataFrame) -> DataFrame:
    gap = F.datediff("label_available_on", "target_period_end")
    t = samples.where("label_available_on is not null").select(gap.alias("gap"))
    # gaps are whole days, so the exact percentile keeps few counters
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gap") <= 0).cast("int")).alias("n_not_after"),
                 F.min("gap").alias("min_gap"), F.percentile("gap", 0.5).alias("median_gap"))


def fiscal_continuity(panel: DataFrame) -> DataFrame:
    """Each row against its predecessor: the fiscal quarter must be the successor and the end must grow."""
    prev = lambda c: F.lag(c).over(entity_rows())
    want_y = F.when(prev("fiscal_quarter") == 4, prev("fiscal_year") + 1).otherwise(prev("fiscal_year"))
    want_q = F.when(prev("fiscal_quarter") == 4, 1).otherwise(prev("fiscal_quarter") + 1)
    return panel.select(
        "entity", "period_end",
        F.when(prev("fiscal_year").isNull(), 1).otherwise(
            ((F.col("fiscal_year") == want_y) & (F.col("fiscal_quarter") == want_q)).cast("int")).alias("label_ok"),
        F.coalesce((F.col("period_end") > prev("period_end")).cast("int"), F.lit(1)).alias("end_ok"))


def balance_identity(panel: DataFrame, tol: float = 0.005) -> DataFrame:
    """Liabilities against assets minus equity where all three are reported."""
    t = panel.where("liabilities is not null and total_assets is not null and stockholders_equity is not null")
    rel = F.when(F.col("total_assets") != 0, F.abs(F.col("liabilities") - (F.col("total_assets") - F.col("stockholders_equity"))) / F.abs("total_assets")).otherwise(F.lit(float("inf")))
    return t.select(rel.alias("rel")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rel") > tol).cast("int")).alias("n_off"), F.max("rel").alias("worst"))
