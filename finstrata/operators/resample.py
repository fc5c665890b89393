"""Resampling of labelled vector tables (id, x array<double>, y 0/1). Applied to training rows only.

Draws depend on keys, not on partitions: the same rows are chosen after a task retry. Synthetic rows carry negative ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import SEED
from ..functions.draws import with_mix, with_pair_uniform, with_uniform
from ..functions.ordered import hash_rank, running_totals
from ..sources.landing import land
from .neighbours import Index, nearest

Sampler = Callable[[DataFrame], DataFrame]


def class_sizes(df: DataFrame, minority: int | None = None) -> tuple[int, int, int]:
    """(minority label, minority size, majority size): two numbers; the smaller class is the minority unless given."""
    n = {int(r["y"]): int(r["n"]) for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    label = minority if minority is not None else (1 if n1 <= n0 else 0)
    return label, (n1 if label else n0), (n0 if label else n1)


def numbered(df: DataFrame, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``pos``, the place of each row in a repeatable random order."""
    t = with_uniform(df, "_o", F.col("id"), seed)
    return hash_rank(t, F.col("_o"), "id", by, "pos").drop("_o")


def draws(df: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """``n`` draws with replacement out of ``size`` numbered rows: (i, pos)."""
    t = df.sparkSession.range(n).withColumnRenamed("id", "i")
    return with_mix(t, "_m", F.col("i"), seed).select("i", (F.col("_m") % size + 1).alias("pos"))


def random_over(ratio: float = 0.5, seed: int = SEED, minority: int | None = None) -> Sampler:
    """Duplicate minority rows until they reach ``ratio`` of the majority; never removes rows."""

    def run(df: DataFrame) -> DataFrame:
        label, n_min, n_maj = class_sizes(df, minority)
        n_new = max(0, round(ratio * n_maj) - n_min)
        if not n_min or not n_maj or not n_new:
            return df
        pool = numbered(df.where(F.col("y") == label), seed)
        extra = draws(df, n_new, n_min, seed + 1).join(pool, "pos").drop("pos", "i")
        return df.unionByName(extra.select(*df.columns))

    return run


def random_under(ratio: float = 0.5, seed: int = SEED, minority: int | None = None) -> Sampler:
    """Keep every minority row and exactly n_min / ratio majority rows, chosen by hash order."""

    def run(df: DataFrame) -> DataFrame:
        label, n_min, n_maj = class_sizes(df, minority)
        keep = round(n_min / ratio)
        if not n_min or not n_maj or keep >= n_maj:
            return df
        major = numbered(df.where(F.col("y") != label), seed).where(F.col("pos") <= keep).drop("pos")
        return df.where(F.col("y") == label).unionByName(major.select(*df.columns))

    return run


def _blend(a: Column, b: Column, gap: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u + gap * (v - u))


def _synthesize(plan: DataFrame, rows: DataFrame, neigh: DataFrame, k: int, label: int, seed: int) -> DataFrame:
    """``plan``: (i, id) base rows to interpolate from; partner and gap are drawn from i."""
    t = with_mix(plan, "_m", F.col("i"), seed + 2).withColumn("rank", (F.col("_m") % k + 1).cast("int")).drop("_m")
    t = with_uniform(t, "gap", F.col("i"), seed + 3)
    base = rows.select("id", F.col("x").alias("xa"))
    part = rows.select(F.col("id").alias("nid"), F.col("x").alias("xb"))
    j = t.join(neigh.select("id", "rank", "nid"), ["id", "rank"]).join(base, "id").join(part, "nid")
    return j.select((-(F.col("i") + 1)).alias("id"), _blend(F.col("xa"), F.col("xb"), F.col("gap")).alias("x"), F.lit(label).alias("y"),
                    F.col("id").alias("base_id"), F.col("nid").alias("partner_id"), "gap")


def smote_rows(df: DataFrame, ratio: float = 0.1, k: int = 5, seed: int = SEED, minority: int | None = None) -> DataFrame | None:
    """The synthetic rows with their parents, or None when nothing is to be added."""
    label, n_min, n_maj = class_sizes(df, minority)
    n_new = max(0, round(ratio * n_maj) - n_min)
    if n_min < 2 or not n_maj or not n_new:
        return None
    rows = df.where(F.col("y") == label)
    kk = max(1, min(k, n_min - 1))
    base = draws(df, n_new, n_min, seed + 1).join(numbered(rows.select("id"), seed), "pos").select("i", "id")
    return _synthesize(base, rows, nearest(rows, rows, kk), kk, label, seed)


def smote(ratio: float = 0.1, k: int = 5, seed: int = SEED, minority: int | None = None) -> Sampler:
    def run(df: DataFrame) -> DataFrame:
        new = smote_rows(df, ratio, k, seed, minority)
        return df if new is None else df.unionByName(new.select("id", "x", "y").select(*df.columns))

    return run


def majority_votes(query: DataFrame, df: DataFrame, k: int, label: int) -> DataFrame:
    """(id, n_major, n_minor): classes among the k nearest rows of the whole table."""
    lab = df.select(F.col("id").alias("nid"), F.col("y").alias("ny"))
    v = nearest(query, df, k).join(lab, "nid")
    return v.groupBy("id").agg(F.sum((F.col("ny") != label).cast("int")).alias("n_major"), F.sum((F.col("ny") == label).cast("int")).alias("n_minor"))


def borderline_rows(df: DataFrame, ratio: float = 0.5, k: int = 5, m: int = 10, seed: int = SEED, minority: int | None = None) -> DataFrame | None:
    label, n_min, n_maj = class_sizes(df, minority)
    n_new = max(0, round(ratio * n_maj) - n_min)
    if n_min < 2 or not n_maj or not n_new:
        return None
    rows = df.where(F.col("y") == label)
    danger = majority_votes(rows, df, max(1, min(m, n_min + n_maj - 1)), label).where("n_major > n_minor").select("id")
    n_danger = danger.count()
    pool, size = (danger, n_danger) if n_danger else (rows.select("id"), n_min)
    kk = max(1, min(k, n_min - 1))
    base = draws(df, n_new, size, seed + 1).join(numbered(pool, seed), "pos").select("i", "id")
    return _synthesize(base, rows, nearest(rows, rows, kk), kk, label, seed)


def borderline_smote(ratio: float = 0.5, k: int = 5, m: int = 10, seed: int = SEED, minority: int | None = None) -> Sampler:
    def run(df: DataFrame) -> DataFrame:
        new = borderline_rows(df, ratio, k, m, seed, minority)
        return df if new is None else df.unionByName(new.select("id", "x", "y").select(*df.columns))

    return run


def adasyn_quota(votes: DataFrame, n_new: int) -> DataFrame:
    """Synthetic rows per minority row in proportion to its share of majority neighbours; what rounding leaves over goes to
    the row with the largest fraction."""
    share = votes.select("id", (F.col("n_major") / (F.col("n_major") + F.col("n_minor"))).alias("s"))
    total = share.agg(F.sum("s").alias("t")).scalar()
    size = share.agg(F.count(F.lit(1)).alias("c")).scalar()
    q = share.withColumn("_t", total).withColumn("_c", size).select("id", F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(1.0 / F.col("_c")).alias("w"))
    q = q.select("id", (F.col("w") * n_new).alias("want")).withColumn("base", F.floor("want"))
    rest = q.agg((F.lit(n_new) - F.sum("base")).alias("r")).scalar()
    first = q.agg(F.max_by("id", F.struct(F.round(F.col("want") - F.col("base"), 9), -F.col("id"))).alias("f")).scalar()
    q = q.withColumn("_r", rest).withColumn("_f", first)
    return q.select("id", (F.col("base") + F.when(F.col("id") == F.col("_f"), F.col("_r")).otherwise(0)).cast("bigint").alias("quota"))


def adasyn_rows(df: DataFrame, ratio: float = 0.5, k: int = 5, seed: int = SEED, minority: int | None = None) -> DataFrame | None:
    label, n_min, n_maj = class_sizes(df, minority)
    n_new = max(0, round(ratio * n_maj) - n_min)
    if n_min < 2 or not n_maj or not n_new:
        return None
    rows = df.where(F.col("y") == label)
    quota = adasyn_quota(majority_votes(rows, df, max(1, min(k, n_min + n_maj - 1)), label), n_new)
    kk = max(1, min(k, n_min - 1))
    # rows are numbered 0 .. n_new - 1 in the order of their base: running sums of the quotas, one exchange by ranges of id
    before = running_totals(quota.where("quota > 0"), "id", ["quota"]).select("id", "quota", (F.col("quota_cum") - F.col("quota")).alias("first"))
    each = before.select("id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("i"))
    return _synthesize(each.select("i", "id"), rows, nearest(rows, rows, kk), kk, label, seed)


def adasyn(ratio: float = 0.5, k: int = 5, seed: int = SEED, minority: int | None = None) -> Sampler:
    def run(df: DataFrame) -> DataFrame:
        new = adasyn_rows(df, ratio, k, seed, minority)
        return df if new is None else df.unionByName(new.select("id", "x", "y").select(*df.columns))

    return run


def tomek_links(df: DataFrame, minority: int | None = None) -> DataFrame:
    """(id, partner): majority rows in a mutual nearest pair with a minority row. Only majority rows that are somebody's
    nearest neighbour can be in a link, so the second search is limited to those."""
    label, _, _ = class_sizes(df, minority)
    small = df.where(F.col("y") == label)
    index = Index.of(df, 1)  # both searches read it
    toward = nearest(small, index, 1).select(F.col("id").alias("partner"), F.col("nid").alias("id"))
    cands = df.where(F.col("y") != label).join(toward.select("id").distinct(), "id", "left_semi")
    back = nearest(cands, index, 1).select("id", F.col("nid").alias("partner"))
    index.drop()
    return toward.join(back, ["id", "partner"])


def tomek(minority: int | None = None) -> Sampler:
    return lambda df: df.join(tomek_links(df, minority).select("id").distinct(), "id", "left_anti").select(*df.columns)


def enn_rejects(df: DataFrame, k: int = 3, kind: str = "all", strategy: str = "auto", minority: int | None = None) -> DataFrame:
    """Rows whose neighbours disagree: any of them ('all') or their mode ('mode'; a tie counts as class 0)."""
    label, n_min, n_maj = class_sizes(df, minority)
    kk = max(1, min(k, n_min + n_maj - 1))
    target = df if strategy == "all" else df.where(F.col("y") != label)
    v = majority_votes(target, df, kk, 1).join(df.select("id", "y"), "id")  # n_minor counts ones, n_major counts zeros
    same = F.when(F.col("y") == 1, F.col("n_minor")).otherwise(F.col("n_major"))
    mode = F.when(F.col("n_minor") > F.col("n_major"), 1).otherwise(0)
    bad = same < kk if kind == "all" else mode != F.col("y")
    return v.where(bad).select("id")


def enn(k: int = 3, kind: str = "all", strategy: str = "auto", minority: int | None = None) -> Sampler:
    return lambda df: df.join(enn_rejects(df, k, kind, strategy, minority), "id", "left_anti").select(*df.columns)


def chain(*steps: Sampler) -> Sampler:
    """One sampler after another. What a step hands on is landed: the next one reads it several times."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps[:-1]:
            df = land(s(df), "sampled-rows")
        return steps[-1](df) if steps else df

    return run


SINGLE_SAMPLERS: dict[str, Callable[..., Sampler]] = {
    "random_over": random_over, "random_under": random_under, "smote": smote, "borderline_smote": borderline_smote, "adasyn": adasyn,
    "tomek": lambda **kw: tomek(kw.get("minority")), "enn": lambda **kw: enn(minority=kw.get("minority")),
}
HYBRID_SAMPLERS: dict[str, Callable[..., Sampler]] = {
    "smote_tomek": lambda ratio=0.5, seed=SEED, **kw: chain(smote(ratio, seed=seed, **kw), tomek(**kw)),
    "smote_enn": lambda ratio=0.5, seed=SEED, **kw: chain(smote(ratio, seed=seed, **kw), enn(**kw)),
    "smote_under": lambda ratio=0.1, under=0.5, seed=SEED, **kw: chain(smote(ratio, seed=seed, **kw), random_under(under, seed=seed, **kw)),
}


def make_sampler(kind: str, **options) -> Sampler:
    table = {**SINGLE_SAMPLERS, **HYBRID_SAMPLERS, "none": lambda **kw: (lambda df: df)}
    if kind not in table:
        raise KeyError(f"unknown sampler {kind!r}; known: {sorted(table)}")
    return table[kind](**options)


def before_after(df: DataFrame, sampler: Sampler) -> DataFrame:
    """Class sizes before and after a sampler."""
    size = lambda d, name: d.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"),
                                 F.sum((F.col("id") < 0).cast("int")).alias("n_synthetic"))
    return size(df, "before").unionByName(size(sampler(df), "after"))


def leak_count(df: DataFrame, sampler: Sampler, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """What goes wrong when resampling precedes the split: synthetic or copied rows that land in the test part."""
    mixed = sampler(df)
    mixed = with_pair_uniform(mixed, "_u", F.abs("id"), (F.col("id") < 0).cast("int"), seed)
    test = mixed.where(F.col("_u") < test_share)
    known = df.select(F.xxhash64("x").alias("h")).distinct()
    return test.withColumn("h", F.xxhash64("x")).join(known.withColumn("known", F.lit(1)), "h", "left").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(F.col("known").isNull().cast("int")).alias("n_synthetic_in_test"))
