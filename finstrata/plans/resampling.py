"""Queries G12, M*: neighbours and resampling of the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R
from ..operators.neighbours import nearest
from .registry import query
from .views import SQL, sql_mix, sql_pair, sql_uniform, vectors

SEED = 42
SQL["v_all"] = (["f_vec"], "SELECT id, x, y, (SELECT 2 * sum(y) <= count(*) FROM f_vec) AS one_small FROM f_vec")
SQL["v_lab"] = (["v_all"], "SELECT id, x, y, CASE WHEN one_small THEN y ELSE 1 - y END AS m FROM v_all")
SQL["v_min"] = (["v_lab"], "SELECT * FROM v_lab WHERE m = 1")
SQL["v_size"] = (["v_lab"], "SELECT sum(m) AS n_min, count(*) - sum(m) AS n_maj FROM v_lab")


def _nn(q, b, k):
    return f"SELECT id, nid, rank, dist, ny FROM (SELECT a.id, b.id AS nid, b.m AS ny, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM {q} a JOIN {b} b ON a.id <> b.id) WHERE rank <= {k}"


SQL["v_nn_min5"] = (["v_min"], _nn("v_min", "v_min", 5))
SQL["v_nn_all3"] = (["v_lab"], _nn("v_lab", "v_lab", 3))
SQL["v_nn_min10"] = (["v_min", "v_lab"], _nn("v_min", "v_lab", 10))


def _pos(src, seed=SEED):
    return f"SELECT *, row_number() OVER (ORDER BY {sql_uniform('id', seed)}, id) AS pos FROM {src}"


def _new(ratio):
    return f"(SELECT CAST(round({ratio} * n_maj) - n_min AS BIGINT) FROM v_size)"


@query("g12_nearest_neighbours", "SELECT id, nid, rank, round(dist, 6) AS dist FROM v_nn_all3", ["v_nn_all3"])
def g12(spark, sf):
    v = vectors(spark, sf)
    return nearest(v, v, 3)


@query("m1_random_over", f"SELECT id, count(*) AS copies FROM (SELECT id FROM v_lab UNION ALL SELECT p.id FROM (SELECT {sql_mix('i', SEED + 1)} % (SELECT n_min FROM v_size) + 1 AS pos FROM (SELECT unnest(range(0, {_new('5e-1')})) AS i)) d JOIN ({_pos('v_min')}) p USING (pos)) GROUP BY id", ["v_min", "v_size"])
def m1(spark, sf):
    return R.random_over(0.5)(vectors(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


@query("m2_random_under", f"SELECT id, CAST(y AS BIGINT) AS y FROM v_min UNION ALL SELECT id, y FROM ({_pos('(SELECT * FROM v_lab WHERE m = 0)')}) WHERE pos <= (SELECT round(n_min / 5e-1) FROM v_size)", ["v_min", "v_size"])
def m2(spark, sf):
    return R.random_under(0.5)(vectors(spark, sf)).select("id", "y")


def _synth(plan, k=5):
    """plan yields (i, id)."""
    return f"""SELECT -(i + 1) AS id, base_id, partner_id, round(gap, 6) AS gap, round(xa[1] + gap * (xb[1] - xa[1]), 6) AS x_first, round(list_sum(xa) + gap * (list_sum(xb) - list_sum(xa)), 6) AS x_sum FROM (
  SELECT t.i, t.id AS base_id, n.nid AS partner_id, t.gap, a.x AS xa, b.x AS xb FROM (SELECT i, id, {sql_mix('i', SEED + 2)} % {k} + 1 AS rank, {sql_uniform('i', SEED + 3)} AS gap FROM ({plan})) t
  JOIN v_nn_min5 n ON n.id = t.id AND n.rank = t.rank JOIN v_min a ON a.id = t.id JOIN v_min b ON b.id = n.nid)"""


def _show(new):
    s = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v)
    return new.select("id", "base_id", "partner_id", "gap", F.get("x", F.lit(0)).alias("x_first"), s.alias("x_sum"))


def _draw(pool, size, ratio):
    return f"SELECT d.i, p.id FROM (SELECT i, {sql_mix('i', SEED + 1)} % {size} + 1 AS pos FROM (SELECT unnest(range(0, {_new(ratio)})) AS i)) d JOIN ({_pos(pool)}) p USING (pos)"


@query("m3_smote", _synth(_draw("v_min", "(SELECT n_min FROM v_size)", "3e-1")), ["v_nn_min5", "v_size"])
def m3(spark, sf):
    return _show(R.smote_rows(vectors(spark, sf), 0.3))


SQL["v_danger"] = (["v_nn_min10"], "SELECT id FROM v_nn_min10 GROUP BY id HAVING sum(1 - ny) > sum(ny)")


@query("m4_borderline_smote", _synth(_draw("(SELECT id FROM v_danger UNION ALL SELECT id FROM v_min WHERE NOT EXISTS (SELECT 1 FROM v_danger))", "(SELECT CASE WHEN (SELECT count(*) FROM v_danger) > 0 THEN (SELECT count(*) FROM v_danger) ELSE n_min END FROM v_size)", "5e-1")), ["v_nn_min5", "v_danger", "v_size"])
def m4(spark, sf):
    return _show(R.borderline_rows(vectors(spark, sf), 0.5))


SQL["v_share"] = (["v_nn_min10"], "SELECT id, sum(1 - ny) / 5e0 AS s FROM v_nn_min10 WHERE rank <= 5 GROUP BY id")
SQL["v_want"] = (["v_share", "v_size"], f"SELECT id, CASE WHEN (SELECT sum(s) FROM v_share) > 0 THEN s / (SELECT sum(s) FROM v_share) ELSE 1e0 / (SELECT count(*) FROM v_share) END * {_new('5e-1')} AS want FROM v_share")
SQL["v_quota"] = (["v_want", "v_size"], f"SELECT id, CAST(floor(want) + CASE WHEN id = (SELECT id FROM v_want ORDER BY round(want - floor(want), 9) DESC, id LIMIT 1) THEN {_new('5e-1')} - (SELECT sum(floor(want)) FROM v_want) ELSE 0 END AS BIGINT) AS quota FROM v_want")


@query("m5_adasyn", _synth(f"SELECT CAST(first + c AS BIGINT) AS i, id FROM (SELECT id, sum(quota) OVER (ORDER BY id) - quota AS first, unnest(range(0, quota)) AS c FROM v_quota WHERE quota > 0)"), ["v_nn_min5", "v_quota"])
def m5(spark, sf):
    return _show(R.adasyn_rows(vectors(spark, sf), 0.5))


SQL["v_nn1"] = (["v_nn_all3"], "SELECT id, nid FROM v_nn_all3 WHERE rank = 1")
SQL["v_tomek"] = (["v_nn1", "v_lab"], "SELECT a.id, a.nid AS partner FROM v_nn1 a JOIN v_nn1 b ON b.id = a.nid AND b.nid = a.id JOIN v_lab u ON u.id = a.id JOIN v_lab w ON w.id = a.nid WHERE u.m = 0 AND w.m = 1")


@query("m6_tomek_links", "SELECT id, partner FROM v_tomek", ["v_tomek"])
def m6(spark, sf):
    return R.tomek_links(vectors(spark, sf))


SQL["v_enn"] = (["v_nn_all3", "v_lab"], "SELECT n.id FROM v_nn_all3 n JOIN v_lab l ON l.id = n.id WHERE l.m = 0 GROUP BY n.id HAVING sum(ny) > 0")


@query("m7_edited_neighbours", "SELECT id FROM v_lab WHERE id NOT IN (SELECT id FROM v_enn)", ["v_enn"])
def m7(spark, sf):
    return R.enn()(vectors(spark, sf)).select("id")


@query("m7_edited_neighbours_mode", "SELECT n.id FROM v_nn_all3 n JOIN v_lab l ON l.id = n.id GROUP BY n.id, l.m, l.y HAVING CASE WHEN sum(CASE WHEN l.m = l.y THEN ny ELSE 1 - ny END) >= 2 THEN 1 ELSE 0 END <> l.y", ["v_nn_all3", "v_lab"])
def m7b(spark, sf):
    return R.enn_rejects(vectors(spark, sf), kind="mode", strategy="all")


@query("m8_sampler_chain", f"SELECT CAST(y AS BIGINT) AS y, count(*) AS n FROM (SELECT y FROM v_min UNION ALL SELECT y FROM v_lab WHERE m = 0 AND id NOT IN (SELECT id FROM v_tomek)) GROUP BY y", ["v_tomek", "v_min"])
def m8(spark, sf):
    return R.chain(R.tomek(), R.random_over(0.01))(vectors(spark, sf)).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


_GROW = lambda r: f"greatest(n_min, CAST(round({r} * n_maj) AS BIGINT))"


@query("m10_smote_then_under", f"SELECT n_min + n_maj AS n_before, CAST({_GROW('3e-1')} + least(n_maj, CAST(round({_GROW('3e-1')} / 5e-1) AS BIGINT)) AS BIGINT) AS n_after, CAST({_GROW('3e-1')} - n_min AS BIGINT) AS n_synthetic FROM (SELECT CAST(n_min AS BIGINT) AS n_min, CAST(n_maj AS BIGINT) AS n_maj FROM v_size)", ["v_size"])
def m10(spark, sf):
    t = R.before_after(vectors(spark, sf), R.make_sampler("smote_under", ratio=0.3, under=0.5))
    at = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    return t.agg(at("before", "n").alias("n_before"), at("after", "n").alias("n_after"), at("after", "n_synthetic").alias("n_synthetic"))


@query("m11_single_sampler_registry")
def m11(spark, sf):
    v = vectors(spark, sf)
    out = None
    for kind in ("random_over", "random_under", "smote", "adasyn"):
        one = R.before_after(v, R.make_sampler(kind, ratio=0.5)).withColumn("sampler", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("m12_hybrid_samplers")
def m12(spark, sf):
    v = vectors(spark, sf)
    a = R.before_after(v, R.make_sampler("smote_tomek", ratio=0.4)).withColumn("sampler", F.lit("smote_tomek"))
    return a.unionByName(R.before_after(v, R.make_sampler("smote_enn", ratio=0.4)).withColumn("sampler", F.lit("smote_enn")))


@query("m14_distribution_probe", "SELECT 'before' AS stage, CAST(n_min + n_maj AS BIGINT) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM v_lab) AS positives, CAST(0 AS BIGINT) AS n_synthetic FROM v_size UNION ALL SELECT 'after', CAST(n_min + round(n_min / 5e-1) AS BIGINT), (SELECT CAST(sum(y) AS BIGINT) FROM v_min), 0 FROM v_size", ["v_size", "v_min"])
def m14(spark, sf):
    return R.before_after(vectors(spark, sf), R.random_under(0.5))


@query("m15_fold_sampler_stats", f"SELECT CAST(sum(y) AS BIGINT) AS positives, count(*) AS n FROM (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY {sql_uniform(sql_pair('1', 'id'), SEED)}, id) - 1) % 4 AS fold FROM v_lab) WHERE fold <> 0", ["v_lab"])
def m15(spark, sf):
    from ..operators.validate import stratified_folds
    v = stratified_folds(vectors(spark, sf), 4).where("fold <> 0").drop("fold")
    return R.before_after(v, R.make_sampler("none")).where("stage = 'after'").select("positives", "n")


@query("m16_leak_demonstration", f"SELECT CAST(sum(CASE WHEN u < 2e-1 THEN 1 ELSE 0 END) AS BIGINT) AS n_test, CAST(sum(CASE WHEN u < 2e-1 AND syn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_synthetic_in_test FROM (SELECT {sql_uniform(sql_pair('aid', 'syn'), SEED)} AS u, syn FROM (SELECT id AS aid, 0 AS syn FROM v_lab UNION ALL SELECT i + 1, 1 FROM (SELECT unnest(range(0, {_new('3e-1')})) AS i)))", ["v_lab", "v_size"])
def m16(spark, sf):
    return R.leak_count(vectors(spark, sf), R.smote(0.3))
