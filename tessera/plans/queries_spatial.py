"""Points: neighbours, radius joins, graphs, spanning trees, distances to masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import spatial as SP
from tessera.plans import fixtures as X
from tessera.plans.queries_raster import MASKS, norm_sql
from tessera.plans.registry import query, r6

PA, PB = X.cte("pa"), X.cte("pb")
FRAME = 252.25, 500.0
D = "sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))"


def nn_sql(points: str, k: int) -> str:
    """CTE ``nn(grp, pid, rank, nid, d)`` by the plain join of each group with itself."""
    return f"nn AS (SELECT * FROM (SELECT a.grp, a.pid, b.pid AS nid, {D} AS d, row_number() OVER (PARTITION BY a.grp, a.pid ORDER BY {D}, b.pid) AS rank FROM {points} a JOIN {points} b ON a.grp = b.grp AND a.pid <> b.pid) WHERE rank <= {k})"


NB = f"{PB}, {nn_sql('pb', 5)}"
NB1 = f"{PB}, {nn_sql('pb', 1)}"


@query("J09_knn", f"{NB} SELECT grp, pid, rank, nid, {r6('d', 'd')} FROM nn")
def j09(spark, d):
    return SP.knn(X.points_b(spark, d), 5)


@query("J10_nearest_other", f"{PB}, o AS (SELECT grp, pid, y + 0.3 AS y, x * 0.99 AS x FROM pb WHERE pid % 3 = 0), nn AS (SELECT a.grp, a.pid, min({D}) AS d FROM pb a JOIN o b ON a.grp = b.grp WHERE a.pid % 3 <> 0 GROUP BY ALL) SELECT grp, {r6('avg(d)', 'nn_other_mean_um')} FROM nn GROUP BY grp")
def j10(spark, d):
    p = X.points_b(spark, d)
    o = p.where("pid % 3 = 0").select("grp", "pid", (F.col("y") + 0.3).alias("y"), (F.col("x") * 0.99).alias("x"))
    return SP.nearest(p.where("pid % 3 <> 0"), o, 1).groupBy("grp").agg(F.avg("d").alias("nn_other_mean_um"))


@query("J11_radius_join", f"{PB} SELECT a.grp, a.pid AS a, b.pid AS b, {r6(D, 'd')} FROM pb a JOIN pb b ON a.grp = b.grp AND a.pid < b.pid WHERE {D} <= 4 + a.grp % 7")
def j11(spark, d):
    p = X.points_b(spark, d)
    return SP.within(p, p.select("grp").distinct().withColumn("radius", 4.0 + F.col("grp") % 7))


@query("A39_nn_stats", f"{NB1}, n AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM pb GROUP BY grp), g AS (SELECT grp, avg(d) AS m, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(d) END AS s FROM nn GROUP BY grp), k AS (SELECT *, n / (252.25 * 500) AS lam FROM n LEFT JOIN g USING (grp)) SELECT grp, {r6('n / (252.25 * 500 / 1e6)', 'density_per_mm2')}, {r6('m', 'nn_mean_um')}, {r6('s', 'nn_sd_um')}, {r6('m / (0.5 / sqrt(lam))', 'clark_evans_R')}, {r6('(m - 0.5 / sqrt(lam)) / sqrt((4 - pi()) / (4 * pi() * lam * n))', 'clark_evans_z')} FROM k")
def a39(spark, d):
    p = X.points_b(spark, d)
    return SP.nn_stats(p, SP.knn(p, 1), *FRAME)


@query("A40_knn_means", f"{NB}, n AS (SELECT grp, count(*) AS n FROM pb GROUP BY grp) SELECT grp, {', '.join(r6(f'avg(CASE WHEN rank = {k} THEN d END)', f'knn_k{k}_mean_um') for k in (1, 3, 5))} FROM n LEFT JOIN nn USING (grp) GROUP BY grp")
def a40(spark, d):
    p = X.points_b(spark, d)
    return SP.knn_means(p, SP.knn(p, 5))


@query("A38_grid_dispersion", f"{PB}, c AS (SELECT grp, least(greatest(floor(y * 10 / 252.25), 0), 9) AS r, least(greatest(floor(x * 10 / 500), 0), 9) AS c, count(*) AS n FROM pb GROUP BY ALL), s AS (SELECT grp, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS q FROM c GROUP BY grp) SELECT grp, {r6('(q - s * s / 100) / 99 / (s / 100)', 'grid_vmr')}, {r6('sqrt((q - s * s / 100) / 99) / (s / 100)', 'grid_cv')} FROM s")
def a38(spark, d):
    return SP.grid_dispersion(X.points_b(spark, d), *FRAME)


@query("G03_proximity_graph", f"""{PB}, {nn_sql('pb', 1)}, rd AS (SELECT grp, greatest(avg(d) * 1.5, 1) AS r FROM nn GROUP BY grp),
e AS (SELECT a.grp, a.pid AS a, b.pid AS b FROM pb a JOIN rd USING (grp) JOIN pb b ON a.grp = b.grp AND a.pid <> b.pid WHERE {D} <= r),
rc AS (SELECT grp, pid, pid AS seen FROM pb UNION SELECT rc.grp, rc.pid, e.b FROM rc JOIN e ON e.grp = rc.grp AND e.a = rc.seen),
cp AS (SELECT grp, pid, min(seen) AS c FROM rc GROUP BY ALL), dg AS (SELECT pb.grp, pb.pid, CAST(count(e.b) AS DOUBLE) AS g FROM pb LEFT JOIN e ON e.grp = pb.grp AND e.a = pb.pid GROUP BY ALL),
cs AS (SELECT grp, c, count(*) AS n FROM cp GROUP BY ALL), ca AS (SELECT grp, count(*) AS k, max(n) AS mx, sum(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END) AS single, CAST(sum(n) AS DOUBLE) AS n FROM cs GROUP BY grp)
SELECT grp, {r6('any_value(r)', 'graph_radius_um')}, {r6('avg(g)', 'graph_mean_degree')}, {r6('stddev_samp(g)', 'graph_sd_degree')}, {r6('any_value(k)', 'graph_components')}, {r6('any_value(mx) / any_value(n)', 'graph_largest_component_frac')}, {r6('any_value(single) / any_value(n)', 'graph_singleton_frac')} FROM rd JOIN dg USING (grp) JOIN ca USING (grp) GROUP BY grp""")
def g03(spark, d):
    p = X.points_b(spark, d)
    return SP.proximity_graph(p, SP.knn(p, 1))


PRIM = f"""{X.cte('pa')}, pts AS (SELECT grp, y, x, min(pid) AS pid FROM pa GROUP BY ALL), ed AS (SELECT a.grp, a.pid AS a, b.pid AS b, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d FROM pts a JOIN pts b ON a.grp = b.grp AND a.pid <> b.pid),
pr AS (SELECT grp, [min(pid)] AS tree, CAST(NULL AS DOUBLE) AS d FROM pts GROUP BY grp UNION ALL SELECT grp, list_append(tree, m.b), m.d FROM (SELECT pr.grp, pr.tree, min(struct_pack(d := ed.d, b := ed.b)) AS m FROM pr JOIN ed ON ed.grp = pr.grp AND list_contains(pr.tree, ed.a) AND NOT list_contains(pr.tree, ed.b) GROUP BY ALL))"""


@query("G04_spanning_tree", f"{PRIM} SELECT grp, {r6('avg(d)', 'mst_edge_mean_um')}, {r6('stddev_samp(d)', 'mst_edge_sd_um')}, {r6('quantile_cont(d, 0.75) - quantile_cont(d, 0.25)', 'mst_edge_iqr_um')}, (SELECT count(*) FROM pa WHERE pa.grp = pr.grp) AS n FROM pr WHERE d IS NOT NULL GROUP BY grp")
def g04(spark, d):
    """Boruvka rounds; the SQL grows each tree by Prim's rule."""
    p = X.points_a(spark, d)
    return SP.tree_stats(SP.spanning_tree(p)).join(p.groupBy("grp").agg(F.count("*").alias("n")), "grp")



DIST = f"""{MASKS}, {norm_sql('masks', 'v', 'm2')}, bm AS (SELECT image, row, col FROM masks WHERE m1),
ds AS (SELECT p.image, p.row, p.col, p.m2, p.norm, min(sqrt(pow((p.row - b.row) * 2e0, 2) + pow((p.col - b.col) * 1.5e0, 2))) AS dist FROM nrm p LEFT JOIN bm b ON p.image = b.image GROUP BY ALL)"""


@query("J12_mask_distance", f"{DIST} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('CASE WHEN dist <= 5 THEN dist END', 'dist')} FROM ds")
def j12(spark, d):
    return SP.mask_distance(X.masks(spark, d), ["image"], "m1", 5.0, 2.0, 1.5).select("image", "row", "col", "dist")


def band(a, b):
    return f"avg(CASE WHEN m2 AND dist >= {a} AND dist < {b} THEN norm END)"


@query("A41_radial", f"{DIST} SELECT image, {r6(band(0, 5), 'x_annulus_0_5um_norm_mean')}, {r6(band(5, 15), 'x_annulus_5_15um_norm_mean')}, {r6(band(15, 30), 'x_annulus_15_30um_norm_mean')}, {r6(f'CASE WHEN abs({band(15, 30)}) > 1e-12 THEN {band(0, 5)} / {band(15, 30)} END', 'x_annulus_near_far_ratio')} FROM ds GROUP BY image")
def a41(spark, d):
    from tessera.operators import raster as R

    n = R.normalise(X.masks(spark, d), ["image"], "v", where=F.col("m2"))
    return SP.radial(SP.mask_distance(n, ["image"], "m1", 30.0, 2.0, 1.5), ["image"], "norm", "m2", "x")
