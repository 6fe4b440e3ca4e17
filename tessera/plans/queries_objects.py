"""Connected objects: labelling, clean-up, gates, object measures and mask topology."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.core import load
from tessera.operators import components as C
from tessera.operators import focal as FO
from tessera.operators.graph import connected_components
from tessera.plans import fixtures as X
from tessera.plans import segmentation as SG
from tessera.plans.queries_raster import HSV, MASKS, RGB, STAINS, VALID, focal_sql, norm_sql, otsu_sql, valid
from tessera.plans.registry import query, r6

IM = ["image"]
STRIDE = C.STRIDE


def label_sql(src: str, name: str, conn: int = 8, key: str = "image") -> str:
    """CTEs ending in ``{name}(key, row, col, label)``: label = least row * STRIDE + col reachable, by pixel steps."""
    reach = f"abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if conn == 8 else "abs(a.row - b.row) + abs(a.col - b.col) <= 1"
    return f"""{name}_r AS (SELECT {key}, row, col, row AS fr, col AS fc FROM {src} UNION SELECT r.{key}, r.row, r.col, b.row, b.col FROM {name}_r r JOIN (SELECT a.{key}, a.row AS ar, a.col AS ac, b.row, b.col FROM {src} a JOIN {src} b ON a.{key} = b.{key} AND {reach}) b ON b.{key} = r.{key} AND b.ar = r.fr AND b.ac = r.fc),
{name} AS (SELECT {key}, row, col, min(CAST(fr AS BIGINT) * {STRIDE} + fc) AS label FROM {name}_r GROUP BY ALL)"""


FG = f"{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m1), pix AS (SELECT image, row, col FROM masks)"
LB = f"{FG}, {label_sql('fg', 'lb')}"
OUT = "SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col"
SIZE = "sz AS (SELECT image, label, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM {l} GROUP BY image, label)"


def fg(spark, d, m="m1"):
    return X.masks(spark, d).where(m).select("image", "row", "col")


def pix(spark, d):
    return X.masks(spark, d).select("image", "row", "col")


def lab(spark, d):
    return C.label(fg(spark, d), IM)


@query("W05_runs", f"{FG}, k AS (SELECT *, col - row_number() OVER (PARTITION BY image, row ORDER BY col) AS i FROM fg) SELECT image, CAST(row AS BIGINT) AS row, CAST(min(col) AS BIGINT) AS c0, CAST(max(col) AS BIGINT) AS c1 FROM k GROUP BY image, row, i")
def w05(spark, d):
    return C.runs(fg(spark, d), IM)


@query("G01_label8", f"{LB} {OUT}, label FROM lb")
def g01(spark, d):
    return lab(spark, d)


@query("G01_label4", f"{FG}, {label_sql('fg', 'lb', 4)} {OUT}, label FROM lb")
def g01b(spark, d):
    return C.label(fg(spark, d), IM, 4)


EDGES = "e0 AS (SELECT o_custkey * 4 AS a, o_orderkey * 4 + 1 AS b FROM orders UNION SELECT l_suppkey * 4 + 2, l_partkey * 4 + 3 FROM lineitem), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"


@query("G02_components", f"WITH RECURSIVE {EDGES}, cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(cc.component) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS r ON r.node = e.b WHERE cc.component < r.component GROUP BY e.b) SELECT node, component FROM cc")
def g02(spark, d):
    """Customers and their orders (a star each), suppliers and the parts they ship (one large component)."""
    o = load(spark, d, "orders").select((F.col("o_custkey") * 4).alias("src"), (F.col("o_orderkey") * 4 + 1).alias("dst"))
    return connected_components(o.union(load(spark, d, "lineitem").select(F.col("l_suppkey") * 4 + 2, F.col("l_partkey") * 4 + 3)), stars=True)


L4 = f"{FG}, {label_sql('fg', 'lb', 4)}"


@query("R04_remove_small", f"{L4}, {SIZE.format(l='lb')} {OUT} FROM lb JOIN sz USING (image, label) WHERE area >= 3")
def r04(spark, d):
    return C.remove_small(fg(spark, d), IM, 3)


@query("R05_remove_long", f"{LB}, {SIZE.format(l='lb')} {OUT} FROM lb JOIN sz USING (image, label) WHERE greatest(r1 - r0, c1 - c0) + 1 < 4")
def r05(spark, d):
    return C.remove_long(fg(spark, d), IM, 0.5, 8, 8)


FG2 = f"{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m2), bg AS (SELECT image, row, col FROM masks WHERE NOT m2), {label_sql('bg', 'lb', 4)}, {SIZE.format(l='lb')}"


@query("R06_fill_holes", f"{FG2} {OUT} FROM (SELECT image, row, col FROM fg UNION ALL SELECT image, row, col FROM lb JOIN sz USING (image, label) WHERE r0 > 0 AND c0 > 0 AND r1 < 7 AND c1 < 7)")
def r06(spark, d):
    return C.fill_holes(pix(spark, d), fg(spark, d, "m2"), IM, 8, 8)


@query("R06_fill_small", f"{FG2} {OUT} FROM (SELECT image, row, col FROM fg UNION ALL SELECT image, row, col FROM lb JOIN sz USING (image, label) WHERE area < 3)")
def r06b(spark, d):
    return C.fill_holes(pix(spark, d), fg(spark, d, "m2"), IM, 8, 8, 3)


@query("R07_clear_border", f"{LB}, {SIZE.format(l='lb')} {OUT} FROM lb JOIN sz USING (image, label) WHERE r0 > 0 AND c0 > 0 AND r1 < 7 AND c1 < 7")
def r07(spark, d):
    return C.clear_border(fg(spark, d), IM, 8, 8)


def clean_sql(src: str, hit: str, pixels: str) -> str:
    """CTEs ending in ``s3``: closing 1, objects of 3 pixels and more, holes below 5 filled."""
    return f"""{focal_sql(src, hit, 1, 'bool_or', 'c1')}, {focal_sql('c1', 'x', 1, 'bool_and', 'c2')}, s0 AS (SELECT image, row, col FROM c2 WHERE x), {label_sql('s0', 'la', 4)},
z1 AS (SELECT image, label FROM la GROUP BY ALL HAVING count(*) >= 3), s1 AS (SELECT la.image, row, col FROM la JOIN z1 USING (image, label)),
b1 AS (SELECT image, row, col FROM {pixels} ANTI JOIN s1 USING (image, row, col)), {label_sql('b1', 'lh', 4)}, z3 AS (SELECT image, label FROM lh GROUP BY ALL HAVING count(*) < 5),
s3 AS (SELECT image, row, col FROM s1 UNION ALL SELECT lh.image, row, col FROM lh JOIN z3 USING (image, label))"""


R08 = f"{MASKS}, {clean_sql('masks', 'm2', 'masks')}"
MORPH = {"close_radius": 1, "small": 3, "fill": True, "fill_area": 5}


@query("R09_hue_engine", f"{HSV}, hh AS (SELECT image, row, col, (h >= 0.9 OR h <= 0.2) AND s >= 0.05 AND v >= 0.2 AND v <= 0.95 AND ({VALID}) AS hit FROM hsv), {clean_sql('hh', 'hit', 'hh')} {OUT} FROM s3")
def r09(spark, d):
    return SG.hue_range(X.rgb(spark, d), IM, valid(), 8, 8, 0.9, 0.2, 0.05, 0.2, 0.95, **MORPH)[0]


SEG = f"""{STAINS}, sv AS (SELECT st.image, st.row, st.col, st.dab AS raw, ({VALID}) AS ok FROM st JOIN hsv USING (image, row, col)), {norm_sql('sv', 'raw', 'ok')},
n1 AS (SELECT *, 1 - norm AS inv, bool_or(ok) OVER (PARTITION BY image) AS has FROM nrm), us AS (SELECT * FROM n1 WHERE ok OR NOT has), {otsu_sql('us', 'norm', 'a')}, {otsu_sql('us', 'inv', 'b')},
fr AS (SELECT image, avg(CASE WHEN norm > aotsu.t THEN 1e0 ELSE 0e0 END) AS f1, avg(CASE WHEN inv > botsu.t THEN 1e0 ELSE 0e0 END) AS f2 FROM n1 JOIN aotsu USING (image) JOIN botsu USING (image) GROUP BY image),
iv AS (SELECT image, CASE WHEN f1 BETWEEN 0.005 AND 0.35 AND NOT f2 BETWEEN 0.005 AND 0.35 THEN false WHEN f2 BETWEEN 0.005 AND 0.35 AND NOT f1 BETWEEN 0.005 AND 0.35 THEN true ELSE abs(f1 - 0.1775) > abs(f2 - 0.1775) END AS invert FROM fr),
hh AS (SELECT n1.image, n1.row, n1.col, ok AND CASE WHEN invert THEN inv > least(greatest(botsu.t * 0.9, 0), 1) ELSE norm > least(greatest(aotsu.t * 0.9, 0), 1) END AS hit FROM n1 JOIN iv USING (image) JOIN aotsu USING (image) JOIN botsu USING (image))"""
SEG = SEG.replace(STAINS, HSV + STAINS[len(RGB) :])


@query("R08_stain_channel", f"{SEG}, {clean_sql('hh', 'hit', 'hh')} {OUT} FROM s3")
def r08s(spark, d):
    return SG.stain_channel(X.rgb(spark, d), IM, "dab", valid(), 8, 8, scale=0.9, **MORPH)[0]


@query("R08_R09_clean_up", f"{R08} {OUT} FROM s3")
def r08(spark, d):
    return C.clean_up(X.masks(spark, d), IM, "m2", 8, 8, close_radius=1, small=3, fill=True, fill_area=5)


GATE = f"{LB}, gt AS (SELECT image, row, col, abs(v) > 0.3 AS g FROM masks), {focal_sql('gt', 'g', 2, 'bool_or', 'dg')}"


@query("R10_J07_gate_touching", f"{GATE}, ok AS (SELECT DISTINCT image, label FROM lb JOIN dg USING (image, row, col) WHERE x) {OUT} FROM lb JOIN ok USING (image, label)")
def r10(spark, d):
    p = X.masks(spark, d).withColumn("g", F.abs("v") > 0.3)
    return C.gate(fg(spark, d), p, "g", IM)


@query("J07_gate_overlap", f"{GATE}, ok AS (SELECT image, label FROM lb JOIN gt USING (image, row, col) GROUP BY ALL HAVING avg(CASE WHEN g THEN 1e0 ELSE 0e0 END) >= 0.1) {OUT} FROM lb JOIN ok USING (image, label)")
def j07(spark, d):
    p = X.masks(spark, d).withColumn("g", F.abs("v") > 0.3)
    return C.gate(fg(spark, d), p, "g", IM, mode="intersect", min_overlap=0.1)


@query("J08_touching", f"{LB}, gt AS (SELECT image, row, col, abs(v) > 0.3 AS g FROM masks), {focal_sql('gt', 'g', 2, 'bool_or', 'dg')}, o AS (SELECT image, label, max(CASE WHEN x THEN 1e0 ELSE 0e0 END) AS n, max(CASE WHEN g THEN 1e0 ELSE 0e0 END) AS o FROM lb JOIN dg USING (image, row, col) JOIN gt USING (image, row, col) GROUP BY ALL) SELECT image, {r6('avg(n)', 'x_touching_object_fraction')}, {r6('avg(o)', 'x_overlapping_object_fraction')} FROM o GROUP BY image")
def j08(spark, d):
    return C.touching(lab(spark, d), X.masks(spark, d).withColumn("g", F.abs("v") > 0.3), "g", IM, "x")


OBJ = {"mean": "avg(v)", "std": "stddev_pop(v)", "median": "median(v)", "iqr": "quantile_cont(v,0.75)-quantile_cont(v,0.25)", "integrated": "sum(v)", "min": "min(v)", "max": "max(v)", "skew": "CASE WHEN count(*) >= 3 AND max(v)-min(v) >= 1e-12 THEN skewness(v) END", "kurtosis": "CASE WHEN count(*) >= 4 AND max(v)-min(v) >= 1e-12 THEN kurtosis(v) END"}


@query("A17_object_intensity", f"{LB} SELECT image, label, {', '.join(r6(e, 'intensity_raw_' + n) for n, e in OBJ.items())} FROM lb JOIN masks USING (image, row, col) GROUP BY image, label")
def a17(spark, d):
    return C.intensity(lab(spark, d).join(X.masks(spark, d), ["image", "row", "col"]), IM, "v", "intensity_raw")


GEO = f"""{LB}, g AS (SELECT image, label, CAST(count(*) AS DOUBLE) AS n, avg(row) AS cr, avg(col) AS cc, var_pop(row) + 1e0/12 AS a, covar_pop(row, col) AS b, var_pop(col) + 1e0/12 AS c, max(row) - min(row) + 1e0 AS bh, max(col) - min(col) + 1e0 AS bw FROM lb GROUP BY image, label),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0) AS l2 FROM g)"""


@query("A18_A43_geometry", f"""{GEO} SELECT image, label, {r6('cr', 'centroid_row_um')}, {r6('cc', 'centroid_col_um')}, {r6('n', 'area_um2')}, {r6('sqrt(n * 4 / pi())', 'equivalent_diameter_um')}, {r6('4 * sqrt(l1)', 'major_axis_length_um')}, {r6('4 * sqrt(l2)', 'minor_axis_length_um')}, {r6('sqrt(greatest(1 - l2 / l1, 0))', 'eccentricity')}, {r6('n / (bh * bw)', 'extent')},
{r6('CASE WHEN abs(b) < 1e-9 AND abs(a - c) < 1e-9 THEN 45 ELSE degrees(atan2(CASE WHEN abs(b) < 1e-9 THEN 0e0 ELSE 2 * b END, a - c) / 2) END', 'orientation_deg')}, {r6('bh * bw', 'bbox_area_um2')}, {r6('n / (bh * bw)', 'bbox_fill_ratio')}, {r6('bw / bh', 'bbox_aspect_ratio')}, {r6('sqrt(l1) / sqrt(l2)', 'elongation')} FROM e""")
def a18(spark, d):
    return C.geometry(lab(spark, d), IM)


PERI = f"""{LB}, nb AS (SELECT a.image, a.label, a.row, a.col, count(*) FILTER (abs(a.row-b.row)+abs(a.col-b.col) = 1) AS s FROM lb a JOIN lb b ON a.image=b.image AND a.label=b.label AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 GROUP BY ALL),
bd AS (SELECT * FROM nb WHERE s < 4), cd AS (SELECT a.image, a.label, a.row, a.col, 1 + 2 * count(*) FILTER (abs(a.row-b.row)+abs(a.col-b.col) = 1) + 10 * count(*) FILTER (abs(a.row-b.row)+abs(a.col-b.col) = 2) AS code FROM bd a JOIN bd b ON a.image=b.image AND a.label=b.label AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 GROUP BY ALL),
pe AS (SELECT image, label, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1e0 WHEN code IN (21,33) THEN sqrt(2e0) WHEN code IN (13,23) THEN (1+sqrt(2e0))/2 ELSE 0e0 END) AS perimeter FROM cd GROUP BY ALL)"""


@query("A19_perimeter", f"{PERI} SELECT image, label, {r6('perimeter', 'perimeter')} FROM pe")
def a19(spark, d):
    return C.perimeter(lab(spark, d), IM)


HOLE = f"""{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m2), {label_sql('fg', 'lb')}, {SIZE.format(l='lb')},
ring AS (SELECT image * 100000000 * {STRIDE}::HUGEINT + label AS k, image, label, r, c FROM sz, unnest(range(r0 - 1, r1 + 2)) AS t(r), unnest(range(c0 - 1, c1 + 2)) AS u(c)),
bgp AS (SELECT k, CAST(r AS INT) + 1 AS row, CAST(c AS INT) + 1 AS col FROM ring WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.image = ring.image AND lb.label = ring.label AND lb.row = ring.r AND lb.col = ring.c)),
{label_sql('bgp', 'lk', 4, 'k')}, part AS (SELECT k, label AS p, count(*) AS area, min(row) - 1 AS h0 FROM lk GROUP BY ALL),
hk AS (SELECT sz.image, sz.label, sum(part.area) AS hole_area, count(*) AS holes FROM part JOIN (SELECT DISTINCT k, image, label FROM ring) USING (k) JOIN sz USING (image, label) WHERE h0 >= r0 GROUP BY ALL)"""


@query("A20_filled_area", f"{HOLE} SELECT sz.image, sz.label, area, CAST(coalesce(hole_area, 0) AS BIGINT) AS hole_area, CAST(coalesce(holes, 0) AS BIGINT) AS holes, CAST(area + coalesce(hole_area, 0) AS BIGINT) AS filled_area, CAST(1 - coalesce(holes, 0) AS BIGINT) AS euler, CAST(CASE WHEN coalesce(holes, 0) = 1 THEN 1 ELSE 1 - coalesce(holes, 0) END AS BIGINT) AS euler_reported FROM sz LEFT JOIN hk USING (image, label)")
def a20(spark, d):
    return C.filled_area(C.label(fg(spark, d, "m2"), IM), IM)


@query("P21_shape_ratios", f"{PERI}, ar AS (SELECT image, label, CAST(count(*) AS DOUBLE) AS area FROM lb GROUP BY ALL) SELECT image, label, {r6('CASE WHEN perimeter > 0 THEN 4*pi()*area/(perimeter*perimeter) ELSE 0 END', 'circularity')}, {r6('perimeter*perimeter/(4*pi()*area)', 'roughness')}, {r6('0e0', 'hole_fraction')} FROM ar JOIN pe USING (image, label)")
def p21(spark, d):
    l = lab(spark, d)
    j = l.groupBy("image", "label").agg(F.count("*").cast("double").alias("area")).join(C.perimeter(l, IM), ["image", "label"])
    return C.shape_ratios(j, "area", "perimeter", "area").select("image", "label", "circularity", "roughness", "hole_fraction")


HULL = f"""{LB}, pt AS (SELECT DISTINCT image, label, row + dr AS y, col + dc AS x FROM lb, (SELECT unnest([-0.5, -0.5, 0.5, 0.5]) AS dr, unnest([-0.5, 0.5, -0.5, 0.5]) AS dc)),
ed AS (SELECT p.image, p.label, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx FROM pt p JOIN pt q ON p.image = q.image AND p.label = q.label AND (p.y <> q.y OR p.x <> q.x) JOIN pt r ON r.image = p.image AND r.label = p.label GROUP BY ALL
  HAVING bool_and((q.y - p.y) * (r.x - p.x) - (q.x - p.x) * (r.y - p.y) > 0 OR ((q.y - p.y) * (r.x - p.x) - (q.x - p.x) * (r.y - p.y) = 0 AND (r.y - p.y) * (r.y - q.y) + (r.x - p.x) * (r.x - q.x) <= 0))),
ha AS (SELECT image, label, abs(sum(px * qy - py * qx)) / 2 AS area FROM ed GROUP BY ALL), hc AS (SELECT p.image, p.label, max(sqrt(pow(p.y - q.y, 2) + pow(p.x - q.x, 2))) AS caliper FROM pt p JOIN pt q ON p.image = q.image AND p.label = q.label GROUP BY ALL)"""


@query("A21_hulls", f"{HULL} SELECT image, label, CAST(n AS BIGINT) AS area, {r6('area', 'convex_area')}, {r6('n / area', 'solidity')}, {r6('caliper', 'caliper')} FROM ha JOIN hc USING (image, label) JOIN (SELECT image, label, count(*) AS n FROM lb GROUP BY ALL) USING (image, label)")
def a21(spark, d):
    return C.hulls(lab(spark, d), IM)


HU = f"""{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m2), {label_sql('fg', 'lb')}, {SIZE.format(l='lb')}, top AS (SELECT image, arg_min(label, {{'a': -area, 'l': label}}) AS label FROM sz GROUP BY image),
c0 AS (SELECT image, row, col, avg(row) OVER i AS cy, avg(col) OVER i AS cx, count(*) OVER i::DOUBLE AS n FROM lb JOIN top USING (image, label) WINDOW i AS (PARTITION BY image)),
e AS (SELECT image, {', '.join(f"sum(pow(col - cx, {p}) * pow(row - cy, {q})) / pow(any_value(n), {1 + (p + q) / 2}) AS e{p}{q}" for p, q in ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)))} FROM c0 GROUP BY image),
f AS (SELECT *, e30 + e12 AS s, e21 + e03 AS t FROM e),
h AS (SELECT image, e20 + e02 AS h1, pow(e20 - e02, 2) + 4 * e11 * e11 AS h2, pow(e30 - 3 * e12, 2) + pow(3 * e21 - e03, 2) AS h3, s * s + t * t AS h4,
  (e30 - 3 * e12) * s * (s * s - 3 * t * t) + (3 * e21 - e03) * t * (3 * s * s - t * t) AS h5, (e20 - e02) * (s * s - t * t) + 4 * e11 * s * t AS h6, (3 * e21 - e03) * s * (s * s - 3 * t * t) - (e30 - 3 * e12) * t * (3 * s * s - t * t) AS h7 FROM f)"""


@query("A44_hu_moments", f"{HU} SELECT image, {', '.join(f'CASE WHEN abs(h{i}) < 1e-12 THEN 0 ELSE round(-sign(h{i}) * log10(abs(h{i})), 3) + 0e0 END AS hu_{i}' for i in range(1, 8))} FROM h")
def a44(spark, d):
    """Area moments of the largest object; image libraries take those of its contour."""
    h = C.log_hu(C.largest(fg(spark, d, "m2"), IM), IM)
    return h.select("image", *[F.round(f"hu_{i}", 3).alias(f"hu_{i}") for i in range(1, 8)])


@query("A22_census", f"""{LB}, {SIZE.format(l='lb')}, tp AS (SELECT image, count(*) FILTER (m2) AS t FROM masks GROUP BY image), c AS (SELECT image, count(*) AS n, max(area) / CAST(sum(area) AS DOUBLE) AS largest, median(area) AS med, quantile_cont(area, 0.75) - quantile_cont(area, 0.25) AS iqr FROM sz GROUP BY image)
SELECT image, {r6('coalesce(n, 0)', 'topology_component_count')}, {r6('coalesce(n, 0) / CASE WHEN t > 0 THEN t / 1e6 END', 'topology_component_density_per_mm2')}, {r6('largest', 'topology_largest_component_frac')}, {r6('med', 'topology_component_area_median_um2')}, {r6('iqr', 'topology_component_area_iqr_um2')} FROM tp LEFT JOIN c USING (image)""")
def a22(spark, d):
    t = X.masks(spark, d).groupBy("image").agg(F.sum(F.col("m2").cast("long")).alias("tissue_px"))
    return C.census(lab(spark, d), IM, t)


A23 = f"""{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m2), bg AS (SELECT image, row, col FROM masks WHERE NOT m2), {label_sql('bg', 'lb', 4)}, {SIZE.format(l='lb')}, {label_sql('fg', 'lf')},
cd AS (SELECT image, row + dy AS r, col + dx AS c, sum(b) AS code FROM fg, (SELECT unnest([0,0,-1,-1]) AS dy, unnest([0,-1,0,-1]) AS dx, unnest([8,4,2,1]) AS b) GROUP BY ALL),
qd AS (SELECT image, (count(*) FILTER (code IN (1,2,4,8)) - count(*) FILTER (code IN (7,11,13,14)) + 2 * count(*) FILTER (code IN (6,9))) / 4e0 AS e4 FROM cd GROUP BY image),
ho AS (SELECT image, sum(area) AS px, count(*) AS n FROM sz WHERE r0 > 0 AND c0 > 0 AND r1 < 7 AND c1 < 7 GROUP BY image), ob AS (SELECT image, count(*) AS a, count(DISTINCT label) AS o FROM lf GROUP BY image)"""


@query("A23_holes", f"{A23} SELECT image, {r6('coalesce(px, 0) / CAST(a AS DOUBLE)', 'topology_hole_area_frac')}, {r6('greatest(0, o - e4)', 'topology_hole_count')}, coalesce(n, 0) AS hole_count_exact, {r6('e4', 'topology_euler_number')} FROM ob JOIN qd USING (image) LEFT JOIN ho USING (image)")
def a23(spark, d):
    return C.hole_summary(pix(spark, d), fg(spark, d, "m2"), IM, 8, 8)


RULES = f"""{MASKS}, ca AS (SELECT image, row, col FROM masks WHERE m1), cb AS (SELECT image, row, col FROM masks WHERE m2), {label_sql('cb', 'l1')}, g1 AS (SELECT image, row, col, m1 AS g FROM masks WHERE image % 2 = 0), {focal_sql('g1', 'g', 1, 'bool_or', 'd1')},
k1 AS (SELECT DISTINCT image, label FROM l1 JOIN d1 USING (image, row, col) WHERE x), b1 AS (SELECT image, row, col FROM l1 JOIN k1 USING (image, label) UNION ALL SELECT image, row, col FROM cb WHERE image % 2 = 1),
{label_sql('ca', 'l2')}, k2 AS (SELECT image, label FROM l2 LEFT JOIN (SELECT *, 1e0 AS h FROM b1) USING (image, row, col) GROUP BY ALL HAVING avg(coalesce(h, 0)) >= 0.3), a2 AS (SELECT image, row, col FROM l2 JOIN k2 USING (image, label))"""


@query("R10_rules", f"{RULES} SELECT image, 'a' AS channel, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM a2 UNION ALL SELECT image, 'b', row, col FROM b1")
def r10b(spark, d):
    """Two rules in order: b by a (even images only), then a by what is left of b."""
    p = X.masks(spark, d)
    masks = p.where("m1").select("image", F.lit("a").alias("channel"), "row", "col").unionByName(p.where("m2").select("image", F.lit("b").alias("channel"), "row", "col"))
    images = p.select("image").distinct()
    rule = lambda t, by, mode, px, f: F.struct(F.lit(t).alias("target"), F.lit(by).alias("by"), F.lit(mode).alias("mode"), F.lit(px).alias("dilate_px"), F.lit(f).alias("min_overlap_frac"))
    first, then = rule("b", "a", "touching", 1, 0.0), rule("a", "b", "intersect", 0, 0.3)
    rules = images.withColumn("rules", F.when(F.col("image") % 2 == 0, F.array(first, then)).otherwise(F.array(then)))
    return SG.apply_rules(masks, p.select("image", "row", "col"), rules)


@query("JOB_segment")
def job(spark, d):
    """The whole job: images and saved parameters to site rows; a test holds it against the operators one by one."""
    from tessera.plans.queries_stats import SAVED
    from tessera.sources import tables as IO

    rgb = X.rgb(spark, d)
    images = rgb.select("image").distinct().withColumn("type", (F.col("image") % 3).cast("int"))
    types = images.select("type").distinct()
    small = "named_struct('open_radius', 0, 'close_radius', 1, 'remove_small', 3, 'fill_holes_max_area', 5, 'clear_border', false, 'large_area_frac', 1.1D)"
    saved = spark.sql(
        f"""SELECT type, map('dab', named_struct('threshold', named_struct('normalize', true, 'scale', 0.9D, 'absolute_normalized', double(null)), 'morph', {small}),
        'hematoxylin', named_struct('threshold', named_struct('normalize', true, 'scale', 1D, 'absolute_normalized', double(null)), 'morph', {small})) AS channels, boolean(null) AS gating_enabled,
        CASE WHEN type = 2 THEN array(named_struct('target', 'dab', 'by', 'hematoxylin', 'mode', string(null), 'dilate_px', '1', 'min_overlap_frac', string(null))) END AS gating_rules FROM {{t}}""",
        t=types,
    )
    out = SG.segment(rgb, images, IO.load_parameters(types, saved), 8, 8)
    return SG.sites(out).select("image", "type", "channel", "label", "area_um2", "centroid_row_um", "centroid_col_um", "eccentricity", "intensity_mean", "intensity_raw_integrated")


HUE = re.sub(r"\b(c1|c2|s0|la|la_r|z1|s1|b1|lh|lh_r|z3|s3)\b", r"\1h", clean_sql("hx", "hit", "hx"))
ENGINES = f"""{SEG}, {clean_sql('hh', 'hit', 'hh')}, hx AS (SELECT image, row, col, (h >= 0.9 OR h <= 0.2) AND s >= 0.05 AND v >= 0.2 AND v <= 0.95 AND ({VALID}) AS hit FROM hsv), {HUE},
ms AS (SELECT * FROM s3 WHERE image % 2 = 0 UNION ALL SELECT * FROM s3h WHERE image % 2 = 1), {label_sql('ms', 'lz')}"""


@query("JOB_engines", f"{ENGINES} SELECT image, CASE WHEN image % 2 = 0 THEN 'hed' ELSE 'hsv' END AS engine, 'dab' AS channel, label, {r6('count(*)', 'area_um2')}, {r6('avg(row)', 'centroid_row_um')}, {r6('avg(col)', 'centroid_col_um')} FROM lz GROUP BY image, label")
def job_engines(spark, d):
    """The job from images, their sizes and saved parameters to site rows, with the engine that each type's record names."""
    from tessera.sources import tables as IO

    rgb = X.rgb(spark, d)
    images = rgb.select("image").distinct().withColumn("type", F.when(F.col("image") % 2 == 0, "hed").otherwise("hsv"))
    sizes = rgb.groupBy("image").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    saved = spark.sql(
        """SELECT type, type AS engine, named_struct('h_low', 0.9D, 'h_high', 0.2D, 's_min', 0.05D, 'v_min', 0.2D, 'v_max', 0.95D) AS hsv, named_struct('black_rgb_thresh', 90, 'white_v_thresh', 0.7D, 'white_s_max', 0.1D) AS pre_mask, array('dab') AS channels_to_output,
        map('dab', named_struct('threshold', named_struct('normalize', true, 'scale', 0.9D, 'absolute_normalized', double(null)), 'morph', named_struct('open_radius', 0, 'close_radius', 1, 'remove_small', 3, 'fill_holes_max_area', 5, 'clear_border', false, 'large_area_frac', 1.1D))) AS channels,
        false AS gating_enabled, CAST(array() AS array<struct<target: string, by: string, mode: string, dilate_px: string, min_overlap_frac: string>>) AS gating_rules FROM {t}""",
        t=images.select("type").distinct(),
    )
    out = SG.segment(rgb, images, IO.load_parameters(images.select("type").distinct(), saved), sizes)
    return SG.sites(out).select("image", F.col("type").alias("engine"), "channel", "label", "area_um2", "centroid_row_um", "centroid_col_um")


@query("A47_channel_summary")
def a47c(spark, d):
    """Every family of one channel's summary over all images, with the cross-channel ones; tests count the names and hold families against their operators."""
    from tessera.operators import raster as R
    from tessera.plans import assembly

    p = R.normalise(X.masks(spark, d).withColumn("w", F.col("v") - F.col("row") / 100), IM, "v").withColumn("ok", F.col("v") > -0.4)
    p = R.normalise(p, IM, "w", "wnorm")
    return assembly.channel_summary(p, "image", "m1", "ok", "norm", "v", 8, 8, others={"other": {"mask": "m2", "norm": "wnorm", "raw": "w"}})


#: Pixels with a mask that is empty in every seventh image.
PZ = f"{MASKS}, pz AS (SELECT image, row, col, v, v + 0.5 AS nv, m1 AND image % 7 <> 0 AS m, m2 AS o, v > -0.4 AS ok FROM masks), im AS (SELECT DISTINCT image FROM pz), fg AS (SELECT image, row, col FROM pz WHERE m), {label_sql('fg', 'lb')}"


def sparse(spark, d):
    p = X.masks(spark, d)
    return p.select("image", "row", "col", "v", (F.col("v") + 0.5).alias("nv"), (F.col("m1") & (F.col("image") % 7 != 0)).alias("m"), F.col("m2").alias("o"), (F.col("v") > -0.4).alias("ok"))


def long_sql(wide: str, features: dict[str, str]) -> str:
    """``wide`` ends in a FROM; one row per image and feature, nulls included."""
    return f"SELECT image, feature, round(value, 6) + 0e0 AS value FROM (SELECT im.image, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in features.items())} {wide}) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(features)}))"


def family(spark, d, only, pixel_um=0.2738, others=None, sizes=None):
    from tessera.plans import assembly

    return assembly.channel_summary(sparse(spark, d), "image", "m", "ok", "nv", "v", *(sizes or (8, 8)), pixel_um=pixel_um, others=others, only=only)


UM = "0.2738"
SITE_VALUES = {
    "area_um2": f"n * {UM} * {UM}", "perimeter_um": f"perimeter * {UM}", "equivalent_diameter_um": f"sqrt(n * 4 / pi()) * {UM}", "major_axis_length_um": f"4 * sqrt(l1) * {UM}", "minor_axis_length_um": f"4 * sqrt(l2) * {UM}",
    "eccentricity": "sqrt(greatest(1 - l2 / l1, 0))", "solidity": "n / ha.area", "extent": "n / (bh * bw)", "circularity": "CASE WHEN perimeter > 0 THEN 4 * pi() * n / (perimeter * perimeter) ELSE 0 END", "roughness": "perimeter * perimeter / (4 * pi() * n)",
    "feret_diameter_um": f"caliper * {UM}", "bbox_area_um2": f"bh * bw * {UM} * {UM}", "bbox_fill_ratio": "n / (bh * bw)", "bbox_aspect_ratio": "bw / bh", "elongation": "sqrt(l1) / sqrt(l2)", "filled_area_um2": f"(n + coalesce(hole_area, 0)) * {UM} * {UM}",
    "convex_area_um2": f"ha.area * {UM} * {UM}", "hole_area_um2": f"coalesce(hole_area, 0) * {UM} * {UM}", "hole_fraction": "coalesce(hole_area, 0) / (n + coalesce(hole_area, 0))", "euler_number": "CASE WHEN coalesce(holes, 0) = 1 THEN 1 ELSE 1 - coalesce(holes, 0) END",
    "intensity_mean": "it.im_", "intensity_raw_mean": "it.rm", "intensity_raw_median": "it.rd", "intensity_raw_iqr": "it.ri", "intensity_raw_integrated": "it.rs",
}
SITES_SQL = f"""{PZ}, {SIZE.format(l='lb')}{GEO[len(LB):]}{PERI[len(LB):]}, {HOLE[HOLE.index('ring AS'):]}{HULL[len(LB):]},
it AS (SELECT image, label, avg(nv) AS im_, avg(v) AS rm, median(v) AS rd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS ri, sum(v) AS rs FROM lb JOIN pz USING (image, row, col) GROUP BY ALL),
si AS (SELECT e.image, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in SITE_VALUES.items())} FROM e JOIN pe USING (image, label) JOIN ha USING (image, label) JOIN hc USING (image, label) JOIN it USING (image, label) LEFT JOIN hk ON hk.image = e.image AND hk.label = e.label),
su AS (SELECT image, count(*) AS num_sites, {', '.join(f'median({n}) AS {n}_median, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS {n}_iqr' for n in SITE_VALUES)} FROM si GROUP BY image)
""" + long_sql("FROM im LEFT JOIN su USING (image)", {"num_sites": "coalesce(num_sites, 0)"} | {f"{n}_{x}": f"{n}_{x}" for n in SITE_VALUES for x in ("median", "iqr")})


@query("A47_sites_family", SITES_SQL)
def a47s(spark, d):
    """All 25 site columns summarised for every image, with and without objects."""
    return family(spark, d, ["sites"])


TOPOLOGY_SQL = f"""{PZ}, {SIZE.format(l='lb')}, bg AS (SELECT image, row, col FROM pz WHERE NOT m), {label_sql('bg', 'lh', 4)}, {SIZE.format(l='lh').replace('sz AS', 'sh AS')}, tp AS (SELECT image, count(*) FILTER (ok) AS t FROM pz GROUP BY image),
cn AS (SELECT image, count(*) AS n, max(area) / CAST(sum(area) AS DOUBLE) AS largest, median(area) AS med, quantile_cont(area, 0.75) - quantile_cont(area, 0.25) AS iqr, sum(area) AS a FROM sz GROUP BY image),
cd AS (SELECT image, row + dy AS r, col + dx AS c, sum(b) AS code FROM fg, (SELECT unnest([0,0,-1,-1]) AS dy, unnest([0,-1,0,-1]) AS dx, unnest([8,4,2,1]) AS b) GROUP BY ALL),
qd AS (SELECT image, count(*) FILTER (code IN (1,2,4,8)) AS q1, count(*) FILTER (code IN (3,12,5,10)) AS q2, count(*) FILTER (code IN (6,9)) AS qd, count(*) FILTER (code IN (7,11,13,14)) AS q3 FROM cd GROUP BY image),
ho AS (SELECT image, sum(area) AS px FROM sh WHERE r0 > 0 AND c0 > 0 AND r1 < 7 AND c1 < 7 GROUP BY image),
bx AS (SELECT image, regr_slope(ln(n), ln(1e0 / s)) AS f FROM (SELECT image, s, count(DISTINCT (row // s) * 100 + col // s) AS n FROM fg, (SELECT unnest([2,4,8]) AS s) GROUP BY ALL) GROUP BY image)
""" + long_sql("FROM im JOIN tp USING (image) LEFT JOIN cn USING (image) LEFT JOIN qd USING (image) LEFT JOIN ho USING (image) LEFT JOIN bx USING (image)", {
    "topology_component_count": "coalesce(n, 0)", "topology_component_density_per_mm2": f"CASE WHEN t > 0 THEN coalesce(n, 0) / (t * {UM} * {UM} / 1e6) END", "topology_largest_component_frac": "largest", "topology_component_area_median_um2": f"med * {UM} * {UM}",
    "topology_component_area_iqr_um2": f"iqr * {UM} * {UM}", "topology_euler_number": "coalesce((q1 - q3 + 2 * qd) / 4e0, 0)", "topology_hole_area_frac": "coalesce(px, 0) / CAST(a AS DOUBLE)", "topology_hole_count": "greatest(0, coalesce(n, 0) - coalesce((q1 - q3 + 2 * qd) / 4e0, 0))",
    "topology_boundary_length_um": f"coalesce(q2 + sqrt(2) / 2 * (q1 + q3 + 2 * qd), 0) * {UM}", "topology_fractal_dimension": "f",
})


@query("A47_topology_family", TOPOLOGY_SQL)
def a47t(spark, d):
    """Counts, Euler number and lengths are 0 where the mask is empty; shares and medians are null. Sizes come from a table of images."""
    sizes = X.masks(spark, d).groupBy("image").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return family(spark, d, ["topology"], sizes=(sizes,))


CROSS_SQL = f"""{PZ}, ot AS (SELECT image, row, col FROM pz WHERE o), {label_sql('ot', 'lo')}, {focal_sql('pz', 'o', 2, 'bool_or', 'dg')},
rp AS (SELECT image, sum(CASE WHEN m AND o THEN 1e0 ELSE 0e0 END) AS i, sum(CASE WHEN m OR o THEN 1e0 ELSE 0e0 END) AS u, sum(CASE WHEN m THEN 1e0 ELSE 0e0 END) AS a, sum(CASE WHEN o THEN 1e0 ELSE 0e0 END) AS b,
  corr(v, w) FILTER (ok) AS c1, corr(v, w) FILTER (ok AND (m OR o)) AS c2, corr(nv, w) FILTER (ok) AS c3 FROM (SELECT *, v * v + row / 10e0 AS w FROM pz) GROUP BY image),
ob AS (SELECT image, label, max(CASE WHEN x THEN 1e0 ELSE 0e0 END) AS n, max(CASE WHEN o THEN 1e0 ELSE 0e0 END) AS o FROM lb JOIN dg USING (image, row, col) JOIN pz USING (image, row, col) GROUP BY ALL), tf AS (SELECT image, avg(n) AS n, avg(o) AS o FROM ob GROUP BY image),
ca AS (SELECT image, label, avg(row) * 2 AS y, avg(col) * 2 AS x FROM lb GROUP BY ALL), cb AS (SELECT image, label, avg(row) * 2 AS y, avg(col) * 2 AS x FROM lo GROUP BY ALL),
nd AS (SELECT image, avg(d) AS d FROM (SELECT ca.image, ca.label, min(sqrt(pow(ca.y - cb.y, 2) + pow(ca.x - cb.x, 2))) AS d FROM ca JOIN cb ON ca.image = cb.image GROUP BY ALL) GROUP BY image),
ds AS (SELECT p.image, p.row, p.col, p.ok, p.nv, min(sqrt(pow((p.row - b.row) * 2e0, 2) + pow((p.col - b.col) * 2e0, 2))) AS dist FROM pz p JOIN ot b ON p.image = b.image GROUP BY ALL),
ri AS (SELECT image, avg(nv) FILTER (ok AND dist < 5) AS b1, avg(nv) FILTER (ok AND dist >= 5 AND dist < 15) AS b2, avg(nv) FILTER (ok AND dist >= 15 AND dist < 30) AS b3 FROM ds GROUP BY image)
""" + long_sql("FROM im JOIN rp USING (image) LEFT JOIN tf USING (image) LEFT JOIN nd USING (image) LEFT JOIN ri USING (image)", {f"cross_with_other_{n}": e for n, e in {
    "jaccard": "i / nullif(u, 0)", "dice": "2 * i / nullif(a + b, 0)", "frac_self_overlap": "i / nullif(a, 0)", "frac_other_overlap": "i / nullif(b, 0)", "positive_area_ratio": "a / nullif(b, 0)", "corr_raw_tissue": "c1", "corr_raw_union": "c2", "corr_norm_tissue": "c3",
    "touching_object_fraction": "tf.n", "overlapping_object_fraction": "tf.o", "nn_other_mean_um": "nd.d", "annulus_0_5um_norm_mean": "b1", "annulus_5_15um_norm_mean": "b2", "annulus_15_30um_norm_mean": "b3", "annulus_near_far_ratio": "CASE WHEN abs(b3) > 1e-12 THEN b1 / b3 END",
}.items()})


@query("A47_cross_family", CROSS_SQL)
def a47x(spark, d):
    """The 15 features of one channel against another, on pixels of 2 um so that all three rings are met."""
    from tessera.plans import assembly

    p = sparse(spark, d).withColumn("w", F.col("v") * F.col("v") + F.col("row") / 10)
    return assembly.channel_summary(p, "image", "m", "ok", "nv", "v", 8, 8, pixel_um=2.0, others={"other": {"mask": "o", "norm": "w", "raw": "w"}}, only=["cross_other"])


@query("A23_A25_empty_masks", f"{PZ}, bg AS (SELECT image, row, col FROM pz WHERE NOT m), {label_sql('bg', 'lh', 4)}, {SIZE.format(l='lh')}, cd AS (SELECT image, row + dy AS r, col + dx AS c, sum(b) AS code FROM fg, (SELECT unnest([0,0,-1,-1]) AS dy, unnest([0,-1,0,-1]) AS dx, unnest([8,4,2,1]) AS b) GROUP BY ALL), qd AS (SELECT image, count(*) FILTER (code IN (1,2,4,8)) AS q1, count(*) FILTER (code IN (3,12,5,10)) AS q2, count(*) FILTER (code IN (6,9)) AS qd, count(*) FILTER (code IN (7,11,13,14)) AS q3 FROM cd GROUP BY image), ho AS (SELECT image, sum(area) AS px, count(*) AS n FROM sz WHERE r0 > 0 AND c0 > 0 AND r1 < 7 AND c1 < 7 GROUP BY image), ob AS (SELECT image, count(*) AS a, count(DISTINCT label) AS k FROM lb GROUP BY image) SELECT image, {r6('coalesce(px, 0) / CAST(a AS DOUBLE)', 'topology_hole_area_frac')}, {r6('greatest(0, coalesce(k, 0) - coalesce((q1 - q3 + 2 * qd) / 4e0, 0))', 'topology_hole_count')}, coalesce(n, 0) AS hole_count_exact, {r6('coalesce((q1 - q3 + 2 * qd) / 4e0, 0)', 'topology_euler_number')}, {r6('coalesce((q1 - q3 - 2 * qd) / 4e0, 0)', 'euler8')}, {r6('coalesce(q2 + sqrt(2) / 2 * (q1 + q3 + 2 * qd), 0)', 'boundary_length')} FROM im LEFT JOIN ob USING (image) LEFT JOIN qd USING (image) LEFT JOIN ho USING (image)")
def a23e(spark, d):
    p = sparse(spark, d)
    on, im = p.where("m").select("image", "row", "col"), p.select("image")
    return C.hole_summary(p, on, IM, 8, 8).join(C.euler(on, IM, im).select("image", "euler8"), "image").join(C.boundary_length(on, IM, im), "image")


GEO_LONG = ("area_um2", "eccentricity", "extent", "elongation")


@query("A47_K02_assembly", f"""{GEO}, f AS (SELECT image, label, n AS area_um2, sqrt(greatest(1 - l2 / l1, 0)) AS eccentricity, n / (bh * bw) AS extent, sqrt(l1) / sqrt(l2) AS elongation FROM e) SELECT image, {', '.join(r6('median(' + c + ')', c + '_median') + ', ' + r6('quantile_cont(' + c + ', 0.75) - quantile_cont(' + c + ', 0.25)', c + '_iqr') for c in GEO_LONG)}, {r6('count(*)', 'num_sites')} FROM f GROUP BY image""")
def a47(spark, d):
    """Feature families as long rows, united, and made wide last."""
    from tessera.plans import assembly

    sites = C.geometry(lab(spark, d), IM).select("image", "label", *GEO_LONG)
    names = [f"{c}_{a}" for c in GEO_LONG for a in ("median", "iqr")] + ["num_sites"]
    return assembly.wide_summary([assembly.site_family(sites, IM, list(GEO_LONG))], IM, names)
