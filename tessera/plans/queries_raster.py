"""Pixel columns, normalisation, pixel statistics, tiles, texture, focal operators and thresholds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.core import load
from tessera.functions import stats as S
from tessera.operators import components as C
from tessera.operators import focal as FO
from tessera.operators import raster as R
from tessera.operators import texture as TX
from tessera.operators import thresholds as TH
from tessera.plans import fixtures as X
from tessera.plans.queries_stats import bins_sql
from tessera.plans.registry import query, r6

RASTER, RGB, MASKS = X.cte("raster"), X.cte("rgb"), X.cte("masks")
IM = ["image"]

HSV = f"""{RGB}, a AS (SELECT *, CAST(greatest(r,g,b) AS DOUBLE) AS hi, CAST(least(r,g,b) AS DOUBLE) AS lo FROM rgb),
t AS (SELECT *, hi - lo AS d, CASE WHEN hi = r THEN (g-b)/nullif(hi-lo,0) WHEN hi = g THEN (b-r)/nullif(hi-lo,0)+2 ELSE (r-g)/nullif(hi-lo,0)+4 END * 30 AS u FROM a),
hsv AS (SELECT image, row, col, r, g, b, CASE WHEN d = 0 THEN 0e0 ELSE (CASE WHEN u < 0 THEN u + 180 ELSE u END)/179 END AS h, CASE WHEN hi > 0 THEN d/hi ELSE 0e0 END AS s, hi/255 AS v FROM t)"""
VALID = "(NOT (greatest(r,g,b) <= 90)) AND NOT (v >= 0.7 AND s <= 0.1)"


def hsv_cols():
    return R.hsv(F.col("r"), F.col("g"), F.col("b"))


def valid():
    return R.tissue(F.col("r"), F.col("g"), F.col("b"), black=90, white_v=0.7, white_s=0.1)


@query("S02_raster", f"{RASTER} SELECT image, CAST(type AS BIGINT) AS type, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('v', 'v')} FROM raster")
def s02(spark, d):
    return X.raster(spark, d)


@query("P11_tissue", f"{HSV} SELECT image, count(*) AS n, sum(CASE WHEN {VALID} THEN 1 ELSE 0 END)::BIGINT AS tissue FROM hsv GROUP BY image")
def p11(spark, d):
    return X.rgb(spark, d).groupBy("image").agg(F.count("*").alias("n"), F.sum(valid().cast("long")).alias("tissue"))


@query("P12_hsv", f"{HSV} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('h', 'h')}, {r6('s', 's')}, {r6('v', 'v')} FROM hsv")
def p12(spark, d):
    h, s, v = hsv_cols()
    return X.rgb(spark, d).select("image", "row", "col", h.alias("h"), s.alias("s"), v.alias("v"))


@query("P13_stain_range", f"{HSV} SELECT image, sum(CASE WHEN (h >= 0.9 OR h <= 0.2) AND s >= 0.05 AND v >= 0.2 AND v <= 0.95 AND ({VALID}) THEN 1 ELSE 0 END)::BIGINT AS n FROM hsv GROUP BY image")
def p13(spark, d):
    h, s, v = hsv_cols()
    return X.rgb(spark, d).groupBy("image").agg(F.sum((R.stain_range(h, s, v, 0.9, 0.2, 0.05, 0.2, 0.95) & valid()).cast("long")).alias("n"))


def stretch_sql(x, lo, hi):
    return f"least(greatest(({x} - {lo}) / ({hi} - {lo}), 0e0), 1e0)"


def norm_sql(source: str, value: str, where: str | None, robust: bool = False) -> str:
    """CTE ``nrm`` with ``norm`` added to ``source``."""
    t = f"CASE WHEN {where} THEN {value} END" if where else value
    whole = f"CASE WHEN hi > lo THEN {stretch_sql(value, 'lo', 'hi')} WHEN mx > mn THEN {stretch_sql(value, 'mn', 'mx')} ELSE 0e0 END"
    inside = whole if not where else f"CASE WHEN tmn IS NULL THEN {whole} WHEN thi > tlo THEN {stretch_sql(value, 'tlo', 'thi')} WHEN tmx > tmn THEN {stretch_sql(value, 'tmn', 'tmx')} ELSE {'0e0' if robust else whole} END"
    return f"""lim AS (SELECT image, quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi, min({value}) AS mn, max({value}) AS mx, quantile_cont({t}, 0.01) AS tlo, quantile_cont({t}, 0.99) AS thi, min({t}) AS tmn, max({t}) AS tmx FROM {source} GROUP BY image),
nrm AS (SELECT s.*, {inside} AS norm FROM {source} s JOIN lim USING (image))"""


@query("P14_darkness", f"{HSV}, k AS (SELECT *, s * (1 - v) AS dark FROM hsv), {norm_sql('k', 'dark', None)} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('norm', 'norm')} FROM nrm")
def p14(spark, d):
    _, s, v = hsv_cols()
    return R.normalise(X.rgb(spark, d).select("image", "row", "col", (s * (1 - v)).alias("dark")), IM, "dark").drop("dark")


@query("P15_optical_density", f"{RGB} SELECT image, {r6('sum(-ln((r + 1) / 256e0))', 'od_r')}, {r6('sum(-ln((g + 1) / 256e0))', 'od_g')}, {r6('sum(-ln((b + 1) / 256e0))', 'od_b')} FROM rgb GROUP BY image")
def p15(spark, d):
    return X.rgb(spark, d).groupBy("image").agg(*[F.sum(R.optical_density(F.col(c))).alias(f"od_{c}") for c in "rgb"])


def stain_sql(k: int) -> str:
    return "greatest(" + " + ".join(f"ln(greatest({c} / 255e0, 1e-6)) / {math.log(1e-6)!r} * ({float(R.UNMIX[i, k])!r})" for i, c in enumerate("rgb")) + ", 0e0)"


STAINS = f"{RGB}, st AS (SELECT image, row, col, {stain_sql(0)} AS hematoxylin, {stain_sql(1)} AS eosin, {stain_sql(2)} AS dab FROM rgb)"


def stains(spark, d):
    u = R.unmix(F.col("r"), F.col("g"), F.col("b"))
    return X.rgb(spark, d).select("image", "row", "col", *[c.alias(n) for n, c in u.items()])


@query("P16_unmix", f"{STAINS} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('hematoxylin', 'hematoxylin')}, {r6('eosin', 'eosin')}, {r6('dab', 'dab')} FROM st")
def p16(spark, d):
    return stains(spark, d)


@query("P17_orient", f"{RASTER}, {norm_sql('raster', 'v', None)} SELECT image, {r6('sum(CASE WHEN type % 2 = 0 THEN -v ELSE v END)', 'raw')}, {r6('sum(CASE WHEN type % 2 = 0 THEN 1 - norm ELSE norm END)', 'norm')} FROM nrm GROUP BY image")
def p17(spark, d):
    n = R.normalise(X.raster(spark, d), IM, "v")
    raw, norm = R.orient(F.col("v"), F.col("norm"), F.col("type") % 2 == 0)
    return n.groupBy("image").agg(F.sum(raw).alias("raw"), F.sum(norm).alias("norm"))


@query("P19_P20_bins", f"{RASTER}, {norm_sql('raster', 'v', 'v > 0', True)} SELECT image, CAST(least(greatest(floor(norm * 31), 0), 31) AS BIGINT) AS level, count(*) AS n FROM nrm GROUP BY ALL")
def p20(spark, d):
    return R.normalise(X.raster(spark, d), IM, "v", where=F.col("v") > 0, robust=True).groupBy("image", R.quantise(F.col("norm")).alias("level")).agg(F.count("*").alias("n"))


for key, where, robust in (("N01_normalise", None, False), ("N02_normalise_tissue", "v > 0", False), ("N03_normalise_robust", "v > 0.2", True)):

    @query(key, f"{RASTER}, {norm_sql('raster', 'v', where, robust)} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('norm', 'norm')} FROM nrm")
    def norm(spark, d, where=where, robust=robust):
        return R.normalise(X.raster(spark, d), IM, "v", where=F.expr(where) if where else None, robust=robust).select("image", "row", "col", "norm")


PLACES = {"tissue": "m2", "positive": "m1 AND m2"}
STAT = {"mean": "avg({x})", "sd": "CASE WHEN count({x}) = 1 THEN 0 ELSE stddev_samp({x}) END", "iqr": "quantile_cont({x},0.75)-quantile_cont({x},0.25)", "skew": "CASE WHEN count({x}) >= 3 AND max({x})-min({x}) >= 1e-12 THEN skewness({x}) END", "kurtosis": "CASE WHEN count({x}) >= 4 AND max({x})-min({x}) >= 1e-12 THEN kurtosis({x}) END"}
PIX = ", ".join(r6(STAT[n].format(x=f"(CASE WHEN {w} THEN {v} END)"), f"pixel_{k}_{p}_{n}") for k, v in (("norm", "norm"), ("raw", "v")) for p, w in PLACES.items() for n in STAT)


@query("A15_pixel_features", f"""{MASKS}, {norm_sql('masks', 'v', 'm2')} SELECT image, {r6('avg(CASE WHEN m1 THEN 1e0 ELSE 0e0 END)', 'percent_area_stained')}, {r6('avg(CASE WHEN m2 THEN 1e0 ELSE 0e0 END)', 'percent_tissue_area')}, {r6('sum(CASE WHEN m1 AND m2 THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN m2 THEN 1e0 ELSE 0e0 END),0)', 'positive_fraction_in_tissue')}, {PIX}, {bins_sql('(CASE WHEN m2 THEN norm END)', 'pixel_norm_tissue')}, {bins_sql('(CASE WHEN m1 AND m2 THEN norm END)', 'pixel_norm_positive')} FROM nrm GROUP BY image""")
def a15(spark, d):
    return R.pixel_features(R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2")), IM, "m1", "m2", "norm", "v")


@query("A26_box_dimension", f"{MASKS}, c AS (SELECT image, s, count(DISTINCT (row // s) * 100 + col // s) AS n FROM masks, (SELECT unnest([2,4,8]) AS s) WHERE m1 GROUP BY ALL) SELECT image, {r6('regr_slope(ln(n), ln(1e0 / s))', 'fractal_dimension')} FROM c GROUP BY image")
def a26(spark, d):
    return R.box_dimension(X.masks(spark, d).where("m1"), IM, 8, 8)


def tile_sql(g: int) -> str:
    return f"""t{g} AS (SELECT image, row // {8 // g} AS tr, col // {8 // g} AS tc, sum(CASE WHEN m1 THEN 1e0 ELSE 0e0 END) AS mass, avg(CASE WHEN m1 THEN 1e0 ELSE 0e0 END) AS share, avg(norm) AS lv FROM nrm WHERE m2 GROUP BY ALL),
u{g} AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY mass) AS i, mass / nullif(sum(mass) OVER (PARTITION BY image), 0) AS p FROM t{g}),
f{g} AS (SELECT image, {r6('coalesce(-sum(CASE WHEN mass > 0 THEN p * log2(p) END), 0)', f'tile_g{g}_mass_entropy')}, {r6('CASE WHEN max(mass) <= 1e-8 THEN 0 ELSE (2*sum(i*mass)-(count(*)+1)*sum(mass))/(count(*)*sum(mass)) END', f'tile_g{g}_mass_gini')}, {r6('avg(share)', f'tile_g{g}_positive_frac_mean')}, {r6(STAT['sd'].format(x='share'), f'tile_g{g}_positive_frac_sd')}, {r6('CASE WHEN abs(avg(share)) < 1e-12 THEN NULL WHEN count(*) = 1 THEN 0 ELSE stddev_samp(share)/avg(share) END', f'tile_g{g}_positive_frac_cv')}, {r6(STAT['iqr'].format(x='share'), f'tile_g{g}_positive_frac_iqr')}, {r6(STAT['sd'].format(x='lv'), f'tile_g{g}_intensity_mean_sd')}, {r6(STAT['iqr'].format(x='lv'), f'tile_g{g}_intensity_mean_iqr')} FROM u{g} GROUP BY image)"""


@query("A27_tiles", f"{MASKS}, {norm_sql('masks', 'v', 'm2')}, {tile_sql(4)}, {tile_sql(8)} SELECT * FROM f4 JOIN f8 USING (image)")
def a27(spark, d):
    return R.tile_features(R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2")), IM, 8, 8, "m1", "m2", "norm")


PX = 0.2738 * 0.2738


@query("A46_P23_burden", f"{MASKS} SELECT image, {r6(f'sum(CASE WHEN m2 THEN 1e0 ELSE 0e0 END) * {PX!r}', 'tissue_area_um2')}, {r6(f'sum(CASE WHEN m1 AND m2 THEN 1e0 ELSE 0e0 END) * {PX!r}', 'positive_area_um2')}, {r6(f'count(*) / nullif(sum(CASE WHEN m2 THEN 1e0 ELSE 0e0 END) * {PX!r} / 1e6, 0)', 'pixels_per_mm2_tissue')} FROM masks GROUP BY image")
def a46(spark, d):
    t = F.sum(F.col("m2").cast("double")) * PX
    return X.masks(spark, d).groupBy("image").agg(t.alias("tissue_area_um2"), (F.sum((F.col("m1") & F.col("m2")).cast("double")) * PX).alias("positive_area_um2"), F.try_divide(F.count("*").cast("double"), t / 1e6).alias("pixels_per_mm2_tissue"))


@query("A48_log_histogram", f"{RASTER}, x AS (SELECT image, log10(greatest(v, 1e-12)) AS x FROM raster), w AS (SELECT *, min(x) OVER (PARTITION BY image) AS lo, max(x) OVER (PARTITION BY image) AS hi FROM x) SELECT image, CAST(least(floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 100), 99) AS BIGINT) AS bin, count(*) AS n FROM w GROUP BY ALL")
def a48(spark, d):
    return R.log_histogram(X.raster(spark, d), IM, "v")


@query("R11_downsample_crop", f"{RASTER} SELECT image, CAST(row // 2 AS BIGINT) AS row, CAST(col // 2 AS BIGINT) AS col, {r6('avg(v)', 'v')}, CAST(row // 2 IN (1, 2) AND col // 2 IN (1, 2) AS BOOLEAN) AS inside FROM raster GROUP BY ALL")
def r11(spark, d):
    small = R.downsample(X.raster(spark, d), IM, 2, 8, 8, ["v"])
    window = R.crop(small, IM, 4, 4, 2).select("image", "row", "col", F.lit(True).alias("in_"))
    return small.join(window, ["image", "row", "col"], "left").select("image", "row", "col", "v", F.coalesce("in_", F.lit(False)).alias("inside"))


QUANT = f"{MASKS}, {norm_sql('masks', 'v', 'm2', True)}, q AS (SELECT image, row, col, CAST(least(greatest(floor(norm * 31), 0), 31) AS INT) AS lv FROM nrm WHERE m2)"
OFF = "off AS (SELECT unnest([" + ",".join(str(x[0]) for x in TX.OFFSETS) + "]) AS d, unnest([" + ",".join(str(x[1]) for x in TX.OFFSETS) + "]) AS a, unnest([" + ",".join(str(x[2]) for x in TX.OFFSETS) + "]) AS dy, unnest([" + ",".join(str(x[3]) for x in TX.OFFSETS) + "]) AS dx)"
GLCM = f"""{QUANT}, {OFF}, pr AS (SELECT x.image, d, a, x.lv AS i, y.lv AS j FROM q x, off JOIN q y ON x.image = y.image AND y.row = x.row + dy AND y.col = x.col + dx),
both_ AS (SELECT * FROM pr UNION ALL SELECT image, d, a, j, i FROM pr), cnt AS (SELECT image, d, a, i, j, count(*) AS n FROM both_ GROUP BY ALL), gl AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY image, d, a) AS DOUBLE) AS p FROM cnt)"""
PROP = f"""{GLCM}, mu AS (SELECT image, d, a, sum(i*p) AS mi, sum(j*p) AS mj, sum(i*i*p) - sum(i*p)*sum(i*p) AS vi, sum(j*j*p) - sum(j*p)*sum(j*p) AS vj, sum(i*j*p) AS ij FROM gl GROUP BY ALL),
pp AS (SELECT image, d, a, sum((i-j)*(i-j)*p) AS contrast, sum(abs(i-j)*p) AS dissimilarity, sum(p/(1+(i-j)*(i-j))) AS homogeneity, sum(p*p) AS asm, sqrt(sum(p*p)) AS energy, -sum(p*log2(p)) AS entropy FROM gl GROUP BY ALL),
pc AS (SELECT pp.*, CASE WHEN vi > 1e-12 AND vj > 1e-12 THEN (ij - mi*mj)/(sqrt(vi)*sqrt(vj)) END AS correlation FROM pp JOIN mu USING (image, d, a))"""


def levels(spark, d):
    n = R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2"), robust=True).where("m2")
    return n.select("image", "row", "col", R.quantise(F.col("norm")).alias("lv"))


@query("J05_A28_glcm", f"{GLCM} SELECT image, CAST(d AS BIGINT) AS d, CAST(a AS BIGINT) AS a, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {r6('p', 'p')} FROM gl WHERE d = 1")
def a28(spark, d):
    return TX.glcm(levels(spark, d), IM, "lv", [o for o in TX.OFFSETS if o[0] == 1])


@query("A29_haralick", f"{PROP} SELECT image, CAST(d AS BIGINT) AS d, CAST(a AS BIGINT) AS a, " + ", ".join(r6(p, p) for p in TX.PROPERTIES) + " FROM pc")
def a29(spark, d):
    return TX.properties(TX.glcm(levels(spark, d), IM, "lv"), IM)


@query("A30_texture_rollup", f"{PROP}, ln_ AS (SELECT image, d, unnest([{','.join(repr(p) for p in TX.PROPERTIES)}]) AS property, unnest([{','.join(TX.PROPERTIES)}]) AS v FROM pc) SELECT image, CAST(d AS BIGINT) AS scale, property, {r6('avg(v)', 'mean')}, CAST(NULL AS DOUBLE) AS sd FROM ln_ GROUP BY ALL UNION ALL SELECT image, NULL, property, round(avg(v),6)+0e0, round(CASE WHEN count(v)=1 THEN 0 ELSE stddev_samp(v) END,6)+0e0 FROM ln_ GROUP BY image, property")
def a30(spark, d):
    return TX.rollup(TX.properties(TX.glcm(levels(spark, d), IM, "lv"), IM), IM)


def focal_sql(src: str, v: str, r: int, what: str, name: str) -> str:
    """CTE ``name(image, row, col, x)``: extreme over a disc, by a plain neighbour join."""
    offs = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    o = f"(SELECT unnest([{','.join(str(a) for a, _ in offs)}]) AS dy, unnest([{','.join(str(b) for _, b in offs)}]) AS dx)"
    return f"{name} AS (SELECT s.image, s.row, s.col, {what}(n.{v}) AS x FROM {src} s, {o} o JOIN {src} n ON n.image = s.image AND n.row = s.row + o.dy AND n.col = s.col + o.dx GROUP BY ALL)"


@query("R01_dilate", f"{MASKS}, {focal_sql('masks', 'm1', 3, 'bool_or', 'dl')} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, x AS m1 FROM dl")
def r01(spark, d):
    return FO.dilate(X.masks(spark, d).select("image", "row", "col", "m1"), IM, "m1", 3)


@query("R02_open_close", f"{MASKS}, {focal_sql('masks', 'm2', 1, 'bool_and', 'e1')}, {focal_sql('e1', 'x', 1, 'bool_or', 'e2')}, {focal_sql('e2', 'x', 2, 'bool_or', 'e3')}, {focal_sql('e3', 'x', 2, 'bool_and', 'e4')} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, x AS m2 FROM e4")
def r02(spark, d):
    return FO.closed(FO.opened(X.masks(spark, d).select("image", "row", "col", "m2"), IM, "m2", 1), IM, "m2", 2)


@query("R03_grey_opening", f"{RASTER}, {focal_sql('raster', 'v', 2, 'min', 'e1')}, {focal_sql('e1', 'x', 2, 'max', 'e2')} SELECT image, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('x', 'v')} FROM e2")
def r03(spark, d):
    return FO.opened(X.raster(spark, d).select("image", "row", "col", "v"), IM, "v", 2)


def gran_sql() -> str:
    out, src = [], "g0"
    for r in (1, 2, 4):
        out += [focal_sql(src, "x", r, "min", f"ge{r}"), focal_sql(f"ge{r}", "x", r, "max", f"go{r}"), f"g{r} AS (SELECT o.image, o.row, o.col, CASE WHEN m2 THEN o.x ELSE 0e0 END AS x FROM go{r} o JOIN nrm USING (image, row, col))"]
        src = f"g{r}"
    sums = ", ".join(f"s{r} AS (SELECT image, sum(x) AS s FROM g{r} GROUP BY image)" for r in (0, 1, 2, 4))
    loss = lambda a, b: r6(f"CASE WHEN has THEN CASE WHEN s0.s <= 0 THEN 0 ELSE greatest(0, s{a}.s - s{b}.s) / s0.s END END", f"granularity_{b}")
    return f"{MASKS}, {norm_sql('masks', 'v', 'm2', True)}, g0 AS (SELECT image, row, col, CASE WHEN m2 THEN norm ELSE 0e0 END AS x FROM nrm), h AS (SELECT image, bool_or(m2) AS has FROM nrm GROUP BY image), {', '.join(out)}, {sums} SELECT image, {loss(0, 1)}, {loss(1, 2)}, {loss(2, 4)} FROM h JOIN s0 USING (image) JOIN s1 USING (image) JOIN s2 USING (image) JOIN s4 USING (image)"


@query("A32_granularity", gran_sql())
def a32(spark, d):
    n = R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2"), robust=True)
    return FO.granularity(n, IM, "norm", "m2", (1, 2, 4))


def hist_sql(src: str, v: str, p: str = "") -> str:
    return f"""{p}l AS (SELECT image, min({v}) AS lo, max({v}) AS hi FROM {src} GROUP BY image),
{p}h AS (SELECT image, lo, hi, CAST(least(floor(coalesce(({v} - lo) * 256 / nullif(hi - lo, 0), 0)), 255) AS INT) AS bin, count(*) AS n FROM {src} JOIN {p}l USING (image) GROUP BY ALL),
{p}x AS (SELECT *, lo + (bin + 0.5e0) * ((hi - lo) / 256) AS x FROM {p}h)"""


def otsu_sql(src: str, v: str, p: str = "") -> str:
    """CTEs ending in ``{p}otsu(image, t)``."""
    return f"""{hist_sql(src, v, p)}, {p}c AS (SELECT *, sum(n) OVER u AS w0, sum(n * x) OVER u AS s0, sum(n) OVER (PARTITION BY image) AS w, sum(n * x) OVER (PARTITION BY image) AS s FROM {p}x WINDOW u AS (PARTITION BY image ORDER BY bin)),
{p}v AS (SELECT *, CASE WHEN w > w0 THEN round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 9) END AS crit FROM {p}c),
{p}otsu AS (SELECT image, CASE WHEN min(lo) = max(hi) OR max(crit) IS NULL THEN min(lo) ELSE arg_max(x, {{'a': crit, 'b': -bin}}) FILTER (crit IS NOT NULL) END AS t FROM {p}v GROUP BY image)"""


@query("A33_otsu", f"{RASTER}, {otsu_sql('raster', 'v')} SELECT image, {r6('t', 't')} FROM otsu")
def a33(spark, d):
    return TH.otsu(X.raster(spark, d), IM, "v")


@query("A34_yen", f"""{RASTER}, {hist_sql('raster', 'v')}, p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY image) AS DOUBLE) AS p FROM x),
c AS (SELECT *, sum(p) OVER u AS p1, sum(p*p) OVER u AS q1, sum(p*p) OVER (PARTITION BY image ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q2 FROM p WINDOW u AS (PARTITION BY image ORDER BY bin)),
v AS (SELECT *, CASE WHEN q2 > 0 THEN round(ln(pow(p1 * (1 - p1), 2) / (q1 * q2)), 9) END AS crit FROM c)
SELECT image, {r6("CASE WHEN min(lo) = max(hi) OR max(crit) IS NULL THEN min(lo) ELSE arg_max(x, {'a': crit, 'b': -bin}) FILTER (crit IS NOT NULL) END", 't')} FROM v GROUP BY image""")
def a34(spark, d):
    return TH.yen(X.raster(spark, d), IM, "v")


LI = f"""{RASTER}, {hist_sql('raster', 'v')}, y AS (SELECT image, n, x - lo AS y, lo FROM x),
li AS (SELECT image, 0 AS k, sum(y * n) / sum(n) AS t, 1e0 AS moved FROM y GROUP BY image UNION ALL SELECT image, k, t, moved FROM (SELECT image, k, coalesce(CASE WHEN a > 0 AND b > a THEN (b - a) / (ln(b) - ln(a)) END, o) AS t, abs(coalesce(CASE WHEN a > 0 AND b > a THEN (b - a) / (ln(b) - ln(a)) END, o) - o) AS moved
  FROM (SELECT li.image, li.k + 1 AS k, li.t AS o, sum(y * n) FILTER (y <= t) / sum(n) FILTER (y <= t) AS a, sum(y * n) FILTER (y > t) / sum(n) FILTER (y > t) AS b FROM li JOIN y ON y.image = li.image WHERE moved > 0 AND li.k < 100 GROUP BY ALL)))"""


@query("A35_li", f"{LI} SELECT image, {r6('any_value(t) + min(y.lo)', 't')} FROM (SELECT image, arg_max(t, k) AS t FROM li GROUP BY image) JOIN y USING (image) GROUP BY image")
def a35(spark, d):
    """A fixed-point loop; unit tests hold it against the same iteration in numpy."""
    return TH.li(X.raster(spark, d), IM, "v")


@query("A31_orientation", f"""{MASKS}, {norm_sql('masks', 'v', 'm2')}, n1 AS (SELECT *, 1 - norm AS inv, bool_or(m2) OVER (PARTITION BY image) AS has FROM nrm), us AS (SELECT * FROM n1 WHERE m2 OR NOT has),
{otsu_sql('us', 'norm', 'a')}, {otsu_sql('us', 'inv', 'b')}, f AS (SELECT image, avg(CASE WHEN norm > aotsu.t THEN 1e0 ELSE 0e0 END) AS f1, avg(CASE WHEN inv > botsu.t THEN 1e0 ELSE 0e0 END) AS f2 FROM n1 JOIN aotsu USING (image) JOIN botsu USING (image) GROUP BY image)
SELECT image, CASE WHEN f1 BETWEEN 0.005 AND 0.35 AND NOT f2 BETWEEN 0.005 AND 0.35 THEN false WHEN f2 BETWEEN 0.005 AND 0.35 AND NOT f1 BETWEEN 0.005 AND 0.35 THEN true ELSE abs(f1 - 0.1775) > abs(f2 - 0.1775) END AS invert FROM f""")
def a31(spark, d):
    return TH.choose_orientation(R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2")), IM, "norm", "m2")


@query("P18_J04_threshold", f"""{MASKS}, n1 AS (SELECT *, bool_or(m2) OVER (PARTITION BY image) AS has FROM masks), us AS (SELECT * FROM n1 WHERE m2 OR NOT has), {otsu_sql('us', 'v')} SELECT image, sum(CASE WHEN v > (CASE WHEN image % 2 = 0 THEN 0.05 ELSE t * 0.9 END) AND m2 THEN 1 ELSE 0 END)::BIGINT AS n FROM masks JOIN otsu USING (image) GROUP BY image""")
def p18(spark, d):
    m = X.masks(spark, d)
    j = m.join(TH.threshold(m, IM, "v", "m2"), "image")
    fixed = F.when(F.col("image") % 2 == 0, F.lit(0.05))
    return j.groupBy("image").agg(F.sum(R.over_threshold(F.col("v"), F.col("t"), fixed, 0.9, False, F.col("m2")).cast("long")).alias("n"))


def macenko_sql() -> str:
    """Eigenvalues of a symmetric 3x3 matrix by the cosine of a third of an angle; an eigenvector is the longest cross product of two rows of the matrix less the eigenvalue."""

    def cross(lam: str, name: str) -> str:
        rows = [(f"(rr-{lam})", "rg", "rb"), ("rg", f"(gg-{lam})", "gb"), ("rb", "gb", f"(bb-{lam})")]
        made = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            u, v = rows[i], rows[j]
            made.append([f"{u[1]}*{v[2]}-{u[2]}*{v[1]}", f"{u[2]}*{v[0]}-{u[0]}*{v[2]}", f"{u[0]}*{v[1]}-{u[1]}*{v[0]}"])
        structs = ", ".join(f"{{'l': sqrt(({x})*({x})+({y})*({y})+({z})*({z})), 'x': {x}, 'y': {y}, 'z': {z}}}" for x, y, z in made)
        return f"list_max([{structs}]) AS {name}"

    unit = lambda n: f"{n}.x/{n}.l*(CASE WHEN {n}.x+{n}.y+{n}.z < 0 THEN -1 ELSE 1 END) AS {n}x, {n}.y/{n}.l*(CASE WHEN {n}.x+{n}.y+{n}.z < 0 THEN -1 ELSE 1 END) AS {n}y, {n}.z/{n}.l*(CASE WHEN {n}.x+{n}.y+{n}.z < 0 THEN -1 ELSE 1 END) AS {n}z"
    end = lambda k: ", ".join(f"v1{c}*cos(a{k})+v2{c}*sin(a{k}) AS {c}{k}" for c in "xyz")
    ref = lambda k: f"abs(({TH.REFERENCE[0]}*x{k}+{TH.REFERENCE[1]}*y{k}+{TH.REFERENCE[2]}*z{k})/(sqrt(x{k}*x{k}+y{k}*y{k}+z{k}*z{k})+1e-8))"
    dab = lambda k: f"(x{k}*od_r+y{k}*od_g+z{k}*od_b)/(sqrt(x{k}*x{k}+y{k}*y{k}+z{k}*z{k})+1e-8)"
    return f"""{RGB}, od AS (SELECT image, -ln((r+1)/256e0) AS od_r, -ln((g+1)/256e0) AS od_g, -ln((b+1)/256e0) AS od_b FROM rgb),
few AS (SELECT image, count(*) FILTER (greatest(od_r, od_g, od_b) > 0.15) < 100 AS few FROM od GROUP BY image),
us AS (SELECT od.* FROM od JOIN few USING (image) WHERE few OR greatest(od_r, od_g, od_b) > 0.15),
cv AS (SELECT image, covar_samp(od_r, od_r) AS rr, covar_samp(od_r, od_g) AS rg, covar_samp(od_r, od_b) AS rb, covar_samp(od_g, od_g) AS gg, covar_samp(od_g, od_b) AS gb, covar_samp(od_b, od_b) AS bb FROM us GROUP BY image),
c1 AS (SELECT *, (rr+gg+bb)/3 AS q FROM cv),
c2 AS (SELECT *, sqrt(((rr-q)*(rr-q)+(gg-q)*(gg-q)+(bb-q)*(bb-q)+2*(rg*rg+rb*rb+gb*gb))/6) AS p FROM c1),
c3 AS (SELECT *, acos(greatest(-1, least(1, ((rr-q)*((gg-q)*(bb-q)-gb*gb)-rg*(rg*(bb-q)-gb*rb)+rb*(rg*gb-(gg-q)*rb))/(2*p*p*p))))/3 AS phi FROM c2),
c4 AS (SELECT *, q+2*p*cos(phi) AS e1, q+2*p*cos(phi-2*pi()/3) AS e2 FROM c3),
vx AS (SELECT image, {cross('e1', 'v1')}, {cross('e2', 'v2')} FROM c4),
vu AS (SELECT image, {unit('v1')}, {unit('v2')} FROM vx),
an AS (SELECT image, v1x, v1y, v1z, v2x, v2y, v2z, atan2(v2x*od_r+v2y*od_g+v2z*od_b, v1x*od_r+v1y*od_g+v1z*od_b) AS angle FROM us JOIN vu USING (image)),
ab AS (SELECT image, v1x, v1y, v1z, v2x, v2y, v2z, quantile_cont(angle, 0.01) AS a1, quantile_cont(angle, 0.99) AS a2 FROM an GROUP BY ALL),
ev AS (SELECT image, {end(1)}, {end(2)} FROM ab),
st AS (SELECT image, greatest(CASE WHEN {ref(1)} >= {ref(2)} THEN {dab(1)} ELSE {dab(2)} END, 0) AS dab FROM od JOIN ev USING (image))
SELECT image, {r6('sum(dab)', 'dab')}, {r6('max(dab)', 'most')} FROM st GROUP BY image"""


@query("A36_macenko", macenko_sql())
def a36(spark, d):
    """Eigenvectors of each image's density covariance; the SQL has them in closed form."""
    return TH.macenko(X.rgb(spark, d), IM).groupBy("image").agg(F.sum("dab").alias("dab"), F.max("dab").alias("most"))


@query("P22_J06_region_pair", f"{MASKS}, c AS (SELECT image, sum(CASE WHEN m1 AND m2 THEN 1e0 ELSE 0e0 END) AS i, sum(CASE WHEN m1 OR m2 THEN 1e0 ELSE 0e0 END) AS u, sum(CASE WHEN m1 THEN 1e0 ELSE 0e0 END) AS a, sum(CASE WHEN m2 THEN 1e0 ELSE 0e0 END) AS b FROM masks GROUP BY image) SELECT image, {r6('i/nullif(u,0)', 'x_jaccard')}, {r6('2*i/nullif(a+b,0)', 'x_dice')}, {r6('i/nullif(a,0)', 'x_frac_self_overlap')}, {r6('i/nullif(b,0)', 'x_frac_other_overlap')}, {r6('a/nullif(b,0)', 'x_positive_area_ratio')} FROM c")
def p22(spark, d):
    return R.region_pair(X.masks(spark, d), IM, "m1", "m2", "x")


@query("A08_cross_correlation", f"{STAINS}, k AS (SELECT *, hematoxylin > 0.05 OR dab > 0.05 AS uni FROM st) SELECT image, {r6('CASE WHEN count(*) >= 3 AND stddev_pop(hematoxylin) >= 1e-12 AND stddev_pop(dab) >= 1e-12 THEN covar_pop(hematoxylin, dab) / (stddev_pop(hematoxylin) * stddev_pop(dab)) END', 'corr_tissue')}, {r6('CASE WHEN count(*) FILTER (uni) >= 3 AND stddev_pop(hematoxylin) FILTER (uni) >= 1e-12 AND stddev_pop(dab) FILTER (uni) >= 1e-12 THEN covar_pop(hematoxylin, dab) FILTER (uni) / (stddev_pop(hematoxylin) FILTER (uni) * stddev_pop(dab) FILTER (uni)) END', 'corr_union')} FROM k GROUP BY image")
def a08x(spark, d):
    u = (F.col("hematoxylin") > 0.05) | (F.col("dab") > 0.05)
    return stains(spark, d).groupBy("image").agg(S.pearson("hematoxylin", "dab").alias("corr_tissue"), S.pearson("hematoxylin", "dab", u).alias("corr_union"))


@query("K04_gray", f"{MASKS}, {norm_sql('masks', 'v', 'm2')} SELECT image, sum(CAST(round(norm * 255) AS BIGINT))::BIGINT AS gray, count(*) FILTER (m1) AS mask FROM nrm GROUP BY image")
def k04(spark, d):
    n = R.normalise(X.masks(spark, d), IM, "v", where=F.col("m2"))
    return n.groupBy("image").agg(F.sum(F.round(F.col("norm") * 255).cast("long")).alias("gray"), F.sum(F.col("m1").cast("long")).alias("mask"))


QUADS = f"""{MASKS}, fg AS (SELECT image, row, col FROM masks WHERE m2), cd AS (SELECT image, row + dy AS r, col + dx AS c, sum(b) AS code FROM fg, (SELECT unnest([0,0,-1,-1]) AS dy, unnest([0,-1,0,-1]) AS dx, unnest([8,4,2,1]) AS b) GROUP BY ALL),
qd AS (SELECT image, count(*) FILTER (code IN (1,2,4,8)) AS q1, count(*) FILTER (code IN (3,12,5,10)) AS q2, count(*) FILTER (code IN (6,9)) AS qd, count(*) FILTER (code IN (7,11,13,14)) AS q3 FROM cd GROUP BY image)"""


@query("A24_euler", f"{QUADS} SELECT image, {r6('(q1 - q3 + 2 * qd) / 4e0', 'euler4')}, {r6('(q1 - q3 - 2 * qd) / 4e0', 'euler8')} FROM qd")
def a24(spark, d):
    return C.euler(X.masks(spark, d).where("m2"), IM)


@query("A25_boundary", f"{QUADS} SELECT image, {r6('q2 + sqrt(2) / 2 * (q1 + q3 + 2 * qd)', 'boundary_length')} FROM qd")
def a25(spark, d):
    return C.boundary_length(X.masks(spark, d).where("m2"), IM)


@query("A45_box_and_length", f"{MASKS} SELECT image, CAST(min(row) AS BIGINT) AS r0, CAST(min(col) AS BIGINT) AS c0, CAST(max(row) + 1 AS BIGINT) AS r1, CAST(max(col) + 1 AS BIGINT) AS c1, {r6('sqrt(pow((max(row) - min(row)) * 0.5, 2) + pow((max(col) - min(col)) * 0.25, 2))', 'diagonal')} FROM masks WHERE m1 GROUP BY image")
def a45(spark, d):
    m = X.masks(spark, d).where("m1").groupBy("image").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"))
    return m.withColumn("diagonal", F.hypot((F.col("r1") - 1 - F.col("r0")) * 0.5, (F.col("c1") - 1 - F.col("c0")) * 0.25))
