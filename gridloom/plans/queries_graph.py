"""Queries of drainage, regions, landscape, relief, smoothing, texture and segmentation operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import surface as sf
from gridloom.functions.surface import num
from gridloom.operators import focal, graph, windows
from gridloom.operators import kernels as kn
from gridloom.plans.queries_terrain import D8, NEAR
from gridloom.plans.recipes import cube, g_bands, g_class, g_qty, nine, scenes, with_, zoned
from gridloom.plans.registry import r6, register, rounded


def d8(s, d) -> DataFrame:
    return focal.pivot3(g_qty(s, d)).select("r", "c", F.expr(D8).cast("int").alias("d"))


DOWN = f"""fd AS (SELECT r, c, CAST({D8} AS INT) d FROM z),
st AS (SELECT * FROM (VALUES (1, 0, 1), (2, -1, 1), (3, -1, 0), (4, -1, -1), (5, 0, -1), (6, 1, -1), (7, 1, 0), (8, 1, 1)) t(d, dr, dc)),
ed AS (SELECT r, c, r + dr AS r2, c + dc AS c2, CASE WHEN d % 2 = 1 THEN 1E0 ELSE sqrt(2E0) END len FROM fd JOIN st USING (d))"""
BASE = "WITH RECURSIVE " + with_("g", nine(), DOWN)[5:-1]
UP = ", up AS (SELECT r, c, r AS r0, c AS c0, 0E0 AS dist FROM fd UNION ALL SELECT ed.r2, ed.c2, r0, c0, dist + len FROM up JOIN ed ON up.r = ed.r AND up.c = ed.c)"
ACC = UP + ", ac AS (SELECT r, c, CAST(count(*) - 1 AS DOUBLE) v FROM up GROUP BY r, c)"
LAST = UP + ", la AS (SELECT r0 AS r, c0 AS c, arg_max(r, dist) rr, arg_max(c, dist) rc, max(dist) dist FROM up GROUP BY r0, c0)"
register("flow_accumulation", lambda s, d: graph.flow_accumulation(d8(s, d)), BASE + ACC + " SELECT r, c, v FROM ac")
register("flow_path_length", lambda s, d: rounded(graph.flow_path_length(d8(s, d))), BASE + LAST + f" SELECT r, c, {r6('dist')} AS v FROM la")
register("watershed", lambda s, d: graph.watershed(d8(s, d)), BASE + LAST + " SELECT r, c, CAST(dense_rank() OVER (ORDER BY rr, rc) AS INT) AS basin FROM la")
register("watershed_parallel", lambda s, d: graph.watershed(d8(s, d)).groupBy("basin").agg(F.count("*").alias("cells")), BASE + LAST + " SELECT basin, count(*) AS cells FROM (SELECT CAST(dense_rank() OVER (ORDER BY rr, rc) AS INT) AS basin FROM la) GROUP BY basin")
HAND = UP + ", ac AS (SELECT r, c, count(*) - 1 v FROM up GROUP BY r, c), hs AS (SELECT u.r0 AS r, u.c0 AS c, arg_min(gg.v, u.dist) zs FROM up u JOIN ac ON ac.r = u.r AND ac.c = u.c AND ac.v >= 8 JOIN g gg ON gg.r = u.r AND gg.c = u.c GROUP BY 1, 2)"
register("hand", lambda s, d: graph.hand(g_qty(s, d), d8(s, d), graph.flow_accumulation(d8(s, d)), 8.0).select("r", "c", "v"), BASE + HAND + " SELECT r, c, g.v - zs AS v FROM g LEFT JOIN hs USING (r, c)")
register("stream_graph", lambda s, d: graph.edges(d8(s, d)).filter("to IS NOT NULL").select("id", "to", F.round("len", 6).alias("len")), BASE + " SELECT CAST(r AS BIGINT) * 4294967296 + c AS id, CAST(r2 AS BIGINT) * 4294967296 + c2 AS \"to\", round(len, 6) AS len FROM ed")
DD = ", sn AS (SELECT r, c, CASE WHEN v >= 4 THEN 1E0 ELSE 0E0 END v FROM ac)"
register("drainage_density", lambda s, d: rounded(focal.statistic(graph.flow_accumulation(d8(s, d)).select("r", "c", (F.col("v") >= 4).cast("double").alias("v")), 2, "mean")),
    BASE + ACC + DD + f" SELECT m.r, m.c, {r6('avg(n.v)')} AS v FROM sn m JOIN sn n ON abs(n.r - m.r) <= 2 AND abs(n.c - m.c) <= 2 GROUP BY m.r, m.c")
code = lambda s, d: d8(s, d).withColumns({"dr": graph.decode(F.col("d"))[0], "dc": graph.decode(F.col("d"))[1], "len": F.round(graph.distance(F.col("d"), 30.0), 6), "back": graph.opposite(F.col("d"))}).fillna(0)
register("d8_codes", lambda s, d: code(s, d).withColumn("again", F.coalesce(graph.encode(F.col("dr"), F.col("dc")), F.lit(0))), with_("g", nine(), DOWN) + "SELECT r, c, d, coalesce(dr, 0) AS dr, coalesce(dc, 0) AS dc, coalesce(round(CASE WHEN d % 2 = 1 THEN 30E0 WHEN d > 0 THEN 30 * sqrt(2E0) END, 6), 0E0) AS len, CASE WHEN d > 0 THEN (d + 3) % 8 + 1 ELSE 0 END AS back, d AS again FROM fd LEFT JOIN st USING (d)")

# regions and landscape
REG = """gcn AS (SELECT row_number() OVER (ORDER BY r, c) i, r, c, v FROM gc WHERE v IS NOT NULL),
rg AS (SELECT i, i AS j FROM gcn UNION SELECT rg.i, n.i FROM rg JOIN gcn m ON m.i = rg.j JOIN gcn n ON n.v = m.v AND abs(n.r - m.r) + abs(n.c - m.c) = 1),
lb AS (SELECT i, min(j) l FROM rg GROUP BY i),
pt AS (SELECT r, c, v, CAST(dense_rank() OVER (ORDER BY l) AS INT) AS label FROM lb JOIN gcn USING (i))"""
RBASE = "WITH RECURSIVE " + with_("g", "gc", REG)[5:]
PM = """, fa AS (SELECT p.label, count(*) FILTER (q.v IS NULL OR q.v <> p.v) e FROM pt p, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dr, dc) LEFT JOIN pt q ON q.r = p.r + dr AND q.c = p.c + dc GROUP BY p.label),
pm AS (SELECT label, CAST(any_value(v) AS BIGINT) AS class, count(*) AS cells, any_value(e) AS edges FROM pt JOIN fa USING (label) GROUP BY label)"""
register("label_patches", lambda s, d: graph.patches(g_class(s, d)), RBASE + "SELECT r, c, v, label FROM pt")
PARA, FRAC = r6("CAST(edges AS DOUBLE) / cells"), r6("CASE WHEN cells > 1 THEN 2 * ln(0.25E0 * edges) / ln(CAST(cells AS DOUBLE)) ELSE 1E0 END")
register("patch_metrics", lambda s, d: rounded(graph.patch_metrics(graph.patches(g_class(s, d)))), RBASE[:-1] + PM + f" SELECT label, class, cells, edges, {PARA} AS para, {FRAC} AS frac FROM pm")
CM = """, ad AS (SELECT CAST(m.v AS BIGINT) AS class, CAST(count(*) AS DOUBLE) g FROM gcn m JOIN gcn n ON n.v = m.v AND ((n.r = m.r AND n.c = m.c + 1) OR (n.c = m.c AND n.r = m.r + 1)) GROUP BY 1),
cm AS (SELECT class, CAST(sum(cells) AS DOUBLE) n, count(*) AS patches, CAST(sum(edges) AS DOUBLE) sp, sum(edges * sqrt(CAST(cells AS DOUBLE))) sq FROM pm GROUP BY class),
tt AS (SELECT CAST(count(*) AS DOUBLE) total FROM gcn)"""
AGGR = "least(coalesce(g, 0E0) / (CASE WHEN n > 1 THEN 2 * n - 2 * ceil(sqrt(n)) ELSE 1 END) * 100, 100E0)"
register("class_metrics", lambda s, d: rounded(graph.class_metrics(g_class(s, d), graph.patch_metrics(graph.patches(g_class(s, d))))),
    RBASE[:-1] + PM + CM + f" SELECT class, {r6('n / total')} AS proportion, patches, {r6('n / patches')} AS mean_area, {r6(AGGR)} AS aggregation, {r6('greatest(least((1 - sp / sq) / (1 - 1 / sqrt(total)) * 100, 100E0), 0E0)')} AS cohesion FROM cm LEFT JOIN ad USING (class), tt")
register("landscape_metrics", lambda s, d: rounded(graph.landscape(g_class(s, d))), with_("g", "gc", "k AS (SELECT v, CAST(count(*) AS DOUBLE) n FROM gc WHERE v IS NOT NULL GROUP BY v)", "t AS (SELECT sum(n) t FROM k)") + f"SELECT {r6('-sum(n / t * ln(n / t))')} AS shdi, {r6('1 - sum(n / t * n / t)')} AS sidi, count(*) AS classes, CAST(sum(n) AS BIGINT) AS cells FROM k, t")
DIV = with_("g", "gc", NEAR(2, src="gc"), "k AS (SELECT r, c, v, CAST(count(*) AS DOUBLE) n FROM w WHERE v0 IS NOT NULL AND v IS NOT NULL GROUP BY r, c, v)", "p AS (SELECT r, c, n / sum(n) OVER (PARTITION BY r, c) p FROM k)")


def diversity(grid: DataFrame, k: int, kind: str) -> DataFrame:
    """Shannon or Simpson diversity of the classes of each window."""
    a = F.expr("transform(filter(near, x -> x.v IS NOT NULL), x -> x.v)")
    t = focal.neighbours(grid, k).filter("v IS NOT NULL").select("r", "c", a.alias("a"))
    p = F.transform(F.array_distinct("a"), lambda u: F.size(F.filter("a", lambda x: x == u)) / F.size("a"))
    total = F.aggregate(p, F.lit(0.0), lambda q, x: q + (-x * F.log(x) if kind == "shannon" else x * x))
    return t.select("r", "c", (total if kind == "shannon" else 1 - total).alias("v"))


register("shannon_diversity", lambda s, d: rounded(diversity(g_class(s, d), 2, "shannon")), DIV + f"SELECT r, c, {r6('-sum(p * ln(p))')} AS v FROM p GROUP BY r, c")
register("simpson_diversity", lambda s, d: rounded(diversity(g_class(s, d), 2, "simpson")), DIV + f"SELECT r, c, {r6('1 - sum(p * p)')} AS v FROM p GROUP BY r, c")
FACES = "f AS (SELECT p.zone, count(*) FILTER (q.zone IS NULL OR q.zone <> p.zone) e FROM gz p, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dr, dc) LEFT JOIN gz q ON q.r = p.r + dr AND q.c = p.c + dc WHERE p.zone > 0 GROUP BY p.zone)"


def basin_morphometry(zones: DataFrame, cs: float = 30.0) -> DataFrame:
    """Area, rim, circularity, compactness and form of each basin."""
    labelled = zones.filter("zone > 0").select("r", "c", F.col("zone").cast("double").alias("v"), F.col("zone").alias("label"))
    t = graph.patch_metrics(labelled, cs).select(F.col("label").alias("zone"), (F.col("cells") * cs * cs).alias("area"), (F.col("edges") * cs).alias("rim"))
    return t.selectExpr("zone", "area", "rim", f"{num(4 * math.pi)} * area / (rim * rim) AS circularity", "rim / (2 * sqrt(pi() * area)) AS compactness")


register("basin_morphometry", lambda s, d: rounded(basin_morphometry(zoned(g_qty(s, d)))), with_("g", "gz", FACES, "a AS (SELECT zone, count(*) * 900E0 area FROM gz GROUP BY zone)") + f"SELECT zone, area, e * 30E0 AS rim, {r6(f'{num(4 * math.pi)} * area / (e * 30E0 * e * 30E0)')} AS circularity, {r6('e * 30E0 / (2 * sqrt(pi() * area))')} AS compactness FROM f JOIN a USING (zone)")
MIG = "SELECT CAST(least(p.zone, q.zone) AS INT) AS a, CAST(greatest(p.zone, q.zone) AS INT) AS b, count(*) AS faces, {m} AS relief FROM gz p JOIN gz q ON ((q.r = p.r AND q.c = p.c + 1) OR (q.c = p.c AND q.r = p.r + 1)) AND q.zone <> p.zone WHERE p.zone > 0 AND q.zone > 0 GROUP BY 1, 2".format(m=r6("median(abs(p.v - q.v))"))


def divides(zones: DataFrame) -> DataFrame:
    """Faces between adjacent basins and the median difference across them."""
    near = zones.filter("zone > 0").select("zone", "v", F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((0, 1), (1, 0))])).alias("n"))
    j = near.select("n.r", "n.c", "zone", "v").join(zones.filter("zone > 0").select("r", "c", F.col("zone").alias("z2"), F.col("v").alias("v2")), ["r", "c"]).filter("zone <> z2")
    return j.groupBy(F.least("zone", "z2").alias("a"), F.greatest("zone", "z2").alias("b")).agg(F.count("*").alias("faces"), F.median(F.abs(F.col("v") - F.col("v2"))).alias("relief"))


register("divide_migration", lambda s, d: rounded(divides(zoned(g_qty(s, d)))), with_("g", "gz") + MIG)


def gaussian(grid: DataFrame, sigma: float, k: int) -> DataFrame:
    """Separable Gaussian mean over valid cells, as two weighted window passes."""
    for axis, pos in (("r", "c"), ("c", "r")):
        near = grid.select("r", "c", "v", F.collect_list(F.struct(F.col(pos).alias("p"), "v")).over(focal._along(axis, k)).alias("a"))
        w = lambda x: F.exp(-(x["p"] - F.col(pos)) * (x["p"] - F.col(pos)) / (2 * sigma * sigma))  # noqa: E731, B023
        a = F.filter("a", lambda x: x["v"].isNotNull())
        top = F.aggregate(a, F.lit(0.0), lambda q, x: q + x["v"] * w(x))
        bottom = F.aggregate(a, F.lit(0.0), lambda q, x: q + w(x))
        grid = near.select("r", "c", F.when(F.col("v").isNotNull(), top / bottom).alias("v"))
    return grid


GAUSS = lambda src, out, sigma, k: (
    f"{out}a AS (SELECT m.r, m.c, CASE WHEN any_value(m.v) IS NOT NULL THEN sum(n.v * exp(-(n.c - m.c) * (n.c - m.c) / {num(2 * sigma * sigma)})) / sum(CASE WHEN n.v IS NOT NULL THEN exp(-(n.c - m.c) * (n.c - m.c) / {num(2 * sigma * sigma)}) END) END v FROM {src} m JOIN {src} n ON n.r = m.r AND abs(n.c - m.c) <= {k} GROUP BY m.r, m.c), "
    f"{out} AS (SELECT m.r, m.c, CASE WHEN any_value(m.v) IS NOT NULL THEN sum(n.v * exp(-(n.r - m.r) * (n.r - m.r) / {num(2 * sigma * sigma)})) / sum(CASE WHEN n.v IS NOT NULL THEN exp(-(n.r - m.r) * (n.r - m.r) / {num(2 * sigma * sigma)}) END) END v FROM {out}a m JOIN {out}a n ON n.c = m.c AND abs(n.r - m.r) <= {k} GROUP BY m.r, m.c)"
)
register("gaussian_smoothing", lambda s, d: rounded(gaussian(g_qty(s, d), 1.0, 2)), with_("g", GAUSS("g", "h", 1.0, 2)) + f"SELECT r, c, {r6('v')} AS v FROM h")


def scale_space(grid: DataFrame, sigmas: tuple[float, ...]) -> DataFrame:
    out = None
    for sigma in sigmas:
        level = gaussian(grid, sigma, math.ceil(3 * sigma)).withColumn("sigma", F.lit(sigma))
        out = level if out is None else out.unionByName(level)
    return out


register("gaussian_scale_space", lambda s, d: rounded(scale_space(g_qty(s, d), (1.0, 2.0)), "v"), with_("g", GAUSS("g", "h1", 1.0, 3), GAUSS("g", "h2", 2.0, 6)) + f"SELECT r, c, {r6('v')} AS v, 1E0 AS sigma FROM h1 UNION ALL SELECT r, c, {r6('v')} AS v, 2E0 AS sigma FROM h2")
register("scale_space_derivatives", lambda s, d: rounded(focal.apply(gaussian(g_qty(s, d), 1.0, 3), sf.curvatures(sf.EVANS)["mean_h"])))

# landform: two position indices against their spread, and the slope
LF = """t3 AS (SELECT m.r, m.c, CASE WHEN m.v IS NOT NULL AND count(*) = 49 THEN m.v - avg(n.v) FILTER (NOT (n.r = m.r AND n.c = m.c)) END t FROM g m JOIN g n ON abs(n.r - m.r) <= 3 AND abs(n.c - m.c) <= 3 GROUP BY m.r, m.c, m.v),
t10 AS (SELECT m.r, m.c, CASE WHEN m.v IS NOT NULL AND count(*) = 441 THEN m.v - avg(n.v) FILTER (NOT (n.r = m.r AND n.c = m.c)) END t FROM g m JOIN g n ON abs(n.r - m.r) <= 10 AND abs(n.c - m.c) <= 10 GROUP BY m.r, m.c, m.v)"""
CASES = (
    "CASE WHEN sz > 1 AND lz > 1 THEN 1 WHEN sz > 1 AND lz >= -1 THEN 2 WHEN sz > 1 THEN 3 WHEN sz >= -1 AND lz > 1 AND NOT g THEN 4 WHEN sz >= -1 AND lz > 1 THEN 5"
    " WHEN sz >= -1 AND lz >= -1 AND NOT g THEN 6 WHEN sz >= -1 AND lz >= -1 THEN 7 WHEN sz >= -1 THEN 8 WHEN lz > 1 THEN 9 WHEN lz >= -1 THEN 10 ELSE 11 END"
)


def landform(grid: DataFrame, small: int = 3, large: int = 10, slope_at: float = 6.0) -> DataFrame:
    """Ten-odd landforms from two standardised position indices and the slope."""
    a = windows.tpi(grid, small).withColumnRenamed("v", "a").join(windows.tpi(grid, large).withColumnRenamed("v", "b"), ["r", "c"]).join(focal.apply(grid, sf.slope()).withColumnRenamed("v", "s"), ["r", "c"])
    k = a.agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb"))
    t = a.crossJoin(F.broadcast(k)).filter("a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL")
    t = t.selectExpr("r", "c", "(a - ma) / sa AS sz", "(b - mb) / sb AS lz", f"s < {slope_at} AS g")
    return t.select("r", "c", F.expr(CASES).cast("int").alias("v"))


SL = f"sl AS (SELECT r, c, CASE WHEN full9 THEN {sf.slope().replace('gx', sf.horn()[0]).replace('gy', sf.horn()[1])} END s FROM z)"
register("landform_classification", lambda s, d: landform(g_qty(s, d)), with_("g", nine(), SL, LF, "k AS (SELECT (SELECT avg(t) FROM t3) ma, (SELECT stddev_pop(t) FROM t3) sa, (SELECT avg(t) FROM t10) mb, (SELECT stddev_pop(t) FROM t10) sb)", "q AS (SELECT r, c, (t3.t - ma) / sa sz, (t10.t - mb) / sb lz, s < 6 g FROM t3 JOIN t10 USING (r, c) JOIN sl USING (r, c), k WHERE t3.t IS NOT NULL AND t10.t IS NOT NULL AND s IS NOT NULL)") + f"SELECT r, c, CAST({CASES} AS INT) AS v FROM q")


KERNELS: dict[str, tuple] = {}


def textures(grid: DataFrame, feature: str) -> DataFrame:
    """A texture feature over tiles, with the levels of the whole grid."""
    ends = grid.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()  # one row
    if ends["lo"] is None:
        return grid.select("r", "c", F.lit(None).cast("double").alias("v"))
    limits = (ends["lo"], ends["hi"])
    return kn.run(grid, lambda z: kn.glcm(z, 2, 16, feature, limits), {"v": "double"}, halo=4)


def grid_query(name: str, kernel, out: dict[str, str] | None = None, halo: int | None = None) -> None:
    """A kernel over the quantity grid, in tiles where its reach is ``halo``; checked by tests on small arrays."""
    KERNELS[name] = (kernel, out or {"v": "double"}, halo)
    register(name, lambda s, d: rounded(kn.run(g_qty(s, d), kernel, out or {"v": "double"}, halo=halo)))


register("priority_flood", lambda s, d: rounded(kn.flooded(g_qty(s, d))))
grid_query("priority_flood_epsilon", lambda z: kn.priority_flood(z, 1e-3))
grid_query("fill_sinks", kn.fill_sinks)


def above_fill(grid: DataFrame, sign: int) -> DataFrame:
    """How far the filled surface of the grid (or of its mirror image, sign -1) stands above it."""
    up = grid.select("r", "c", (F.col("v") * sign).alias("v"))
    return kn.flooded(up).withColumnRenamed("v", "w").join(up, ["r", "c"]).select("r", "c", (F.col("w") - F.col("v")).alias("v"))


register("elev_above_pit", lambda s, d: rounded(above_fill(g_qty(s, d), 1)))
register("valley_depth", lambda s, d: rounded(above_fill(g_qty(s, d), -1)))

grid_query("flow_direction", kn.d8, {"d": "int"})
grid_query("resolve_flats", lambda z: kn.resolve_flats(z, kn.d8(z, False)), {"d": "int"})
grid_query("flow_accumulation_mfd", kn.mfd)
grid_query("flow_accumulation_mfd_adaptive", kn.mfd_adaptive)
grid_query("flow_accumulation_tfga", kn.facet_accumulation)
register("priority_flood_flat", lambda s, d: rounded(kn.flooded(g_qty(s, d))))
grid_query("flow_direction_dinf", kn.dinf, halo=1)
grid_query("flow_accumulation_dinf", lambda z: kn.dinf_accumulation(kn.dinf(z)))
grid_query("flow_dinf", lambda z: {"angle": (a := kn.dinf(z)), "acc": kn.dinf_accumulation(a)}, {"angle": "double", "acc": "double"})
grid_query("strahler_order", lambda z: kn.strahler(d := kn.d8(kn.priority_flood(z)), kn.d8_accumulation(d) >= 4))
grid_query("isobasins", lambda z: kn.isobasins(kn.d8(kn.priority_flood(z)), 50.0), {"basin": "int"})
grid_query("flood_fill_simulation", lambda z: kn.flood(z, float(np.nanmedian(z))))
grid_query("breach_depressions", kn.breach)
grid_query("nested_depressions", kn.nested_depressions, {"basin": "int"})
grid_query("sediment_connectivity", lambda z: kn.sediment_connectivity(np.arctan(np.hypot(*kn.horn(z, 1000.0))), kn.d8(kn.priority_flood(z)), 20))
grid_query("max_branch_length", kn.max_branch_length)
grid_query("downslope_index", lambda z: kn.downslope_index(z, 200.0))
grid_query("excess_topography", kn.excess_topography)
register("cost_distance", lambda s, d: rounded(kn.run(g_qty(s, d), lambda z: kn.cost_distance(z, [(0, 0), (20, 20)]), {"v": "double"})))
grid_query("horizon_angle_map", lambda z: np.degrees(np.arctan(kn.horizon(z, math.pi / 4, 8))), halo=8)
grid_query("horizon_angles", lambda z: {f"h{i}": np.arctan(h) for i, h in enumerate(kn.horizons(z, 8, 8))}, {f"h{i}": "double" for i in range(8)}, halo=8)
grid_query("horizon_tan_map", lambda z: kn.horizon(z, math.pi / 4, 8), halo=8)
grid_query("sky_view_factor", kn.sky_view, halo=10)
grid_query("ambient_shade", lambda z: kn.sky_view(z, 8, 16), halo=8)
grid_query("positive_openness", kn.openness, halo=10)
grid_query("negative_openness", lambda z: kn.openness(z, positive=False), halo=10)
grid_query("wind_exposure", lambda z: kn.wind_exposure(z, 8), halo=8)
grid_query("viewshed", lambda z: kn.viewshed(z, 16, 16), {"v": "int"})
grid_query("viewshed_multiple", lambda z: kn.viewshed(z, 8, 8) + kn.viewshed(z, 24, 24), {"v": "int"})
grid_query("geomorphons", kn.geomorphons, {"v": "int"}, halo=10)
grid_query("directional_relief", kn.directional_relief, halo=10)
grid_query("relative_aspect", kn.relative_aspect, halo=10)
grid_query("iterative_mean_smoothing", kn.iterative_mean, halo=3)
grid_query("feature_preserving_smoothing", kn.feature_smoothing, halo=7)
grid_query("fft_low_pass", kn.fft_low_pass)
grid_query("ssa_2d", kn.ssa_2d)
grid_query("msv", kn.multiscale_valleyness, halo=5)
grid_query("multiscale_curvatures", lambda z: kn.mean_curvature(kn.quadratic(z, 2)), halo=2)
grid_query("mrvbf", kn.mrvbf, {"mrvbf": "double", "mrrtf": "double"}, halo=24)
grid_query("uncertainty", kn.uncertainty, halo=1)
grid_query("solar_radiation", lambda z: kn.solar(np.arctan(np.hypot(*kn.horn(z, 100.0))), np.nan_to_num(kn.aspect_radians(z))), halo=1)
grid_query("solar_radiation_annual", lambda z: sum(30.4 * kn.solar(np.arctan(np.hypot(*kn.horn(z, 100.0))), np.nan_to_num(kn.aspect_radians(z)), 15 + 30 * m, step=1.0) for m in range(12)), halo=1)
for feature in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "correlation"):
    register(f"glcm_{feature}", lambda s, d, f=feature: rounded(textures(g_qty(s, d), f)))
grid_query("refined_lee_filter", kn.refined_lee, halo=3)
grid_query("felzenszwalb", lambda z: kn.felzenszwalb(z, 300.0, 10), {"label": "int"})
grid_query("slic", lambda z: kn.slic(z, 64), {"label": "int"})
grid_query("detect_water", lambda z: kn.detect_water(z / 1000, 0.2, 3), {"v": "int"})
grid_query("water_depth", lambda z: kn.chamfer(kn.detect_water(z / 1000, 0.2, 3) > 0))
grid_query("cast_shadow_ray_mask", lambda z: kn.cast_shadow(z / 500, math.radians(315), math.radians(45), 8), {"v": "int"}, halo=8)
grid_query("ray_shade", lambda z: np.mean([kn.cast_shadow(z / 500, math.radians(315), math.radians(a), 8) for a in (40, 45, 50)], 0), halo=8)
register("patch_density", lambda s, d: rounded(kn.run(g_class(s, d), lambda a: kn.patch_density(a, 2), {"v": "double"}, halo=2)))
register("fill_gaps_neighbor_mean", lambda s, d: rounded(kn.run(g_qty(s, d).select("r", "c", F.when(F.col("v") > 1300, F.col("v")).alias("v")), kn.gap_fill, {"v": "double"}, halo=20)))


def feather(tiles: DataFrame, scene: str = "scene") -> DataFrame:
    """Overlapping scenes blended by each cell's distance to its scene's edge."""
    w = kn.run(tiles, lambda a: {"v": a, "w": kn.chamfer(~np.isnan(a))}, {"v": "double", "w": "double"}, by=scene)
    return w.filter("w > 0 AND v IS NOT NULL").groupBy("r", "c").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


register("feather_mosaic", lambda s, d: rounded(feather(scenes(s, d).select("scene", "r", "c", "v"))))
register("composite_scene_strips", lambda s, d: rounded(kn.run(scenes(s, d).groupBy("r", "c").agg(F.median("v").alias("v")), kn.gap_fill, {"v": "double"}, halo=20)))
HYPSO = "(g.v - lo) / (hi - lo)"
SHADE = sf.hillshade(normalized=True).replace("gx", sf.horn()[0]).replace("gy", sf.horn()[1])
register(
    "hypsometric_hillshade",
    lambda s, d: rounded(focal.surface(g_qty(s, d), only=sf.hillshade(normalized=True)).crossJoin(F.broadcast(g_qty(s, d).agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("r", "c", F.when(F.col("full"), F.expr(sf.hillshade(normalized=True)) * (F.col("z5") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))),
    with_("g", nine(), "k AS (SELECT min(v) lo, max(v) hi FROM g)") + f"SELECT r, c, {r6(f'CASE WHEN full9 THEN {SHADE} * (z5 - lo) / (hi - lo) END')} AS v FROM z, k",
)
CONV = f"a AS (SELECT r, c, CASE WHEN full9 AND NOT (abs({sf.horn()[0]}) < 2.3e-16 AND abs({sf.horn()[1]}) < 2.3e-16) THEN degrees(atan2(-{sf.horn()[0]}, {sf.horn()[1]})) END a FROM z)"


def convergence(grid: DataFrame, k: int = 1) -> DataFrame:
    """The mean angle between neighbours' aspects and their direction to the centre, less 90 degrees, in percent."""
    aspect = focal.surface(grid, only="gx gy").select("r", "c", F.expr("CASE WHEN full AND NOT (abs(gx) < 2.3e-16 AND abs(gy) < 2.3e-16) THEN degrees(atan2(-gx, gy)) END").alias("v"))
    near = focal.neighbours(aspect, k)
    turn = "abs(pmod(x.v, 360) - pmod(degrees(atan2(CAST(-x.dc AS DOUBLE), CAST(x.dr AS DOUBLE))), 360))"
    a = F.expr(f"transform(filter(near, x -> x.v IS NOT NULL AND NOT (x.dr = 0 AND x.dc = 0)), x -> CASE WHEN {turn} > 180 THEN 360 - {turn} ELSE {turn} END)")
    t = near.select("r", "c", a.alias("a")).filter("size(a) > 0")
    return t.select("r", "c", ((F.aggregate("a", F.lit(0.0), lambda q, x: q + x) / F.size("a") - 90) / 0.9).alias("v"))


TURN = "abs((CASE WHEN n.a < 0 THEN n.a + 360 ELSE n.a END) - (CASE WHEN t < 0 THEN t + 360 ELSE t END))"
register("convergence_index", lambda s, d: rounded(convergence(g_qty(s, d))), with_("g", nine(), CONV, "p AS (SELECT m.r, m.c, n.a, degrees(atan2(CAST(m.c - n.c AS DOUBLE), CAST(n.r - m.r AS DOUBLE))) t FROM a m JOIN a n ON abs(n.r - m.r) <= 1 AND abs(n.c - m.c) <= 1 AND NOT (n.r = m.r AND n.c = m.c) WHERE n.a IS NOT NULL)")
    + f"SELECT r, c, {r6(f'(avg(CASE WHEN {TURN} > 180 THEN 360 - {TURN} ELSE {TURN} END) - 90) / 0.9E0')} AS v FROM p n GROUP BY r, c")
