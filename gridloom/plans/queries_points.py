"""Queries of points, vectors, resampling, coordinates, drift of networks, formats and strings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import points as pt
from gridloom.plans.recipes import g_bands, g_qty, points, table, with_
from gridloom.plans.registry import r6, register, rounded

# a 12 x 12 grid over the middle of the points' plane
X0, Y0, W, H, N = -0.3, 0.3, 0.05, -0.05, 12
CELLS = f"ce AS (SELECT CAST(i // {N} AS INT) r, CAST(i % {N} AS INT) c, {X0}E0 + (i % {N} + 0.5E0) * {W}E0 x, {Y0}E0 + (i // {N} + 0.5E0) * {H}E0 y FROM range({N * N}) t(i))"
PAIR = lambda rad: f"pr AS (SELECT r, c, id, value, sqrt((ce.x - pts.x) * (ce.x - pts.x) + (ce.y - pts.y) * (ce.y - pts.y)) d FROM ce, pts WHERE sqrt((ce.x - pts.x) * (ce.x - pts.x) + (ce.y - pts.y) * (ce.y - pts.y)) <= {rad})"
cells = lambda s: pt.cells(s, N, N, X0, Y0, W, H)
register("sample_at_points", lambda s, d: rounded(pt.sample(points(s, d).selectExpr("id", "x", "y"), g_bands(s, d), -0.4, 0.4, 0.025, -0.025).select("id", "r", "c", "b1", "b4"), "b1"),
    with_("bands", "pts", "q AS (SELECT id, CAST(floor((y - 0.4E0) / -0.025E0) AS INT) r, CAST(floor((x - -0.4E0) / 0.025E0) AS INT) c FROM pts)") + f"SELECT id, r, c, {r6('b1')} AS b1, b4 FROM q JOIN bands USING (r, c)")
register("nearest_neighbor", lambda s, d: rounded(pt.nearest(cells(s), points(s, d), 0.1), "v"), with_("pts", CELLS, PAIR(0.1)) + f"SELECT r, c, {r6('value')} AS v FROM (SELECT r, c, value, row_number() OVER (PARTITION BY r, c ORDER BY d, id) k FROM pr) WHERE k = 1")
register("idw", lambda s, d: rounded(pt.idw(cells(s), points(s, d), 0.15), "v"), with_("pts", CELLS, PAIR(0.15)) + f"SELECT r, c, {r6('sum(value / (d * d)) / sum(1 / (d * d))')} AS v FROM pr GROUP BY r, c")
VG = "pv AS (SELECT a.value va, b.value vb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d FROM pts a JOIN pts b ON a.id < b.id)"
register("empirical_variogram", lambda s, d: rounded(pt.variogram(points(s, d), 0.03, 8), "distance", "gamma"), with_("pts", VG) + f"SELECT CAST(floor(d / 0.03E0) AS INT) AS lag, count(*) AS pairs, {r6('avg(d)')} AS distance, {r6('sum((vb - va) * (vb - va)) / (2 * count(*))')} AS gamma FROM pv WHERE d < 0.24E0 GROUP BY 1")


def fitted(s, d):
    rows = [(r["distance"], r["gamma"], r["pairs"]) for r in pt.variogram(points(s, d), 0.03, 8).orderBy("lag").collect()]
    return [(k, *map(float, pt.fit_variogram(rows, k))) for k in ("spherical", "exponential", "gaussian")]


def best_model(s, d):
    k = min(fitted(s, d), key=lambda m: m[4])
    return k[:4]


register("fit_variogram", lambda s, d: rounded(s.createDataFrame(fitted(s, d), "model string, nugget double, sill double, reach double, rss double")))
register("fit_best_variogram", lambda s, d: rounded(s.createDataFrame([best_model(s, d)], "model string, nugget double, sill double, reach double")))
register("ordinary_kriging", lambda s, d: rounded(pt.kriging(cells(s), points(s, d), 0.2, best_model(s, d))))
register("universal_kriging", lambda s, d: rounded(pt.kriging(cells(s), points(s, d), 0.2, best_model(s, d), drift=1)))


def regression_kriging(s, d, model=None):
    """A plane by least squares, and kriging of what it leaves, with a variogram that is given or fitted."""
    p = points(s, d)
    row = p.agg(*[F.avg(c) for c in ("x", "y", "value")], F.covar_pop("x", "x"), F.covar_pop("x", "y"), F.covar_pop("y", "y"), F.covar_pop("x", "value"), F.covar_pop("y", "value")).first()
    mx, my, mv, xx, xy, yy, xv, yv = row
    det = xx * yy - xy * xy
    a, b = (xv * yy - yv * xy) / det, (yv * xx - xv * xy) / det
    plane = mv + (F.col("x") - mx) * a + (F.col("y") - my) * b
    left = p.select("id", "x", "y", (F.col("value") - plane).alias("value"))
    k = pt.kriging(cells(s), left, 0.2, model or best_model(s, d))
    return k.join(cells(s), ["r", "c"]).select("r", "c", (F.col("v") + plane).alias("v"), "variance")


register("regression_kriging", lambda s, d: rounded(regression_kriging(s, d)))
register("regression_kriging_with_variogram", lambda s, d: rounded(regression_kriging(s, d, ("exponential", 0.002, 0.016, 0.15))))
register("tps_interpolation", lambda s, d: rounded(pt.thin_plate(cells(s), points(s, d), 1e-3), "v"))
register("natural_neighbor", lambda s, d: rounded(pt.natural_neighbours(cells(s), points(s, d), 0.2, 24), "v"))
register("tin_interpolation", lambda s, d: rounded(pt.tin(cells(s), points(s, d), 0.4), "v"))
register("grid_points_in_polygon", lambda s, d: s.range(144).selectExpr("CAST(floor(id / 12) AS INT) AS r", "CAST(id % 12 AS INT) AS c", "id % 12 + 0.5D AS x", "floor(id / 12) + 0.5D AS y").withColumn("ring", F.expr("array(named_struct('x', 1.03D, 'y', 1.07D), named_struct('x', 10.11D, 'y', 2.05D), named_struct('x', 7.02D, 'y', 11.3D))")).filter(pt.contains(F.col("ring"), F.col("x"), F.col("y"))).select("r", "c"),
    "SELECT CAST(i // 12 AS INT) AS r, CAST(i % 12 AS INT) AS c FROM (SELECT i, i % 12 + 0.5E0 x, i // 12 + 0.5E0 y FROM range(144) t(i)) WHERE (x - 1.03E0) * 0.98E0 - (y - 1.07E0) * 9.08E0 < 0 AND (x - 10.11E0) * 9.25E0 - (y - 2.05E0) * -3.09E0 < 0 AND (x - 7.02E0) * -10.23E0 - (y - 11.3E0) * -5.99E0 < 0")
PATCH = "SELECT p.id, list(b.b1 ORDER BY b.r, b.c) AS patch FROM q p JOIN bands b ON abs(b.r - p.r) <= 1 AND abs(b.c - p.c) <= 1 GROUP BY p.id HAVING count(*) = 9"


def patches(s, d):
    """3 x 3 patches round points, in row-major order; patches that leave the grid or hold nodata are dropped."""
    r, c = geo.pixel_of("x", "y", -0.4, 0.4, 0.025, -0.025)
    p = points(s, d).select("id", F.expr(r).alias("r0"), F.expr(c).alias("c0"))
    around = F.explode(F.array(*[F.struct((F.col("r0") + a).alias("r"), (F.col("c0") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    j = p.select("id", around.alias("n")).select("id", "n.r", "n.c").join(g_bands(s, d), ["r", "c"])
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "c", "b1"))).alias("a")).filter("size(a) = 9")
    return g.select("id", F.concat_ws(",", F.expr("transform(a, x -> CAST(CAST(x.b1 AS BIGINT) AS STRING))")).alias("patch"))


register("extract_patches", patches, with_("bands", "pts", "q AS (SELECT id, CAST(floor((y - 0.4E0) / -0.025E0) AS INT) r, CAST(floor((x - -0.4E0) / 0.025E0) AS INT) c FROM pts)") + PATCH.replace("list(b.b1 ORDER BY b.r, b.c)", "string_agg(CAST(CAST(b.b1 AS BIGINT) AS VARCHAR), ',' ORDER BY b.r, b.c)"))
LINE = [(4.0, 2.0), (12.0, 8.0), (20.0, 16.0), (28.0, 30.0)]
SW = "sw AS (SELECT r, c, v, i, sqrt((c - x) * (c - x) + (r - y) * (r - y)) d FROM g, (VALUES " + ", ".join(f"({i}, {x}E0, {y}E0)" for i, (x, y) in enumerate(LINE)) + ") l(i, x, y))"
register("swath_profile", lambda s, d: rounded(pt.swath(g_qty(s, d).select(F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "v"), LINE, 6.0)), with_("g", SW) + f"SELECT CAST(i AS INT) AS bin, count(v) AS n, min(v) AS min, {r6('avg(v)')} AS mean, max(v) AS max FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d, i) k FROM sw) WHERE k = 1 AND d <= 6 GROUP BY i")

# regridding
NEAREST = "SELECT CAST(i // 20 AS INT) AS r, CAST(i % 20 AS INT) AS c, v FROM range(400) t(i) JOIN g ON g.r = CAST(floor((i // 20 + 0.5E0) * 1.6E0) AS INT) AND g.c = CAST(floor((i % 20 + 0.5E0) * 1.6E0) AS INT)"
target = lambda s, n: s.range(n * n).selectExpr(f"CAST(floor(id / {n}) AS INT) AS r", f"CAST(id % {n} AS INT) AS c")
register("resample_nearest", lambda s, d: target(s, 20).selectExpr("r", "c", "CAST(floor((r + 0.5D) * 1.6D) AS INT) AS sr", "CAST(floor((c + 0.5D) * 1.6D) AS INT) AS sc").join(g_qty(s, d).selectExpr("r AS sr", "c AS sc", "v"), ["sr", "sc"]).select("r", "c", "v"), with_("g") + NEAREST)
register("resample_average", lambda s, d: rounded(g_qty(s, d).groupBy(F.floor(F.col("r") / 4).cast("int").alias("r"), F.floor(F.col("c") / 4).cast("int").alias("c")).agg(F.avg("v").alias("v")), "v"), with_("g") + f"SELECT CAST(floor(r / 4.0) AS INT) AS r, CAST(floor(c / 4.0) AS INT) AS c, {r6('avg(v)')} AS v FROM g GROUP BY 1, 2")


def bilinear(s, d):
    """Each target centre from the four cells round it; null if one of them is."""
    t = target(s, 20).selectExpr("r", "c", "(r + 0.5D) * 1.6D - 0.5D AS y", "(c + 0.5D) * 1.6D - 0.5D AS x").selectExpr("r", "c", "CAST(floor(y) AS INT) AS y0", "CAST(floor(x) AS INT) AS x0", "y - floor(y) AS fy", "x - floor(x) AS fx")
    corner = F.explode(F.array(*[F.struct((F.col("y0") + a).alias("sr"), (F.col("x0") + b).alias("sc"), ((F.col("fy") if a else 1 - F.col("fy")) * (F.col("fx") if b else 1 - F.col("fx"))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    j = t.select("r", "c", corner.alias("k")).select("r", "c", "k.sr", "k.sc", "k.w").join(g_qty(s, d).selectExpr("r AS sr", "c AS sc", "v"), ["sr", "sc"])
    return j.groupBy("r", "c").agg(F.count("v").alias("n"), F.sum(F.col("v") * F.col("w")).alias("v")).filter("n = 4").select("r", "c", "v")


register("resample_bilinear", lambda s, d: rounded(bilinear(s, d), "v"), with_("g", "t AS (SELECT CAST(i // 20 AS INT) r, CAST(i % 20 AS INT) c, (i // 20 + 0.5E0) * 1.6E0 - 0.5E0 y, (i % 20 + 0.5E0) * 1.6E0 - 0.5E0 x FROM range(400) q(i))") + f"SELECT t.r, t.c, {r6('sum(g.v * (1 - abs(t.y - g.r)) * (1 - abs(t.x - g.c)))')} AS v FROM t JOIN g ON g.r BETWEEN CAST(floor(t.y) AS INT) AND CAST(floor(t.y) AS INT) + 1 AND g.c BETWEEN CAST(floor(t.x) AS INT) AND CAST(floor(t.x) AS INT) + 1 GROUP BY t.r, t.c HAVING count(g.v) = 4")
register("build_overview", lambda s, d: rounded(g_qty(s, d).groupBy(F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.avg("v").alias("v")), "v"), with_("g") + f"SELECT CAST(floor(r / 2.0) AS INT) AS r, CAST(floor(c / 2.0) AS INT) AS c, {r6('avg(v)')} AS v FROM g GROUP BY 1, 2")
register("tiles_for_bbox", lambda s, d: g_qty(s, d).filter("r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 17").selectExpr("CAST(floor(r / 8) AS INT) AS tr", "CAST(floor(c / 8) AS INT) AS tc").distinct(), with_("g") + "SELECT DISTINCT CAST(floor(r / 8.0) AS INT) AS tr, CAST(floor(c / 8.0) AS INT) AS tc FROM g WHERE r BETWEEN 5 AND 20 AND c BETWEEN 10 AND 17")

# coordinates over the points: 30 + 5 x degrees
LON, LAT = "(9 + 5 * x)", "(45 + 5 * y)"


def scalar(name: str, **parts: str) -> None:
    register(name, lambda s, d: points(s, d).select("id", *[F.expr(r6(t)).alias(k) for k, t in parts.items()]), with_("pts") + "SELECT id, " + ", ".join(f"{r6(t)} AS {k}" for k, t in parts.items()) + " FROM pts")


E, Nn = geo.to_utm(LON, LAT, 32)
scalar("wgs84_to_utm", easting=E, northing=Nn)
lo, la = geo.from_utm("(500000 + 100000 * x)", "(5000000 + 100000 * y)", 32)
scalar("utm_to_wgs84", lon=lo, lat=la)
w, h = geo.cell_dimensions(LAT, 0.001, 0.001)
scalar("cell_dimensions", dx=w, dy=h)
scalar("geographic_cell_sizes", dx=w, dy=h, area=f"{w} * {h}")
sv = geo.solar_vector("172", "(12 + 4 * x)", 45.0)
scalar("solar_vector", east=sv[0], north=sv[1], up=sv[2])
sn = geo.surface_normal("abs(x)", "(3 * y)")
scalar("surface_normal", east=sn[0], north=sn[1], up=sn[2])
scalar("cos_incidence_vectorial", v="greatest(0E0, " + " + ".join(f"{a} * {b}" for a, b in zip(sv, sn)) + ")")
scalar("relative_angles", v="atan2(y, x)")
scalar("geo_to_pixel", row="(y - 0.4E0) / -0.025E0", col="(x - -0.4E0) / 0.025E0")

# rings round the points
RING = lambda df, k=16: df.withColumn("ring", pt.buffer_point(F.col("x"), F.col("y"), 0.5, k))
register("buffer_points", lambda s, d: rounded(RING(points(s, d)).select("id", F.size("ring").alias("n"), pt.ring_area(F.col("ring")).alias("area")), "area"), with_("pts") + f"SELECT id, 16 AS n, round({16 * 0.25 * math.sin(2 * math.pi / 16) / 2!r}E0, 6) + 0.0E0 AS area FROM pts")
register("perimeter", lambda s, d: rounded(RING(points(s, d)).select("id", pt.line_length(F.concat("ring", F.array(F.element_at("ring", 1)))).alias("v")), "v"), with_("pts") + f"SELECT id, round({16 * math.sin(math.pi / 16)!r}E0, 6) + 0.0E0 AS v FROM pts")
register("area", lambda s, d: rounded(RING(points(s, d), 6).select("id", pt.ring_area(F.col("ring")).alias("v")), "v"), with_("pts") + f"SELECT id, round({6 * 0.25 * math.sin(math.pi / 3) / 2!r}E0, 6) + 0.0E0 AS v FROM pts")
register("length", lambda s, d: rounded(RING(points(s, d), 6).select("id", pt.line_length(F.col("ring")).alias("v")), "v"), with_("pts") + "SELECT id, 2.5E0 AS v FROM pts")
register("centroid", lambda s, d: rounded(RING(points(s, d)).select("id", pt.ring_centroid(F.col("ring"))[0].alias("cx"), pt.ring_centroid(F.col("ring"))[1].alias("cy")), "cx", "cy"), with_("pts") + f"SELECT id, {r6('x')} AS cx, {r6('y')} AS cy FROM pts")
register("bounding_box", lambda s, d: rounded(RING(points(s, d), 4).select("id", pt.bounding_box(F.col("ring")).alias("b")).select("id", "b.x0", "b.y0", "b.x1", "b.y1")), with_("pts") + f"SELECT id, {r6('x - 0.5E0')} AS x0, {r6('y - 0.5E0')} AS y0, {r6('x + 0.5E0')} AS x1, {r6('y + 0.5E0')} AS y1 FROM pts")

# interval and string helpers of the front ends, over tables
register("stac_time_series", lambda s, d: table(s, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week"), "event_type").agg(F.count("*").alias("n")), "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
register("days_in_month", lambda s, d: table(s, d, "orders").select(F.dayofmonth(F.last_day("o_orderdate")).alias("days"), F.month("o_orderdate").alias("m")).groupBy("m", "days").agg(F.count("*").alias("n")), "SELECT CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INT) AS days, CAST(month(CAST(o_orderdate AS DATE)) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
register("geojson_properties", lambda s, d: table(s, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n")), "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
