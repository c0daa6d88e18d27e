"""Queries of the cell-wise, global, zonal, classification and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import spectral as sp
from gridloom.functions.formula import to_sql
from gridloom.operators import cells, series
from gridloom.plans.recipes import cube, g_bands, g_qty, scenes, table, with_, zoned
from gridloom.plans.registry import r6, register, rounded

B = with_("bands")


def band(name: str, text: str, kind: str = "double") -> None:
    """A formula over b1..b4."""
    value = r6(text) if kind == "double" else f"CAST({text} AS {kind})"
    register(name, lambda s, d: g_bands(s, d).select("r", "c", F.expr(value).alias("v")), B + f"SELECT r, c, {value} AS v FROM bands")


ROLE = {"nir": "b1", "red": "b3", "green": "b4", "swir": "b2", "red_edge": "b3", "co_pol": "b1", "cross_pol": "b3"}
for name, (a, b) in sp.PAIRS.items():
    band(name, sp.normalized_difference(ROLE[a], ROLE[b]))
band("normalized_difference", sp.normalized_difference("b1", "b4"))
band("savi", sp.savi("b1", "b3"))
band("evi", sp.evi("b1", "b3", "b2"))
band("evi2", sp.evi2("b1", "b3"))
band("bsi", sp.bsi("b2", "b3", "b1", "b4"))
band("reci", sp.reci("b1", "b3"))
band("msavi", sp.msavi("b1", "b3"))
for op in ("add", "subtract", "multiply", "divide", "min", "max"):
    band(f"band_math_{op}", sp.band_math("b1", "b3", op))
band("band_math_power", sp.band_math("(b2 / 10)", "(b3 / 100)", "power"))
band("band_math_unary", "sqrt(b1) + 1")
band("index_builder", to_sql("(b1 - b3) / (b1 + b3) * 2 - -b2 / (b4 - b4)", ["b1", "b2", "b3", "b4"]))
band("calc_formula", to_sql("2.5 * (b1 - b3) / (b1 + 6 * b3 - 7.5 * b2 + 1)", ["b1", "b2", "b3"]))
band("dnbr", f"{sp.normalized_difference('b1', 'b2')} - {sp.normalized_difference('b4', 'b3')}")
band("burn_severity_classify", sp.burn_severity("(b2 / 60 - 0.5E0)"))
band("dn_to_toa_landsat", sp.landsat_toa("b1", 2e-5, -0.1, 35.0))
band("dn_to_surface_reflectance_landsat_c2", sp.landsat_sr("b1"))
band("dn_to_reflectance_s2", sp.s2_reflectance("b1", 10000.0, -1000.0))
band("linear_to_db", sp.linear_to_db("b1"))
band("db_to_linear", sp.db_to_linear("(b2 / 10)"))
band("sar_water_mask", sp.water_mask("b1", 1500.0), "INT")
band("reclassify", sp.reclassify("b1", [(0, 1000, 1), (1000, 1400, 2), (1400, 1600, 3), (1600, 99999, 4)]))
band("log_transform", sp.log_transform("(b1 - 1500)"))
band("change_vector_magnitude", "sqrt((b3 - b2) * (b3 - b2) + (b4 - b1) * (b4 - b1))")
band("change_vector_direction", "atan2(b4 - b1, b3 - b2)")
band("complex_magnitude", "sqrt((b2 - 60) * (b2 - 60) + (b3 - 230) * (b3 - 230))")
band("complex_phase", "atan2(b3 - 230, b2 - 60)")
band("twi", "ln((b2 + 1) / tan(greatest(b3 / 500, 0.001E0)))")
band("spi", "(b2 + 1) * tan(b3 / 500)")
band("sti", "1.4E0 * power((b2 + 1) / 22.13E0, 0.4E0) * power(sin(b3 / 500) / 0.0896E0, 1.3E0)")
band("ls_factor", "power(b2 / 22.13E0, 0.4E0) * power(sin(b3 / 500) / 0.0896E0, 1.3E0)")
band("relative_slope_position", "CASE WHEN b2 + b3 = 0 THEN 0.5E0 ELSE b2 / (b2 + b3) END")
band("stream_network", "CASE WHEN b1 >= 1500 THEN 1 ELSE 0 END", "INT")
DIFF = "(b4 / 4 - b1)"
register(
    "raster_difference",
    lambda s, d: g_bands(s, d).select("r", "c", F.expr(r6(DIFF)).alias("diff"), F.expr(sp.change_class(DIFF, -50, 50)).alias("category")),
    B + f"SELECT r, c, {r6(DIFF)} AS diff, {sp.change_class(DIFF, -50, 50)} AS category FROM bands",
)
register("complex_from_parts", lambda s, d: g_bands(s, d).select("r", "c", F.struct(F.col("b1").alias("re"), F.col("b2").alias("im")).alias("z")).select("r", "c", "z.re", "z.im"), B + "SELECT r, c, b1 AS re, b2 AS im FROM bands")
brovey = ", ".join(f"{r6(f'CASE WHEN (b1 + b2 + b3) / 3 > 0 THEN {b} * b4 / ((b1 + b2 + b3) / 3) END')} AS {b}" for b in ("b1", "b2", "b3"))
register("pansharpen_brovey", lambda s, d: rounded(cells.brovey(g_bands(s, d), "b4", ["b1", "b2", "b3"])), B + f"SELECT r, c, {brovey} FROM bands")
GS = "gs AS (SELECT avg(s) ms, stddev_pop(s) ss, avg(b4) mp, stddev_pop(b4) sp, covar_pop(s, b1) / var_pop(s) g1, covar_pop(s, b2) / var_pop(s) g2, covar_pop(s, b3) / var_pop(s) g3 FROM (SELECT *, (b1 + b2 + b3) / 3 s FROM bands))"
gs = ", ".join(f"{r6(f'b{i} + g{i} * ((b4 - mp) * ss / sp + ms - (b1 + b2 + b3) / 3)')} AS b{i}" for i in (1, 2, 3))
register("pansharpen_gram_schmidt", lambda s, d: rounded(cells.gram_schmidt(g_bands(s, d), "b4", ["b1", "b2", "b3"])), with_("bands", GS) + f"SELECT r, c, {gs} FROM bands, gs")
register("pansharpen_pca", lambda s, d: rounded(cells.pca_pansharpen(g_bands(s, d), "b4", ["b1", "b2", "b3"])))
register("pca", lambda s, d: rounded(cells.principal_components(g_bands(s, d), ["b1", "b2", "b3", "b4"], 2)[0]))
register("mad", lambda s, d: rounded(cells.mad(g_bands(s, d), ["b1", "b2"], ["b3", "b4"])[0]))
register("ir_mad", lambda s, d: rounded(cells.ir_mad(g_bands(s, d), ["b1", "b2"], ["b3", "b4"], 5)[0]))

# global statistics
G = with_("g")
register("dos1", lambda s, d: rounded(cells.dos1(g_qty(s, d), 0.01)), with_("g", "k AS (SELECT list_sort(list(v) FILTER (v IS NOT NULL))[CAST(floor(0.01E0 * (count(v) - 1) + 0.5E0) AS INT) + 1] x FROM g)") + f"SELECT r, c, {r6('CASE WHEN v IS NULL THEN NULL ELSE greatest(v - x, 0E0) END')} AS v FROM g, k")
register(
    "histogram_match",
    lambda s, d: rounded(cells.histogram_match(g_qty(s, d), g_bands(s, d).select("r", "c", F.col("b4").alias("v")))),
    with_("g", "bands", "f AS (SELECT list_sort(list(b4)) a, count(*) m FROM bands)", "k AS (SELECT *, (rank() OVER (ORDER BY v) - 1) / greatest(count(*) OVER () - 1, 1) p FROM g WHERE v IS NOT NULL)", "p AS (SELECT r, c, a, m, p * (m - 1) x FROM k, f)")
    + f"SELECT r, c, {r6('a[CAST(floor(x) AS INT) + 1] * (1 - (x - floor(x))) + a[CAST(least(floor(x) + 1, m - 1) AS INT) + 1] * (x - floor(x))')} AS v FROM g LEFT JOIN p USING (r, c)",
)
register(
    "moment_match",
    lambda s, d: rounded(cells.moment_match(g_qty(s, d), g_bands(s, d).select("r", "c", F.col("b4").alias("v")))),
    with_("g", "bands", "a AS (SELECT avg(v) m1, stddev_pop(v) s1 FROM g)", "b AS (SELECT avg(b4) m2, stddev_pop(b4) s2 FROM bands)") + f"SELECT r, c, {r6('(v - m1) * (s2 / s1) + m2')} AS v FROM g, a, b",
)
register("elev_relative_to_min_max", lambda s, d: rounded(cells.with_global(g_qty(s, d), lo=F.min("v"), hi=F.max("v")).selectExpr("r", "c", "(v - lo) / (hi - lo) AS v")), with_("g", "k AS (SELECT min(v) lo, max(v) hi FROM g)") + f"SELECT r, c, {r6('(v - lo) / (hi - lo)')} AS v FROM g, k")
register("colormap_range", lambda s, d: g_qty(s, d).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), G + "SELECT min(v) AS lo, max(v) AS hi FROM g")

# zones
ZS = with_("g", "gz", "zz AS (SELECT * FROM gz WHERE zone <> 0 AND v IS NOT NULL)")
MODE = "mo AS (SELECT zone, min_by(v, (-k, v)) majority, min_by(v, (k, v)) minority FROM (SELECT zone, v, count(*) k FROM zz GROUP BY zone, v) GROUP BY zone)"
STATS = "count(*) AS count, sum(v) AS sum, {m} AS mean, {s} AS std_dev, min(v) AS min, max(v) AS max, max(v) - min(v) AS range, median(v) AS median, count(DISTINCT v) AS variety".format(m=r6("avg(v)"), s=r6("stddev_pop(v)"))
MODE = "mo AS (SELECT zone, max(CASE WHEN hi = 1 THEN v END) majority, max(CASE WHEN lo = 1 THEN v END) minority FROM (SELECT zone, v, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, v) hi, row_number() OVER (PARTITION BY zone ORDER BY count(*), v) lo FROM zz GROUP BY zone, v) GROUP BY zone)"
register("zonal_statistics", lambda s, d: rounded(cells.zonal(zoned(g_qty(s, d))), "mean", "std_dev"), ZS[:-1] + f", {MODE}, st AS (SELECT zone, {STATS} FROM zz GROUP BY zone) SELECT * FROM st JOIN mo USING (zone)")
for stat, agg in (("mean", "avg(v)"), ("max", "max(v)"), ("sum", "sum(v)"), ("std_dev", "stddev_pop(v)")):
    register(f"zonal_raster_{stat}", lambda s, d, stat=stat: rounded(cells.zonal_raster(zoned(g_qty(s, d)), stat)), ZS[:-1] + f", st AS (SELECT zone, {agg} x FROM zz GROUP BY zone) SELECT gz.r, gz.c, {r6('x')} AS v FROM gz LEFT JOIN st USING (zone)")
register("hypsometric_integral", lambda s, d: rounded(zoned(g_qty(s, d)).filter("zone > 0 AND v IS NOT NULL").groupBy("zone").agg(F.expr("CASE WHEN max(v) - min(v) < 1e-10 THEN 0.5D ELSE (avg(v) - min(v)) / (max(v) - min(v)) END").alias("hi"))), ZS + f"SELECT zone, {r6('CASE WHEN max(v) - min(v) < 1e-10 THEN 0.5E0 ELSE (avg(v) - min(v)) / (max(v) - min(v)) END')} AS hi FROM zz GROUP BY zone")
register("melton_ruggedness", lambda s, d: rounded(zoned(g_qty(s, d)).filter("zone > 0 AND v IS NOT NULL").groupBy("zone").agg(F.count("*").alias("n"), F.expr("(max(v) - min(v)) / sqrt(count(*) * 900D)").alias("melton"))), ZS + f"SELECT zone, count(*) AS n, {r6('(max(v) - min(v)) / sqrt(count(*) * 900E0)')} AS melton FROM zz GROUP BY zone")
register(
    "zonal_join_region",
    lambda s, d: rounded(cells.zonal(
        table(s, d, "lineitem").join(table(s, d, "supplier"), F.expr("l_suppkey = s_suppkey")).join(F.broadcast(table(s, d, "nation")), F.expr("s_nationkey = n_nationkey"))
        .select(F.col("n_regionkey").cast("int").alias("zone"), F.col("l_quantity").cast("double").alias("v"))
    ).select("zone", "count", "sum", "mean", "std_dev", "min", "max"), "mean", "std_dev"),
    f"SELECT CAST(n_regionkey AS INT) AS zone, count(*) AS count, sum(CAST(l_quantity AS DOUBLE)) AS sum, {r6('avg(CAST(l_quantity AS DOUBLE))')} AS mean, {r6('stddev_pop(CAST(l_quantity AS DOUBLE))')} AS std_dev, min(CAST(l_quantity AS DOUBLE)) AS min, max(CAST(l_quantity AS DOUBLE)) AS max FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY 1",
)
MORAN = """dv AS (SELECT r, c, v - (SELECT avg(v) FROM g) d FROM g WHERE v IS NOT NULL),
nb AS (SELECT a.r, a.c, a.d, count(b.d) k, sum(b.d) s FROM dv a LEFT JOIN dv b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY 1, 2, 3),
t AS (SELECT CAST(count(*) AS DOUBLE) n, CAST(sum(k) AS DOUBLE) w, sum(d * s) top, sum(d * d) m2, sum(d * d * d * d) m4, sum(4.0E0 * k * k) s2 FROM nb),
u AS (SELECT *, (n / w) * (top / m2) i, -1 / (n - 1) e, 2 * w s1, (m4 / n) / ((m2 / n) * (m2 / n)) b2 FROM t),
q AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - e * e va FROM u),
z AS (SELECT i, e, (i - e) / sqrt(CASE WHEN va > 0 THEN va ELSE 1 / ((n - 1) * (n - 1)) END) z FROM q)"""
register("global_morans_i", lambda s, d: rounded(cells.morans_i(g_qty(s, d))), with_("g", MORAN) + f"SELECT {r6('i')} AS i, {r6('e')} AS expected, {r6('z')} AS z_score, {r6(sp.two_sided_p('z'))} AS p_value FROM z")
GETIS = "gg AS (SELECT avg(v) gm, stddev_pop(v) gs, CAST(count(v) AS DOUBLE) gn FROM g), w AS (SELECT a.r, a.c, a.v, count(b.v) n, sum(b.v) s FROM g a JOIN g b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2, 3), z AS (SELECT r, c, CASE WHEN v IS NULL THEN NULL ELSE (s - gm * n) / (gs * sqrt((gn * n - n * n) / (gn - 1))) END z FROM w, gg)"
register("local_getis_ord", lambda s, d: rounded(cells.getis_ord(g_qty(s, d), 2)), with_("g", GETIS) + f"SELECT r, c, {r6('z')} AS z, {r6(sp.two_sided_p('z'))} AS p FROM z")

# classification
SIG = "sg AS (SELECT CAST(zone AS DOUBLE) AS label, avg(v) AS mean, greatest(stddev_samp(v), 1e-10) AS std_dev, count(*) AS n FROM gz WHERE v IS NOT NULL GROUP BY zone HAVING count(*) >= 2)"
sig = lambda s, d: cells.signatures(zoned(g_qty(s, d)).select(F.col("zone").cast("double").alias("label"), "v"))
register("signatures_from_training", lambda s, d: rounded(sig(s, d)), with_("g", "gz", SIG) + f"SELECT label, {r6('mean')} AS mean, {r6('std_dev')} AS std_dev, n FROM sg")
pick = lambda f: f"SELECT r, c, label AS v FROM (SELECT r, c, label, row_number() OVER (PARTITION BY r, c ORDER BY {f}, label) k FROM g, sg WHERE v IS NOT NULL) WHERE k = 1"
register("classify_minimum_distance", lambda s, d: cells.minimum_distance(g_qty(s, d), sig(s, d)).filter("v IS NOT NULL"), with_("g", "gz", SIG) + pick("abs(v - mean)"))
register("classify_maximum_likelihood", lambda s, d: cells.maximum_likelihood(g_qty(s, d), sig(s, d)).filter("v IS NOT NULL"), with_("g", "gz", SIG) + pick("ln(std_dev) + (v - mean) * (v - mean) / (2 * std_dev * std_dev)"))
register("kmeans_raster", lambda s, d: cells.kmeans(g_qty(s, d), 5))
register("isodata", lambda s, d: cells.isodata(g_qty(s, d), max_std=100.0, min_merge=50.0))

# masks
register("cloud_mask_scl", lambda s, d: scenes(s, d).filter((F.col("qa") % 12).isin(4, 5, 6, 7)).select("scene", "r", "c", "v"), with_("scenes") + "SELECT scene, r, c, v FROM scenes WHERE qa % 12 IN (4, 5, 6, 7)")
register("cloud_mask_qa_pixel", lambda s, d: scenes(s, d).filter(F.expr(sp.excluded_bits("qa", 27))).select("scene", "r", "c", "v"), with_("scenes") + "SELECT scene, r, c, v FROM scenes WHERE (qa & 27) = 0")
register("cloud_mask_hls_fmask", lambda s, d: scenes(s, d).select("scene", "r", "c", F.expr(f"CASE WHEN {sp.excluded_bits('qa', 14)} THEN v END").alias("v")), with_("scenes") + "SELECT scene, r, c, CASE WHEN (qa & 14) = 0 THEN v END AS v FROM scenes")

# series
C = with_("cube")
one = {"mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)", "count": "count(v)", "p90": "quantile_cont(v, 0.9)"}
for name, agg in one.items():
    fn = lambda s, d, n=name: rounded(series.statistics(cube(s, d), 90).select("r", "c", F.col(n).alias("v")))
    register(f"temporal_{'percentile' if name == 'p90' else name}", fn, C + f"SELECT r, c, {agg if name == 'count' else r6(agg)} AS v FROM cube GROUP BY r, c")
register("temporal_stats", lambda s, d: rounded(series.statistics(cube(s, d), 25, 75)), C + f"SELECT r, c, count(v) AS count, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std, {r6('min(v)')} AS min, {r6('max(v)')} AS max, {r6('quantile_cont(v, 0.25)')} AS p25, {r6('quantile_cont(v, 0.75)')} AS p75 FROM cube GROUP BY r, c")
register("reduce_temporal", lambda s, d: rounded(cube(s, d).groupBy("r", "c").agg(F.avg("v").alias("v"), F.count("v").alias("n")).filter("n >= 20").select("r", "c", "v")), C + f"SELECT r, c, {r6('avg(v)')} AS v FROM cube GROUP BY r, c HAVING count(v) >= 20")
REF = "rf AS (SELECT r, c, avg(v) m, stddev_samp(v) s FROM cube WHERE t <= 15 GROUP BY r, c)"
for method, text in (("zscore", "CASE WHEN s > 1e-10 THEN (v - m) / s END"), ("difference", "v - m"), ("percent", "CASE WHEN abs(m) > 1e-10 THEN (v - m) / m * 100 END")):
    register(f"temporal_anomaly_{method}", lambda s, d, m=method: rounded(series.anomaly(cube(s, d).filter("t <= 15"), cube(s, d).filter("t > 15"), m), "v"), with_("cube", REF) + f"SELECT r, c, t, {r6(text)} AS v FROM (SELECT * FROM cube WHERE t > 15) LEFT JOIN rf USING (r, c)")
register("linear_trend", lambda s, d: rounded(series.linear_trend(cube(s, d)).drop("p_value")), C + f"SELECT r, c, {r6('regr_slope(v, t)')} AS slope, {r6('regr_intercept(v, t)')} AS intercept, {r6('CASE WHEN regr_syy(v, t) > 1e-30 THEN regr_r2(v, t) ELSE 0E0 END')} AS r_squared FROM cube GROUP BY r, c HAVING count(v) >= 3 AND regr_sxx(v, t) >= 1e-30")
register("linear_trend_p_value", lambda s, d: rounded(series.linear_trend(cube(s, d)).select("r", "c", "p_value")))
PAIR = "pr AS (SELECT a.r, a.c, b.v - a.v dy, b.t - a.t dt FROM cube a JOIN cube b ON a.r = b.r AND a.c = b.c AND b.t > a.t)"
register("sens_slope", lambda s, d: rounded(series.sens_slope(cube(s, d))), with_("cube", PAIR) + f"SELECT r, c, {r6('median(dy / dt)')} AS v FROM pr GROUP BY r, c")
MK = """n AS (SELECT r, c, CAST(count(*) AS DOUBLE) n FROM cube GROUP BY r, c HAVING count(*) >= 3),
ti AS (SELECT r, c, sum(k * (k - 1) / 2) n1, sum(k * (k - 1) * (2 * k + 5)) tc FROM (SELECT r, c, v, CAST(count(*) AS DOUBLE) k FROM cube GROUP BY r, c, v) GROUP BY r, c),
sg AS (SELECT r, c, CAST(sum(sign(dy)) AS DOUBLE) s, median(dy / dt) ss FROM pr GROUP BY r, c),
m AS (SELECT r, c, s, ss, (n * (n - 1) / 2 - n1) * (n * (n - 1) / 2) d, (n * (n - 1) * (2 * n + 5) - tc) / 18 va FROM n JOIN ti USING (r, c) JOIN sg USING (r, c)),
y AS (SELECT r, c, s, ss, CASE WHEN d > 0 THEN s / sqrt(d) END tau, CASE WHEN va > 0 THEN (s - sign(s)) / sqrt(va) END z FROM m)"""
P = sp.two_sided_p("z")
register("mann_kendall", lambda s, d: rounded(series.mann_kendall(cube(s, d))), with_("cube", PAIR, MK) + f"SELECT r, c, {r6('s')} AS s, {r6('tau')} AS tau, {r6(P)} AS p_value, {r6(f'CASE WHEN {P} < 0.05E0 THEN CAST(sign(s) AS DOUBLE) WHEN z IS NOT NULL THEN 0E0 END')} AS trend, {r6('ss')} AS sens_slope FROM y")
register("vegetation_phenology", lambda s, d: rounded(series.phenology(cube(s, d))))
S = with_("scenes")
register("median_composite", lambda s, d: rounded(series.median_composite(scenes(s, d))), S + f"SELECT r, c, {r6('median(v)')} AS v FROM scenes GROUP BY r, c")
register("coverage_order", lambda s, d: series.coverage_order(scenes(s, d)), S + "SELECT scene, count(v) AS n FROM scenes GROUP BY scene")
register("fill_from_scenes_by_coverage", lambda s, d: series.fill_by_coverage(scenes(s, d).filter("scene = 'view'").groupBy("r", "c").agg(F.max(F.when(F.col("v") > 30, F.col("v"))).alias("v")), scenes(s, d)),
    with_("scenes", "o AS (SELECT scene, count(v) n FROM scenes GROUP BY scene)", "b AS (SELECT r, c, v f FROM (SELECT r, c, v, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, scene) k FROM scenes JOIN o USING (scene) WHERE v IS NOT NULL) WHERE k = 1)", "h AS (SELECT r, c, max(CASE WHEN v > 30 THEN v END) v FROM scenes WHERE scene = 'view' GROUP BY r, c)") + "SELECT r, c, coalesce(v, f) AS v FROM h LEFT JOIN b USING (r, c)")
register("select_dates_by_coverage", lambda s, d: cube(s, d).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(5), C + "SELECT t, count(*) AS n FROM cube GROUP BY t ORDER BY n DESC, t LIMIT 5")
register("mosaic", lambda s, d: scenes(s, d).filter("v IS NOT NULL").groupBy("r", "c").agg(F.max_by("v", "scene").alias("v")), S + "SELECT r, c, max_by(v, scene) AS v FROM scenes WHERE v IS NOT NULL GROUP BY r, c")
register("interval_composite", lambda s, d: rounded(cube(s, d).groupBy(F.floor((F.col("t") - 1) / 7).cast("int").alias("week"), "r", "c").agg(F.median("v").alias("v"))), C + f"SELECT CAST(floor((t - 1) / 7) AS INT) AS week, r, c, {r6('median(v)')} AS v FROM cube GROUP BY 1, 2, 3")
register("temporal_change", lambda s, d: cube(s, d).filter("t = 1").select("r", "c", F.col("v").alias("a")).join(cube(s, d).filter("t = 30").select("r", "c", F.col("v").alias("b")), ["r", "c"]).selectExpr("r", "c", "b - a AS v"), C + "SELECT a.r, a.c, b.v - a.v AS v FROM cube a JOIN cube b ON a.r = b.r AND a.c = b.c AND a.t = 1 AND b.t = 30")
