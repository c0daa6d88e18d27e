"""Analytic grids, borders, gaps and ties; parity of the forms of one operator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions import surface as sf
from gridloom.functions.formula import FormulaError, to_sql
from gridloom.operators import cells, focal, graph, points, series, windows
from gridloom.operators import kernels as kn
from gridloom.sources import grids, vector
from gridloom.streaming.composites import composite


def grid(spark, a):
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, v double")


def array(df, shape, col="v"):
    out = np.full(shape, np.nan)
    for x in df.collect():
        if x[col] is not None:
            out[x["r"], x["c"]] = x[col]
    return out


RNG = np.random.default_rng(1)
ROUGH = RNG.integers(0, 50, (9, 11)).astype(float)
HOLED = ROUGH.copy()
HOLED[4, 5] = np.nan


def test_plane_has_its_slope_and_aspect(spark):
    r, c = np.mgrid[0:6, 0:6].astype(float)
    east = grid(spark, -c)  # falls towards the east
    s, a = array(focal.apply(east, sf.slope()), (6, 6)), array(focal.apply(east, sf.aspect()), (6, 6))
    assert np.allclose(s[1:-1, 1:-1], 45) and np.allclose(a[1:-1, 1:-1], 90)
    assert np.isnan(s[0]).all() and np.isnan(s[:, -1]).all()
    south = array(focal.apply(grid(spark, -r), sf.aspect("compass")), (6, 6))
    assert (south[1:-1, 1:-1] == 5).all()
    flat = grid(spark, np.ones((5, 5)))
    assert np.isnan(array(focal.apply(flat, sf.aspect()), (5, 5))).all()
    assert (array(focal.apply(flat, sf.hillshade()), (5, 5))[1:-1, 1:-1] == round(255 * math.cos(math.radians(45)))).all()


def test_a_gap_nulls_its_neighbours(spark):
    s = array(focal.apply(grid(spark, HOLED), sf.slope()), HOLED.shape)
    assert np.isnan(s[3:6, 4:7]).all() and not np.isnan(s[1, 1])


@pytest.mark.parametrize("stat", ["mean", "stddev", "min", "max", "range", "sum", "count", "median", "percentile", "majority"])
def test_focal_statistics_are_brute_force(spark, stat):
    got = array(focal.statistic(grid(spark, HOLED), 2, stat, p=90), HOLED.shape)
    for (r, c), v in np.ndenumerate(got):
        w = HOLED[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].ravel()
        w = np.sort(w[~np.isnan(w)])
        values, n = np.unique(w, return_counts=True)
        want = {
            "mean": w.mean(), "stddev": w.std(), "min": w.min(), "max": w.max(), "range": np.ptp(w), "sum": w.sum(), "count": len(w), "median": np.median(w),
            "percentile": w[math.floor(0.9 * (len(w) - 1) + 0.5)], "majority": values[n.argmax()],
        }[stat]
        assert math.isclose(v, want, abs_tol=1e-6)


def test_circle_is_smaller_than_square(spark):
    g = grid(spark, ROUGH)
    assert array(focal.statistic(g, 2, "count", True), ROUGH.shape)[4, 5] == 13
    assert array(focal.statistic(g, 2, "count"), ROUGH.shape)[4, 5] == 25
    with pytest.raises(ValueError):
        focal.statistic(g, 0, "mean")


def test_morphology_duals(spark):
    g = grid(spark, ROUGH)
    e = array(windows.erode(g), ROUGH.shape)
    d = array(windows.dilate(g.withColumn("v", -F.col("v"))), ROUGH.shape)
    assert np.array_equal(e, -d, equal_nan=True) and np.isnan(e[0]).all()
    assert np.nanmin(array(windows.top_hat(g), ROUGH.shape)) >= 0
    assert np.array_equal(array(windows.erode(g, 1, "disk"), ROUGH.shape), array(windows.erode(g, 1, "cross"), ROUGH.shape), equal_nan=True)


def test_formulas():
    assert "CASE WHEN" in to_sql("(a - b) / (a + b)", ["a", "b"])
    for bad in ("a +", "a b", "(a", "a ^ 2", "q", "a )"):
        with pytest.raises(FormulaError):
            to_sql(bad, ["a", "b"])


def test_ranks_over_bins(spark):
    v = RNG.integers(0, 20, 500).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for bins in (1, 7, 64):
        ranks = cells.value_ranks(df, bins=bins).collect()
        assert len(ranks) == len(set(v.tolist()))
        assert all(r["below"] == (v < r["v"]).sum() and r["n"] == (v == r["v"]).sum() for r in ranks)
    assert cells.nearest_rank(df, 0.25).first()["x"] == np.sort(v)[math.floor(499 * 0.25 + 0.5)]


def test_zones_ignore_zero_and_break_ties_low(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, 1.0), (1, None), (0, 9.0), (2, 5.0)], "zone int, v double")
    got = {r["zone"]: r for r in cells.zonal(df).collect()}
    assert set(got) == {1, 2} and got[1]["majority"] == 1.0 and got[1]["count"] == 4 and got[2]["std_dev"] == 0


def test_trends(spark):
    rows = [(0, 0, float(t), 2.0 * t + 1) for t in range(6)] + [(0, 1, float(t), float(v)) for t, v in enumerate([3, 1, 4, 1, 5, 9])] + [(0, 2, 0.0, 1.0)]
    cube = spark.createDataFrame(rows, "r int, c int, t double, v double")
    got = {r["c"]: r for r in series.linear_trend(cube).collect()}
    assert set(got) == {0, 1} and math.isclose(got[0]["slope"], 2) and got[0]["p_value"] == 0
    assert math.isclose(got[1]["p_value"], 0.1244, abs_tol=1e-3)
    mk = {r["c"]: r for r in series.mann_kendall(cube).collect()}
    assert mk[0]["s"] == 15 and mk[0]["trend"] == 1 and mk[0]["sens_slope"] == 2 and mk[1]["s"] == 8


def test_drainage_parity(spark):
    z = np.add.outer(np.arange(8.0) * 3, np.arange(7.0)) + RNG.random((8, 7))
    d = kn.d8(z, False)
    df = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(d)], "r int, c int, d int")
    assert np.array_equal(array(graph.flow_accumulation(df), d.shape), kn.d8_accumulation(d))
    assert np.nanmax(array(graph.flow_path_length(df), d.shape)) > 7
    assert array(graph.watershed(df).withColumnRenamed("basin", "v"), d.shape)[0, 0] == 1


def test_fill_and_flats():
    z = np.ones((7, 7)) * 5
    z[1:6, 1:6] = 2
    z[3, 3] = 1
    z[3, 0] = 3
    f = kn.priority_flood(z)
    assert (f[1:6, 1:6] == 3).all() and f[0, 0] == 5
    assert np.allclose(kn.fill_sinks(z, 0.0), f)
    d = kn.d8(f)
    assert (d[1:6, 1:6] > 0).all()
    to = kn.receivers(d)
    assert len(kn.downstream_order(to)) == to.size  # no cycles


def test_regions_are_the_kernel_s(spark):
    a = RNG.integers(0, 3, (10, 10)).astype(float)
    a[2, 2] = np.nan
    got = array(graph.patches(grid(spark, a)).withColumnRenamed("v", "k").withColumnRenamed("label", "v"), a.shape)
    assert np.array_equal(np.nan_to_num(got), kn.label(a)[0])


def test_views_and_texture():
    z = np.zeros((9, 9))
    z[4, 6] = 10
    v = kn.viewshed(z, 4, 4)
    assert v[4, 8] == 0 and v[4, 5] == 1 and v[0, 0] == 1
    assert kn.sky_view(np.zeros((9, 9)), 3).min() == 1
    assert np.nanmax(kn.glcm(np.ones((6, 6)), 2)) == 0
    a = np.zeros((8, 8))
    a[:, 4:] = 10
    assert len(np.unique(kn.felzenszwalb(a, 1.0, 2))) == 2


def test_utm_round_trip(spark):
    e, n = geo.to_utm("lon", "lat", 33)
    df = spark.createDataFrame([(15.0, 45.0), (13.2, 50.7)], "lon double, lat double").selectExpr("lon", "lat", f"{e} AS e", f"{n} AS n")
    lo, la = geo.from_utm("e", "n", 33)
    for r in df.selectExpr("*", f"{lo} AS lon2", f"{la} AS lat2").collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-7 and abs(r["lat"] - r["lat2"]) < 1e-7
    assert abs(df.first()["e"] - 500000) < 1e-6 and geo.utm_zone(32633) == (33, True) and geo.utm_zone(4326) is None


def test_points(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5, 10.0), (2, 2.5, 0.5, 20.0)], "id long, x double, y double, value double")
    g = points.cells(spark, 1, 3, 0.0, 1.0, 1.0, -1.0)
    assert [r["v"] for r in points.nearest(g, p, 3.0).orderBy("c").collect()] == [10.0, 10.0, 20.0]
    assert [r["v"] for r in points.idw(g, p, 3.0).orderBy("c").collect()] == [10.0, 15.0, 20.0]
    k = points.kriging(g, p, 5.0, ("exponential", 0.0, 1.0, 3.0)).orderBy("c").collect()
    assert k[0]["v"] == 10.0 and math.isclose(k[1]["v"], 15.0, abs_tol=1e-9)
    assert sorted(points.clip_ring([(0, 0), (4, 0), (4, 4), (0, 4)], 1, 1, 2, 9)) == [(1, 1), (1, 4), (2, 1), (2, 4)]
    assert points.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"p","geometry":{"type":"Point","coordinates":[1.5,2]},"properties":{"k":"3"}}]}')
    row = vector.points_of(vector.read_geojson(spark, str(tmp_path / "a.geojson"))).first()
    assert (row["x"], row["y"], row["props"]["k"]) == (1.5, 2.0, "3")
    g = grid(spark, ROUGH)
    grids.write_grid(g, str(tmp_path / "g"), 4)
    assert grids.read_window(spark, str(tmp_path / "g"), 2, 5, 3, 6, 4).count() == 16


def test_stream_is_the_batch(spark, tmp_path):
    spark.range(200).selectExpr("timestamp_seconds(1704067200 + id * 7200) AS ts", "id % 20 AS user_id", "CAST(id AS DOUBLE) AS value").write.parquet(str(tmp_path / "e"))
    table = spark.read.parquet(str(tmp_path / "e"))
    q = composite(spark.readStream.schema(table.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, composite(table).collect()))


def test_spline_query_takes_all_points(spark):
    from gridloom.operators import points as pt
    from gridloom.plans import queries_points as q
    from gridloom.plans.recipes import points as table_points
    from gridloom.plans.registry import QUERIES

    d = "/root/testdata/sf0.01"
    rows = sorted(table_points(spark, d).collect(), key=lambda x: x.id)
    assert len(rows) > 200
    whole = spark.createDataFrame(rows)
    want = {(x.r, x.c): x.v for x in pt.thin_plate(q.cells(spark), whole, 1e-3).collect()}
    got = {(x.r, x.c): x.v for x in QUERIES["tps_interpolation"](spark, d).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in want)


def terrain(n=40, m=37, seed=5, gaps=True):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 30, (n, m)) + 40 * np.sin(np.arange(n) / 6)[:, None] + 2 * np.arange(m)
    if gaps:
        z[11, 9], z[20:23, 30] = np.nan, np.nan
    return np.round(z, 3)


def test_tiles_with_halo_are_the_whole_grid(spark):
    from gridloom.plans import queries_more  # noqa: F401  it adds to the kernels
    from gridloom.plans.queries_graph import KERNELS

    z = terrain()
    df = grid(spark, z).cache()
    seen = 0
    for name, (kernel, out, halo) in sorted(KERNELS.items()):
        if halo is None:
            continue
        seen += 1
        whole = kernel(z)
        whole = whole if isinstance(whole, dict) else {next(iter(out)): whole}
        got = kn.run(df, kernel, out, halo=halo, tile=13).toPandas()
        assert len(got) == z.size, name
        for k, t in out.items():
            want = np.asarray(whole[k], float)[got["r"], got["c"]]
            want = np.nan_to_num(want).astype(int) if t == "int" else np.where(np.isfinite(want), want, np.nan)
            np.testing.assert_allclose(got[k].to_numpy(float), want, atol=1e-8, err_msg=name)
    assert seen > 25


@pytest.mark.parametrize("gaps", [False, True])
def test_tiled_flood_is_the_whole_flood(spark, gaps):
    z = terrain(41, 50, 8, gaps)
    for tile in (7, 16, 64):
        np.testing.assert_array_equal(array(kn.flooded(grid(spark, z), tile), z.shape), kn.priority_flood(z))
    assert kn.flooded(grid(spark, z).limit(0), 8).count() == 0


def test_textures_over_tiles(spark):
    z = terrain(30, 30, 2, False)
    limits = (z.min(), z.max())
    for feature in ("contrast", "entropy", "correlation"):
        got = kn.run(grid(spark, z), lambda a, f=feature: kn.glcm(a, 2, 16, f, limits), {"v": "double"}, halo=4, tile=11)
        np.testing.assert_allclose(array(got, z.shape), kn.glcm(z, 2, 16, feature), atol=1e-9)


def test_zone_medians_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, float(rng.integers(0, 40)) if i % 5 else 3.0, int(rng.integers(1, 6))) for i in range(700)]
    got = {r["zone"]: (r["median"], r["variety"]) for r in cells.zonal(spark.createDataFrame(rows, "r int, c int, v double, zone int")).collect()}
    for zone in range(1, 6):
        v = [x for _, _, x, z in rows if z == zone]
        assert got[zone] == (np.median(v), len(set(v)))


def test_cones_against_all_pairs(spark):
    from gridloom.operators import fluvial

    z = terrain(25, 37, 3)
    spots = [(2, 3), (20, 25), (12, 12)]
    got = array(fluvial.energy_cone(grid(spark, z), spark.createDataFrame(spots, "r int, c int"), 30.0, 20.0), z.shape)
    r, c = np.indices(z.shape)
    top = np.max([z[a, b] + 20 - np.tan(np.radians(30)) * np.hypot(r - a, c - b) for a, b in spots], 0)
    np.testing.assert_allclose(got, np.where(np.isnan(z), np.nan, np.maximum(top - z, 0)), atol=1e-9)


def test_exact_sweep_is_the_rays():
    from gridloom.operators import sight

    for seed, gaps in ((1, False), (2, False), (3, True)):
        z = terrain(24, 34, seed, gaps) if gaps else terrain(21, 26, seed, False)
        for spot in ((0, 0), (10, 12), (20, 25), (5, 0)):
            for target in (0.0, 15.0):
                got, want = sight.pderl(z, *spot, 10.0, target), sight.exact_by_rays(z, *spot, 10.0, target)
                if gaps:  # behind a gap the broken line has a hole, where rays see the whole cell beside it
                    assert np.nanmean(got == want) > 0.97
                else:
                    np.testing.assert_array_equal(got, want)


def test_interpolated_sweep():
    from gridloom.operators import sight

    assert (sight.xdraw(np.zeros((9, 11)), 4, 5) == 1).all()
    wall = np.zeros((9, 11))
    wall[:, 7] = 50
    seen = sight.xdraw(wall, 4, 3, 2.0)
    assert (seen[:, :8] == 1).all() and (seen[:, 8:] == 0).all()
    r, c = np.indices((30, 30))
    hills = 20 * np.sin(r / 5) + 20 * np.cos(c / 6)
    assert (sight.xdraw(hills, 15, 15, 5.0) == sight.pderl(hills, 15, 15, 5.0)).mean() > 0.93


def test_facet_flow_on_planes():
    r, c = np.indices((9, 12)).astype(float)
    np.testing.assert_allclose(kn.facet_accumulation(100 - c), c, atol=1e-9)
    np.testing.assert_allclose(kn.facet_accumulation(100 - r - c)[1:-1, 1:-1], np.minimum(r, c)[1:-1, 1:-1], atol=1e-9)
    z = terrain(20, 20, 4, False)
    acc = kn.facet_accumulation(kn.priority_flood(z, 1e-3))
    assert acc.min() >= 0 and acc.max() < z.size


def test_sibson_reproduces_planes_and_uses_neighbours_only():
    rng = np.random.default_rng(2)
    p = rng.uniform(-1, 1, (40, 2))
    plane = 3 * p[:, 0] - 2 * p[:, 1] + 1
    for x, y in rng.uniform(-0.4, 0.4, (20, 2)):
        w = points.sibson(x, y, p)
        assert abs(w @ plane / w.sum() - (3 * x - 2 * y + 1)) < 1e-9 and (w >= 0).all() and 3 <= (w > 0).sum() < 14


def test_triangles_have_empty_circles_and_interpolate_planes(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0, 10, (60, 2)), 3)
    t = points.delaunay(p)
    for a, b, c in p[t]:
        m = 2 * np.array([b - a, c - a])
        mid = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        assert (np.hypot(*(p - mid).T) >= np.hypot(*(a - mid)) - 1e-7).all()
    table = spark.createDataFrame([(i, float(x), float(y), float(2 * x - y)) for i, (x, y) in enumerate(p)], "id long, x double, y double, value double")
    spots = spark.createDataFrame([(r, c, 0.5 + c, 0.5 + r) for r in range(10) for c in range(10)], "r int, c int, x double, y double")
    whole = points.tin(spots, table, 20.0).toPandas()
    ok = whole.dropna()
    assert len(ok) > 60 and np.allclose(ok["v"], 2 * (0.5 + ok["c"]) - (0.5 + ok["r"]))
    noisy = table.withColumn("value", F.sin("value"))
    a, b = (points.tin(spots, noisy, r).toPandas().sort_values(["r", "c"])["v"].to_numpy() for r in (20.0, 6.0))
    inner = ~np.isnan(a)
    assert np.mean(np.isclose(a[inner], b[inner])) > 0.9
    natural = points.natural_neighbours(spots.filter("r between 3 and 6 and c between 3 and 6"), table, 6.0, 30).toPandas()
    assert np.allclose(natural["v"], 2 * (0.5 + natural["c"]) - (0.5 + natural["r"]), atol=1e-6)


def test_directions_of_filled_surfaces_have_no_circles(spark):
    for seed in range(6):
        z = np.round(terrain(30, 28, seed, False) / 15)  # wide flats
        f = kn.priority_flood(z)
        d = kn.d8(f)
        assert len(kn.downstream_order(kn.receivers(d))) == z.size
    with pytest.raises(ValueError, match="circle"):
        graph.accumulate(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0)], "id long, to long, len double"))


def test_colours_and_images(spark):
    import struct
    import zlib

    from gridloom.sources import png

    z = grid(spark, np.array([[0.0, 1.0], [np.nan, 0.5]]))
    got = {(r.r, r.c): (r.red, r.green, r.blue, r.opacity) for r in png.coloured(z, "terrain").collect()}
    assert got == {(0, 0): (34, 139, 34, 255), (0, 1): (255, 255, 255, 255), (1, 0): (0, 0, 0, 0), (1, 1): (220, 200, 80, 255)}
    (image,) = png.images(png.coloured(z, "grayscale")).collect()
    data = bytes(image.content)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 2)
    (size,) = struct.unpack(">I", data[33:37])
    rows = zlib.decompress(data[41 : 41 + size])
    assert rows == bytes([0, 0, 0, 0, 255, 255, 255, 255, 255, 0, 0, 0, 0, 0, 128, 128, 128, 255])


def test_triangles_of_many_points_are_those_of_all(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(0, 1, (700, 2)), rng.uniform(-9, 9, (40, 2))])
    v = rng.normal(0, 1, len(p))
    table = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(p, v))], "id long, x double, y double, value double")
    spots = points.cells(spark, 12, 12, -9.0, 9.0, 1.5, -1.5)
    want = np.full((12, 12), np.nan)
    for t in points.delaunay(p):
        for r in range(12):
            for c in range(12):
                w = points._parts(p[t][None], np.array([-8.25 + 1.5 * c, 8.25 - 1.5 * r]))[0]
                if w.min() >= 0:
                    want[r, c] = w @ v[t]
    for radius in (0.5, 4.0):  # squares of four radii, less than the circles of the outer triangles
        np.testing.assert_allclose(array(points.tin(spots, table, radius), (12, 12)), want, atol=1e-9)
    lattice = spark.createDataFrame([(8 * i + j, float(i), float(j), float((i * 7 + j * 3) % 5)) for i in range(8) for j in range(8)], "id long, x double, y double, value double")
    inner = points.cells(spark, 14, 14, 0.0, 7.0, 0.5, -0.5)
    got = points.tin(inner, lattice, 2.0).toPandas()
    assert len(got) == 196 and got["v"].notna().all()
    assert points.tin(inner, lattice.filter("x = 1"), 2.0).filter("v is not null").count() == 0


@pytest.mark.parametrize("shift", [(0, 0), (1, 0), (-2, 1), (0, 2)])
def test_lags_by_moments_are_those_of_all_pairs(shift):
    rng = np.random.default_rng(1)
    a = np.c_[rng.uniform(0.12, 0.24, (3000, 2)), rng.normal(5, 1, 3000)]
    b = a if shift == (0, 0) else np.c_[rng.uniform(0.12, 0.24, (2500, 2)) + 0.12 * np.array(shift), rng.normal(5, 1, 2500)]
    a[7, 2] = np.nan
    d = np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)
    g = np.nan_to_num((a[:, None, 2] - b[None, :, 2]) ** 2)
    ok = np.triu(d < 0.24, 1) if shift == (0, 0) else d < 0.24
    k = np.floor(d[ok] / 0.03).astype(int)
    got = points.lag_sums(a, b, 0.03, 8, (0.12, 0.12), shift, 0.12)
    assert (got[:, 0] == np.bincount(k, minlength=8)).all()
    np.testing.assert_allclose(got[:, 1:], np.stack([np.bincount(k, w[ok], 8) for w in (d, g)], 1), rtol=1e-11, atol=1e-9)


def test_variogram_and_nearest_few_of_odd_rows(spark):
    rows = [(1, 0.1, 0.1, 1.0), (1, 0.2, 0.1, 2.0), (2, -0.1, 0.1, 5.0), (3, -0.1, 0.1, None), (None, 0.0, 0.0, 1.0), (4, None, 0.0, 1.0), (5, 9.0, 9.0, 1.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, value double")
    got = {r.lag: (r.pairs, round(r.distance, 9), round(r.gamma, 9)) for r in points.variogram(p, 0.11, 4).collect()}
    assert got == {0: (1, 0.0, 0.0), 1: (2, 0.2, 4.0), 2: (2, 0.3, 2.25)}  # rows of one id are no pair; a null value counts, but adds nothing
    near = points.nearest_few(spark.createDataFrame([(0, 0, 0.0, 0.0)], "r int, c int, x double, y double"), p.filter("value is not null"), 1.0, 3).first().a
    assert [(round(a.d, 6), a.id) for a in near] == [(0.0, None), (0.141421, 1), (0.141421, 2)]


def test_spline_by_rounds_is_the_solved_one(spark):
    rng = np.random.default_rng(4)
    p, v = rng.normal(0, 0.13, (2500, 2)), rng.normal(0, 0.12, 2500)
    p[5] = p[6]
    table = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, ((x, y), z) in enumerate(zip(p, v))], "id long, x double, y double, value double")
    spots = points.cells(spark, 6, 6, -0.3, 0.3, 0.1, -0.1)
    got, want = (array(points.thin_plate(spots, table, 1e-3, most), (6, 6)) for most in (2000, 2500))
    np.testing.assert_allclose(got, want, atol=2e-8)
