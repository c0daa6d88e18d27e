"""Round trips of file formats, polygons against sampling, and rows against hand-made files."""

import json
import math
import random
import sqlite3
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import polygons as pg
from gridloom.operators import regrid
from gridloom.sources import tiff, vector


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
@pytest.mark.parametrize("big", [False, True])
def test_geotiff_codec_round_trip(dtype, big):
    rng = np.random.default_rng(1)
    for shape in ((1, 10, 7), (3, 150, 130), (2, 33, 17)):
        a = rng.integers(0, 200, shape).astype(dtype) if dtype[0] != "f" else rng.normal(0, 1e3, shape).astype(dtype)
        data = tiff.encode(a, (10, 20, 2, -2), 32719, 0, tile=64, big=big)
        first = tiff.pages(data)[0]
        assert (first.epsg, first.transform, first.nodata) == (32719, (10, 20, 2, -2), 0)
        assert (tiff.decode(data) == a).all()
        for k, page in enumerate(tiff.pages(data)):
            assert tiff.decode(data, k).shape[1:] == page.shape == (-(-shape[1] // 2**k), -(-shape[2] // 2**k))


def test_geotiff_strips_big_endian_and_other_compressions():
    a = np.arange(12, dtype=">i2").reshape(3, 4)

    def packbits(raw):
        return bytes([len(raw) - 1]) + raw

    for code, pack in ((1, bytes), (32773, packbits)):
        strips = [pack(a[:2].tobytes()), pack(a[2:].tobytes())]
        tags = [(256, 4), (257, 3), (258, 16), (259, code), (262, 1), (277, 1), (278, 2), (339, 2)]
        at = 8 + 2 + 12 * (len(tags) + 2) + 4
        extra = struct.pack(">IIII", at + 16, at + 16 + len(strips[0]), len(strips[0]), len(strips[1]))
        rows = {t: struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in tags}
        rows[273] = struct.pack(">HHII", 273, 4, 2, at)
        rows[279] = struct.pack(">HHII", 279, 4, 2, at + 8)
        data = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", len(rows)) + b"".join(rows[k] for k in sorted(rows)) + struct.pack(">I", 0) + extra + b"".join(strips)
        assert (tiff.decode(data)[0] == a).all()


def test_lzw_and_predictors():
    def lzw(raw):
        bits, width, table, word = "", 9, {bytes([i]): i for i in range(256)}, b""
        n = 258
        bits += f"{256:09b}"
        for x in raw:
            w = word + bytes([x])
            if w in table:
                word = w
                continue
            bits += f"{table[word]:0{width}b}"
            table[w] = n
            n += 1
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
            word = bytes([x])
        bits += f"{table[word]:0{width}b}" + f"{257:0{width}b}"
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    raw = bytes(random.Random(1).choices(range(4), k=900))
    assert tiff.unpack(lzw(raw), tiff.LZW, len(raw)) == raw
    rng = np.random.default_rng(3)
    for dtype, how in (("uint16", 2), ("float32", 3), ("float64", 3)):
        a = (rng.normal(0, 50, (5, 6, 2)) + 300).astype(dtype)
        assert (tiff.unpredict(tiff.predict(a, how), how, 5, 6, 2, np.dtype(f"<{np.dtype(dtype).kind}{a.itemsize}")) == a).all()


def test_geotiff_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    z = np.round(rng.normal(100, 9, (70, 50)), 3)
    z[3, 4] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c]), float(r * 50 + c)) for r in range(70) for c in range(50)]
    grid = spark.createDataFrame(rows, "r int, c int, v double, w double")
    folder = str(tmp_path / "tif")
    tiff.write_geotiff(grid, folder, bands=["v", "w"], side=32, tile=16, transform=(500.0, 9000.0, 10.0, -10.0), epsg=32633)
    meta = tiff.describe(tiff.files(spark, folder)).collect()
    assert len(meta) == 6 and {m.epsg for m in meta} == {32633} and {m.bands for m in meta} == {2}
    got = {(int((9000 - x.y) // 10), int((x.x - 500) // 10)): (x.b1, x.b2) for x in tiff.read_geotiff(spark, folder, (1, 2)).collect()}
    assert got == {(r, c): (v, w) for r, c, v, w in rows}
    part = tiff.read_geotiff(spark, folder, window=(600.0, 8500.0, 700.0, 8600.0)).collect()
    assert len(part) == 100 and all(600 < x.x < 700 and 8500 < x.y < 8600 for x in part)
    coarse = tiff.read_geotiff(spark, folder, cell=20.0).filter("path like '%/0_0.tif'").collect()
    assert len(coarse) == 256 and {x.x for x in coarse} == {510.0 + 20 * i for i in range(16)}
    want = {(r, c): np.nanmean(z[2 * r : 2 * r + 2, 2 * c : 2 * c + 2]) for r in range(16) for c in range(16)}
    assert all(abs(x.b1 - want[x.r, x.c]) < 1e-9 for x in coarse)


def test_overview_choice():
    assert tiff.overview_by_ratio([1000, 500, 250, 125], 4.5) == 2 and tiff.overview_by_ratio([1000, 500], 1.5) == 0
    assert tiff.overview_for_size([1000, 500, 250], 1e6, 10**6 // 16) == 2 and tiff.overview_for_size([1000, 500], 1e6, None) == 0
    assert tiff.overview_for_resolution([1000, 500], 10, 15) == 0 and tiff.overview_for_resolution([1000, 500], 10, 25) == 1


def star(rng, x, y, n):
    return [(x + rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_overlay_against_sampling():
    rng = random.Random(2)
    x, y = np.meshgrid(np.linspace(-2, 3, 120) + 1e-4, np.linspace(-2, 3, 120) + 1e-4)
    for k in range(25):
        a, b = [star(rng, 0, 0, rng.randint(3, 12))], [star(rng, rng.uniform(-0.5, 1.2), rng.uniform(-0.5, 1), rng.randint(3, 12))]
        if k % 3 == 0:
            b.append(star(rng, 0.2, 0.1, 5))
        for how, op in pg.OPERATIONS.items():
            assert (pg.within(pg.overlay(a, b, how), x, y) == op(pg.within(a, x, y), pg.within(b, x, y))).all()


def square(x, y, s=1.0):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]


def test_overlay_of_touching_and_equal_regions():
    joined = pg.overlay(square(0, 0), square(1, 0), "union")
    assert len(joined) == 1 and len(joined[0]) == 4 and pg.area(joined) == 2
    assert pg.overlay(square(0, 0), square(0, 0), "difference") == [] and pg.overlay([], [], "union") == []
    ring = pg.overlay(square(0, 0, 3), square(1, 1), "difference")
    assert len(ring) == 2 and pg.area(ring) == 8
    assert pg.area(pg.dissolve([square(i * 0.5, 0) for i in range(9)])) == 5
    assert abs(pg.area(pg.buffer_region(square(0, 0, 2), -0.5)) - 1) < 1e-9
    corners = pg.buffer_line([(0, 0), (3, 0)], 0.5, 16)
    assert abs(pg.area(corners) - 3 - 8 * 0.25 * math.sin(math.pi / 8)) < 1e-9


def test_simplify_by_areas_is_the_definition():
    rng = random.Random(4)
    line = [(i, rng.uniform(0, 3)) for i in range(40)]
    held, last = list(line), 0.0
    while len(held) > 2:
        sizes = [abs(pg.area([[a, b, c]])) for a, b, c in zip(held, held[1:], held[2:])]
        if (last := max(last, min(sizes))) >= 1.0:
            break
        del held[sizes.index(min(sizes)) + 1]
    assert pg.simplify_areas(line, 1.0) == held
    assert len(pg.simplify_areas(square(0, 0)[0], 9.0, closed=True)) == 3


def test_layers_meet_once(spark):
    rng = random.Random(7)
    rows = lambda n: [(i, pg.value_of(square(rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0.5, 3)))) for i in range(n)]
    a, b = rows(12), rows(9)
    left, right = (spark.createDataFrame(x, f"id long, region {pg.REGION}") for x in (a, b))
    got = {(r.a_id, r.b_id): pg.area(pg.rings_of(r.region)) for r in pg.overlay_layers(left, right, "intersection", 1.0).collect()}
    want = {(i, j): v for i, x in a for j, y in b if (v := pg.area(pg.overlay(pg.rings_of(x), pg.rings_of(y), "intersection"))) > 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    rest = {r.a_id: pg.area(pg.rings_of(r.region)) for r in pg.overlay_layers(left, right, "difference", 1.0).collect()}
    for i, x in a:
        cut = pg.overlay(pg.rings_of(x), pg.dissolve([pg.rings_of(y) for _, y in b]), "difference")
        assert abs(rest.get(i, 0) - pg.area(cut)) < 1e-9
    one = pg.dissolved(left.withColumn("k", F.col("id") % 2), "k", 4.0).select("k", pg.region_area("region").alias("v")).collect()
    assert {r.k: round(r.v, 9) for r in one} == {k: round(pg.area(pg.dissolve([pg.rings_of(x) for i, x in a if i % 2 == k])), 9) for k in (0, 1)}



def test_equal_and_crowded_regions_dissolve_in_bounded_pieces(spark):
    import time

    where = lambda n: spark.range(n).select((F.col("id") % 2).alias("k"), pg.box(F.col("id") % 30, F.col("id") % 7, F.col("id") % 30 + 3, F.col("id") % 7 + 2).alias("region"))
    start = time.time()
    got = {r.k: r.v for r in pg.dissolved(where(40_000), "k", 8.0).select("k", F.round(pg.region_area("region"), 6).alias("v")).collect()}
    assert time.time() - start < 60  # 40,000 rows of 210 places
    held = {k: {(x + i, y + j) for n in range(420) if n % 2 == k for x, y in [(n % 30, n % 7)] for i in range(3) for j in range(2)} for k in (0, 1)}
    assert got == {k: float(len(v)) for k, v in held.items()}


def test_rasterized_regions_hold_the_middles(spark):
    rng = random.Random(3)
    regions = [(i, float(i + 1), pg.value_of([star(rng, rng.uniform(0, 9), rng.uniform(0, 9), 9), star(rng, 4, 4, 5)])) for i in range(4)]
    df = spark.createDataFrame(regions, f"seq long, value double, region {pg.REGION}")
    got = {(r.r, r.c): r.v for r in pg.rasterized(df, -1.0, 10.0, 0.25, -0.25, 44, 44).collect()}
    r, c = np.indices((44, 44))
    want = np.zeros((44, 44))
    for _, v, region in regions:
        want[pg.within(pg.rings_of(region), -1 + (c + 0.5) * 0.25, 10 - (r + 0.5) * 0.25)] = v
    assert got == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want))}


def test_points_and_regions_as_geoparquet(spark, tmp_path):
    values = [0.0, -0.0, 1.0, -2.5, 1e-310, 123456.789, -1e300, 0.1, 2.0**-1022, math.nextafter(2.0, 0)]
    df = spark.createDataFrame([(i, x, -x) for i, x in enumerate(values)], "id long, x double, y double").coalesce(1)
    wkb = df.select("x", vector.point_wkb(F.col("x"), F.col("y")).alias("g")).collect()
    assert all(struct.unpack("<dd", bytes(r.g)[5:])[0] == r.x for r in wkb if abs(r.x) > 1e-300 or r.x == 0)
    vector.write_points(df, str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    assert json.loads(pq.read_schema(part).metadata[b"geo"])["columns"]["geometry"]["encoding"] == "WKB"
    hole = [[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]
    rows = [(1, "a", pg.value_of(hole)), (2, "b", pg.value_of(square(3, 3)))]
    vector.write_geoparquet(spark.createDataFrame(rows, f"id long, name string, region {pg.REGION}"), str(tmp_path / "g"), epsg=4326)
    got = {r.id: (r.name, r.kind, pg.area(pg.rings_of(r.region))) for r in vector.read_vector(spark, str(tmp_path / "g")).collect()}
    assert got == {1: ("a", "Polygon", 80.0), 2: ("b", "Polygon", 1.0)}


def test_geopackage_and_shapefile(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT, z INT, m INT)")
    db.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'LINESTRING', 32719, 0, 0)")
    head = b"GP\x00\x03" + struct.pack("<i4d", 32719, 0, 5, 0, 5)
    db.execute("INSERT INTO roads VALUES (7, ?, 'x')", (head + vector.encode_wkb("LineString", [[(0.0, 0.0), (5.0, 5.0)]]),))
    db.execute("INSERT INTO roads VALUES (8, NULL, NULL)")
    db.commit()
    db.close()
    assert [tuple(r)[1:] for r in vector.list_gpkg_layers(spark, path).collect()] == [("roads", "geom", 32719)]
    got = sorted((r.fid, r.kind, pg.rings_of(r.region), r.props["name"]) for r in vector.read_vector(spark, path).collect())
    assert got == [(7, "LineString", [[(0.0, 0.0), (5.0, 5.0)]], "x"), (8, None, [], None)]
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 4, 4, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    (tmp_path / "s.shp").write_bytes(b"\x00" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"NAME".ljust(11, b"\x00") + b"C" + b"\x00" * 4 + bytes([6, 0]) + b"\x00" * 14
    (tmp_path / "s.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 65, 7) + b"\x00" * 20 + field + b"\r" + b" hello ")
    (row,) = vector.read_vector(spark, str(tmp_path / "s.shp")).collect()
    assert (row.kind, pg.rings_of(row.region), row.props) == ("Polygon", [ring], {"NAME": "hello"})


def test_geojson_regions(spark, tmp_path):
    shape = lambda kind, c: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"k": 1}}
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [shape("Polygon", [ring]), shape("MultiPolygon", [[ring], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]), shape("Point", [1, 2])]}
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    got = {r.kind: pg.rings_of(r.region) for r in vector.read_vector(spark, str(tmp_path / "x.geojson")).collect()}
    assert pg.area(got["Polygon"]) == 4 and pg.area(got["MultiPolygon"]) == 4.5 and got["Point"] == [[(1.0, 2.0)]]


def test_grids_between_zones_keep_planes(spark):
    x0, y0, size = 690000.0, 5000000.0, 500.0
    plane = lambda x, y: (x - x0) * 0.01 - (y - y0) * 0.02
    rows = [(x0 + (c + 0.5) * size, y0 - (r + 0.5) * size, plane(x0 + (c + 0.5) * size, y0 - (r + 0.5) * size)) for r in range(20) for c in range(20)]
    got = regrid.between_utm(spark.createDataFrame(rows, "x double, y double, v double"), 32632, 32633)
    full = got.filter("v is not null")
    assert 250 < full.count() < 400
    lon, lat = geo.from_utm("x", "y", 32)
    e, n = geo.to_utm("lon", "lat", 33)
    there = spark.createDataFrame([(x, y) for x in (rows[0][0], rows[19][0]) for y in (rows[0][1], rows[380][1])], "x double, y double")
    there = there.selectExpr(f"{lon} AS lon", f"{lat} AS lat").selectExpr(f"{e} AS x", f"{n} AS y").collect()
    left, top = min(p.x for p in there), max(p.y for p in there)
    spots = full.select("v", (F.lit(left) + F.col("c") * size).alias("x"), (F.lit(top) - F.col("r") * size).alias("y"))
    lon, lat = geo.from_utm("x", "y", 33)
    e, n = geo.to_utm("lon", "lat", 32)
    back = spots.selectExpr("v", f"{lon} AS lon", f"{lat} AS lat").selectExpr("v", f"{e} AS x", f"{n} AS y").collect()
    assert max(abs(p.v - plane(p.x, p.y)) for p in back) < 0.05


def test_placements():
    a = regrid.Placement(10, 8, 100.0, 200.0, 2.0, -2.0, 32633)
    assert a.bytes == 640 and a.box == (100, 180, 116, 200) and a.strip(1, 4, 1.0) == (4, 8, (99, 183, 117, 193)) and a.strip(2, 4)[:2] == (8, 10)
    regrid.check_aligned(a, regrid.Placement(10, 8, 100.0 + 1e-8, 200.0, 2.0, -2.0, None))
    for b in (regrid.Placement(9, 8, 100, 200, 2, -2), regrid.Placement(10, 8, 100.1, 200, 2, -2), regrid.Placement(10, 8, 100, 200, 2, -2, 4326)):
        with pytest.raises(ValueError):
            regrid.check_aligned(a, b)
    assert (regrid.search_limit(0.5, 0.5, 10), regrid.search_limit(5, 5, 20), regrid.search_limit(20, 20, 99)) == (1000, 10000, 10000)
    assert regrid.box_in((0, 0, 1, 2), lambda x, y: (x - y, x + y)) == (-2, 0, 1, 3)


def test_parts_of_complex(spark):
    z = spark.sql("SELECT 0 AS r, 1 AS c, named_struct('re', 1.5D, 'im', -2D) AS v UNION ALL SELECT 0, 2, NULL")
    re_, im = regrid.parts_of_complex(z)
    assert sorted(map(tuple, re_.collect())) == [(0, 1, 1.5), (0, 2, None)] and im.filter("v = -2").count() == 1
