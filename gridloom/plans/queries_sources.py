"""Queries of files and polygons: written, read again and compared with the tables they came from."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import points as pt
from gridloom.operators import polygons as pg
from gridloom.operators import regrid
from gridloom.plans.lineage import shared_root
from gridloom.plans.recipes import g_bands, g_qty, points, table, with_
from gridloom.plans.registry import r6, register, rounded
from gridloom.sources import tiff, vector


def fresh(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


# rasters as files


def as_files(s: SparkSession, grid: DataFrame, **options) -> str:
    folder = fresh(s)
    tiff.write_geotiff(grid, folder, side=16, tile=16, **options)
    return folder


def cells_of(df: DataFrame, *bands: str) -> DataFrame:
    """Rows and columns of the whole grid from the places of the cells of its files."""
    return df.select(F.floor(-F.col("y")).cast("int").alias("r"), F.floor("x").cast("int").alias("c"), *bands)


register("read_geotiff", lambda s, d: cells_of(tiff.read_geotiff(s, as_files(s, g_qty(s, d), epsg=32633)), "b1"), with_("g") + "SELECT r, c, v AS b1 FROM g")
register(
    "read_geotiff_window",
    lambda s, d: cells_of(tiff.read_geotiff(s, as_files(s, g_qty(s, d)), window=(5.0, -28.0, 21.0, -3.0)), "b1"),
    with_("g") + "SELECT r, c, v AS b1 FROM g WHERE c BETWEEN 5 AND 20 AND r BETWEEN 3 AND 27",
)
register(
    "read_geotiff_bands",
    lambda s, d: cells_of(tiff.read_geotiff(s, as_files(s, g_bands(s, d), bands=["b1", "b2", "b3", "b4"]), (2, 4)).filter("b2 is not null"), "b2", "b4"),
    with_("bands") + "SELECT r, c, b2, b4 FROM bands",
)
register(
    "read_cog_overview",
    lambda s, d: rounded(tiff.cells(tiff.encoded(g_qty(s, d), side=64, tile=16).withColumnRenamed("name", "path"), level=1).select("r", "c", F.col("b1").alias("v")), "v"),
    with_("g") + f"SELECT CAST(floor(r / 2.0) AS INT) AS r, CAST(floor(c / 2.0) AS INT) AS c, {r6('avg(v)')} AS v FROM g GROUP BY 1, 2",
)
register(
    "geotiff_metadata",
    lambda s, d: tiff.describe(tiff.files(s, as_files(s, g_qty(s, d), epsg=32719, transform=(300000.0, 6000000.0, 30.0, -30.0)))).select("width", "height", "bands", "dtype", "x0", "y0", "dx", "dy", "epsg", "nodata", "images"),
    "SELECT CAST(16 AS INT) AS width, CAST(16 AS INT) AS height, CAST(1 AS INT) AS bands, 'float64' AS dtype, 300000E0 + 480 * (i % 2) AS x0, 6000000E0 - 480 * (i // 2) AS y0, 30E0 AS dx, -30E0 AS dy, CAST(32719 AS INT) AS epsg, -9999E0 AS nodata, CAST(1 AS INT) AS images FROM range(4) t(i)",
)

# vectors as files


def points_as_geoparquet(s, d) -> DataFrame:
    folder = fresh(s)
    vector.write_points(points(s, d), folder)
    place = F.col("region")[0][0]
    return vector.read_geoparquet(s, folder).select("id", place["x"].alias("gx"), place["y"].alias("gy"), "value")


register("read_geoparquet_points", points_as_geoparquet, with_("pts") + "SELECT id, x AS gx, y AS gy, value FROM pts")
SMALL = lambda df, h=0.02: df.withColumn("region", pg.box(F.col("x") - h, F.col("y") - h, F.col("x") + h, F.col("y") + h))


def regions_as_geoparquet(s, d) -> DataFrame:
    folder = fresh(s)
    vector.write_geoparquet(SMALL(points(s, d)).select("id", "value", "region"), folder, epsg=4326)
    ring = F.col("region")[0]
    return vector.read_vector(s, folder).select("id", "kind", F.size(ring).alias("corners"), ring[2]["x"].alias("x1"), ring[2]["y"].alias("y1"))


register("read_geoparquet", regions_as_geoparquet, with_("pts") + "SELECT id, 'Polygon' AS kind, CAST(5 AS INT) AS corners, x + 0.02E0 AS x1, y + 0.02E0 AS y1 FROM pts")

# polygons and grids: triangles round the points, on the cells of the quantity grid
GX, GY = "(16 + 60 * x)", "(16 + 60 * y)"
CORNERS = ((-0.91, -0.83), (1.37, -0.42), (0.21, 1.29))


def triangles(s, d) -> DataFrame:
    corner = lambda dx, dy: F.struct((F.expr(GX) + dx).alias("x"), (F.expr(GY) + dy).alias("y"))
    return points(s, d).select(F.col("id").alias("seq"), F.col("value"), F.array(F.array(*[corner(*q) for q in CORNERS])).alias("region"))


HALF = " AND ".join(
    f"(({bx - ax!r}E0) * (r + 0.5E0 - {GY} - ({ay!r}E0)) - ({by - ay!r}E0) * (c + 0.5E0 - {GX} - ({ax!r}E0))) > 0" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1])
)
register("rasterize_polygons", lambda s, d: pg.rasterized(triangles(s, d), 0.0, 0.0, 1.0, 1.0, 32, 32), with_("g", "pts") + f"SELECT r, c, max_by(value, id) AS v FROM g JOIN pts ON {HALF} GROUP BY r, c")
register("clip_raster", lambda s, d: pg.clip_raster(g_qty(s, d), triangles(s, d), 0.0, 0.0, 1.0, 1.0, 32, 32), with_("g", "pts") + f"SELECT r, c, CASE WHEN EXISTS (SELECT 1 FROM pts WHERE {HALF}) THEN v END AS v FROM g")
one = lambda s: s.createDataFrame([(0, 1.0, [[(3.2, 4.1), (28.7, 9.3), (20.4, 30.6), (6.6, 22.2)], [(12.1, 12.2), (18.3, 13.1), (15.2, 19.4)]])], f"seq long, value double, region {pg.REGION}")
RINGS = (((3.2, 4.1), (28.7, 9.3), (20.4, 30.6), (6.6, 22.2)), ((12.1, 12.2), (18.3, 13.1), (15.2, 19.4)))
CROSSED = " + ".join(
    f"CASE WHEN (({ay}E0 > r + 0.5E0) <> ({by}E0 > r + 0.5E0)) AND c + 0.5E0 < ({bx - ax!r}E0) * (r + 0.5E0 - {ay}E0) / ({by - ay!r}E0) + {ax}E0 THEN 1 ELSE 0 END"
    for ring in RINGS for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])
)
register("clip_raster_by_polygon", lambda s, d: pg.clip_raster(g_qty(s, d), one(s), 0.0, 0.0, 1.0, 1.0, 32, 32), with_("g") + f"SELECT r, c, CASE WHEN ({CROSSED}) % 2 = 1 THEN v END AS v FROM g")

# overlays: two layers whose own rows do not overlap
LEFT = "l AS (SELECT CAST(i * 1000 + j AS BIGINT) id, i / 20E0 + 0.013E0 x0, j / 20E0 + 0.007E0 y0, i / 20E0 + 0.049E0 x1, j / 20E0 + 0.041E0 y1 FROM (SELECT DISTINCT floor(20 * x) i, floor(20 * y) j FROM pts))"
RIGHT = "m AS (SELECT CAST(i * 1000 + j AS BIGINT) id, i / 15E0 + 0.003E0 x0, j / 15E0 + 0.011E0 y0, i / 15E0 + 0.061E0 x1, j / 15E0 + 0.06E0 y1 FROM (SELECT DISTINCT floor(15 * value) i, floor(15 * x) j FROM pts))"


def layer(s, d, a: str, b: str, n: int, edge: tuple[float, float, float, float]) -> DataFrame:
    cell = points(s, d).select(F.floor(n * F.col(a)).alias("i"), F.floor(n * F.col(b)).alias("j")).distinct()
    x0, y0, x1, y1 = edge
    box = pg.box(F.col("i") / n + x0, F.col("j") / n + y0, F.col("i") / n + x1, F.col("j") / n + y1)
    return cell.select((F.col("i") * 1000 + F.col("j")).alias("id"), box.alias("region"))


def layers(s, d, how: str) -> DataFrame:
    left = layer(s, d, "x", "y", 20, (0.013, 0.007, 0.049, 0.041))
    right = layer(s, d, "value", "x", 15, (0.003, 0.011, 0.061, 0.06))
    out = pg.overlay_layers(left, right, how, 0.05)
    out = out.withColumn("area", F.round(pg.region_area("region"), 8)).drop("region")
    return out.filter("area > 1e-7")


MET = with_("pts", LEFT, RIGHT, "o AS (SELECT l.id a_id, m.id b_id, (least(l.x1, m.x1) - greatest(l.x0, m.x0)) * (least(l.y1, m.y1) - greatest(l.y0, m.y0)) area FROM l JOIN m ON l.x0 < m.x1 AND m.x0 < l.x1 AND l.y0 < m.y1 AND m.y0 < l.y1)",
    "la AS (SELECT id, (x1 - x0) * (y1 - y0) - coalesce((SELECT sum(area) FROM o WHERE a_id = l.id), 0) area FROM l)", "ra AS (SELECT id, (x1 - x0) * (y1 - y0) - coalesce((SELECT sum(area) FROM o WHERE b_id = m.id), 0) area FROM m)")
PAIRS = "SELECT a_id, b_id, round(area, 8) AS area FROM o WHERE area > 1e-7"
APART = "SELECT id AS a_id, CAST(NULL AS BIGINT) AS b_id, round(area, 8) AS area FROM la WHERE area > 1e-7 UNION ALL SELECT NULL, id, round(area, 8) FROM ra WHERE area > 1e-7"
register("overlay_intersection", lambda s, d: layers(s, d, "intersection"), MET + PAIRS)
register("overlay_difference", lambda s, d: layers(s, d, "difference"), MET + "SELECT id AS a_id, round(area, 8) AS area FROM la WHERE area > 1e-7")
register("overlay_symmetric_difference", lambda s, d: layers(s, d, "symmetric_difference"), MET + APART)
register("overlay_union", lambda s, d: layers(s, d, "union"), MET + APART + " UNION ALL " + PAIRS)


def labelled(s, d) -> DataFrame:
    e = table(s, d, "embeddings")
    return points(s, d).join(e.select(F.col("vec_id").alias("id"), "label"), "id")


def dissolve(s, d) -> DataFrame:
    at = lambda c: F.floor(40 * F.col(c))
    boxes = labelled(s, d).withColumn("region", pg.box(at("x"), at("y"), at("x") + 3, at("y") + 2))
    return pg.dissolved(boxes, "label", 8.0).select("label", F.round(pg.region_area("region"), 6).alias("area"))


register(
    "dissolve", dissolve,
    with_("pts") + "SELECT label, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT label, floor(40 * x) + i AS a, floor(40 * y) + j AS b FROM pts JOIN embeddings ON vec_id = id, range(3) u(i), range(2) w(j)) GROUP BY label",
)


def hulls(s, d) -> DataFrame:
    """The hull of each label: first of the points of each cell of a coarse grid, then of what those leave."""
    p = labelled(s, d).select("label", F.struct("x", "y").alias("p"), F.floor(F.col("x") * 8).alias("cell"))
    part = p.groupBy("label", "cell").agg(F.collect_list("p").alias("ps"))
    part = part.select("label", F.explode(pt.ring_udf(pt.convex_hull)("ps")).alias("p"))
    whole = part.groupBy("label").agg(F.collect_list("p").alias("ps")).select("label", pt.ring_udf(pt.convex_hull)("ps").alias("ring"))
    return whole.select("label", F.size("ring").alias("corners"), F.round(F.abs(pt.ring_area(F.col("ring"))), 9).alias("area"))


register(
    "convex_hull", hulls,
    with_("pts", "q AS (SELECT label, x, y FROM pts JOIN embeddings ON vec_id = id)")
    + "SELECT label, CAST(count(*) AS INT) AS corners, round(abs(sum(ax * by_ - ay * bx)) / 2, 9) AS area FROM (SELECT a.label, a.x ax, a.y ay, b.x bx, b.y by_ FROM q a JOIN q b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)"
    " WHERE NOT EXISTS (SELECT 1 FROM q p WHERE p.label = a.label AND (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0)) GROUP BY label",
)


def buffered(s, d) -> DataFrame:
    line = points(s, d).select("id", F.array(F.array(F.struct("x", "y"), F.struct((F.col("x") + 1 + F.abs("value")).alias("x"), "y"))).alias("line"))
    out = pg.mapped(line, lambda rings: pg.buffer_line(rings[0], 0.5, 16), "line")
    return out.select("id", F.round(pg.region_area("region"), 6).alias("area"))


register("buffer_geometry", buffered, with_("pts") + f"SELECT id, round(1 + abs(value) + {16 * 0.25 * math.sin(2 * math.pi / 16) / 2!r}E0, 6) AS area FROM pts")
CLIP = (-0.05, -0.08, 0.1, 0.06)
register(
    "clip_by_rect",
    lambda s, d: SMALL(points(s, d)).select("id", pt.ring_udf(pt.clip_ring, *CLIP)(F.col("region")[0]).alias("ring")).filter("size(ring) > 2").select("id", F.round(F.abs(pt.ring_area(F.col("ring"))), 9).alias("area")).filter("area > 1e-8"),
    with_("pts") + f"SELECT id, round(w * h, 9) AS area FROM (SELECT id, least(x + 0.02E0, {CLIP[2]}E0) - greatest(x - 0.02E0, {CLIP[0]}E0) w, least(y + 0.02E0, {CLIP[3]}E0) - greatest(y - 0.02E0, {CLIP[1]}E0) h FROM pts) WHERE w > 0 AND h > 0 AND w * h > 1e-8",
)


def simplified(s, d, how) -> DataFrame:
    """The line of each label's values, its points in the order of ids."""
    line = labelled(s, d).groupBy("label").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("double").alias("x"), F.col("value").alias("y")))).alias("line"))
    return line.select("label", how("line").alias("kept")).select("label", F.size("kept").alias("n"), F.round(F.aggregate(F.transform("kept", lambda p: p["y"]), F.lit(0.0), lambda a, b: a + b), 9).alias("total"))


register("simplify_dp", lambda s, d: simplified(s, d, pt.ring_udf(pt.simplify, 0.1)))
register("simplify_vw", lambda s, d: simplified(s, d, pt.ring_udf(pg.simplify_areas, 1.0)))

# grids between zones of the projection
register("reproject_raster_utm", lambda s, d: rounded(regrid.between_utm(regrid.placed(g_qty(s, d), 690000.0, 5000000.0, 500.0), 32632, 32633), "v"))
LON, LAT = geo.from_utm("(500000 + 100000 * x)", "(5000000 + 100000 * y)", 32)
E33, N33 = geo.to_utm("lon", "lat", 33)
register(
    "reproject_utm_to_utm",
    lambda s, d: points(s, d).selectExpr("id", f"{LON} AS lon", f"{LAT} AS lat").selectExpr("id", f"{r6(E33)} AS easting", f"{r6(N33)} AS northing"),
    with_("pts") + f"SELECT id, {r6(E33)} AS easting, {r6(N33)} AS northing FROM (SELECT id, {LON} AS lon, {LAT} AS lat FROM pts)",
)
