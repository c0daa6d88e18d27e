"""Chains of operators from one surface, colours, and names of bands."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import colours
from gridloom.functions import surface as sf
from gridloom.operators import focal, graph, windows
from gridloom.operators import kernels as kn
from gridloom.plans.lineage import written
from gridloom.plans.queries_graph import d8
from gridloom.plans.recipes import g_bands, g_qty, nine, with_
from gridloom.plans.queries_terrain import PREP
from gridloom.plans.registry import r6, register, rounded
from gridloom.sources import png

PARTS = {
    "slope": sf.slope(), "aspect": sf.aspect(units="degrees"), "hillshade": sf.hillshade(),
    "northness": f"cos({sf.aspect('radians')})", "eastness": f"sin({sf.aspect('radians')})", "curvature": sf.curvature("general"),
}


def terrain_all(s, d) -> DataFrame:
    """The usual terrain factors of a cell from one pass over its neighbours, and its position within ten cells."""
    dem = written(g_qty(s, d))
    near = focal.surface(dem, only=" ".join(PARTS.values()))
    near = near.select("r", "c", *[F.when(F.col("full"), F.expr(t)).alias(n) for n, t in PARTS.items()])
    return written(near).join(windows.tpi(dem, 10).withColumnRenamed("v", "tpi"), ["r", "c"], "left")


PREPARED = "y AS (SELECT *" + "".join(f", CASE WHEN full9 THEN {t} END {k}" for k, t in sf.needed(" ".join(PARTS.values()), PREP).items()) + " FROM z)"
WIDE = "tp AS (SELECT m.r, m.c, CASE WHEN m.v IS NOT NULL AND count(*) = 441 THEN m.v - (sum(n.v) - m.v) / (count(n.v) - 1) END tpi FROM g m JOIN g n ON abs(n.r - m.r) <= 10 AND abs(n.c - m.c) <= 10 GROUP BY m.r, m.c, m.v)"
register(
    "terrain_all", lambda s, d: rounded(terrain_all(s, d), *PARTS, "tpi"),
    with_("g", nine(), PREPARED, WIDE) + "SELECT y.r, y.c, " + ", ".join(f"{r6(f'CASE WHEN full9 THEN {t} END')} AS {n}" for n, t in PARTS.items()) + f", {r6('tpi')} AS tpi FROM y LEFT JOIN tp ON y.r = tp.r AND y.c = tp.c",
)


def wetness(s, d, cs: float = 100.0) -> DataFrame:
    """From the surface alone: D8, accumulation and slope, and from them wetness, stream power and transport.

    ``area`` is the catchment a metre of contour, the cell itself counted; slopes are at least a thousandth.
    """
    dem = g_qty(s, d)
    acc = written(graph.flow_accumulation(d8(s, d)))
    slope = focal.apply(dem, sf.slope("radians"), cs=cs).withColumnRenamed("v", "slope")
    t = acc.join(slope, ["r", "c"]).filter("slope IS NOT NULL")
    area, tan = f"((v + 1) * {cs!r}D)", "greatest(tan(slope), 0.001D)"
    return t.selectExpr(
        "r", "c", "v AS acc", f"ln({area} / {tan}) AS twi", f"{area} * {tan} AS spi", f"1.6D * pow({area} / 22.13D, 0.6D) * pow(sin(slope) / 0.0896D, 1.3D) AS sti"
    )


SLOPE100 = f"sl AS (SELECT r, c, CASE WHEN full9 THEN {sf.slope('radians').replace('gx', '(gx / 100E0)').replace('gy', '(gy / 100E0)').replace('gx', sf.horn()[0]).replace('gy', sf.horn()[1])} END slope FROM z)"


def hydrology_sql() -> str:
    from gridloom.plans.queries_graph import ACC, BASE

    area, tan = "((v + 1) * 100E0)", "greatest(tan(slope), 0.001E0)"
    return (
        BASE + ACC + ", " + SLOPE100 + f" SELECT ac.r, ac.c, v AS acc, {r6(f'ln({area} / {tan})')} AS twi, {r6(f'{area} * {tan}')} AS spi,"
        f" {r6(f'1.6E0 * pow({area} / 22.13E0, 0.6E0) * pow(sin(slope) / 0.0896E0, 1.3E0)')} AS sti FROM ac JOIN sl ON ac.r = sl.r AND ac.c = sl.c WHERE slope IS NOT NULL"
    )


register("wetness_from_surface", lambda s, d: rounded(wetness(s, d), "twi", "spi", "sti"), hydrology_sql())


def hydrology_all(s, d, threshold: float = 20.0) -> DataFrame:
    """The filled surface, its directions and accumulation, streams, and the height above the nearest of them."""
    dem = g_qty(s, d)
    filled = written(kn.flooded(dem).withColumnRenamed("v", "filled"))
    down = kn.run(filled, lambda z: {"d": (d := kn.d8(z)), "acc": kn.d8_accumulation(d)}, {"d": "int", "acc": "double"}, ("filled",))
    out = dem.join(filled, ["r", "c"]).join(written(down), ["r", "c"])
    return out.select("r", "c", "v", "filled", "d", "acc", (F.col("acc") >= threshold).cast("int").alias("stream"))


register("hydrology_all", lambda s, d: rounded(hydrology_all(s, d), "filled", "acc"))
INDICES = {"ndvi": "(b1 - b2) / (b1 + b2)", "ndwi": "(b3 - b1) / (b3 + b1)", "brightness": "(b1 + b2 + b3 + b4) / 4"}


def features(s, d) -> DataFrame:
    """A table to learn from: bands, indices and the shape of the surface, by cell; cells without all of them go."""
    shape = focal.apply(g_qty(s, d), sf.slope()).withColumnRenamed("v", "slope").join(windows.tpi(g_qty(s, d), 3).withColumnRenamed("v", "tpi"), ["r", "c"])
    bands = g_bands(s, d).selectExpr("*", *[f"{t} AS {n}" for n, t in INDICES.items()])
    return bands.join(shape, ["r", "c"]).dropna()


FEATURES = with_(
    "g", "bands", nine(),
    f"sl AS (SELECT r, c, CASE WHEN full9 THEN {sf.slope().replace('gx', sf.horn()[0]).replace('gy', sf.horn()[1])} END slope FROM z)",
    "tp AS (SELECT m.r, m.c, CASE WHEN m.v IS NOT NULL AND count(*) = 49 THEN m.v - (sum(n.v) - m.v) / (count(n.v) - 1) END tpi FROM g m JOIN g n ON abs(n.r - m.r) <= 3 AND abs(n.c - m.c) <= 3 GROUP BY m.r, m.c, m.v)",
)
register(
    "pipeline_features", lambda s, d: rounded(features(s, d), "slope", "tpi", *INDICES),
    FEATURES + "SELECT bands.r, bands.c, b1, b2, b3, b4, " + ", ".join(f"{r6(t)} AS {n}" for n, t in INDICES.items()) + f", {r6('slope')} AS slope, {r6('tpi')} AS tpi FROM bands JOIN sl ON sl.r = bands.r AND sl.c = bands.c JOIN tp ON tp.r = bands.r AND tp.c = bands.c WHERE slope IS NOT NULL AND tpi IS NOT NULL",
)

# colours and names
MIN_MAX = "e AS (SELECT min(v) lo, max(v) hi FROM g)"
for scheme in ("terrain", "imhof1", "geomorphons"):
    register(
        f"raster_to_rgba_{scheme}", lambda s, d, k=scheme: png.coloured(g_qty(s, d), k),
        with_("g", MIN_MAX) + "SELECT r, c, " + ", ".join(f"CAST({t} AS INT) AS {n}" for n, t in colours.rgba(scheme, "v", "lo", "hi").items()) + " FROM g, e",
    )
NAMES = [n for names in colours.BANDS.values() for n in names] + ["B04", "NIR", "qa_pixel", "visual"]
register(
    "detect_band_type", lambda s, d: s.createDataFrame([(n,) for n in NAMES], "key string").selectExpr("key", f"{colours.band_type('key')} AS kind"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for k, names in colours.BANDS.items() for n in names) + ", ('B04', 'red'), ('NIR', 'nir'), ('qa_pixel', 'unknown'), ('visual', 'unknown')) t(key, kind)",
)
