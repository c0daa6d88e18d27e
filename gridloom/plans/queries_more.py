"""Further queries: views, scale analysis, geographic grids, tiled models, overlays of boxes, learners."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions import surface as sf
from gridloom.operators import focal
from gridloom.operators import kernels as kn
from gridloom.operators import sight
from gridloom.plans.queries_graph import grid_query
from gridloom.plans.recipes import g_bands, g_qty, nine, with_, zoned
from gridloom.plans.registry import r6, register, rounded


def visible_share(z: np.ndarray, rounds: int = 20, error: float = 50.0) -> np.ndarray:
    """The share of noisy surfaces on which a cell is seen; the noise is seeded."""
    rng = np.random.default_rng(42)
    return np.mean([kn.viewshed(z + rng.normal(0, error, z.shape), 16, 16) for _ in range(rounds)], 0)


def best_observers(z: np.ndarray, candidates: list[tuple[int, int]], most: int = 3) -> np.ndarray:
    """Cells by the order (from 1) of the observer that first covers them, chosen greedily; 0 is unseen."""
    seen = {p: kn.viewshed(z, *p) > 0 for p in candidates}
    out = np.zeros(z.shape)
    for k in range(1, most + 1):
        p = max(sorted(seen), key=lambda q: (seen[q] & (out == 0)).sum())
        gain = seen[p] & (out == 0)
        if not gain.any():
            break
        out[gain] = k
    return out


def lineaments(z: np.ndarray, least: int = 4) -> np.ndarray:
    """Connected lines of strong plan or profile curvature: 1 strike-slip, 2 dip-slip, 3 oblique."""
    d = kn.quadratic(z, 1)
    g = d["p"] ** 2 + d["q"] ** 2 + 1e-20
    kh = -(d["q"] ** 2 * d["r"] - 2 * d["p"] * d["q"] * d["s"] + d["p"] ** 2 * d["t"]) / (g * np.sqrt(1 + g))
    kv = -(d["p"] ** 2 * d["r"] + 2 * d["p"] * d["q"] * d["s"] + d["q"] ** 2 * d["t"]) / (g * (1 + g) ** 1.5)
    h, v = np.abs(kh) > np.nanstd(kh), np.abs(kv) > np.nanstd(kv)
    kind = np.where(h & v, 3, np.where(h, 1, np.where(v, 2, 0)))
    lab, n = kn.label(np.where(kind > 0, 1.0, np.nan), True)
    return np.where(np.bincount(lab.ravel(), minlength=n + 1)[lab] >= least, kind, 0)


def chebyshev(z: np.ndarray, order: int = 3, half: int = 2) -> dict[str, np.ndarray]:
    """First derivatives of a least-squares Chebyshev surface over a square window."""
    x = np.linspace(-1, 1, 2 * half + 1)
    t = np.polynomial.chebyshev.chebvander(x, order)
    dt = np.stack([np.polynomial.chebyshev.chebval(0, np.polynomial.chebyshev.chebder(np.eye(order + 1)[i])) for i in range(order + 1)])
    t0 = np.polynomial.chebyshev.chebvander(np.zeros(1), order)[0]
    p = np.linalg.pinv(t)
    first, zero = dt @ p / half, t0 @ p
    out = {"p": np.zeros(z.shape), "q": np.zeros(z.shape)}
    for i in range(-half, half + 1):
        for j in range(-half, half + 1):
            v = kn.shifted(z, i, j)
            out["p"] = out["p"] + zero[i + half] * first[j + half] * v
            out["q"] = out["q"] - first[i + half] * zero[j + half] * v
    return out


def shadowed(z: np.ndarray) -> np.ndarray:
    """One day's energy where cells behind an eighth-circle horizon lose the beam of that direction."""
    slope, aspect = np.arctan(np.hypot(*kn.horn(z, 100.0))), np.nan_to_num(kn.aspect_radians(z))
    lit = np.mean([(np.arctan(kn.horizon(z / 100, math.pi / 4 * i, 6)) < math.radians(40)) for i in range(8)], 0)
    return kn.solar(slope, aspect) * (0.25 + 0.75 * lit)


grid_query("viewshed_xdraw", lambda z: sight.xdraw(z, 16, 16, 100.0), {"v": "int"})
grid_query("viewshed_pderl", lambda z: sight.pderl(z, 10, 20, 100.0), {"v": "int"})
grid_query("viewshed_probabilistic", visible_share)
grid_query("observer_optimization", lambda z: best_observers(z, [(r, c) for r in (4, 16, 28) for c in (4, 16, 28)]), {"v": "int"})
grid_query("horizon_angles_fast", lambda z: {f"h{i}": np.arctan(h) for i, h in enumerate(kn.horizons(z, 12, 4))}, {f"h{i}": "double" for i in range(4)}, halo=12)
grid_query("horizon_angle_map_fast", lambda z: np.arctan(kn.horizon(z, math.pi / 2, 12)), halo=12)
grid_query("sky_view_factor_fast", lambda z: kn.sky_view(z, 10, 16), halo=10)
grid_query("lineament_detection", lineaments, {"v": "int"})
grid_query("chebyshev_derivatives", chebyshev, {"p": "double", "q": "double"}, halo=2)
grid_query("solar_radiation_shadowed", shadowed, halo=6)
grid_query("solar_radiation_annual_only", lambda z: sum(30.4 * kn.solar(np.arctan(np.hypot(*kn.horn(z, 100.0))), np.nan_to_num(kn.aspect_radians(z)), 15 + 30 * m, step=2.0) for m in range(12)), halo=1)


def rea(grid: DataFrame, factors: tuple[int, ...] = (2, 4)) -> DataFrame:
    """factor and the correlation of the slope of a coarser grid with the mean of the fine slope."""
    fine = focal.apply(grid, sf.slope()).withColumnRenamed("v", "s")
    out = None
    for k in factors:
        cell = [F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")]
        coarse = focal.apply(grid.groupBy(*cell).agg(F.avg("v").alias("v")), sf.slope(), cs=float(k))
        j = coarse.join(fine.groupBy(*cell).agg(F.avg("s").alias("s")), ["r", "c"])
        row = j.agg(F.lit(k).alias("factor"), F.corr("v", "s").alias("corr"))
        out = row if out is None else out.unionByName(row)
    return out


register("rea_analysis", lambda s, d: rounded(rea(g_qty(s, d))))
W, H = geo.cell_dimensions("(45 - r * 0.001E0)", 0.001, 0.001)
GEO = f"degrees(atan(sqrt(power(gx / {W}, 2) + power(gy / {H}, 2))))"
register("slope_geographic", lambda s, d: rounded(focal.surface(g_qty(s, d), only="gx gy").select("r", "c", F.when(F.col("full"), F.expr(GEO)).alias("v")), "v"),
    with_("g", nine(), f"y AS (SELECT *, {sf.horn()[0]} gx, {sf.horn()[1]} gy FROM z)") + f"SELECT r, c, {r6(f'CASE WHEN full9 THEN {GEO} END')} AS v FROM y")


def vincenty(df: DataFrame) -> DataFrame:
    """Geodesic metres between (lat1, lon1) and (lat2, lon2), iterated in Arrow batches."""
    import pandas as pd

    a, f = geo.A, geo.FLAT
    b = a * (1 - f)

    def run(batches):
        for t in batches:
            u1, u2 = np.arctan((1 - f) * np.tan(np.radians(t["lat1"]))), np.arctan((1 - f) * np.tan(np.radians(t["lat2"])))
            ell = np.radians(t["lon2"] - t["lon1"])
            lam = ell
            for _ in range(100):
                ss = np.sqrt((np.cos(u2) * np.sin(lam)) ** 2 + (np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)) ** 2)
                cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                sg = np.arctan2(ss, cs)
                sa = np.cos(u1) * np.cos(u2) * np.sin(lam) / np.maximum(ss, 1e-300)
                c2 = 1 - sa**2
                cm = np.where(c2 > 0, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(c2 > 0, c2, 1), 0.0)
                c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
                new = ell + (1 - c) * f * sa * (sg + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
                if np.abs(new - lam).max() < 1e-12:
                    break
                lam = new
            k = c2 * (a * a - b * b) / (b * b)
            big, small = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))), k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
            ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
            yield pd.DataFrame({"id": t["id"], "v": b * big * (sg - ds)})

    return df.select("id", "lat1", "lon1", "lat2", "lon2").mapInPandas(run, "id long, v double")


def geodesics(s, d):
    from gridloom.plans.recipes import points

    return vincenty(points(s, d).selectExpr("id", "45 + x AS lat1", "9 + y AS lon1", "46 - y AS lat2", "10 + x AS lon2"))


register("vincenty_distance", lambda s, d: rounded(geodesics(s, d), "v"))
MODEL = lambda a: np.tanh((a - 1500) / 500)


def tiled(grid: DataFrame, size: int = 8) -> DataFrame:
    """A model over tiles, one tile a group."""
    t = grid.withColumn("tile", (F.floor(F.col("r") / size) * 1000 + F.floor(F.col("c") / size)).cast("int"))
    return kn.run(t, MODEL, {"v": "double"}, by="tile").drop("tile")


register("run_tiled", lambda s, d: rounded(tiled(g_qty(s, d))), with_("g") + f"SELECT r, c, {r6('tanh((v - 1500) / 500)')} AS v FROM g")
def forest(s, d, trees: int = 10) -> DataFrame:
    """A random forest of the block of a cell from its bands, trained on two thirds of the cells."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    t = zoned(g_bands(s, d)).withColumn("label", (F.col("zone") % 4).cast("double"))
    t = VectorAssembler(inputCols=["b1", "b2", "b3", "b4"], outputCol="features").transform(t)
    model = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=42).fit(t.filter("(r + c) % 3 <> 0"))
    return model.transform(t).select("r", "c", "label", "prediction")


register("ml_train_predict", forest)
register("ml_benchmark", lambda s, d: forest(s, d, 5).filter("(r + c) % 3 = 0").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count("*").alias("n")))
CUBIC = "CASE WHEN {t} <= 1 THEN 1.5E0 * power({t}, 3) - 2.5E0 * power({t}, 2) + 1 WHEN {t} < 2 THEN -0.5E0 * power({t}, 3) + 2.5E0 * power({t}, 2) - 4 * {t} + 2 ELSE 0E0 END"


def cubic(s, d) -> DataFrame:
    """Catmull-Rom from sixteen cells; null where one is missing."""
    t = s.range(400).selectExpr("CAST(floor(id / 20) AS INT) AS r", "CAST(id % 20 AS INT) AS c", "(floor(id / 20) + 0.5D) * 1.6D - 0.5D AS y", "(id % 20 + 0.5D) * 1.6D - 0.5D AS x")
    near = F.explode(F.array(*[F.struct((F.floor("y").cast("int") + a).alias("sr"), (F.floor("x").cast("int") + b).alias("sc")) for a in (-1, 0, 1, 2) for b in (-1, 0, 1, 2)]))
    j = t.select("r", "c", "x", "y", near.alias("k")).select("r", "c", "x", "y", "k.sr", "k.sc").join(g_qty(s, d).selectExpr("r AS sr", "c AS sc", "v"), ["sr", "sc"])
    w = F.expr(f"({CUBIC.format(t='abs(y - sr)')}) * ({CUBIC.format(t='abs(x - sc)')})")
    return j.groupBy("r", "c").agg(F.count("v").alias("n"), F.sum(F.col("v") * w).alias("v")).filter("n = 16").select("r", "c", "v")


register("resample_cubic", lambda s, d: cubic(s, d).withColumn("v", F.round("v", 8)), with_("g", "t AS (SELECT CAST(i // 20 AS INT) r, CAST(i % 20 AS INT) c, (i // 20 + 0.5E0) * 1.6E0 - 0.5E0 y, (i % 20 + 0.5E0) * 1.6E0 - 0.5E0 x FROM range(400) q(i))")
    + f"SELECT t.r, t.c, round(sum(g.v * ({CUBIC.format(t='abs(t.y - g.r)')}) * ({CUBIC.format(t='abs(t.x - g.c)')})), 8) AS v FROM t JOIN g ON g.r BETWEEN CAST(floor(t.y) AS INT) - 1 AND CAST(floor(t.y) AS INT) + 2 AND g.c BETWEEN CAST(floor(t.x) AS INT) - 1 AND CAST(floor(t.x) AS INT) + 2 GROUP BY t.r, t.c HAVING count(g.v) = 16")
