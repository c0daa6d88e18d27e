"""Window operators built on :mod:`gridloom.operators.focal`: position indices, morphology, roughness.

All take a dense grid (r, c, v) and return (r, c, v). "Full" windows lie wholly
on the grid; without one the result is null, as it is for a null centre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import surface as sf
from gridloom.operators.focal import _along, in_circle, moments, neighbours, pivot3


def _full(k: int) -> Column:
    return F.col("v").isNotNull() & (F.col("cells") == (2 * k + 1) ** 2)


def _others(grid: DataFrame, k: int) -> DataFrame:
    """Moments without the centre: n, mean, var (population), and ``ok`` for full windows."""
    m = moments(grid, k).withColumn("n1", F.col("n") - 1)
    mean = F.when(F.col("n1") > 0, (F.col("s") - F.col("v")) / F.col("n1"))
    m = m.withColumns({"mean": mean, "square": F.when(F.col("n1") > 0, (F.col("q") - F.col("v") * F.col("v")) / F.col("n1"))})
    return m.withColumns({"var": F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)), "ok": _full(k)})


def _pick(df: DataFrame, ok: Column, value: Column) -> DataFrame:
    return df.select("r", "c", F.when(ok, value).alias("v"))


def tpi(grid: DataFrame, k: int = 1) -> DataFrame:
    """Elevation less the mean of the other valid cells of a full window."""
    o = _others(grid, k)
    return _pick(o, F.col("ok"), F.col("v") - F.col("mean"))


diff_from_mean = tpi


def tri(grid: DataFrame, k: int = 1) -> DataFrame:
    """Root mean square difference to the other cells of a full window."""
    o = _others(grid, k)
    return _pick(o, F.col("ok"), F.sqrt(F.greatest(F.col("square") - 2 * F.col("v") * F.col("mean") + F.col("v") * F.col("v"), F.lit(0.0))))


def dev(grid: DataFrame, k: int = 1) -> DataFrame:
    """Difference to the mean in standard deviations; 0 on flat windows, null with fewer than two neighbours."""
    o = _others(grid, k)
    value = F.when(F.col("var") < 1e-20, 0.0).otherwise((F.col("v") - F.col("mean")) / F.sqrt(F.greatest(F.col("var"), F.lit(1e-300))))
    return _pick(o, F.col("ok") & (F.col("n1") >= 2), value)


def percent_range(grid: DataFrame, k: int = 1) -> DataFrame:
    """Position between the least and the largest cell of a full window, in percent; 0 where it is flat."""
    m = moments(grid, k)
    span = F.col("hi") - F.col("lo")
    return _pick(m, _full(k), F.when(span < 2.220446049250313e-16, 0.0).otherwise((F.col("v") - F.col("lo")) / F.greatest(span, F.lit(1e-300)) * 100))


def lee(grid: DataFrame, size: int = 7, looks: float = 1.0) -> DataFrame:
    """Lee's speckle filter over partial windows of ``size``."""
    m = moments(grid, size // 2)
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    ci2 = var / F.greatest(mean * mean, F.lit(1e-300))
    cu2 = 1.0 / looks
    value = F.when((F.abs(mean) < 1e-15) | (ci2 <= cu2), mean).otherwise(mean + (1 - F.lit(cu2) / F.greatest(ci2, F.lit(1e-300))) * (F.col("v") - mean))
    return _pick(m, F.col("v").isNotNull(), value)


def _element(grid: DataFrame, k: int, shape: str, low: bool) -> DataFrame:
    """The least or largest value under a structuring element that lies on valid cells only."""
    f = F.min if low else F.max
    if shape == "square":
        m = moments(grid, k)
        return _pick(m, F.col("n") == (2 * k + 1) ** 2, F.col("lo" if low else "hi"))
    if shape == "cross":
        parts = grid
        for axis in ("r", "c"):
            w = _along(axis, k)
            parts = parts.withColumns({f"x{axis}": f("v").over(w), f"n{axis}": F.count("v").over(w)})
        both = (F.least if low else F.greatest)("xr", "xc")
        return _pick(parts, (F.col("nr") == 2 * k + 1) & (F.col("nc") == 2 * k + 1), both)
    if shape == "disk":
        n = sum(1 for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= k * k)
        a = F.expr(f"transform(filter(near, x -> x.v IS NOT NULL AND {in_circle(k)}), x -> x.v)")
        out = neighbours(grid, k).select("r", "c", a.alias("a"))
        return out.select("r", "c", F.when(F.size("a") == n, (F.array_min if low else F.array_max)("a")).alias("v"))
    raise ValueError(f"no such structuring element: {shape}")


def erode(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return _element(grid, k, shape, True)


def dilate(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return _element(grid, k, shape, False)


def opening(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return dilate(erode(grid, k, shape), k, shape)


def closing(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return erode(dilate(grid, k, shape), k, shape)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["r", "c"]).select("r", "c", (F.col("x") - F.col("y")).alias("v"))


def gradient(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return minus(dilate(grid, k, shape), erode(grid, k, shape))


def top_hat(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return minus(grid, opening(grid, k, shape))


def black_hat(grid: DataFrame, k: int = 1, shape: str = "square") -> DataFrame:
    return minus(closing(grid, k, shape), grid)


def _vector_sums(grid: DataFrame, parts: dict[str, str], valid: str, k: int) -> DataFrame:
    """Window sums (named as in ``parts``) of formulas over z1..z9, ``n`` valid cells and ``cells`` on the grid."""
    base = pivot3(grid).withColumn("ok", F.expr(valid))
    base = base.select("r", "c", F.col("z5").alias("v"), *[F.when(F.col("ok"), F.expr(t)).alias(n) for n, t in parts.items()])
    first = next(iter(parts))
    sums = base.select("*", F.count(first).over(_along("r", k)).alias("n_"), F.count(F.lit(1)).over(_along("r", k)).alias("c_"), *[F.sum(n).over(_along("r", k)).alias(f"{n}_") for n in parts])
    w = _along("c", k)
    return sums.select("r", "c", "v", *parts, F.sum("n_").over(w).alias("n"), F.sum("c_").over(w).alias("cells"), *[F.sum(f"{n}_").over(w).alias(f"s{n}") for n in parts])


def _length(n: Column, *parts: str) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p) * F.col(p)
    return F.sqrt(total) / n


def spherical_std_dev(grid: DataFrame, k: int = 1, cs: float = 1.0) -> DataFrame:
    """Spherical standard deviation of the surface normals of a full window."""
    s = _vector_sums(grid, dict(zip("xyz", sf.normal(cs))), "full", k).withColumn("bar", _length(F.col("n"), "sx", "sy", "sz"))
    value = F.when(F.col("bar") >= 1, 0.0).when(F.col("bar") < 1e-10, F.pi()).otherwise(F.sqrt(-2 * F.log(F.greatest("bar", F.lit(1e-300)))))
    return _pick(s, _full(k) & (F.col("n") >= 2), value)


def normal_deviation(grid: DataFrame, k: int = 1, cs: float = 1.0) -> DataFrame:
    """Mean angle of the normals of a full window to their mean direction, in degrees."""
    base = _vector_sums(grid, dict(zip("xyz", sf.normal(cs))), "full", k)
    packed = base.select("r", "c", F.when(F.col("x").isNotNull(), F.struct("x", "y", "z")).alias("v"))
    near = neighbours(packed, k).select("r", "c", F.expr("transform(filter(near, q -> q.v IS NOT NULL), q -> q.v)").alias("a"))
    s = base.drop("x", "y", "z").join(near, ["r", "c"]).withColumn("len", _length(F.lit(1.0), "sx", "sy", "sz"))
    angle = F.aggregate("a", F.lit(0.0), lambda t, q: t + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (q["x"] * F.col("sx") + q["y"] * F.col("sy") + q["z"] * F.col("sz")) / F.greatest("len", F.lit(1e-300))))))
    return _pick(s, _full(k) & (F.col("n") >= 2) & (F.col("len") / F.col("n") >= 1e-10), F.degrees(angle / F.col("n")))


def vrm(grid: DataFrame, k: int = 1) -> DataFrame:
    """Vector ruggedness: 1 less the mean resultant of normals from unnormalised gradients; border k + 1."""
    x, y = sf.horn(1 / 8)
    n = f"sqrt(1 + {x} * {x} + {y} * {y})"
    s = _vector_sums(grid, {"x": f"-{y} / {n}", "y": f"-{x} / {n}", "z": f"1 / {n}"}, "full", k)
    inside = moments(grid, k + 1).select("r", "c", (F.col("cells") == (2 * k + 3) ** 2).alias("inside"))
    return _pick(s.join(inside, ["r", "c"]), F.col("inside") & (F.col("n") > 0), 1 - _length(F.col("n"), "sx", "sy", "sz"))


def circular_variance(grid: DataFrame, k: int = 1) -> DataFrame:
    """Circular variance of aspect over a full window; flat cells are passed over."""
    x, y = sf.horn()
    n = f"sqrt({x} * {x} + {y} * {y})"
    s = _vector_sums(grid, {"x": f"-{y} / {n}", "y": f"-{x} / {n}"}, f"full AND NOT (abs({x}) < 1e-10 AND abs({y}) < 1e-10)", k)
    return _pick(s, _full(k) & (F.col("n") >= 2), 1 - _length(F.col("n"), "sx", "sy"))


def edge_density(grid: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Share of Sobel edges above a threshold among the valid cells of a full window."""
    inner = moments(grid, 1).select("r", "c", (F.col("cells") == 9).alias("inner"))
    e = pivot3(grid).join(inner, ["r", "c"]).select("r", "c", F.col("z5").alias("e0"), F.when(F.col("inner") & F.col("z5").isNotNull(), F.expr(sf.sobel())).alias("s"))
    flags = e.select("r", "c", "e0", F.when(F.col("s").isNotNull(), (F.col("s") > threshold).cast("double")).alias("v"))
    m = moments(flags.select("r", "c", "v"), k).select("r", "c", "n", "cells", "s").join(flags.select("r", "c", F.col("e0").alias("v")), ["r", "c"])
    return _pick(m, _full(k) & (F.col("n") > 0), F.col("s") / F.col("n"))
