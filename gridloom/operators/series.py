"""Per-cell statistics of time series: long tables (r, c, t, v), one group a cell.

Null values are missing. Pairs of dates are formed inside a cell's own array,
so a series of n dates costs n (n - 1) / 2 terms and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.spectral import two_sided_p


def statistics(cube: DataFrame, *percentiles: float) -> DataFrame:
    """count, mean, std (sample), min, max and percentiles (p10 for 10) of each cell, in one pass."""
    return cube.groupBy("r", "c").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        *[F.percentile("v", p / 100).alias(f"p{p:g}") for p in percentiles],
    )


def anomaly(reference: DataFrame, target: DataFrame, method: str = "zscore") -> DataFrame:
    """Target values against their cell's reference period: zscore, difference or percent."""
    base = reference.groupBy("r", "c").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    j = target.join(base, ["r", "c"], "left")
    d = F.col("v") - F.col("m")
    value = {
        "difference": d,
        "zscore": F.when(F.col("s") > 1e-10, d / F.when(F.col("s") > 1e-10, F.col("s"))),
        "percent": F.when(F.abs("m") > 1e-10, d / F.when(F.abs("m") > 1e-10, F.col("m")) * 100),
    }[method]
    return j.select("r", "c", "t", value.alias("v"))


def linear_trend(cube: DataFrame) -> DataFrame:
    """slope, intercept, r_squared and p_value (two-sided t test) of cells with three values or more."""
    g = cube.filter("v IS NOT NULL").groupBy("r", "c").agg(
        F.count("*").cast("double").alias("n"), F.avg("t").alias("mt"), F.avg("v").alias("mv"),
        F.regr_sxx("v", "t").alias("sxx"), F.regr_syy("v", "t").alias("syy"), F.regr_sxy("v", "t").alias("sxy"),
    ).filter("n >= 3 AND sxx >= 1e-30")
    g = g.selectExpr(
        "r", "c", "n", "sxy / sxx AS slope", "mv - sxy / sxx * mt AS intercept",
        "CASE WHEN syy > 1e-30 THEN sxy * sxy / (sxx * syy) ELSE 0D END AS r_squared",
        "sqrt(greatest(syy - sxy * sxy / sxx, 0D) / (n - 2) / sxx) AS se",
    )
    t = F.abs(F.col("slope")) / F.when(F.col("se") > 1e-30, F.col("se"))
    p = F.when(F.col("se") > 1e-30, t_test_p(t, F.col("n") - 2)).when(F.abs("slope") > 1e-30, F.lit(0.0))
    return g.select("r", "c", "slope", "intercept", "r_squared", p.alias("p_value"))


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the angle."""
    theta = F.atan(t / F.sqrt(df))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    first = F.when(odd, F.cos(theta)).otherwise(1.0)
    steps = F.sequence(F.lit(1), F.greatest(F.floor((df - F.when(odd, 1).otherwise(0)) / 2).cast("int"), F.lit(1)))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    grow = lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * cos2 * (2 * i - F.when(odd, 0).otherwise(1)) / (2 * i + F.when(odd, 1).otherwise(0))).alias("term"))
    series = F.aggregate(steps, start, grow)["sum"]
    inside = F.when(odd, 2 / F.pi() * (theta + F.when(df > 1, F.sin(theta) * series).otherwise(0.0))).otherwise(F.sin(theta) * series)
    return F.greatest(F.least(1 - inside, F.lit(1.0)), F.lit(0.0))


def _pairs(cube: DataFrame) -> DataFrame:
    """r, c, n, ``a`` (values by time) and the arrays ``dy`` and ``dt`` of all pairs of dates."""
    g = cube.filter("v IS NOT NULL").groupBy("r", "c").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("a"))
    g = g.withColumn("n", F.size("a"))
    pairs = "flatten(transform(a, (x, i) -> transform(slice(a, i + 2, n), y -> named_struct('dy', y.v - x.v, 'dt', y.t - x.t))))"
    return g.withColumn("p", F.expr(pairs))


SLOPES = "array_sort(transform(filter(p, x -> x.dt > 0), x -> x.dy / x.dt))"
MIDDLE = "CASE WHEN size(slopes) > 0 THEN (element_at(slopes, CAST(floor((size(slopes) + 1) / 2) AS INT)) + element_at(slopes, CAST(floor((size(slopes) + 2) / 2) AS INT))) / 2 END"


def sens_slope(cube: DataFrame, least: int = 2) -> DataFrame:
    """The median of the slopes of all pairs of dates."""
    return _pairs(cube).filter(F.col("n") >= least).selectExpr("r", "c", f"{SLOPES} AS slopes").selectExpr("r", "c", f"{MIDDLE} AS v")


def mann_kendall(cube: DataFrame, alpha: float = 0.05) -> DataFrame:
    """s, tau (b), p_value, trend (-1, 0, 1) and sens_slope of cells with three values or more."""
    g = _pairs(cube).filter("n >= 3")
    ties = "transform(array_distinct(transform(a, x -> x.v)), u -> CAST(size(filter(a, x -> x.v = u)) AS DOUBLE))"
    g = g.select("r", "c", F.col("n").cast("double").alias("n"), F.expr("CAST(aggregate(p, 0, (q, x) -> q + CAST(sign(x.dy) AS INT)) AS DOUBLE)").alias("s"), F.expr(ties).alias("u"), F.expr(SLOPES).alias("slopes"))
    g = g.withColumn("slope", F.expr(MIDDLE)).drop("slopes")
    total = lambda f: f"aggregate(u, 0D, (q, x) -> q + {f})"
    g = g.selectExpr("r", "c", "slope", "s", "n", f"(n * (n - 1) / 2 - {total('x * (x - 1) / 2')}) * (n * (n - 1) / 2) AS d", f"(n * (n - 1) * (2 * n + 5) - {total('x * (x - 1) * (2 * x + 5)')}) / 18 AS var_")
    g = g.selectExpr("r", "c", "slope", "s", "CASE WHEN d > 0 THEN s / sqrt(d) END AS tau", "CASE WHEN var_ > 0 THEN (s - sign(s)) / sqrt(var_) END AS z")
    g = g.selectExpr("r", "c", "slope", "s", "tau", f"{two_sided_p('z')} AS p_value")
    trend = f"CASE WHEN p_value < {alpha} THEN sign(s) WHEN p_value IS NOT NULL THEN 0D END AS trend"
    return g.selectExpr("r", "c", "s", "tau", "p_value", trend, "slope AS sens_slope")


def median_composite(scenes: DataFrame) -> DataFrame:
    """The median over scenes (scene, r, c, v)."""
    return scenes.groupBy("r", "c").agg(F.median("v").alias("v"))


def coverage_order(scenes: DataFrame) -> DataFrame:
    """Scenes by their number of valid cells, most first, names in order on ties."""
    return scenes.groupBy("scene").agg(F.count("v").alias("n")).orderBy(F.desc("n"), "scene")


def fill_by_coverage(grid: DataFrame, scenes: DataFrame) -> DataFrame:
    """Null cells take the value of the scene of the best coverage that has one."""
    order = scenes.groupBy("scene").agg(F.count("v").alias("n"))
    best = scenes.filter("v IS NOT NULL").join(order, "scene").groupBy("r", "c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("scene"))).alias("f"))
    return grid.join(best, ["r", "c"], "left").select("r", "c", F.coalesce("v", "f").alias("v"))


def phenology(cube: DataFrame, threshold: float = 0.5, window: int = 5) -> DataFrame:
    """sos, peak_time, eos, season_length, amplitude, peak and base of cells with four values or more.

    Series are filled by interpolation, smoothed by an odd moving mean, and
    crossed at ``base + threshold * amplitude`` on both sides of the peak.
    """
    import numpy as np
    import pandas as pd

    names = ["sos", "peak_time", "eos", "season_length", "amplitude", "peak", "base"]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        t, v = p["t"].to_numpy(float), p["v"].to_numpy(float)
        ok = np.isfinite(v)
        out = dict.fromkeys(names)
        if len(v) >= 6 and ok.sum() >= 4:
            y = np.interp(t, t[ok], v[ok])
            half = window // 2
            y = np.array([y[max(0, i - half) : i + half + 1].mean() for i in range(len(y))])
            k = int(y.argmax())
            base, peak = float(y.min()), float(y[k])
            level = base + threshold * (peak - base)
            out |= {"peak_time": t[k], "amplitude": peak - base, "peak": peak, "base": base}
            cross = lambda i: t[i] + (level - y[i]) / (y[i + 1] - y[i]) * (t[i + 1] - t[i])
            up = [i for i in range(k) if y[i] < level <= y[i + 1]]
            down = [i for i in range(k, len(y) - 1) if y[i] >= level > y[i + 1]]
            if up:
                out["sos"] = cross(up[0])
                if down:
                    out["eos"] = cross(down[-1])
                    out["season_length"] = out["eos"] - out["sos"]
        return pd.DataFrame([{"r": p["r"].iloc[0], "c": p["c"].iloc[0]} | out]).astype({n: "float64" for n in names})

    return cube.groupBy("r", "c").applyInPandas(one, "r int, c int, " + ", ".join(f"{n} double" for n in names))
