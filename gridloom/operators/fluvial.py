"""Channel metrics on drainage edges, and reach of flows from sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import accumulate, cell_of, edges, node, roots
from gridloom.plans.lineage import written


def stream_edges(d8: DataFrame, dem: DataFrame, threshold: float, cs: float = 30.0) -> DataFrame:
    """(id, to, len, acc, z, acc_to, z_to) of stream cells, whose accumulation reaches ``threshold``."""
    e = written(edges(d8, cs))
    acc = accumulate(e)
    z = dem.select(node(F.col("r"), F.col("c")).alias("id"), F.col("v").alias("z"))
    t = written(acc.join(z, "id"))
    s = e.join(t.filter(F.col("acc") >= threshold), "id")
    return s.join(t.select(F.col("id").alias("to"), F.col("acc").alias("acc_to"), F.col("z").alias("z_to")), "to", "left").select("id", "to", "len", "acc", "z", "acc_to", "z_to")


def steepness(s: DataFrame, theta: float = 0.45) -> DataFrame:
    """(r, c, v): slope to the next cell, not below 0, times (cells drained) ^ theta; null at outlets."""
    v = F.when(F.col("z_to").isNotNull(), F.greatest((F.col("z") - F.col("z_to")) / F.col("len"), F.lit(0.0)) * F.pow(F.col("acc") + 1, F.lit(theta)))
    return cell_of(s.select("id", v.alias("v"))).select("r", "c", "v")


def chi(s: DataFrame, theta: float = 0.45, cs: float = 30.0, a0: float = 1.0) -> DataFrame:
    """(id, root, chi): the trapezoidal integral of (a0 / area) ^ theta up from the outlet."""
    f = lambda a: F.pow(F.lit(a0) / ((F.col(a) + 1) * cs * cs), F.lit(theta))
    e = s.select("id", "to", (F.col("len") * (f("acc") + f("acc_to")) / 2).alias("len"))
    return roots(e).select("id", "root", F.col("dist").alias("chi"))


def main_stems(s: DataFrame) -> DataFrame:
    """(r, c, outlet, distance, z) of the nodes that the largest tributary leads to, up from every outlet."""
    w = Window.partitionBy("to").orderBy(F.desc("acc"), "id")
    e = s.withColumn("nth", F.row_number().over(w))
    e = written(e.select("id", F.when(F.col("nth") == 1, F.col("to")).alias("to"), "len", F.col("to").isNull().alias("outlet"), "z"))
    t = roots(e.select("id", "to", "len")).join(e.filter("outlet").select(F.col("id").alias("root")), "root").join(e.select("id", "z"), "id")
    return cell_of(t).select("r", "c", F.col("root").alias("outlet"), F.col("dist").alias("distance"), "z")


def concavity(s: DataFrame, thetas: list[float], cs: float = 30.0) -> DataFrame:
    """(root, theta, rmse): the theta whose chi leaves the least spread of elevation about a line, for each outlet."""
    out = None
    for theta in thetas:
        t = chi(s, theta, cs).join(s.select("id", "z"), "id").groupBy("root").agg(F.count("*").alias("n"), F.regr_syy("z", "chi").alias("syy"), F.regr_sxy("z", "chi").alias("sxy"), F.regr_sxx("z", "chi").alias("sxx"))
        t = t.filter("n >= 4 AND sxx > 0").selectExpr("root", f"{theta}D AS theta", "sqrt(greatest(syy - sxy * sxy / sxx, 0D) / n) AS rmse")
        out = t if out is None else out.unionByName(t)
    return written(out).groupBy("root").agg(F.min_by("theta", F.struct("rmse", "theta")).alias("theta"), F.min("rmse").alias("rmse"))


def energy_cone(dem: DataFrame, sources: DataFrame, degrees: float = 11.0, collapse: float = 50.0, cs: float = 1.0) -> DataFrame:
    """Height of the highest cone over each cell, 0 where none reaches; ``sources`` are rows (r, c).

    A cone cannot stand over any cell farther than its top is above the lowest ground, so cells meet
    the sources of their own and the eight neighbouring squares of that reach, by an equi-join.
    """
    t = math.tan(math.radians(degrees))
    z = dem.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("v").alias("sz"))
    s = sources.select(F.col("r").alias("sr"), F.col("c").alias("sc")).distinct().join(z, ["sr", "sc"]).filter("sz IS NOT NULL")
    top = s.agg(F.max("sz").alias("top")).crossJoin(dem.agg(F.min("v").alias("low"))).first()  # one row
    if top["top"] is None:
        return dem.select("r", "c", F.when(F.col("v").isNotNull(), F.lit(0.0)).alias("v"))
    reach = max(1, math.ceil((top["top"] + collapse - top["low"]) / t / cs) + 1)
    bin_of = lambda c: F.floor(F.col(c) / reach).cast("int")
    near = lambda c: F.explode(F.sequence(bin_of(c) - 1, bin_of(c) + 1))
    s = s.withColumn("br", near("sr")).withColumn("bc", near("sc"))
    far = F.sqrt((F.col("r") - F.col("sr")) ** 2 + (F.col("c") - F.col("sc")) ** 2) * cs
    high = F.max(F.col("sz") + collapse - t * far)
    cells = dem.withColumns({"br": bin_of("r"), "bc": bin_of("c")}).join(s, ["br", "bc"], "left").groupBy("r", "c", "v").agg(high.alias("top"))
    return cells.select("r", "c", F.when(F.col("v").isNotNull(), F.greatest(F.col("top") - F.col("v"), F.lit(0.0))).alias("v"))
