"""Moving windows over dense grids.

A grid is (r, c, v); a cell without data is a row with a null ``v`` (see
:func:`dense`). Windows are built in two passes, along rows and then along
columns, each one exchange on one coordinate: no cell is copied to its
neighbours, so a radius costs no extra shuffle. Range frames and position
checks keep edges exact. Columns other than r, c, v are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.surface import needed, prepare

#: z1..z9, row by row from the north-west; z5 is the cell itself.
NAMES = [f"z{i}" for i in range(1, 10)]


def dense(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """All ``rows`` x ``cols`` cells from 0, with null where ``grid`` has no row."""
    spark = grid.sparkSession
    cells = spark.range(rows * cols).select(
        (F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c")
    )
    return cells.join(grid, ["r", "c"], "left")


def _along(axis: str, k: int):
    other = "c" if axis == "r" else "r"
    return Window.partitionBy(axis).orderBy(other).rangeBetween(-k, k)


def pivot3(grid: DataFrame) -> DataFrame:
    """r, c and z1..z9; a neighbour off the grid is null. ``full`` says that none of the nine is null."""
    w = Window.partitionBy("r").orderBy("c")
    at = lambda f, col, pos, step: F.when(f(pos).over(w) == F.col(pos) + step, f(col).over(w))
    row = grid.select(
        "r", "c", F.struct(at(F.lag, "v", "c", -1).alias("w"), F.col("v").alias("m"), at(F.lead, "v", "c", 1).alias("e")).alias("t")
    )
    w = Window.partitionBy("c").orderBy("r")
    up, down = at(F.lag, "t", "r", -1), at(F.lead, "t", "r", 1)
    out = row.select("r", "c", up.alias("n"), F.col("t").alias("m"), down.alias("s"))
    z = [F.col(f"{a}.{b}") for a in "nms" for b in "wme"]
    out = out.select("r", "c", *[x.alias(n) for x, n in zip(z, NAMES)])
    ok = F.lit(True)
    for n in NAMES:
        ok = ok & F.col(n).isNotNull()
    return out.withColumn("full", ok)


def surface(grid: DataFrame, cs: float = 1.0, zf: float = 1.0, only: str | None = None) -> DataFrame:
    """:func:`pivot3` with the prepared derivatives (all, or those that the formula ``only`` names); null unless ``full``."""
    parts = prepare(cs, zf)
    parts = parts if only is None else needed(only, parts)
    return pivot3(grid).select("*", *[F.when(F.col("full"), F.expr(t)).alias(k) for k, t in parts.items()])


def apply(grid: DataFrame, text: str, cs: float = 1.0, zf: float = 1.0) -> DataFrame:
    """(r, c, v): a surface formula of the cells whose nine values are all there."""
    return surface(grid, cs, zf, text).select("r", "c", F.when(F.col("full"), F.expr(text)).alias("v"))


def moments(grid: DataFrame, k: int) -> DataFrame:
    """r, c, v with the square window's s (sum), q (sum of squares), n (values), cells, lo and hi."""
    parts = {
        "s": F.sum("v"), "q": F.sum(F.col("v") * F.col("v")), "n": F.count("v"),
        "cells": F.count(F.lit(1)), "lo": F.min("v"), "hi": F.max("v"),
    }
    out = grid.select("r", "c", "v", *[f.over(_along("r", k)).alias(n) for n, f in parts.items()])
    join = {"s": F.sum, "q": F.sum, "n": F.sum, "cells": F.sum, "lo": F.min, "hi": F.max}
    return out.select("r", "c", "v", *[f(n).over(_along("c", k)).alias(n) for n, f in join.items()])


def neighbours(grid: DataFrame, k: int) -> DataFrame:
    """r, c, v and ``near``: an array of (dr, dc, v) of the square window's cells on the grid."""
    row = grid.select("r", "c", "v", F.collect_list(F.struct("c", "v")).over(_along("r", k)).alias("line"))
    out = row.select("r", "c", "v", F.collect_list(F.struct("r", "line")).over(_along("c", k)).alias("lines"))
    near = F.expr(
        "flatten(transform(lines, l -> transform(l.line, x -> named_struct('dr', l.r - r, 'dc', x.c - c, 'v', x.v))))"
    )
    return out.select("r", "c", "v", near.alias("near"))


def in_circle(k: int) -> str:
    return f"x.dr * x.dr + x.dc * x.dc <= {k * k}"


def statistic(grid: DataFrame, k: int, stat: str, circular: bool = False, p: float = 50.0) -> DataFrame:
    """r, c, v: one focal statistic over the valid cells of partial windows; null where there are none.

    ``stat``: mean, stddev (population), min, max, range, sum, count, median,
    percentile (nearest rank) or majority (the smallest of the most frequent).
    """
    if k < 1:
        raise ValueError("the radius must be at least 1")
    simple = {
        "mean": F.col("s") / F.col("n"), "sum": F.col("s"), "count": F.col("n").cast("double"),
        "min": F.col("lo"), "max": F.col("hi"), "range": F.col("hi") - F.col("lo"),
        "stddev": F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)), F.lit(0.0))),
    }
    if stat in simple and not circular:
        out = moments(grid, k)
        return out.select("r", "c", F.when(F.col("n") > 0, simple[stat]).alias("v"))
    keep = f"x.v IS NOT NULL AND {in_circle(k) if circular else 'true'}"
    values = F.expr(f"array_sort(transform(filter(near, x -> {keep}), x -> x.v))")
    out = neighbours(grid, k).select("r", "c", values.alias("a"))
    return out.select("r", "c", F.when(F.size("a") > 0, array_statistic(F.col("a"), stat, p)).alias("v"))


def array_statistic(a: Column, stat: str, p: float = 50.0) -> Column:
    """A statistic of a sorted array of doubles."""
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total / n
    if stat == "percentile":
        return F.element_at(a, F.floor(F.lit(p / 100.0) * (n - 1) + 0.5).cast("int") + 1)
    if stat == "median":
        return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor((n + 2) / 2).cast("int"))) / 2
    if stat == "majority":
        runs = F.transform(a, lambda x: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("k"), x.alias("x")))
        return F.array_min(runs)["x"]
    return {
        "mean": mean, "sum": total, "count": n.cast("double"),
        "min": F.element_at(a, 1), "max": F.element_at(a, -1), "range": F.element_at(a, -1) - F.element_at(a, 1),
        "stddev": F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n),
    }[stat]
