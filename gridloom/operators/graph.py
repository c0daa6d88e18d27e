"""Drainage networks and regions as edge tables, solved by pointer doubling.

A node is a long (row in the high half, column in the low half). Every loop
doubles the reach of a node's pointer, so it ends after log2(longest path)
rounds of one join and one aggregate; each round is written, not collected.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cells import value_ranks
from gridloom.plans.lineage import written

#: Row and column steps of D8 codes 1 to 8, counter-clockwise from east (fixed values).
STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def node(r: Column, c: Column) -> Column:
    return F.shiftleft(r.cast("long"), 32).bitwiseOR(c.cast("long"))


def cell_of(df: DataFrame) -> DataFrame:
    """r and c from ``id``."""
    return df.withColumns({"r": F.shiftright("id", 32).cast("int"), "c": F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")})


def encode(dr: Column, dc: Column) -> Column:
    """The D8 code of a step, null if it is none."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(STEPS, 1):
        out = F.when((dr == a) & (dc == b), i).otherwise(out)
    return out


def decode(d: Column) -> tuple[Column, Column]:
    def pick(k: int) -> Column:
        out = F.lit(None).cast("int")
        for i, step in enumerate(STEPS, 1):
            out = F.when(d == i, step[k]).otherwise(out)
        return out

    return pick(0), pick(1)


def distance(d: Column, cs: float = 1.0) -> Column:
    return F.when(d.between(1, 8), F.when(d % 2 == 1, F.lit(float(cs))).otherwise(F.lit(cs * math.sqrt(2))))


def opposite(d: Column) -> Column:
    return F.when(d.between(1, 8), (d + 3) % 8 + 1).otherwise(0)


def edges(d8: DataFrame, cs: float = 1.0) -> DataFrame:
    """(id, to, len) of (r, c, d); ``to`` is null at pits and where the flow leaves the grid."""
    dr, dc = decode(F.col("d"))
    e = d8.select(node(F.col("r"), F.col("c")).alias("id"), node(F.col("r") + dr, F.col("c") + dc).alias("to"), distance(F.col("d"), cs).alias("len"), (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc"))
    e = e.withColumn("to", F.when((F.col("nr") >= 0) & (F.col("nc") >= 0), F.col("to")))
    there = d8.select(node(F.col("r"), F.col("c")).alias("to"), F.lit(True).alias("on"))
    e = e.join(there, "to", "left")
    return e.select("id", F.when(F.col("on"), F.col("to")).alias("to"), F.when(F.col("on"), F.col("len")).alias("len"))


def _rounds(state: DataFrame) -> Iterator[int]:
    """As many rounds as doubling takes over a way through all nodes; one more is an error."""
    yield from range(state.count().bit_length() + 1)
    raise ValueError("directions run in a circle")


def accumulate(e: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, acc): nodes upstream of each node, or the sum of their ``weight``, itself not counted."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    state = written(e.select("id", "to", w.alias("w"), w.alias("own")))
    rounds = _rounds(state)
    while state.filter("to IS NOT NULL").take(1):
        next(rounds)
        got = state.filter("to IS NOT NULL").groupBy(F.col("to").alias("id")).agg(F.sum("w").alias("more"))
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"))
        state = state.join(ahead, "to", "left").join(got, "id", "left")
        state = written(state.select("id", F.col("next").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"), "own"))
    return state.select("id", (F.col("w") - F.col("own")).alias("acc"))


def roots(e: DataFrame) -> DataFrame:
    """(id, root, dist): the last node downstream and the length of the way to it."""
    state = written(e.select("id", "to", F.coalesce("to", "id").alias("root"), F.coalesce("len", F.lit(0.0)).alias("dist")))
    rounds = _rounds(state)
    while state.filter("to IS NOT NULL").take(1):
        next(rounds)
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("r2"), F.col("dist").alias("d2"))
        j = state.join(ahead, "to", "left")
        state = written(j.select("id", F.col("next").alias("to"), F.coalesce("r2", "root").alias("root"), (F.col("dist") + F.coalesce("d2", F.lit(0.0))).alias("dist")))
    return state.select("id", "root", "dist")


def flow_accumulation(d8: DataFrame) -> DataFrame:
    return cell_of(accumulate(edges(d8))).select("r", "c", F.col("acc").alias("v"))


def flow_path_length(d8: DataFrame, cs: float = 1.0) -> DataFrame:
    return cell_of(roots(edges(d8, cs))).select("r", "c", F.col("dist").alias("v"))


def watershed(d8: DataFrame) -> DataFrame:
    """(r, c, basin): outlets are numbered from 1 in row-major order."""
    t = written(roots(edges(d8)))
    outlets = value_ranks(t.select("root").distinct(), "root").select("root", (F.col("below") + 1).cast("int").alias("basin"))
    return cell_of(t.join(outlets, "root")).select("r", "c", "basin")


def hand(dem: DataFrame, d8: DataFrame, acc: DataFrame, threshold: float) -> DataFrame:
    """Height above the first stream cell downstream; null where there is none."""
    stream = acc.filter(F.col("v") >= threshold).select(node(F.col("r"), F.col("c")).alias("id"), F.lit(True).alias("stream"))
    e = edges(d8).join(stream, "id", "left")
    e = e.select("id", F.when(F.col("stream").isNull(), F.col("to")).alias("to"), "len")
    z = dem.select(node(F.col("r"), F.col("c")).alias("id"), F.col("v").alias("z"))
    t = roots(e).join(stream.select(F.col("id").alias("root"), "stream"), "root", "left")
    t = t.join(z, "id").join(z.select(F.col("id").alias("root"), F.col("z").alias("zr")), "root")
    return cell_of(t).select("r", "c", F.when(F.col("stream"), F.col("z") - F.col("zr")).alias("v"))


def label_regions(grid: DataFrame, eight: bool = False) -> DataFrame:
    """(r, c, v, label): connected cells of one rounded class; label is the least node of the region.

    Labels spread to neighbours and jump along pointers until none changes.
    """
    cells = grid.filter("v IS NOT NULL").select(node(F.col("r"), F.col("c")).alias("id"), "r", "c", F.floor(F.col("v") + 0.5).alias("k"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    far = cells.select("id", "k", F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps])).alias("n"))
    pairs = far.select(F.col("id").alias("a"), "k", "n.r", "n.c").join(cells.select(F.col("id").alias("b"), "r", "c", "k"), ["r", "c", "k"]).select("a", "b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = written(cells.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = state.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        # the label's own new label is as good, and further on
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new").select("id", "label", F.least("new", "far").alias("new")))
        state = step.select("id", F.col("new").alias("label"))
        if not step.filter("new <> label").take(1):
            return cell_of(state).join(grid, ["r", "c"]).select("r", "c", "v", "label")


def patches(grid: DataFrame, eight: bool = False) -> DataFrame:
    """(r, c, v, label) with labels from 1 in row-major order of their first cells."""
    t = written(label_regions(grid, eight))
    order = value_ranks(t.select("label").distinct(), "label").select("label", (F.col("below") + 1).cast("int").alias("patch"))
    return t.join(order, "label").select("r", "c", "v", F.col("patch").alias("label"))


def patch_metrics(labelled: DataFrame, cs: float = 1.0) -> DataFrame:
    """Area, perimeter, their ratio and the fractal dimension of each patch of (r, c, v, label)."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    near = labelled.select("label", "v", F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps])).alias("n"))
    other = labelled.select("r", "c", F.col("v").alias("w"))
    faces = near.select("label", "v", "n.r", "n.c").join(other, ["r", "c"], "left").groupBy("label").agg(F.sum((F.col("w").isNull() | (F.col("w") != F.col("v"))).cast("long")).alias("edges"))
    t = labelled.groupBy("label").agg(F.first("v").cast("long").alias("class"), F.count("*").alias("cells")).join(faces, "label")
    area, rim = F.col("cells") * (cs * cs), F.col("edges") * cs
    frac = F.when((area > 1) & (rim > 0), 2 * F.log(0.25 * rim) / F.log(F.when(area > 1, area))).otherwise(1.0)
    return t.select("label", "class", "cells", "edges", (rim / area).alias("para"), frac.alias("frac"))


def class_metrics(grid: DataFrame, patch_table: DataFrame) -> DataFrame:
    """Share, patches, mean area, aggregation and cohesion of each class."""
    total = grid.agg(F.count("v").cast("double").alias("total"))
    steps = [(0, 1), (1, 0)]
    near = grid.filter("v IS NOT NULL").select("v", F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps])).alias("n"))
    like = near.select(F.col("v").alias("k"), "n.r", "n.c").join(grid, ["r", "c"]).filter("v = k").groupBy(F.col("k").cast("long").alias("class")).agg(F.count("*").cast("double").alias("g"))
    p = patch_table.groupBy("class").agg(
        F.sum("cells").cast("double").alias("n"), F.count("*").alias("patches"), F.sum("edges").cast("double").alias("sp"), F.sum(F.col("edges") * F.sqrt(F.col("cells").cast("double"))).alias("sq")
    )
    t = p.join(like, "class", "left").crossJoin(F.broadcast(total))
    most = "CASE WHEN n > 1 THEN 2 * n - 2 * ceil(sqrt(n)) ELSE 1 END"
    return t.selectExpr(
        "class", "n / total AS proportion", "patches", "n / patches AS mean_area", f"CASE WHEN {most} > 0 THEN least(coalesce(g, 0D) / ({most}) * 100, 100D) ELSE 0D END AS aggregation",
        "greatest(least((1 - sp / sq) / (1 - 1 / sqrt(total)) * 100, 100D), 0D) AS cohesion",
    )


def landscape(grid: DataFrame) -> DataFrame:
    """One row: Shannon and Simpson diversity, classes and cells."""
    p = grid.filter("v IS NOT NULL").groupBy(F.floor(F.col("v") + 0.5).alias("k")).agg(F.count("*").cast("double").alias("n"))
    p = p.crossJoin(F.broadcast(p.agg(F.sum("n").alias("t"))))
    share = F.col("n") / F.col("t")
    return p.agg((-F.sum(share * F.log(share))).alias("shdi"), (1 - F.sum(share * share)).alias("sidi"), F.count("*").alias("classes"), F.sum("n").cast("long").alias("cells"))
