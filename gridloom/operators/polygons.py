"""Polygons as rings: overlay, dissolve, buffers, simplification, clipping and rasterising.

A region is a list of closed or open rings of (x, y); a place is inside if an odd number
of rings surround it, so holes are rings too and a multipolygon is one list. In tables
a region is ``array<array<struct<x: double, y: double>>>``. Overlay cuts all edges where
they meet, asks for each piece what lies on its two sides, keeps the pieces where the answer
changes, and joins them to rings with the inside on the left. Layers meet by a join on the
cells of a coarse grid that boxes touch, each pair once, and only pairs travel on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.plans.lineage import workers_see_package

REGION = "array<array<struct<x: double, y: double>>>"
Ring = list[tuple[float, float]]
OPERATIONS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "intersection": np.logical_and,
    "union": np.logical_or,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": np.logical_xor,
}
_SNAP = 1e-9


def _edges(rings: Sequence[Ring]) -> np.ndarray:
    parts = []
    for ring in rings:
        p = np.array([(x, y) for x, y in ring], float).reshape(-1, 2)
        if len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) >= 3:
            parts.append(np.stack([p, np.roll(p, -1, 0)], 1))
    return np.concatenate(parts) if parts else np.zeros((0, 2, 2))


def within(rings: Sequence[Ring], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an odd number of rings surround each place."""
    odd = np.zeros(np.shape(x), bool)
    for (ax, ay), (bx, by) in _edges(rings):
        cross = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= cross & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def _pieces(edges: np.ndarray, snap: float) -> np.ndarray:
    """All edges cut where any two meet or touch; each piece once, from its lower end."""
    out: set[tuple[tuple[float, float], tuple[float, float]]] = set()
    p, d = edges[:, 0], edges[:, 1] - edges[:, 0]
    known: dict[tuple[int, int], tuple[float, float]] = {}

    def spot(x: float, y: float) -> tuple[float, float]:
        """The first place named within a step or two of here: edges that meet share it."""
        i, j = round(x / snap), round(y / snap)
        for k in (0, -1, 1):
            for m in (0, -1, 1):
                if (i + k, j + m) in known:
                    return known[i + k, j + m]
        known[i, j] = (x, y)
        return x, y

    for x, y in p.tolist():
        spot(x, y)
    for i in range(len(edges)):
        length = d[i] @ d[i]
        if length == 0:
            continue
        at = [0.0, 1.0]
        w = p - p[i]
        cross = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        flat = np.abs(cross) <= 1e-14 * max(length, 1e-300) ** 0.5 * np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / cross
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        eps = snap / math.sqrt(length)
        met = ~flat & (t > -eps) & (t < 1 + eps) & (u >= -1e-9) & (u <= 1 + 1e-9)
        at += t[met].tolist()
        # ends of edges that lie along this one
        for q in (p, p + d):
            v = q - p[i]
            away = np.abs(v[:, 0] * d[i, 1] - v[:, 1] * d[i, 0]) / math.sqrt(length)
            along = (v @ d[i]) / length
            at += along[(away <= snap) & (along > 0) & (along < 1)].tolist()
        q = [spot(x, y) for x, y in (p[i] + np.clip(np.unique(at), 0, 1)[:, None] * d[i]).tolist()]
        out.update((min(a, b), max(a, b)) for a, b in zip(q, q[1:]) if a != b)
    return np.array(sorted(out)).reshape(-1, 2, 2)


def overlay(a: Sequence[Ring], b: Sequence[Ring], how: str = "union") -> list[Ring]:
    """The rings of an operation on two regions, with the inside on the left: outer rings run
    anticlockwise, holes clockwise. An empty result has no rings. Places nearer than about 1e-9 of the
    extent are one; where that leaves an open ring, coarser steps are tried."""
    for step in (_SNAP, 10 * _SNAP, 100 * _SNAP, 1000 * _SNAP):
        try:
            return _overlay(a, b, how, step)
        except KeyError:
            continue
    raise ValueError("the edges of these regions do not close at any step")


def _overlay(a: Sequence[Ring], b: Sequence[Ring], how: str, step: float) -> list[Ring]:
    op = OPERATIONS[how]
    edges = np.concatenate([_edges(a), _edges(b)])
    if not len(edges):
        return []
    extent = float(np.ptp(edges.reshape(-1, 2), axis=0).max())
    snap = max(extent, 1e-12) * step
    base = edges.reshape(-1, 2).min(0)
    shift = lambda rings: [[(x - base[0], y - base[1]) for x, y in ring] for ring in rings]  # noqa: E731  precision near the region
    a, b = shift(a), shift(b)
    pieces = _pieces(np.concatenate([_edges(a), _edges(b)]), snap)
    if not len(pieces):
        return []
    mid, d = pieces.mean(1), pieces[:, 1] - pieces[:, 0]
    n = np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(d[:, 0], d[:, 1])[:, None] * snap * 16
    sides = []
    for s in (1, -1):
        x, y = (mid + s * n).T
        sides.append(op(within(a, x, y), within(b, x, y)))
    keep = sides[0] != sides[1]
    starts = np.where(sides[0][:, None], pieces[:, 0], pieces[:, 1])[keep]
    ends = np.where(sides[0][:, None], pieces[:, 1], pieces[:, 0])[keep]
    after: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for p, q in zip(map(tuple, starts.tolist()), map(tuple, ends.tolist())):
        after.setdefault(p, []).append(q)
    rings = []
    while after:
        start = min(after)
        ring, p, came = [start], start, None
        while True:
            ways = after[p]
            if came is None or len(ways) == 1:
                q = ways.pop(0)
            else:  # the sharpest turn to the left keeps touching rings apart
                back = math.atan2(came[1] - p[1], came[0] - p[0])
                q = min(ways, key=lambda w: (back - math.atan2(w[1] - p[1], w[0] - p[0])) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
                ways.remove(q)
            if not ways:
                del after[p]
            came, p = p, q
            if p == start:
                break
            ring.append(p)
        ring = _straightened(ring, snap)
        if len(ring) >= 3 and abs(area([ring])) > snap * snap:
            rings.append([(x + base[0], y + base[1]) for x, y in ring])
    return rings


def _straightened(ring: Ring, snap: float) -> Ring:
    """Without the corners that lie on the line of their neighbours."""
    out = []
    for i, q in enumerate(ring):
        p, r = out[-1] if out else ring[-1], ring[(i + 1) % len(ring)]
        turn = (q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])
        if abs(turn) > snap * max(math.dist(p, q), math.dist(q, r)):
            out.append(q)
    return out


def area(rings: Sequence[Ring]) -> float:
    """Signed: anticlockwise rings add, clockwise ones (holes) take away."""
    total = 0.0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            total += ax * by - bx * ay
    return total / 2


def dissolve(regions: Sequence[Sequence[Ring]]) -> list[Ring]:
    """The union of many regions, pairwise like a tournament, so that each works on few edges for long."""
    held = [list(r) for r in regions]
    if len(held) == 1:
        return overlay(held[0], [], "union")
    while len(held) > 1:
        held = [overlay(held[i], held[i + 1] if i + 1 < len(held) else [], "union") for i in range(0, len(held), 2)]
    return held[0] if held else []


def _disc(x: float, y: float, r: float, corners: int) -> Ring:
    return [(x + r * math.cos(2 * math.pi * i / corners), y + r * math.sin(2 * math.pi * i / corners)) for i in range(corners)]


def buffer_line(line: Ring, distance: float, corners: int = 16) -> list[Ring]:
    """All places within ``distance`` of a line (or point), its round parts as ``corners``-gons."""
    parts: list[list[Ring]] = [[_disc(x, y, distance, corners)] for x, y in line]
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        n = math.hypot(bx - ax, by - ay)
        if n:
            u, v = -(by - ay) / n * distance, (bx - ax) / n * distance
            parts.append([[(ax - u, ay - v), (bx - u, by - v), (bx + u, by + v), (ax + u, ay + v)]])
    return dissolve(parts)


def buffer_region(rings: Sequence[Ring], distance: float, corners: int = 16) -> list[Ring]:
    """A region grown by ``distance``, or shrunk if it is negative."""
    rim = dissolve([buffer_line([*ring, ring[0]], abs(distance), corners) for ring in rings]) if distance else []
    return overlay(rings, rim, "union" if distance >= 0 else "difference")


def simplify_areas(line: Ring, least: float, closed: bool = False) -> Ring:
    """Visvalingam and Whyatt: the point of the smallest triangle with its neighbours goes, until all are ``least``.

    Ends of open lines stay, and so do three points of a ring. A triangle counts at least as the last one removed.
    """
    n, floor = len(line), 3 if closed else 2
    before = {i: (i - 1) % n if closed else i - 1 for i in range(n)}
    after = {i: (i + 1) % n if closed else i + 1 for i in range(n)}
    size = lambda i: abs(area([[line[before[i]], line[i], line[after[i]]]]))
    inner = range(n) if closed else range(1, n - 1)
    now = {i: size(i) for i in inner}
    heap = [(v, i) for i, v in now.items()]
    heapq.heapify(heap)
    gone: set[int] = set()
    while heap and n - len(gone) > floor:
        v, i = heapq.heappop(heap)
        if i in gone or v != now[i]:
            continue
        if v >= least:
            break
        gone.add(i)
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if j in now and j not in gone:
                now[j] = max(v, size(j))
                heapq.heappush(heap, (now[j], j))
    return [p for i, p in enumerate(line) if i not in gone]


# tables


def rings_of(value) -> list[Ring]:
    return [[(p["x"], p["y"]) for p in ring] for ring in value] if value is not None else []


def value_of(rings: Sequence[Ring]) -> list[list[dict[str, float]]]:
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def region_area(col: str | Column) -> Column:
    """The signed sum over rings, in SQL."""
    def one(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2

    return F.aggregate(F.transform(col, one), F.lit(0.0), lambda s, v: s + v)


def _extent(col: str) -> list[Column]:
    flat = F.flatten(F.col(col))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def touching(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of rows of (a_id, a) and (b_id, b) whose boxes meet, each once: in the first cell that both touch."""

    def dealt(df: DataFrame, g: str) -> DataFrame:
        df = df.withColumns(dict(zip([f"{g}x0", f"{g}y0", f"{g}x1", f"{g}y1"], _extent(g))))
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return df.filter(f"{g}x0 is not null").withColumn("gx", span(f"{g}x0", f"{g}x1")).withColumn("gy", span(f"{g}y0", f"{g}y1"))

    j = dealt(left, "a").join(dealt(right, "b"), ["gx", "gy"]).filter("ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1")
    first = (F.col("gx") == F.floor(F.greatest("ax0", "bx0") / cell)) & (F.col("gy") == F.floor(F.greatest("ay0", "by0") / cell))
    return j.filter(first).select("a_id", "a", "b_id", "b")


def arrow_schema(kinds: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(kinds))


def map_rows(df: DataFrame, fn: Callable[[list[dict]], list[dict]], kinds: str) -> DataFrame:
    """``fn`` over each batch as a list of dictionaries; regions have rings of any number and length, which pandas columns cannot hold."""
    workers_see_package(df.sparkSession)
    schema = arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist(fn(b.to_pylist()), schema=schema)

    return df.mapInArrow(run, kinds)


def kinds_of(df: DataFrame, *but: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in but)


def mapped(df: DataFrame, fn: Callable[..., list[Ring]], *cols: str, name: str = "region") -> DataFrame:
    """Adds ``name``: a region from regions in ``cols``."""
    rest = kinds_of(df, name)
    return map_rows(df, lambda rows: [r | {name: value_of(fn(*(rings_of(r[c]) for c in cols)))} for r in rows], f"{rest}, `{name}` {REGION}")


def overlay_layers(left: DataFrame, right: DataFrame, how: str, cell: float) -> DataFrame:
    """Regions of (id, region) layers: for intersection one a pair (a_id, b_id, region); for difference one a left row
    (a_id, region), all of the right layer taken away; for union and symmetric difference one a row of either layer's
    own part, and one a common part of a pair (union only). Rows of one layer do not overlap each other in well-formed layers.
    """
    workers_see_package(left.sparkSession)
    a = left.select(F.col("id").alias("a_id"), F.col("region").alias("a"))
    b = right.select(F.col("id").alias("b_id"), F.col("region").alias("b"))
    pairs = touching(a, b, cell)
    if how == "intersection":
        out = mapped(pairs, lambda x, y: overlay(x, y, "intersection"), "a", "b")
        return out.filter(F.size("region") > 0).select("a_id", "b_id", "region")

    def rest(own: DataFrame, i: str, g: str, other: str) -> DataFrame:
        cuts = pairs.groupBy(i).agg(F.collect_list(other).alias("cuts"))  # what touches one region
        j = own.join(cuts, i, "left")

        def cut(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                left_over = rings_of(r[g])
                for c in r["cuts"] or ():
                    left_over = overlay(left_over, rings_of(c), "difference")
                out.append({i: r[i], "region": value_of(left_over)})
            return out

        return map_rows(j, cut, f"{i} {own.schema[i].dataType.simpleString()}, region {REGION}").filter(F.size("region") > 0)

    mine = rest(a, "a_id", "a", "b")
    if how == "difference":
        return mine
    none = lambda n, like: F.lit(None).cast(like.schema[n].dataType).alias(n)
    both = mine.select("a_id", none("b_id", b), "region").unionByName(rest(b, "b_id", "b", "a").select(none("a_id", a), "b_id", "region"))
    if how == "symmetric_difference":
        return both
    return both.unionByName(overlay_layers(left, right, "intersection", cell))


def dissolved(df: DataFrame, key: str, cell: float | None = None) -> DataFrame:
    """(key, region): the union of the regions of each key. Equal regions of a key are one. If a cell is given, first within
    pieces of about 200 rows of the cells of a coarse grid, so that neither a key nor a cell with most of the rows is one
    task, then of what those give within the cells, and of what these give."""
    workers_see_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    kinds = f"{key} {kind}, region {REGION}"
    schema = arrow_schema(kinds)

    def one(t: pa.Table) -> pa.Table:
        rows = t.select([key, "region"]).to_pylist()
        return pa.Table.from_pylist([{key: rows[0][key], "region": value_of(dissolve([rings_of(r["region"]) for r in rows]))}], schema=schema)

    def within_cell(t: pa.Table) -> pa.Table:
        got = one(t)
        return got.append_column("_x", t["_x"].slice(0, 1)).append_column("_y", t["_y"].slice(0, 1))

    df = df.select(key, "region").dropDuplicates([key, "region"])
    if cell is not None:
        x0, y0, *_ = _extent("region")
        df = df.withColumns({"_a": x0, "_b": y0}).withColumns({"_x": F.floor(F.col("_a") / cell), "_y": F.floor(F.col("_b") / cell)})
        at = Window.partitionBy(key, "_x", "_y")
        # strips of a cell: near rows meet first, as their unions have fewer edges
        df = df.withColumn("_n", F.ceil(F.count("*").over(at) / 200)).withColumn("_p", F.floor((F.col("_a") / cell - F.col("_x")) * F.col("_n")))
        df = df.groupBy(key, "_x", "_y", "_p").applyInArrow(within_cell, f"{kinds}, _x long, _y long")
        df = df.groupBy(key, "_x", "_y").applyInArrow(one, kinds)
    return df.select(key, "region").groupBy(key).applyInArrow(one, kinds)


def rasterized(features: DataFrame, x0: float, y0: float, w: float, h: float, rows: int, cols: int) -> DataFrame:
    """(r, c, v): cells whose middle a region of (seq, value, region) holds; the last in order wins.

    Regions are cut into runs of cells along rows; runs, not cells, come from Python, and are opened in the JVM.
    """

    def scan(rows_: list[dict]) -> list[dict]:
        out = []
        for f in rows_:
            e = _edges(rings_of(f["region"]))
            if not len(e):
                continue
            ends = (e[:, :, 1] - y0) / h - 0.5
            for r in range(max(0, math.ceil(ends.min())), min(rows - 1, math.floor(ends.max())) + 1):
                y = y0 + (r + 0.5) * h
                on = e[(e[:, 0, 1] > y) != (e[:, 1, 1] > y)]
                xs = np.sort((on[:, 1, 0] - on[:, 0, 0]) * (y - on[:, 0, 1]) / (on[:, 1, 1] - on[:, 0, 1]) + on[:, 0, 0])
                for a, z in zip(xs[::2], xs[1::2]):
                    first, last = math.ceil((a - x0) / w - 0.5), math.ceil((z - x0) / w - 0.5) - 1
                    if max(first, 0) <= min(last, cols - 1):
                        out.append({"r": r, "first": max(first, 0), "last": min(last, cols - 1), "seq": f["seq"], "v": f["value"]})
        return out

    runs = map_rows(features.select("seq", F.col("value").cast("double").alias("value"), "region"), scan, "r int, first int, last int, seq long, v double")
    cells = runs.select("r", F.explode(F.sequence("first", "last")).alias("c"), "seq", "v")
    return cells.groupBy("r", "c").agg(F.max_by("v", "seq").alias("v"))


def clip_raster(grid: DataFrame, features: DataFrame, x0: float, y0: float, w: float, h: float, rows: int, cols: int) -> DataFrame:
    """The grid with nulls where no region holds the middle of the cell."""
    held = rasterized(features, x0, y0, w, h, rows, cols).select("r", "c", F.lit(True).alias("held"))
    out = grid.join(held, ["r", "c"], "left")
    return out.select(*[F.when(F.col("held"), F.col(c)).alias(c) if c not in ("r", "c") else F.col(c) for c in grid.columns])
