"""Order-dependent and linear-algebra kernels on whole arrays, run one grid (or tile) a task.

A kernel takes float arrays (NaN is nodata) and returns arrays of the same
shape. :func:`run` groups a table by its grid id, so many grids or basins run side
by side; kernels of a bounded reach run over tiles with a halo, so that a grid of any
size is dealt over all tasks. :func:`flooded` fills depressions over tiles by the
graph of their rims. Only kernels without such a form need a grid whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lineage import workers_see_package, written

STEPS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
FAR = tuple(math.hypot(*s) for s in STEPS)


def run(
    df: DataFrame,
    kernel: Callable[..., dict[str, np.ndarray] | np.ndarray],
    out: dict[str, str],
    bands: tuple[str, ...] = ("v",),
    by: str | None = None,
    halo: int | None = None,
    tile: int = 512,
) -> DataFrame:
    """(r, c, *out): ``kernel`` over the arrays of ``bands``, for each ``by`` (one grid if None).

    A kernel whose results hang on cells within ``halo`` rows and columns only runs tile by
    tile: each tile's group holds the cells within ``halo`` of it too (a share of about
    4 * halo / tile more), and gives its own cells. Without ``halo`` a grid is one group.
    """
    workers_see_package(df.sparkSession)
    df = df.select("r", "c", *bands, *([by] if by else []))
    keys = ["_g"]
    df = df.withColumn("_g", F.lit(0) if by is None else F.col(by))
    if halo is not None:
        near = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile)).cast("array<int>"))
        df = df.withColumn("_tr", near("r")).withColumn("_tc", near("c"))
        keys += ["_tr", "_tc"]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(p["r"].min()), int(p["c"].min())
        r, c = p["r"].to_numpy() - r0, p["c"].to_numpy() - c0
        own = np.ones(len(p), bool)
        if halo is not None:
            own = (p["r"].to_numpy() // tile == p["_tr"].to_numpy()) & (p["c"].to_numpy() // tile == p["_tc"].to_numpy())
        if not own.any():  # cells beside an empty tile
            return pd.DataFrame({"r": [], "c": []} | {k: [] for k in out} | ({by: []} if by else {}))
        arrays = []
        for b in bands:
            a = np.full((r.max() + 1, c.max() + 1), np.nan)
            a[r, c] = p[b].to_numpy(float)
            arrays.append(a)
        got = kernel(*arrays)
        got = got if isinstance(got, dict) else {next(iter(out)): got}
        res = pd.DataFrame({"r": p["r"], "c": p["c"]})
        for k, t in out.items():
            x = np.asarray(got[k], float)[r, c]
            res[k] = pd.Series(x, index=p.index).where(np.isfinite(x)) if t == "double" else np.nan_to_num(x).astype("int32")
        if by is not None:
            res[by] = p[by]
        return res[own]

    schema = "r int, c int, " + ", ".join(f"{k} {t}" for k, t in out.items())
    if by is not None:
        schema += f", {by} {df.schema[by].dataType.simpleString()}"
    return df.groupBy(*keys).applyInPandas(one, schema)


def shifted(a: np.ndarray, dr: int, dc: int, fill: float = np.nan) -> np.ndarray:
    """The neighbour at (dr, dc) of every cell."""
    out = np.full(a.shape, fill)
    n, m = a.shape
    if abs(dr) >= n or abs(dc) >= m:
        return out
    out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[max(0, dr) : n - max(0, -dr), max(0, dc) : m - max(0, -dc)]
    return out


def inside(shape, r, c) -> bool:
    return 0 <= r < shape[0] and 0 <= c < shape[1]


# hydrology


def priority_flood(z: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Depressions filled from the border and from nodata inwards, lowest cell first."""
    out = np.where(np.isnan(z), np.nan, np.inf)
    near_gap = np.zeros(z.shape, bool)
    for dr, dc in STEPS:
        near_gap |= np.isnan(shifted(z, dr, dc))
    seeds = np.argwhere(near_gap & ~np.isnan(z))
    heap = [(z[r, c], r, c) for r, c in seeds.tolist()]
    done = np.isnan(z)
    for _, r, c in heap:
        out[r, c], done[r, c] = z[r, c], True
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        for dr, dc in STEPS:
            a, b = r + dr, c + dc
            if inside(z.shape, a, b) and not done[a, b]:
                done[a, b] = True
                out[a, b] = max(z[a, b], h + eps)
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def rim_flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tile filled as if its rim were an outlet, and the flat index of the rim (or outlet) cell whose water holds each cell."""
    level, owner = np.where(np.isnan(z), np.nan, np.inf), np.full(z.shape, -1)
    n, m = z.shape
    seeds = np.zeros(z.shape, bool)
    for dr, dc in STEPS:
        seeds |= np.isnan(shifted(z, dr, dc))
    seeds &= ~np.isnan(z)
    heap = [(z[r, c], r, c) for r, c in np.argwhere(seeds).tolist()]
    for h, r, c in heap:
        level[r, c], owner[r, c] = h, r * m + c
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        for dr, dc in STEPS:
            a, b = r + dr, c + dc
            if inside(z.shape, a, b) and owner[a, b] < 0 and not np.isnan(z[a, b]):
                level[a, b], owner[a, b] = max(z[a, b], h), owner[r, c]
                heapq.heappush(heap, (level[a, b], a, b))
    return level, owner


def flooded(df: DataFrame, tile: int = 512) -> DataFrame:
    """(r, c, v): :func:`priority_flood` over tiles of a grid of any size (after Barnes 2016).

    Each tile is filled down to its rim alone, which gives every cell the rim cell whose water
    holds it and the passes between the waters of two rim cells. Waters of neighbouring tiles meet
    across their rims. The lowest way out from every rim cell is solved on that graph, about
    4 / tile of the cells, in one task; then each tile raises its cells to what their water needs.
    """
    workers_see_package(df.sparkSession)
    g = df.select("r", "c", "v", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
    # one ring of neighbours tells a grid's edge and gaps from a tile's rim
    ring = lambda x: F.explode(F.sequence(F.floor((F.col(x) - 1) / tile), F.floor((F.col(x) + 1) / tile)).cast("array<int>"))
    wide = df.filter("v is not null").select("r", "c", "v", ring("r").alias("tr")).select("r", "c", "v", "tr", ring("c").alias("tc"))

    def local(p: pd.DataFrame):
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        z = np.full((tile + 2, tile + 2), np.nan)
        z[p["r"] - tr * tile + 1, p["c"] - tc * tile + 1] = p["v"]
        return tr, tc, z, *rim_flood(z[1:-1, 1:-1])

    def names(owner: np.ndarray, tr: int, tc: int) -> np.ndarray:
        r, c = np.divmod(owner, tile)
        return ((r + tr * tile).astype(np.int64) << 32) | (c + tc * tile)

    def links(p: pd.DataFrame) -> pd.DataFrame:
        tr, tc, z, level, owner = local(p)
        if (owner < 0).all():
            return pd.DataFrame({"a": [], "b": [], "h": []})
        a_, b_, h_ = [], [], []
        for dr, dc in STEPS[:4]:
            other, high = shifted(owner.astype(float), dr, dc, -1.0), shifted(level, dr, dc)
            on = (owner >= 0) & (other >= 0) & (other != owner)
            a_.append(names(owner[on], tr, tc))
            b_.append(names(other[on].astype(np.int64), tr, tc))
            h_.append(np.maximum(level[on], high[on]))
        gap = np.zeros(owner.shape, bool)  # beside the grid's edge or a gap: the way out
        for dr, dc in STEPS:
            there = shifted(z, dr, dc)[1:-1, 1:-1]
            gap |= np.isnan(there)
            edge = np.zeros(owner.shape, bool)
            if dr:
                edge[0 if dr < 0 else -1, :] = True
            if dc:
                edge[:, 0 if dc < 0 else -1] = True
            on = edge & (owner >= 0) & ~np.isnan(there)
            r, c = np.nonzero(on)
            beyond = ((r + dr < 0) | (r + dr >= tile) | (c + dc < 0) | (c + dc >= tile))
            r, c = r[beyond], c[beyond]
            a_.append(names(owner[r, c], tr, tc))
            b_.append(((r + dr + tr * tile).astype(np.int64) << 32) | (c + dc + tc * tile))  # a rim cell of the next tile: its own water
            h_.append(np.maximum(z[r + 1, c + 1], there[r, c]))
        on = gap & (owner >= 0)
        a_.append(names(owner[on], tr, tc))
        b_.append(np.full(int(on.sum()), -1, np.int64))
        h_.append(z[1:-1, 1:-1][on])
        out = pd.DataFrame({"a": np.concatenate(a_), "b": np.concatenate(b_), "h": np.concatenate(h_)})
        return out.groupby(["a", "b"], as_index=False)["h"].min()

    def ways_out(p: pd.DataFrame) -> pd.DataFrame:
        node, at = np.unique(np.concatenate([p["a"], p["b"]]), return_inverse=True)
        a, b = np.split(at, 2)
        h = p["h"].to_numpy()
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        to, cost = np.concatenate([b, a])[order], np.concatenate([h, h])[order]
        first = np.searchsorted(np.concatenate([a, b])[order], np.arange(len(node) + 1))
        best = np.full(len(node), np.inf)
        heap = [(-np.inf, int(np.searchsorted(node, -1)))] if (node == -1).any() else []
        while heap:
            level, i = heapq.heappop(heap)
            if level >= best[i]:
                continue
            best[i] = level
            for j in range(first[i], first[i + 1]):
                new = max(level, cost[j])
                if new < best[to[j]]:
                    heapq.heappush(heap, (new, int(to[j])))
        return pd.DataFrame({"a": node, "level": best})

    graph = wide.groupBy("tr", "tc").applyInPandas(links, "a long, b long, h double")
    levels = written(graph.groupBy(F.lit(0).alias("_g")).applyInPandas(ways_out, "a long, level double"))
    levels = levels.filter("a >= 0").select("level", (F.floor(F.shiftright("a", 32) / tile)).cast("int").alias("tr"), F.floor(F.col("a").bitwiseAND(F.lit(0xFFFFFFFF)) / tile).cast("int").alias("tc"), "a")

    def raise_(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"r": [], "c": [], "v": []})
        tr, tc, _, level, owner = local(left)
        out = level
        if len(right):
            right = right.sort_values("a")
            known, need = right["a"].to_numpy(), right["level"].to_numpy()
            ids = names(np.maximum(owner, 0), tr, tc)
            i = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            out = np.where(owner >= 0, np.maximum(level, np.where(known[i] == ids, need[i], -np.inf)), np.nan)
        own = left[(left["r"] // tile == tr) & (left["c"] // tile == tc)]
        v = out[own["r"].to_numpy() - tr * tile, own["c"].to_numpy() - tc * tile]
        return pd.DataFrame({"r": own["r"], "c": own["c"], "v": v})

    filled = wide.groupBy("tr", "tc").cogroup(levels.groupBy("tr", "tc")).applyInPandas(raise_, "r int, c int, v double")
    return filled.unionByName(g.filter("v is null").select("r", "c", "v"))


def fill_sinks(z: np.ndarray, min_slope: float = 0.01) -> np.ndarray:
    """Planchon and Darboux: a high water surface lowered until it rests on cells or on its neighbours."""
    edge = np.zeros(z.shape, bool)
    for dr, dc in STEPS:
        edge |= np.isnan(shifted(z, dr, dc))
    w = np.where(np.isnan(z), np.nan, np.where(edge, z, np.inf))
    while True:
        low = np.full(z.shape, np.inf)
        for (dr, dc), d in zip(STEPS, FAR):
            low = np.fmin(low, shifted(w, dr, dc) + min_slope * d)
        new = np.where(edge | np.isnan(z), w, np.minimum(w, np.maximum(z, low)))
        if np.array_equal(new, w, equal_nan=True):
            return w
        w = new


def d8(z: np.ndarray, flats: bool = True) -> np.ndarray:
    """Codes 1 to 8 of the steepest drop, 0 without one; flats drain to their lower rim, away from higher ground."""
    drops = np.stack([(z - shifted(z, dr, dc)) / d for (dr, dc), d in zip(STEPS, FAR)])
    drops = np.nan_to_num(drops, nan=-np.inf)
    best = drops.argmax(0)
    out = np.where(np.isnan(z) | (drops.max(0) <= 0), 0, best + 1)
    return resolve_flats(z, out) if flats else out


def resolve_flats(z: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two gradients over flats: away from higher cells, and (twice) towards outlets at the same level."""
    d = d.copy()
    n, m = z.shape
    flat = (d == 0) & ~np.isnan(z)
    flat[[0, -1], :] = False
    flat[:, [0, -1]] = False
    towards = np.full(z.shape, -1)
    level = [(r, c) for r in range(n) for c in range(m) if not flat[r, c] and not np.isnan(z[r, c]) and any(inside(z.shape, r + a, c + b) and flat[r + a, c + b] and z[r + a, c + b] == z[r, c] for a, b in STEPS)]
    dist, seen = 1, set(level)
    while level:
        nxt = []
        for r, c in level:
            for a, b in STEPS:
                p = (r + a, c + b)
                if inside(z.shape, *p) and flat[p] and towards[p] < 0 and z[p] == z[r, c] and p not in seen:
                    towards[p] = dist
                    seen.add(p)
                    nxt.append(p)
        level, dist = nxt, dist + 1
    away = np.zeros(z.shape, int)
    level = [tuple(p) for p in np.argwhere(flat & (towards >= 0)) if any(inside(z.shape, p[0] + a, p[1] + b) and z[p[0] + a, p[1] + b] > z[tuple(p)] for a, b in STEPS)]
    dist, seen = 1, set(level)
    while level:
        nxt = []
        for p in level:
            away[p] = dist
            for a, b in STEPS:
                q = (p[0] + a, p[1] + b)
                if inside(z.shape, *q) and flat[q] and towards[q] >= 0 and z[q] == z[p] and q not in seen:
                    seen.add(q)
                    nxt.append(q)
        level, dist = nxt, dist + 1
    top = away.max()
    cost = np.where(towards >= 0, 2 * towards + np.where(away > 0, top - away, 0), 0)
    for r, c in np.argwhere(flat & (towards >= 0)):
        best = None
        for k, (a, b) in enumerate(STEPS, 1):
            q = (r + a, c + b)
            if inside(z.shape, *q) and z[q] == z[r, c]:
                key = cost[q] if towards[q] >= 0 else -1
                if key >= cost[r, c]:  # up the gradients a diagonal could run in a circle
                    continue
                key /= FAR[k - 1]
                if best is None or key < best[0]:
                    best = (key, k)
        d[r, c] = best[1] if best else 0
    return d


def receivers(d: np.ndarray) -> np.ndarray:
    """Flat index of the cell that each cell drains to, -1 for none."""
    n, m = d.shape
    out = np.full(n * m, -1)
    for r, c in np.argwhere((d >= 1) & (d <= 8)):
        a, b = r + STEPS[int(d[r, c]) - 1][0], c + STEPS[int(d[r, c]) - 1][1]
        if inside(d.shape, a, b):
            out[r * m + c] = a * m + b
    return out


def downstream_order(to: np.ndarray) -> list[int]:
    """Cells, each before the one that it drains to; cells of cycles are left out."""
    wait = np.bincount(to[to >= 0], minlength=len(to))
    ready = np.flatnonzero(wait == 0).tolist()
    out = []
    while ready:
        i = ready.pop()
        out.append(i)
        j = to[i]
        if j >= 0:
            wait[j] -= 1
            if wait[j] == 0:
                ready.append(int(j))
    return out


def d8_accumulation(d: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(d.size) if weight is None else np.nan_to_num(weight).ravel()
    acc, to = np.zeros(d.size), receivers(d)
    for i in downstream_order(to):
        if to[i] >= 0:
            acc[to[i]] += acc[i] + w[i]
    return acc.reshape(d.shape)


def mfd(z: np.ndarray, exponent: float | np.ndarray = 1.1) -> np.ndarray:
    """Quinn's multiple flow: shares by (slope * contour length) ^ exponent; the cell itself is not counted."""
    contour = [0.5 if i % 2 == 0 else 0.354 for i in range(8)]
    p = np.broadcast_to(exponent, z.shape)
    acc = np.where(np.isnan(z), 0.0, 1.0)
    order = np.argsort(-np.nan_to_num(z, nan=-np.inf).ravel(), kind="stable")
    for i in order.tolist():
        r, c = divmod(i, z.shape[1])
        if np.isnan(z[r, c]):
            continue
        parts = []
        for k, (a, b) in enumerate(STEPS):
            q = (r + a, c + b)
            if inside(z.shape, *q) and z[r, c] - z[q] > 0:
                parts.append((q, ((z[r, c] - z[q]) / FAR[k] * contour[k]) ** p[r, c]))
        total = sum(w for _, w in parts)
        for q, w in parts:
            acc[q] += acc[r, c] * w / total if total > 0 else 0
    return np.where(np.isnan(z), np.nan, acc - 1)


def mfd_adaptive(z: np.ndarray, scale: float = 8.9, least: float = 0.5, most: float = 20.0) -> np.ndarray:
    """Qin's exponent: from the tangent of the steepest downslope."""
    steep = np.zeros(z.shape)
    for (dr, dc), d in zip(STEPS, FAR):
        steep = np.fmax(steep, (z - shifted(z, dr, dc)) / d)
    return mfd(z, np.clip(scale * np.minimum(steep, 1) + 1.1, least, most))


def dinf(z: np.ndarray) -> np.ndarray:
    """Tarboton's angle of steepest descent over eight facets, counter-clockwise from east; -1 for pits."""
    best, angle = np.zeros(z.shape), np.full(z.shape, -1.0)
    for k in range(8):
        first, second = (k, k + 1) if k % 2 == 0 else (k + 1, k)
        e1, e2 = shifted(z, *STEPS[first % 8]), shifted(z, *STEPS[second % 8])
        s1, s2 = z - e1, e1 - e2
        r = np.arctan2(s2, s1)
        s = np.hypot(s1, s2)
        low, high = r < 0, r > math.pi / 4
        s = np.where(low, s1, np.where(high, (z - e2) / math.sqrt(2), s))
        r = np.where(low, 0, np.where(high, math.pi / 4, r))
        a = k * math.pi / 4 + r if k % 2 == 0 else (k + 1) * math.pi / 4 - r
        ok = ~np.isnan(s) & (s > best)
        best, angle = np.where(ok, s, best), np.where(ok, a % (2 * math.pi), angle)
    return np.where(np.isnan(z), np.nan, angle)


def dinf_accumulation(angle: np.ndarray) -> np.ndarray:
    """Each cell's flow is split between the two neighbours on both sides of its angle."""
    n, m = angle.shape
    links: list[list[tuple[int, float]]] = [[] for _ in range(n * m)]
    wait = np.zeros(n * m, int)
    for r, c in np.argwhere(angle >= 0):
        k, part = divmod(angle[r, c] / (math.pi / 4), 1)
        for step, share in ((int(k) % 8, 1 - part), (int(k + 1) % 8, part)):
            a, b = r + STEPS[step][0], c + STEPS[step][1]
            if share > 1e-12 and inside(angle.shape, a, b) and not np.isnan(angle[a, b]):
                links[r * m + c].append((a * m + b, share))
                wait[a * m + b] += 1
    acc = np.zeros(n * m)
    ready = np.flatnonzero(wait == 0).tolist()
    while ready:
        i = ready.pop()
        for j, share in links[i]:
            acc[j] += (acc[i] + 1) * share
            wait[j] -= 1
            if wait[j] == 0:
                ready.append(j)
    return np.where(np.isnan(angle), np.nan, acc.reshape(n, m))


def facet_accumulation(z: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Flow over eight triangular facets: each whose steepest descent lies inside it takes a share by its slope, and
    splits it between its two cells by the angle. Without such a facet, lower cells share by their slopes."""
    n, m = z.shape
    shares = np.zeros((8, n, m))
    for k in range(8):
        q = (k + 1) % 8
        (ri, ci), (rj, cj) = STEPS[k], STEPS[q]
        zi, zj = shifted(z, ri, ci) - z, shifted(z, rj, cj) - z
        det = ci * rj - cj * ri
        gx, gy = (zi * rj - zj * ri) / det, (ci * zj - cj * zi) / det
        slope = np.hypot(gx, gy)
        # the turn from cell k towards cell q, up to the eighth of a circle between them
        turn = lambda y, x, ri=ri, ci=ci: np.arctan2(ci * y - ri * x, ci * x + ri * y)
        whole = float(turn(rj, cj))
        part = turn(-gy, -gx) / whole
        ok = (slope >= least) & (part >= -1e-12) & (part <= 1 + 1e-12)
        part = np.clip(part, 0, 1)
        shares[k] += np.where(ok, slope * (1 - part), 0)
        shares[q] += np.where(ok, slope * part, 0)
    none = shares.sum(0) <= 0
    for k, ((dr, dc), d) in enumerate(zip(STEPS, FAR)):
        drop = z - shifted(z, dr, dc)
        shares[k] = np.where(none & (drop > least), drop / d, shares[k])
    total = shares.sum(0)
    acc = np.where(np.isnan(z), 0.0, 1.0)
    for i in np.argsort(-np.nan_to_num(z, nan=-np.inf).ravel(), kind="stable").tolist():
        r, c = divmod(i, m)
        if total[r, c] > 0:
            for k in np.flatnonzero(shares[:, r, c]):
                acc[r + STEPS[k][0], c + STEPS[k][1]] += acc[r, c] * shares[k, r, c] / total[r, c]
    return np.where(np.isnan(z), np.nan, np.maximum(acc - 1, 0))


def strahler(d: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Orders of stream cells by the textbook rule: two or more of the highest order raise it by one."""
    to, on = receivers(d), (stream > 0).ravel()
    order, top, ties = np.where(on, 1.0, 0.0), np.zeros(d.size), np.zeros(d.size)
    for i in downstream_order(to):
        if on[i]:
            order[i] = max(1, top[i] + (ties[i] >= 2))
            j = to[i]
            if j >= 0 and on[j]:
                if order[i] > top[j]:
                    top[j], ties[j] = order[i], 1
                elif order[i] == top[j]:
                    ties[j] += 1
    return np.where(on, order, np.nan).reshape(d.shape)


def max_branch_length(z: np.ndarray) -> np.ndarray:
    """The longest way down to each cell along D8."""
    d = d8(z)
    to, length = receivers(d), np.zeros(d.size)
    far = np.array([0, *FAR])[d.ravel().astype(int)]
    for i in downstream_order(to):
        if to[i] >= 0:
            length[to[i]] = max(length[to[i]], length[i] + far[i])
    return np.where(np.isnan(z), np.nan, length.reshape(z.shape))


def downslope_index(z: np.ndarray, drop: float = 5.0) -> np.ndarray:
    """The way along D8 of the filled surface until it is ``drop`` lower, or until it ends."""
    f = priority_flood(z)
    d = d8(f)
    to, far = receivers(d), np.array([0, *FAR])[d.ravel().astype(int)]
    flat, out = f.ravel(), np.full(z.size, np.nan)
    for i in range(z.size):
        if np.isnan(flat[i]):
            continue
        j, way, steps = i, 0.0, 0
        while to[j] >= 0 and flat[i] - flat[j] < drop and steps <= z.size:
            way, j, steps = way + far[j], to[j], steps + 1
        out[i] = way
    return out.reshape(z.shape)


def breach(z: np.ndarray) -> np.ndarray:
    """Pits are joined to lower ground by the cheapest cut, then what is left is filled."""
    out = z.copy()
    low = np.full(z.shape, np.inf)
    for dr, dc in STEPS:
        low = np.fmin(low, shifted(z, dr, dc))
    n, m = z.shape
    pits = [p for p in np.argwhere(z <= low).tolist() if 0 < p[0] < n - 1 and 0 < p[1] < m - 1]
    for r, c in sorted(pits, key=lambda p: z[p[0], p[1]]):
        cost, prev, heap, end = {(r, c): 0.0}, {}, [(0.0, r, c)], None
        while heap:
            w, a, b = heapq.heappop(heap)
            if w > cost[(a, b)]:
                continue
            if (a, b) != (r, c) and (out[a, b] < out[r, c] or a in (0, n - 1) or b in (0, m - 1)):
                end = (a, b)
                break
            for k, (dr, dc) in enumerate(STEPS):
                q = (a + dr, b + dc)
                if inside(z.shape, *q) and not np.isnan(out[q]):
                    x = w + max(out[q] - out[r, c], 0) * FAR[k]
                    if x < cost.get(q, np.inf):
                        cost[q], prev[q] = x, (a, b)
                        heapq.heappush(heap, (x, *q))
        if end:
            path = [end]
            while path[-1] != (r, c):
                path.append(prev[path[-1]])
            path = path[::-1]
            top, bottom = out[r, c], min(out[end], out[r, c])
            for i, p in enumerate(path):
                out[p] = min(out[p], top + (bottom - top) * i / max(len(path) - 1, 1))
    return priority_flood(out)


def flood(z: np.ndarray, level: float) -> np.ndarray:
    """Depth of water at ``level`` that comes in over the border."""
    wet = np.zeros(z.shape, bool)
    low = z <= level
    edge = np.zeros(z.shape, bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    todo = [tuple(p) for p in np.argwhere(low & edge)]
    for p in todo:
        wet[p] = True
    while todo:
        r, c = todo.pop()
        for a, b in STEPS:
            q = (r + a, c + b)
            if inside(z.shape, *q) and low[q] and not wet[q]:
                wet[q] = True
                todo.append(q)
    return np.where(wet, level - z, np.nan)


def nested_depressions(z: np.ndarray, least_depth: float = 0.1, least_cells: int = 3) -> np.ndarray:
    """Depressions as components of filled cells of enough depth and size, numbered in row-major order."""
    depth = priority_flood(z) - z
    lab, n = label(np.where(depth > 0, 1.0, np.nan), True)
    out, k = np.zeros(z.shape), 0
    for i in range(1, n + 1):
        mine = lab == i
        if mine.sum() >= least_cells and np.nanmax(depth[mine]) >= least_depth:
            k += 1
            out[mine] = k
    return out


def sediment_connectivity(slope: np.ndarray, d: np.ndarray, threshold: float = 1000.0) -> np.ndarray:
    """log10 of upslope supply (mean weight, mean slope, root of area) over the weighted way down to a stream."""
    s = np.maximum(np.tan(slope), 0.005)
    w = np.minimum(s, 1.0)
    to, order = receivers(d), downstream_order(receivers(d))
    n, sw, ss = np.ones(d.size), w.ravel().copy(), s.ravel().copy()
    for i in order:
        if to[i] >= 0:
            n[to[i]] += n[i]
            sw[to[i]] += sw[i]
            ss[to[i]] += ss[i]
    up = (sw / n) * (ss / n) * np.sqrt(n)
    far = np.array([0, *FAR])[d.ravel().astype(int)]
    way = np.zeros(d.size)
    own = far / (w.ravel() * s.ravel())
    for i in reversed(order):
        if to[i] >= 0 and n[i] - 1 < threshold:
            way[i] = own[i] + way[to[i]]
    with np.errstate(divide="ignore"):
        out = np.log10(up / np.where(way > 0, way, np.nan))
    return out.reshape(d.shape)


def isobasins(d: np.ndarray, size: float) -> np.ndarray:
    """Basins of about ``size`` cells: a cell closes one when enough has gathered above it."""
    to, order = receivers(d), downstream_order(receivers(d))
    held, close = np.ones(d.size), np.zeros(d.size, bool)
    for i in order:
        if held[i] >= size or to[i] < 0:
            close[i] = True
        else:
            held[to[i]] += held[i]
    out, ids = np.zeros(d.size), {int(i): k for k, i in enumerate(np.flatnonzero(close), 1)}
    for i in reversed(order):
        out[i] = ids[i] if close[i] else out[to[i]]
    return out.reshape(d.shape)


# regions, cost, relief


def label(a: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Connected regions of equal rounded values, numbered in row-major order; 0 is nodata."""
    steps = STEPS if eight else STEPS[::2]
    out, n = np.zeros(a.shape, int), 0
    k = np.floor(a + 0.5)
    for r, c in np.argwhere(~np.isnan(a)):
        if out[r, c]:
            continue
        n += 1
        out[r, c] = n
        todo = [(r, c)]
        while todo:
            x, y = todo.pop()
            for dr, dc in steps:
                q = (x + dr, y + dc)
                if inside(a.shape, *q) and not out[q] and k[q] == k[r, c]:
                    out[q] = n
                    todo.append(q)
    return out, n


def cost_distance(cost: np.ndarray, sources: list[tuple[int, int]]) -> np.ndarray:
    """The cheapest way to a source; a step costs the mean of both cells times its length."""
    out = np.full(cost.shape, np.inf)
    heap = []
    for r, c in sources:
        out[r, c] = 0.0
        heap.append((0.0, r, c))
    heapq.heapify(heap)
    while heap:
        w, r, c = heapq.heappop(heap)
        if w > out[r, c]:
            continue
        for k, (dr, dc) in enumerate(STEPS):
            q = (r + dr, c + dc)
            if inside(cost.shape, *q) and cost[q] > 0:
                x = w + (cost[r, c] + cost[q]) / 2 * FAR[k]
                if x < out[q]:
                    out[q] = x
                    heapq.heappush(heap, (x, *q))
    return out


def excess_topography(z: np.ndarray, degrees: float = 30.0) -> np.ndarray:
    """What rises above the highest surface that is nowhere steeper than a threshold."""
    t = math.tan(math.radians(degrees))
    s = z.copy()
    while True:
        new = s.copy()
        for (dr, dc), d in zip(STEPS, FAR):
            new = np.fmin(new, shifted(s, dr, dc) + t * d)
        new = np.where(np.isnan(z), np.nan, new)
        if np.nanmax(s - new, initial=0) <= 1e-4:
            return z - new
        s = new


def horizon(z: np.ndarray, azimuth: float, radius: int) -> np.ndarray:
    """The steepest rise within ``radius`` along one azimuth (radians, clockwise from north), as tangent, at least 0."""
    best = np.zeros(z.shape)
    for k in range(1, radius + 1):
        dr, dc = -round(k * math.cos(azimuth)), round(k * math.sin(azimuth))
        best = np.fmax(best, (shifted(z, dr, dc) - z) / math.hypot(dr, dc))
    return np.where(np.isnan(z), np.nan, best)


def horizons(z: np.ndarray, radius: int, directions: int) -> list[np.ndarray]:
    return [horizon(z, 2 * math.pi * i / directions, radius) for i in range(directions)]


def sky_view(z: np.ndarray, radius: int = 10, directions: int = 16) -> np.ndarray:
    return 1 - np.mean([np.sin(np.arctan(h)) ** 2 for h in horizons(z, radius, directions)], 0)


def openness(z: np.ndarray, radius: int = 10, directions: int = 8, positive: bool = True) -> np.ndarray:
    """The mean of 90 degrees less the horizon, above or (for -z) below."""
    out = []
    s = z if positive else -z
    for i in range(directions):
        a = 2 * math.pi * i / directions
        best = np.full(z.shape, -np.inf)
        for k in range(1, radius + 1):
            dr, dc = -round(k * math.cos(a)), round(k * math.sin(a))
            best = np.fmax(best, (shifted(s, dr, dc) - s) / math.hypot(dr, dc))
        out.append(np.where(np.isfinite(best), 90 - np.degrees(np.arctan(best)), np.nan))
    return np.where(np.isnan(z), np.nan, np.nanmean(out, 0))


def wind_exposure(z: np.ndarray, radius: int = 30, directions: int = 8) -> np.ndarray:
    """Sum of the horizon angles of all directions, in degrees; rays end at nodata or the border."""
    total = np.zeros(z.shape)
    for i in range(directions):
        a = 2 * math.pi * i / directions
        best, open_ = np.zeros(z.shape), ~np.isnan(z)
        for k in range(1, radius + 1):
            v = shifted(z, -round(k * math.cos(a)), round(k * math.sin(a)))
            open_ &= ~np.isnan(v)
            best = np.where(open_, np.fmax(best, np.arctan((v - z) / k)), best)
        total += np.degrees(best)
    return np.where(np.isnan(z), np.nan, total)


def viewshed(z: np.ndarray, row: int, col: int, eye: float = 1.7, target: float = 0.0) -> np.ndarray:
    """1 where the line of sight from the observer stays above the ground."""
    out = np.zeros(z.shape)
    h0 = z[row, col] + eye
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            n = max(abs(r - row), abs(c - col))
            if n == 0:
                out[r, c] = 1
                continue
            if np.isnan(z[r, c]):
                continue
            k = np.arange(1, n)
            rr, cc = np.rint(row + (r - row) * k / n).astype(int), np.rint(col + (c - col) * k / n).astype(int)
            d = np.hypot(rr - row, cc - col)
            limit = ((z[rr, cc] - h0) / d).max(initial=-np.inf) if n > 1 else -np.inf
            out[r, c] = (z[r, c] + target - h0) / math.hypot(r - row, c - col) >= limit
    return out


def geomorphons(z: np.ndarray, radius: int = 10, flat: float = 1.0) -> np.ndarray:
    """Landform 1 to 10 from how many of eight lines of sight rise and fall."""
    plus, minus = np.zeros(z.shape, int), np.zeros(z.shape, int)
    t = math.radians(flat)
    for dr, dc in STEPS:
        up, down = np.full(z.shape, -np.inf), np.full(z.shape, -np.inf)
        for k in range(1, radius + 1):
            v = (shifted(z, dr * k, dc * k) - z) / (k * math.hypot(dr, dc))
            up, down = np.fmax(up, v), np.fmax(down, -v)
        zenith, nadir = math.pi / 2 - np.arctan(up), math.pi / 2 - np.arctan(down)
        plus += (nadir - zenith > t) & np.isfinite(up)
        minus += (zenith - nadir > t) & np.isfinite(up)
    form = np.array([FORMS[min(int(m), 8)][min(int(p), 8)] for m, p in zip(minus.ravel(), plus.ravel())]).reshape(z.shape)
    inner = np.zeros(z.shape, bool)
    inner[1:-1, 1:-1] = True
    return np.where(inner & ~np.isnan(z), form, np.nan)


#: Landforms by the number of falling (row) and rising (column) lines: 1 flat, 2 peak, 3 ridge, 4 shoulder,
#: 5 spur, 6 slope, 7 hollow, 8 footslope, 9 valley, 10 pit (fixed values).
FORMS = (
    (1, 1, 1, 8, 8, 9, 9, 9, 10), (1, 1, 8, 8, 8, 9, 9, 9, 9), (1, 4, 6, 6, 7, 7, 9, 9, 9), (4, 4, 6, 6, 6, 7, 7, 9, 9), (4, 4, 5, 6, 6, 6, 7, 9, 9),
    (3, 3, 5, 5, 6, 6, 6, 9, 9), (3, 3, 3, 5, 5, 6, 6, 9, 9), (3, 3, 3, 3, 5, 5, 6, 9, 9), (2, 3, 3, 3, 3, 3, 3, 9, 9),
)


# filters and transforms


def gaussian(z: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    """Separable Gaussian mean over the valid cells."""
    k = radius or max(1, math.ceil(3 * sigma))
    w = np.exp(-np.arange(-k, k + 1) ** 2 / (2 * sigma * sigma))
    for axis in (0, 1):
        top, bottom = np.zeros(z.shape), np.zeros(z.shape)
        for i, x in zip(range(-k, k + 1), w):
            v = shifted(z, i, 0) if axis == 0 else shifted(z, 0, i)
            top += np.nan_to_num(v) * x
            bottom += ~np.isnan(v) * x
        z = np.where(np.isnan(z) | (bottom == 0), np.nan, top / np.maximum(bottom, 1e-300))
    return z


def iterative_mean(z: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Repeated 3 x 3 means weighted by inverse distance, the centre as 1."""
    for _ in range(rounds):
        top, bottom = np.nan_to_num(z).copy(), (~np.isnan(z)).astype(float)
        for (dr, dc), d in zip(STEPS, FAR):
            v = shifted(z, dr, dc)
            top += np.nan_to_num(v) / d
            bottom += ~np.isnan(v) / d
        z = np.where(np.isnan(z), np.nan, top / np.maximum(bottom, 1e-300))
    return z


def fft_low_pass(z: np.ndarray, wavelength: float = 8.0) -> np.ndarray:
    """Wavelengths under a cutoff removed; nodata stands in as the mean."""
    gap = np.isnan(z)
    a = np.where(gap, np.nanmean(z), z)
    f = np.hypot(np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :])
    return np.where(gap, np.nan, np.fft.ifft2(np.fft.fft2(a) * (f <= 1 / wavelength)).real)


def ssa_2d(z: np.ndarray, rows: int = 5, cols: int = 5, keep: int = 3) -> np.ndarray:
    """Rank reduction of the trajectory matrix of all windows, averaged back."""
    a = np.where(np.isnan(z), np.nanmean(z), z)
    win = np.lib.stride_tricks.sliding_window_view(a, (rows, cols))
    n, m = win.shape[:2]
    u, s, v = np.linalg.svd(win.reshape(n * m, -1), full_matrices=False)
    low = ((u[:, :keep] * s[:keep]) @ v[:keep]).reshape(n, m, rows, cols)
    top, uses = np.zeros(z.shape), np.zeros(z.shape)
    for i in range(rows):
        for j in range(cols):
            top[i : i + n, j : j + m] += low[:, :, i, j]
            uses[i : i + n, j : j + m] += 1
    return np.where(np.isnan(z), np.nan, top / uses)


def feature_smoothing(z: np.ndarray, radius: int = 2, rounds: int = 3, threshold: float = 15.0) -> np.ndarray:
    """Normals are smoothed where they agree within a threshold, then elevations follow them."""
    gy, gx = (np.nan_to_num(g) for g in np.gradient(z)) if min(z.shape) > 1 else (np.zeros(z.shape),) * 2  # level beside gaps
    t = math.cos(math.radians(threshold))
    nx, ny, nz = -gx, -gy, np.ones(z.shape)
    sx, sy, sw = np.zeros(z.shape), np.zeros(z.shape), np.zeros(z.shape)
    norm = np.sqrt(nx**2 + ny**2 + 1)
    for dr in range(-radius, radius + 1):
        for dc in range(-radius, radius + 1):
            ax, ay = shifted(nx, dr, dc), shifted(ny, dr, dc)
            cos = (nx * ax + ny * ay + nz) / (norm * np.sqrt(ax**2 + ay**2 + 1))
            w = np.where(cos > t, np.square(np.nan_to_num(cos) - t), 0.0)
            sx += np.nan_to_num(ax) * w
            sy += np.nan_to_num(ay) * w
            sw += w
    nx, ny = sx / np.maximum(sw, 1e-300), sy / np.maximum(sw, 1e-300)
    out = z.copy()
    for _ in range(rounds):
        top, bottom = np.zeros(z.shape), np.zeros(z.shape)
        for dr, dc in STEPS:
            ax, ay, v = shifted(nx, dr, dc), shifted(ny, dr, dc), shifted(out, dr, dc)
            cos = (nx * ax + ny * ay + 1) / np.sqrt((nx**2 + ny**2 + 1) * (ax**2 + ay**2 + 1))
            w = np.where(cos > t, np.square(np.nan_to_num(cos) - t), 0.0)
            top += np.nan_to_num((v + ax * dc + ay * dr) * w)
            bottom += np.where(np.isnan(v), 0, w)
        out = np.where(np.isnan(z), np.nan, np.where(bottom > 0, top / np.maximum(bottom, 1e-300), out))
    return out


def quadratic(z: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Least-squares quadric over a square window: its p, q, r, s, t."""
    y, x = np.mgrid[k : -k - 1 : -1, -k : k + 1].astype(float)
    a = np.stack([x.ravel() ** 2 / 2, x.ravel() * y.ravel(), y.ravel() ** 2 / 2, x.ravel(), y.ravel(), np.ones(x.size)], 1)
    pinv = np.linalg.pinv(a)
    out = {n: np.zeros(z.shape) for n in "rstpq"}
    i = 0
    for dr in range(-k, k + 1):
        for dc in range(-k, k + 1):
            v = shifted(z, dr, dc)
            for j, n in enumerate("rstpq"):
                out[n] = out[n] + pinv[j, i] * v
            i += 1
    return out


def mean_curvature(d: dict[str, np.ndarray]) -> np.ndarray:
    w = 1 + d["p"] ** 2 + d["q"] ** 2
    return -((1 + d["q"] ** 2) * d["r"] - 2 * d["p"] * d["q"] * d["s"] + (1 + d["p"] ** 2) * d["t"]) / (2 * w**1.5)


def multiscale_valleyness(z: np.ndarray, radii: tuple[int, ...] = (2, 5)) -> np.ndarray:
    """The largest positive Hessian eigenvalue over window sizes, scaled by area."""
    out = np.full(z.shape, -np.inf)
    for k in radii:
        d = quadratic(z, k)
        e = (d["r"] + d["t"]) / 2 + np.sqrt(((d["r"] - d["t"]) / 2) ** 2 + d["s"] ** 2)
        out = np.fmax(out, np.maximum(e, 0) * k * k)
    return np.where(np.isinf(out), np.nan, out)


def horn(z: np.ndarray, cs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    s = lambda a, b: shifted(z, a, b)
    gx = ((s(-1, 1) + 2 * s(0, 1) + s(1, 1)) - (s(-1, -1) + 2 * s(0, -1) + s(1, -1))) / (8 * cs)
    gy = ((s(1, -1) + 2 * s(1, 0) + s(1, 1)) - (s(-1, -1) + 2 * s(-1, 0) + s(-1, 1))) / (8 * cs)
    return gx, gy


def mrvbf(z: np.ndarray, threshold: float = 16.0, steps: int = 3, shape: float = 4.0) -> dict[str, np.ndarray]:
    """Multi-resolution valley-bottom and ridge-top flatness."""
    out = {"mrvbf": np.zeros(z.shape), "mrrtf": np.zeros(z.shape)}
    s = z
    for i in range(steps):
        gx, gy = horn(s)
        flat = 1 / (1 + (np.hypot(gx, gy) * 100 / (threshold / 2**i)) ** shape)
        k = 3 * 2**i
        below, uses = np.zeros(z.shape), np.zeros(z.shape)
        for dr in range(-k, k + 1):
            for dc in range(-k, k + 1):
                v = shifted(s, dr, dc)
                below += v < s
                uses += ~np.isnan(v)
        part = below / np.maximum(uses, 1)
        for name, low in (("mrvbf", 1 - part), ("mrrtf", part)):
            v = np.minimum(flat, low)
            out[name] = np.where(v > 0.5, np.fmax(out[name], i + 1 - 0.5 + v), out[name])
        s = gaussian(s, 1.0)
    return {k: np.where(np.isnan(z), np.nan, v) for k, v in out.items()}


def uncertainty(z: np.ndarray, rmse: float = 1.0, cs: float = 1.0) -> np.ndarray:
    """Standard error of the slope (degrees) from the elevation error."""
    gx, gy = horn(z, cs)
    g2 = gx**2 + gy**2
    return np.degrees(rmse * math.sqrt(12) / (8 * cs) / (1 + g2))


def solar(slope: np.ndarray, aspect: np.ndarray, day: int = 172, latitude: float = 45.0, transmittance: float = 0.7, diffuse: float = 0.3, constant: float = 1367.0, step: float = 0.5) -> np.ndarray:
    """Energy of one day (Wh a square metre): beam by incidence and diffuse by the isotropic sky."""
    lat = math.radians(latitude)
    decl = math.radians(23.45) * math.sin(2 * math.pi * (284 + day) / 365)
    total = np.zeros(slope.shape)
    for hour in np.arange(step / 2, 24, step):
        h = math.radians(15 * (hour - 12))
        up = math.sin(lat) * math.sin(decl) + math.cos(lat) * math.cos(decl) * math.cos(h)
        if up <= 0:
            continue
        east, north = -math.cos(decl) * math.sin(h), math.cos(lat) * math.sin(decl) - math.sin(lat) * math.cos(decl) * math.cos(h)
        beam = constant * transmittance ** (1 / up)
        inc = np.sin(slope) * np.sin(aspect) * east + np.sin(slope) * np.cos(aspect) * north + np.cos(slope) * up
        total += (beam * np.maximum(inc, 0) + diffuse * beam * up * (1 + np.cos(slope)) / 2) * step
    return total


def glcm(a: np.ndarray, radius: int = 3, levels: int = 32, feature: str = "contrast", limits: tuple[float, float] | None = None) -> np.ndarray:
    """A texture feature of the symmetric co-occurrences of each window, in four directions at distance 1."""
    lo, hi = limits or (np.nanmin(a), np.nanmax(a))  # of the whole grid, where ``a`` is a tile of it
    q = np.minimum(((a - lo) / max(hi - lo, 1e-300) * levels), levels - 1)
    terms = {"contrast": lambda i, j: (i - j) ** 2, "dissimilarity": lambda i, j: abs(i - j), "homogeneity": lambda i, j: 1 / (1 + (i - j) ** 2)}
    q = np.floor(q)
    pairs = [(q, shifted(q, dr, dc)) for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1))]
    if feature in terms:
        top, n = np.zeros(a.shape), np.zeros(a.shape)
        for x, y in pairs:
            v = terms[feature](x, y)
            ok = ~np.isnan(v)
            for dr in range(-radius, radius + 1):
                for dc in range(-radius, radius + 1):
                    top += np.nan_to_num(shifted(np.where(ok, v, 0.0), dr, dc))
                    n += np.nan_to_num(shifted(ok.astype(float), dr, dc))
        return np.where((n > 0) & ~np.isnan(a), top / np.maximum(n, 1), np.nan)
    out = np.full(a.shape, np.nan)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            sl = (slice(max(0, r - radius), r + radius + 1), slice(max(0, c - radius), c + radius + 1))
            x = np.concatenate([p[0][sl].ravel() for p in pairs] + [p[1][sl].ravel() for p in pairs])
            y = np.concatenate([p[1][sl].ravel() for p in pairs] + [p[0][sl].ravel() for p in pairs])
            ok = ~(np.isnan(x) | np.isnan(y))
            if np.isnan(a[r, c]) or not ok.any():
                continue
            x, y = x[ok], y[ok]
            p = np.unique(x * levels + y, return_counts=True)[1] / len(x)
            if feature == "energy":
                out[r, c] = (p * p).sum()
            elif feature == "entropy":
                out[r, c] = -(p * np.log(p)).sum()
            else:
                out[r, c] = 0.0 if x.std() == 0 else ((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std())
    return out


def refined_lee(a: np.ndarray, size: int = 7, looks: float = 1.0) -> np.ndarray:
    """Lee's filter in the half window on the centre's side of the strongest of four edges."""
    k = size // 2
    dr, dc = np.mgrid[-k : k + 1, -k : k + 1]
    out = np.full(a.shape, np.nan)
    pad = np.pad(a, k, constant_values=np.nan)
    halves = [dc >= 0, dc <= 0, dr >= 0, dr <= 0, dr + dc >= 0, dr + dc <= 0, dr - dc >= 0, dr - dc <= 0]
    for r, c in np.argwhere(~np.isnan(a)):
        w = pad[r : r + size, c : c + size]
        means = [np.nanmean(w[h]) for h in halves]
        gaps = [abs(means[i] - means[i + 1]) for i in range(0, 8, 2)]
        i = 2 * int(np.argmax(gaps))
        half = halves[i] if abs(means[i] - a[r, c]) <= abs(means[i + 1] - a[r, c]) else halves[i + 1]
        v = w[half]
        m, var = np.nanmean(v), np.nanvar(v)
        ci2 = var / (m * m) if m else 0.0
        out[r, c] = m + (0.0 if ci2 <= 1 / looks else 1 - 1 / looks / ci2) * (a[r, c] - m)
    return out


def felzenszwalb(a: np.ndarray, scale: float = 1.0, least: int = 20) -> np.ndarray:
    """Regions merged along sorted edges while the edge is no larger than either's inner difference plus scale / size."""
    n, m = a.shape
    edges = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        b = shifted(a, dr, dc)
        for r, c in np.argwhere(~np.isnan(a) & ~np.isnan(b)):
            edges.append((abs(a[r, c] - b[r, c]), int(r * m + c), int((r + dr) * m + c + dc)))
    edges.sort()
    root, size, inner = list(range(n * m)), [1] * (n * m), [0.0] * (n * m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for final in (False, True):
        for w, x, y in edges:
            x, y = find(x), find(y)
            if x != y and ((size[x] < least or size[y] < least) if final else w <= min(inner[x] + scale / size[x], inner[y] + scale / size[y])):
                root[y] = x
                size[x] += size[y]
                inner[x] = max(inner[x], inner[y], w)
    ids: dict[int, int] = {}
    return np.array([ids.setdefault(find(i), len(ids) + 1) if not np.isnan(a.flat[i]) else 0 for i in range(n * m)]).reshape(n, m)


def slic(a: np.ndarray, segments: int = 100, compactness: float = 0.1, rounds: int = 10) -> np.ndarray:
    """Superpixels: nearest centre in value and place, within two steps of the centre grid."""
    n, m = a.shape
    s = max(1, int(round(math.sqrt(n * m / segments))))
    v = (a - np.nanmin(a)) / max(np.nanmax(a) - np.nanmin(a), 1e-300)
    centres = np.array([[r, c, v[r, c]] for r in range(s // 2, n, s) for c in range(s // 2, m, s) if not np.isnan(v[r, c])], float)
    rr, cc = np.mgrid[0:n, 0:m]
    lab = np.zeros((n, m), int)
    for _ in range(rounds):
        best = np.full((n, m), np.inf)
        for i, (r, c, x) in enumerate(centres):
            d = (v - x) ** 2 + compactness**2 * (((rr - r) / s) ** 2 + ((cc - c) / s) ** 2)
            d = np.where((abs(rr - r) <= 2 * s) & (abs(cc - c) <= 2 * s), d, np.inf)
            near = d < best
            best, lab = np.where(near, d, best), np.where(near, i + 1, lab)
        for i in range(len(centres)):
            mine = (lab == i + 1) & ~np.isnan(v)
            if mine.any():
                centres[i] = rr[mine].mean(), cc[mine].mean(), v[mine].mean()
    return np.where(np.isnan(a), 0, lab)


def gap_fill(a: np.ndarray, passes: int = 20) -> np.ndarray:
    """Gaps with two valid neighbours or more take their mean, pass by pass."""
    for _ in range(passes):
        top, n = np.zeros(a.shape), np.zeros(a.shape)
        for dr, dc in STEPS:
            v = shifted(a, dr, dc)
            top += np.nan_to_num(v)
            n += ~np.isnan(v)
        fill = np.isnan(a) & (n >= 2)
        if not fill.any():
            return a
        a = np.where(fill, top / np.maximum(n, 1), a)
    return a


def chamfer(valid: np.ndarray) -> np.ndarray:
    """Steps to the nearest invalid cell or to the outside, diagonals as sqrt 2."""
    return np.where(valid, np.minimum.reduce([_edge_distance(valid)]), 0.0)


def _edge_distance(valid: np.ndarray) -> np.ndarray:
    pad = np.pad(valid, 1)
    d = np.where(pad, np.inf, 0.0)
    while True:
        new = d
        for (dr, dc), f in zip(STEPS, FAR):
            new = np.minimum(new, shifted(d, dr, dc, np.inf) + f)
        new = np.where(pad, new, 0.0)
        if (new == d).all():
            return d[1:-1, 1:-1]
        d = new


def detect_water(z: np.ndarray, flat: float = 0.01, least: int = 20) -> np.ndarray:
    """Large connected areas whose gradient is almost nil."""
    gx, gy = horn(z)
    lab, n = label(np.where(np.hypot(gx, gy) <= flat, 1.0, np.nan), True)
    sizes = np.bincount(lab.ravel(), minlength=n + 1)
    return ((lab > 0) & (sizes[lab] >= least)).astype(float)


def cast_shadow(z: np.ndarray, azimuth: float, altitude: float, radius: int) -> np.ndarray:
    """1 lit, 0 shadowed."""
    h = horizon(z, azimuth, radius)
    return np.where(np.isnan(z), np.nan, (h <= math.tan(altitude)).astype(float))


def patch_density(a: np.ndarray, radius: int = 3) -> np.ndarray:
    """Four-connected patches of each window over its valid cells."""
    out = np.full(a.shape, np.nan)
    for r, c in np.argwhere(~np.isnan(a)):
        w = a[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
        out[r, c] = label(w)[1] / (~np.isnan(w)).sum()
    return out


def directional_relief(z: np.ndarray, radius: int = 10, azimuth: float = 0.0) -> np.ndarray:
    """The signed change of the largest size along a line both ways; the mean of eight lines for azimuth 0."""
    angles = [i * 45.0 for i in range(8)] if azimuth == 0 else [azimuth]
    parts = []
    for deg in angles:
        best = np.zeros(z.shape)
        for a in (math.radians(deg), math.radians(deg + 180)):
            for k in range(1, radius + 1):
                v = shifted(z, -round(k * math.cos(a)), round(k * math.sin(a))) - z
                best = np.where(np.abs(np.nan_to_num(v)) > np.abs(best), np.nan_to_num(v), best)
        parts.append(best)
    return np.where(np.isnan(z), np.nan, np.mean(parts, 0))


def aspect_radians(z: np.ndarray) -> np.ndarray:
    gx, gy = horn(z)
    a = np.arctan2(-gx, gy)
    return np.where((np.abs(gx) < 1e-10) & (np.abs(gy) < 1e-10), np.nan, np.where(a < 0, a + 2 * math.pi, a))


def relative_aspect(z: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """The angle between the aspect and the smoothed surface's, 0 to 180 degrees."""
    d = np.degrees(np.abs(aspect_radians(z) - aspect_radians(gaussian(z, sigma))))
    return np.minimum(d, 360 - d)
