"""Points and vectors: sampling, nearest and weighted interpolation, variograms, kriging, rings.

Points meet cells by bins: both sides carry the bin of their place, and a
search radius reaches the bins around, so a join is on equal keys.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import centre_of, pixel_of
from gridloom.plans.lineage import workers_see_package, written


def cells(spark, rows: int, cols: int, x0: float, y0: float, w: float, h: float) -> DataFrame:
    """r, c and centre x, y of a grid."""
    x, y = centre_of("r", "c", x0, y0, w, h)
    out = spark.range(rows * cols).selectExpr(f"CAST(floor(id / {cols}) AS INT) AS r", f"CAST(id % {cols} AS INT) AS c")
    return out.selectExpr("r", "c", f"{x} AS x", f"{y} AS y")


def sample(points: DataFrame, bands: DataFrame, x0: float, y0: float, w: float, h: float) -> DataFrame:
    """Points with the bands of their cell; points off the grid or on a null band are dropped."""
    r, c = pixel_of("x", "y", x0, y0, w, h)
    got = points.withColumns({"r": F.expr(r), "c": F.expr(c)}).join(bands, ["r", "c"])
    return got.dropna(subset=[b for b in bands.columns if b not in ("r", "c")])


def pairs_within(grid: DataFrame, points: DataFrame, radius: float, *kept: str) -> DataFrame:
    """Cells (and their columns ``kept``) with the points within ``radius``: r, c, id, value, d; by bins of that size."""
    bin_of = lambda n: F.floor(F.col(n) / radius).cast("long")
    around = F.explode(F.array(*[F.struct((bin_of("x") + a).alias("bx"), (bin_of("y") + b).alias("by")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left = grid.select("r", "c", "x", "y", *kept, around.alias("b")).select("r", "c", "x", "y", *kept, "b.bx", "b.by")
    right = points.select("id", "value", F.col("x").alias("px"), F.col("y").alias("py"), bin_of("x").alias("bx"), bin_of("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return left.join(right, ["bx", "by"]).select("r", "c", "x", "y", *kept, "id", "value", "px", "py", d.alias("d")).filter(F.col("d") <= radius)


def nearest(grid: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The value of the nearest point within ``radius``, the smaller id on ties."""
    return pairs_within(grid, points, radius).groupBy("r", "c").agg(F.min_by("value", F.struct("d", "id")).alias("v"))


def nearest_few(grid: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """Cells with ``a``: the ``most`` nearest places within ``radius``, nearest first; equal places are one, with their mean value.

    Places are counted by rings that widen by a fifth, and only those up to the ring that holds the last one are listed.
    """
    p = written(points.groupBy("x", "y").agg(F.avg("value").alias("value"), F.min("id").alias("id")))
    ring = F.greatest(F.floor(F.log2(F.col("d") / radius) * 4), F.lit(-160)).cast("int").alias("ring")
    held = pairs_within(grid, p, radius).select("r", "c", F.when(F.col("d") > 0, ring).otherwise(-160).alias("ring")).groupBy("r", "c", "ring").agg(F.count("*").alias("n"))
    held = held.withColumn("before", F.sum("n").over(Window.partitionBy("r", "c").orderBy("ring")) - F.col("n")).filter(F.col("before") < most)
    reach = held.groupBy("r", "c").agg(F.max("ring").alias("last"))
    near = pairs_within(grid.join(reach, ["r", "c"]), p, radius, "last").filter(F.col("d") <= radius * F.pow(F.lit(2.0), (F.col("last") + 1) / 4) * (1 + 1e-9))
    few = F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "px", "py", "value"))), 1, most)
    return near.groupBy("r", "c", "x", "y").agg(few.alias("a"))


def idw(grid: DataFrame, points: DataFrame, radius: float, power: float = 2.0, snap: float = 1e-10) -> DataFrame:
    """Inverse distance weights within ``radius``; a point at the cell gives its own value."""
    p = pairs_within(grid, points, radius)
    w = 1 / F.pow(F.greatest("d", F.lit(snap)), F.lit(power))
    g = p.groupBy("r", "c").agg(F.min_by("value", F.struct("d", "id")).alias("hit"), F.min("d").alias("near"), (F.sum(w * F.col("value")) / F.sum(w)).alias("m"))
    return g.select("r", "c", F.when(F.col("near") < snap, F.col("hit")).otherwise(F.col("m")).alias("v"))


def _correlated(m: int, pairs: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The sum of factor * a[i] * b[i + offset] over the bins i of two m x m grids (as transforms), by offset 1 - m .. m - 1."""
    got = np.fft.irfft2(sum(k * np.conj(p) * q for p, q, k in pairs), s=(2 * m, 2 * m))
    at = np.arange(1 - m, m)
    return got[np.ix_(at, at)]


def lag_sums(a: np.ndarray, b: np.ndarray, lag: float, n_lags: int, corner: tuple[float, float], shift: tuple[int, int], side: float, order: int = 6) -> np.ndarray:
    """(n_lags, 3): pairs, summed distances and summed squared differences of values of the pairs of ``a`` and ``b`` (n, 3: x, y, value).

    ``a`` lies in the square of ``side`` at ``corner``, ``b`` in the square ``shift`` squares away; without a shift both are
    one set and each pair counts once. Both squares are cut into m x m bins. Pairs of bins that lie within one lag
    count by moments, for all pairs of bins of one offset at once: numbers and squared differences are exact, distances are
    Taylor series of degree ``order`` about the middles, at least 10 bins away. The pairs of all other bins are taken one by one.
    """
    m = int(np.clip(math.sqrt(max(len(a), len(b))) / 1.8, 4, 160))
    step, own = side / m, shift == (0, 0)
    local = np.arange(1 - m, m)
    v, u = np.meshgrid(local + shift[1] * m, local + shift[0] * m, indexing="ij")
    far = np.hypot(np.abs(u) + 1, np.abs(v) + 1) * step * (1 + 1e-9)
    near = np.hypot(np.maximum(np.abs(u) - 1, 0), np.maximum(np.abs(v) - 1, 0)) * step * (1 - 1e-9)
    k = np.floor(near / lag).astype(int)
    half = (v > 0) | ((v == 0) & (u >= 0)) if own else np.ones(u.shape, bool)
    whole = half & (k == np.floor(far / lag)) & (np.hypot(u, v) >= 10) & (k < n_lags)
    single = half & ~whole & (k < n_lags)
    some = bool(whole.any())
    known = [~np.isnan(q[:, 2]) for q in (a, b)]
    mean = float(np.concatenate([a[known[0], 2], b[known[1], 2]]).mean()) if known[0].any() or known[1].any() else 0.0

    def binned(q, ok, dx, dy):
        x, y = (q[:, 0] - corner[0]) / step - dx * m, (q[:, 1] - corner[1]) / step - dy * m
        col, row = (np.clip(np.floor(t), 0, m - 1).astype(int) for t in (x, y))
        by = np.argsort(row * m + col, kind="stable")
        q, ok, x, y, col, row = q[by], ok[by], (x - col - 0.5)[by], (y - row - 0.5)[by], col[by], row[by]
        put = lambda w: np.fft.rfft2(np.bincount(row * m + col, w, m * m).reshape(m, m), s=(2 * m, 2 * m))
        v = np.where(ok, q[:, 2] - mean, 0.0)
        moments = {(i, j): put(x**i * y**j) for i in range(order + 1) for j in range(order + 1 - i)} if some else {}
        sums = (put(ok.astype(float)), put(v), put(v * v)) if some else (None, None, None)
        return q, row, col, moments, sums, np.concatenate([[0], np.cumsum(np.bincount(row * m + col, minlength=m * m))])

    a, row, col, am, (ak, av, aq), _ = binned(a, known[0], 0, 0)
    b, _, _, bm, (bk, bv, bq), first = binned(b, known[1], *shift)
    out = np.zeros((n_lags, 3))
    if some:
        n = np.rint(_correlated(m, [(am[0, 0], bm[0, 0], 1.0)]))
        g = _correlated(m, [(ak, bq, 1.0), (aq, bk, 1.0), (av, bv, -2.0)])
        x, y = u[whole].astype(float), v[whole].astype(float)
        square = {(0, 0): x * x + y * y, (1, 0): 2 * x, (0, 1): 2 * y, (2, 0): 1.0, (0, 2): 1.0}
        root, d = {}, np.zeros(len(x))  # the series of the distance, term by term from its square
        for total in range(order + 1):
            for i in range(total + 1):
                j = total - i
                if total == 0:
                    root[0, 0] = np.sqrt(square[0, 0])
                else:
                    rest = sum(root[p, q] * root[i - p, j - q] for p in range(i + 1) for q in range(j + 1) if 0 < p + q < total)
                    root[i, j] = (square.get((i, j), 0.0) - rest) / (2 * root[0, 0])
                terms = [(am[p, q], bm[i - p, j - q], (-1.0) ** (p + q) * math.comb(i, p) * math.comb(j, q)) for p in range(i + 1) for q in range(j + 1)]
                d += root[i, j] * (n if total == 0 else _correlated(m, terms))[whole]
        for c, w in enumerate((n[whole], d * step, g[whole])):
            out[:, c] += np.bincount(k[whole], w, n_lags)
    ca, cb, full = a.T.copy(), b.T.copy(), known[0].all() and known[1].all()
    for line in np.flatnonzero(single.any(1)):
        to = row + local[line]
        held = np.flatnonzero((to >= 0) & (to < m))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single[line].astype(np.int8), [0]])))
        for lo, hi in zip(edge[::2], edge[1::2]):
            left, right = np.maximum(col[held] + local[lo], 0), np.minimum(col[held] + local[hi - 1], m - 1)
            ok = left <= right
            i = held[ok]
            start, stop = first[to[i] * m + left[ok]], first[to[i] * m + right[ok] + 1]
            if own and v[line, lo] == 0 and u[line, lo] == 0:
                start = np.maximum(start, i + 1)  # within a bin, and along its row, the later ones
            size = np.maximum(stop - start, 0)
            ends = np.cumsum(size)
            at = 0
            while at < len(i):  # blocks that stay in a core's cache
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + 60_000, "right")))
                n, own_ = size[at:upto], i[at:upto]
                q = np.repeat(start[at:upto] - (np.cumsum(n) - n), n)
                q += np.arange(len(q))
                dx, dy, dv = (np.repeat(s[own_], n) - t[q] for s, t in zip(ca, cb))
                dx *= dx
                dy *= dy
                dv *= dv
                dx += dy
                d = np.sqrt(dx, out=dx)
                lags = (d / lag).astype(np.int64)
                np.minimum(lags, n_lags, out=lags)
                if not full:
                    dv[np.isnan(dv)] = 0.0
                at = upto
                for c, w in enumerate((None, d, dv)):
                    out[:, c] += np.bincount(lags, w, n_lags + 1)[:n_lags]
    return out


def variogram(points: DataFrame, lag: float, n_lags: int) -> DataFrame:
    """lag number, pairs, mean distance and semivariance of all pairs of points with different ids within ``lag * n_lags``.

    Squares of half the reach meet those within reach, each pair of squares in a task of its own; the time grows with the
    pairs of bins that a bound of a lag cuts, about the power 1.5 of the points.
    """
    workers_see_package(points.sparkSession)
    reach = lag * n_lags
    side = reach / 2
    near = [(i, j) for j in range(3) for i in range(-2, 3) if j > 0 or i >= 0]
    p = points.filter("id is not null and x is not null and y is not null").select("id", "x", "y", F.col("value").cast("double").alias("value"), F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near]))
    dealt = p.select("bx", "by", shift.alias("o"), "x", "y", "value").select("bx", "by", "o.i", "o.j", "x", "y", "value")
    keys = ["bx", "by", "i", "j"]
    others = dealt.withColumns({"bx": F.col("bx") - F.col("i"), "by": F.col("by") - F.col("j")})

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"lag": [], "pairs": [], "d": [], "g": []})
        x, y, i, j = map(int, key)
        a, b = (f[["x", "y", "value"]].to_numpy(float) for f in (left, left if (i, j) == (0, 0) else right))
        got = lag_sums(a, b, lag, n_lags, (x * side, y * side), (i, j), side)
        return pd.DataFrame({"lag": np.arange(n_lags), "pairs": np.rint(got[:, 0]), "d": got[:, 1], "g": got[:, 2]})

    kinds = "lag int, pairs double, d double, g double"
    parts = dealt.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(one, kinds)
    # rows of one id are no pair: what they added goes
    again = p.join(p.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "id")
    d = F.sqrt((F.col("l.x") - F.col("m.x")) ** 2 + (F.col("l.y") - F.col("m.y")) ** 2)
    same = again.alias("l").join(again.alias("m"), F.col("l.id") == F.col("m.id")).select(d.alias("d"), ((F.col("l.value") - F.col("m.value")) ** 2).alias("g"))
    same = same.filter(F.col("d") < reach).groupBy(F.floor(F.col("d") / lag).cast("int").alias("lag")).agg((-F.count("*") / 2).alias("pairs"), (-F.sum("d") / 2).alias("d"), (-F.sum("g") / 2).alias("g"))
    itself = again.groupBy().agg(F.lit(0).alias("lag"), (F.count("*") / 2).alias("pairs"), F.lit(0.0).alias("d"), F.lit(0.0).alias("g"))
    g = parts.unionByName(same).unionByName(itself).groupBy("lag").agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("d").alias("d"), F.sum("g").alias("g")).filter("pairs > 0")
    return g.select("lag", "pairs", (F.col("d") / F.col("pairs")).alias("distance"), (F.col("g") / (2 * F.col("pairs"))).alias("gamma"))


def model_value(kind: str, h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """A variogram model at distances ``h``."""
    s = np.minimum(h / reach, 1.0) if kind == "spherical" else h / reach
    part = {"spherical": lambda: 1.5 * s - 0.5 * s**3, "exponential": lambda: 1 - np.exp(-3 * s), "gaussian": lambda: 1 - np.exp(-3 * s * s)}[kind]()
    return np.where(h <= 0, 0.0, nugget + (sill - nugget) * part)


def fit_variogram(rows: list[tuple[float, float, int]], kind: str) -> tuple[float, float, float, float]:
    """(nugget, sill, range, weighted rss) of the best of a grid of ranges; linear least squares inside."""
    h, g, n = (np.array(x, float) for x in zip(*rows))
    best = None
    for reach in np.linspace(h.max() / 10, h.max() * 1.5, 60):
        shape = model_value(kind, h, 0.0, 1.0, reach)
        a = np.stack([np.ones(len(h)), shape], 1) * np.sqrt(n)[:, None]
        (c0, c1), *_ = np.linalg.lstsq(a, g * np.sqrt(n), rcond=None)
        c0, c1 = max(c0, 0.0), max(c1, 1e-12)
        rss = float((n * (g - c0 - c1 * shape) ** 2).sum())
        if best is None or rss < best[3]:
            best = (c0, c0 + c1, float(reach), rss)
    return best


def kriging(grid: DataFrame, points: DataFrame, radius: float, model: tuple[str, float, float, float], max_points: int = 16, drift: int = 0) -> DataFrame:
    """Ordinary (drift 0) or universal kriging: (r, c, v, variance) from the nearest points within ``radius``."""
    kind, nugget, sill, reach = model
    g = nearest_few(grid, points, radius, max_points)
    def solve(batches):
        for b in batches:
            out = []
            for r, c, x, y, a in b[["r", "c", "x", "y", "a"]].itertuples(index=False):
                q = np.array([(t["px"], t["py"], t["value"]) for t in a], float)
                d = np.hypot(q[:, 0] - x, q[:, 1] - y)
                if d.min() < 1e-12:
                    out.append((r, c, q[d.argmin(), 2], 0.0))
                    continue
                f = [np.ones(len(q))] + ([q[:, 0] - x, q[:, 1] - y] if drift else [])
                f0 = [1.0] + ([0.0, 0.0] if drift else [])
                k = len(f)
                if len(q) < k + 1:
                    continue
                m = np.zeros((len(q) + k,) * 2)
                m[: len(q), : len(q)] = model_value(kind, np.hypot(q[:, None, 0] - q[None, :, 0], q[:, None, 1] - q[None, :, 1]), nugget, sill, reach)
                m[len(q) :, : len(q)] = f
                m[: len(q), len(q) :] = np.array(f).T
                rhs = np.concatenate([model_value(kind, d, nugget, sill, reach), f0])
                w = np.linalg.lstsq(m, rhs, rcond=None)[0]
                out.append((r, c, float(w[: len(q)] @ q[:, 2]), max(float(w @ rhs), 0.0)))
            yield pd.DataFrame(out, columns=["r", "c", "v", "variance"])

    workers_see_package(grid.sparkSession)
    return g.mapInPandas(solve, "r int, c int, v double, variance double")


def _plates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel d * d * log(d) of each of ``a`` (n, 2) with each of ``b``."""
    d2 = np.subtract.outer(a[:, 0], b[:, 0])
    d2 *= d2
    dy = np.subtract.outer(a[:, 1], b[:, 1])
    dy *= dy
    d2 += dy
    np.maximum(d2, 1e-300, out=d2)  # the kernel of equal places is nothing to any precision
    np.log(d2, out=dy)
    d2 *= dy
    d2 *= 0.5
    return d2


def _plates_times(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``_plates(a, b) @ w`` in blocks that stay in a core's cache."""
    out = np.zeros(len(a))
    for i in range(0, len(a), 64):
        for j in range(0, len(b), 2048):
            out[i : i + 64] += _plates(a[i : i + 64], b[j : j + 2048]) @ w[j : j + 2048]
    return out


def _dense_spline(p: np.ndarray, v: np.ndarray, smoothing: float) -> np.ndarray:
    n = len(p)
    m = np.zeros((n + 3, n + 3))
    m[:n, :n] = _plates(p, p) + smoothing * np.eye(n)
    m[:n, n], m[:n, n + 1 :], m[n, :n], m[n + 1 :, :n] = 1, p, 1, p.T
    return np.linalg.lstsq(m, np.concatenate([v, np.zeros(3)]), rcond=None)[0]


def _few_plates(p: np.ndarray, smoothing: float, few: int) -> Callable[[np.ndarray], np.ndarray]:
    """About the inverse of kernel and smoothing for weights that no plane sees: exact on what ``few`` of the points span."""
    marks = p[np.linspace(0, len(p) - 1, min(few, len(p) // 2)).astype(int)]
    ends = marks[[marks[:, 0].argmin(), marks[:, 0].argmax()]]
    far = np.abs((ends[1, 0] - ends[0, 0]) * (marks[:, 1] - ends[0, 1]) - (ends[1, 1] - ends[0, 1]) * (marks[:, 0] - ends[0, 0]))
    three = np.concatenate([ends, marks[[far.argmax()]]])
    if far.max() == 0:
        return lambda r: r
    shares = lambda x: np.linalg.solve(np.c_[three, np.ones(3)].T, np.c_[x, np.ones(len(x))].T).T
    of_marks, of_three, base = shares(marks), _plates(three, marks), _plates(three, three)

    def block(x: np.ndarray) -> np.ndarray:  # the kernel that is positive for all weights: less its values at three places
        own = shares(x)
        return _plates(x, marks) - own @ of_three - _plates(x, three) @ of_marks.T + own @ base @ of_marks.T

    parts = [slice(i, i + 4096) for i in range(0, len(p), 4096)]
    held_ = [block(p[k]) for k in parts] if len(p) * len(marks) <= 24_000_000 else None  # 200 MB, or made again each time
    blocks = lambda: held_ or (block(p[k]) for k in parts)
    square = sum(c.T @ c for c in blocks())
    middle = block(marks)
    held, ways = np.linalg.eigh(smoothing * (middle + middle.T) / 2 + square)
    inverse = np.where(held > held[-1] * 1e-14, 1 / np.maximum(held, held[-1] * 1e-14), 0.0)

    def apply(r: np.ndarray) -> np.ndarray:
        t = sum(c.T @ r[k] for c, k in zip(blocks(), parts))
        t = ways @ (inverse * (ways.T @ t))
        return (r - np.concatenate([c @ t for c in blocks()])) / smoothing

    return apply


def _spline(spark: SparkSession, p: np.ndarray, v: np.ndarray, smoothing: float, most_rounds: int = 500) -> np.ndarray:
    """The weights of a spline through any number of points, by conjugate gradients over weights that no plane sees.

    The kernel is never held: each round makes it in blocks over the tasks, n * n values a round. The driver holds vectors.
    """
    n = len(p)
    middle = p.mean(0)
    poly = np.linalg.svd(np.c_[np.ones(n), p - middle], full_matrices=False)
    poly = poly[0][:, poly[1] > poly[1][0] * 1e-12]
    free = lambda w: w - poly @ (poly.T @ w)
    near = _few_plates(p, smoothing, int(np.clip(20_000_000 / n, 600, 2000))) if smoothing > 0 else lambda r: r
    places = spark.sparkContext.broadcast(p)
    cuts = np.linspace(0, n, max(min(n // 500, 192), 1) + 1).astype(int).tolist()

    def times(w: np.ndarray) -> np.ndarray:
        weights = spark.sparkContext.broadcast(w)
        rows = spark.sparkContext.parallelize(list(zip(cuts, cuts[1:])), len(cuts) - 1)
        got = rows.map(lambda k: _plates_times(places.value[k[0] : k[1]], places.value, weights.value)).collect()
        weights.destroy()
        return np.concatenate(got) + smoothing * w

    w, r = np.zeros(n), free(v)
    aim = 1e-10 * float(np.linalg.norm(r))
    z = free(near(r))
    way, size = z, float(r @ z)
    for _ in range(most_rounds):
        if np.linalg.norm(r) <= aim:
            break
        to = free(times(way))
        step = size / float(way @ to)
        w, r = w + step * way, r - step * to
        z = free(near(r))
        size, before = float(r @ z), size
        way = z + size / before * way
    else:
        raise ValueError(f"the spline of {n} points does not settle in {most_rounds} rounds: more smoothing is needed")
    plane = np.linalg.lstsq(np.c_[np.ones(n), p], v - times(w), rcond=None)[0]
    places.destroy()
    return np.concatenate([w, plane])


def thin_plate(grid: DataFrame, points: DataFrame, smoothing: float = 0.0, most: int = 2000) -> DataFrame:
    """A thin plate spline through all points: solved on the driver for at most ``most`` of them, beyond that by rounds over the tasks."""
    spark = grid.sparkSession
    workers_see_package(spark)
    held = points.filter("x is not null and y is not null and value is not null").orderBy("id").select("x", "y", "value").toPandas().to_numpy(float)
    p, v, n = np.ascontiguousarray(held[:, :2]), held[:, 2].copy(), len(held)
    w = _dense_spline(p, v, smoothing) if n <= most else _spline(spark, p, v, smoothing)
    both = spark.sparkContext.broadcast((p, w))

    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        p, w = both.value
        at = np.stack([x.to_numpy(float), y.to_numpy(float)], 1)
        return pd.Series(_plates_times(at, p, w[:n]) + w[n] + at @ w[n + 1 :])

    return grid.select("r", "c", F.pandas_udf(value, "double")("x", "y").alias("v"))


def half_plane(polygon: list[tuple[float, float]], a: float, b: float, c: float) -> list[tuple[float, float]]:
    """The part of a convex polygon where a x + b y <= c."""
    out = []
    for p, q in zip(polygon, polygon[1:] + polygon[:1]):
        u, v = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if u <= 0:
            out.append(p)
        if (u < 0 < v) or (v < 0 < u):
            t = u / (u - v)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def _size(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(polygon, polygon[1:] + polygon[:1]))) / 2


def sibson(x: float, y: float, near: np.ndarray) -> np.ndarray:
    """Natural-neighbour weights of (x, y) among ``near`` (n, 2): the areas that its cell would take from theirs.

    Cells are cut to a square as wide as the neighbours reach, which ends those that are open.
    """
    p = near - (x, y)
    half = float(np.abs(p).max()) or 1.0
    square = [(-half, -half), (half, -half), (half, half), (-half, half)]
    own = square
    for u, v in p:
        own = half_plane(own, u, v, (u * u + v * v) / 2)
    out = np.zeros(len(p))
    for i, (u, v) in enumerate(p):
        part = own
        for k, (s, t) in enumerate(p):
            if k != i and part:
                part = half_plane(part, s - u, t - v, (s * s + t * t - u * u - v * v) / 2)
        out[i] = _size(part) if len(part) > 2 else 0.0
    return out


def natural_neighbours(grid: DataFrame, points: DataFrame, radius: float, max_points: int = 32) -> DataFrame:
    """(r, c, v) by Sibson's areas among the nearest points within ``radius``; a point at the cell gives its value."""
    g = nearest_few(grid, points, radius, max_points)

    def solve(batches):
        for b in batches:
            out = []
            for r, c, x, y, a in b[["r", "c", "x", "y", "a"]].itertuples(index=False):
                q = np.array([(t["px"], t["py"], t["value"], t["d"]) for t in a], float)
                if q[0, 3] < 1e-12:
                    out.append((r, c, q[0, 2]))
                    continue
                w = sibson(x, y, q[:, :2])
                out.append((r, c, float(w @ q[:, 2] / w.sum()) if w.sum() > 0 else q[0, 2]))
            yield pd.DataFrame(out, columns=["r", "c", "v"])

    workers_see_package(grid.sparkSession)
    return g.mapInPandas(solve, "r int, c int, v double")


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of distinct points, point by point: those whose circles hold the next one go, and the rim
    of the hole is joined to it. Each step is one array pass over the triangles."""
    n = len(p)
    mid, reach = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-12) * 1e4
    q = np.concatenate([p, mid + reach * np.array([[-2.0, -1.0], [2.0, -1.0], [0.0, 2.5]])])
    tri = np.array([[n, n + 1, n + 2]])
    for i in np.lexsort((p[:, 1], p[:, 0])).tolist():
        a, b, c = (q[tri[:, k]] - q[i] for k in range(3))
        sq = lambda v: (v * v).sum(1)
        inside = (
            sq(a) * (b[:, 0] * c[:, 1] - c[:, 0] * b[:, 1]) - sq(b) * (a[:, 0] * c[:, 1] - c[:, 0] * a[:, 1]) + sq(c) * (a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1])
        ) > 0  # triangles run anticlockwise
        bad = tri[inside]
        edges = np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]])
        twice = set(map(tuple, edges[:, ::-1].tolist()))
        rim = [e for e in map(tuple, edges.tolist()) if e not in twice]
        tri = np.concatenate([tri[~inside], np.array([(u, v, i) for u, v in rim], int).reshape(-1, 3)])
    return tri[(tri < n).all(1)]


def _parts(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Barycentric weights of ``q`` (2,) in triangles ``a`` (n, 3, 2); minus infinity where a triangle is flat."""
    (x1, y1), (x2, y2), (x3, y3) = ((a[:, k] - q).T for k in range(3))
    d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = -((y2 - y3) * x3 + (x3 - x2) * y3) / d, -((y3 - y1) * x3 + (x1 - x3) * y3) / d
    return np.where((d == 0)[:, None], -np.inf, np.stack([u, v, 1 - u - v], 1))


def triangle_at(q: np.ndarray, p: np.ndarray, t: list[int]) -> tuple[list[int], np.ndarray, float]:
    """The Delaunay triangle of ``p`` that holds ``q``, from any triangle ``t`` that does; its plane over the paraboloid round
    ``q`` (a point is in the circle where its squared distance is below the plane) and the step that counts as a tie.

    The simplex method: the point deepest in the circle enters, the corner whose weight falls to nothing first leaves.
    Points on one circle are cut like a fan from the smallest, so that all cells between them see the same triangles.
    """
    p = p - q
    cost, one = (p * p).sum(1), np.ones(len(p))
    for turn in range(100_000):
        m = np.stack([p[t, 0], p[t, 1], one[t]])
        plane = np.linalg.solve(m.T, cost[t])
        rest, tie = cost - (p @ plane[:2] + plane[2]), 1e-11 * float(cost[t].max())
        below = np.flatnonzero(rest < -tie)
        if not len(below):
            break
        enter = int(below[0] if turn > 500 else rest.argmin())  # the smallest number cannot run in circles
        fall, have = np.linalg.solve(m, [*p[enter], 1.0]), np.maximum(np.linalg.solve(m, [0.0, 0.0, 1.0]), 0.0)
        go = [k for k in range(3) if fall[k] > 1e-12]
        least = min(have[k] / fall[k] for k in go)
        t[min((k for k in go if have[k] / fall[k] <= least), key=lambda k: t[k])] = enter
    ring = np.flatnonzero(np.abs(rest) <= tie)
    if len(ring) > 3:
        ring = ring[np.argsort(np.arctan2(p[ring, 1] - plane[1] / 2, p[ring, 0] - plane[0] / 2))]
        ring = np.roll(ring, -int(np.lexsort((p[ring, 1], p[ring, 0]))[0]))
        fan = np.array([(ring[0], i, j) for i, j in zip(ring[1:], ring[2:])])
        t = fan[_parts(p[fan], np.zeros(2)).min(1).argmax()].tolist()
    return t, plane, tie


def _hull(points: DataFrame) -> np.ndarray:
    """The corners of all points: of each batch first, of what those leave on the driver."""

    def part(batches):
        held: list[tuple[float, float]] = []
        for b in batches:
            held = convex_hull(held + list(zip(b["x"].tolist(), b["y"].tolist())))
        yield pd.DataFrame(held, columns=["x", "y"], dtype=float)

    return np.array(convex_hull([tuple(r) for r in points.select("x", "y").mapInPandas(part, "x double, y double").collect()]), float).reshape(-1, 2)


def tin(grid: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(r, c, v): linear over the Delaunay triangles of all points; null outside their hull.

    Only the triangles that hold cells are made. Each cell starts from the nearest points in eight directions (within ``radius``,
    or nearer where points are many) and a triangle of the hull; in each round the circles of the triangles meet
    all points by bins, the deepest in eight directions are taken in, and cells whose circles hold no other point are done.
    """
    workers_see_package(grid.sparkSession)
    p = written(points.filter("value is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.avg("value").alias("value")))
    n, x0, y0, x1, y1 = p.agg(F.count("x"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    hull = _hull(p)
    if len(hull) < 3:
        return grid.select("r", "c", F.lit(None).cast("double").alias("v"))
    corners = {(r["x"], r["y"]): r["value"] for r in p.join(F.broadcast(grid.sparkSession.createDataFrame(pd.DataFrame(hull, columns=["x", "y"]))), ["x", "y"]).collect()}
    tops = np.array([corners[tuple(q)] for q in hull.tolist()])
    start = min(radius, math.sqrt(64 * max((x1 - x0) * (y1 - y0), 1e-300) / n / math.pi))
    side = max(start, max(x1 - x0, y1 - y0) / 256)
    sector = lambda dx, dy: F.floor(F.atan2(dy, dx) * (4 / math.pi)).alias("k")
    spot = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), "value")
    listed = lambda df: df.groupBy("r", "c").agg(F.collect_list("s").alias("new"))  # noqa: E731  at most nine a cell
    kinds = "r int, c int, x double, y double, near array<struct<x: double, y: double, value: double>>, a double, b double, z double, tie double, v double, done boolean"

    def solve(batches):
        for frame in batches:
            out = []
            for r, c, x, y, near, new in frame[["r", "c", "x", "y", "near", "new"]].itertuples(index=False):
                q = np.array([x, y])
                old = {} if near is None else {(s["x"], s["y"]): s["value"] for s in near}
                more = {} if new is None else {(s["x"], s["y"]): s["value"] for s in new}
                held = old | more
                fan = np.stack([np.zeros(len(hull) - 2, int), np.arange(1, len(hull) - 1), np.arange(2, len(hull))], 1)
                inside = _parts(hull[fan], q).min(1)
                first = fan[inside.argmax()]
                if inside.max() < -1e-10:
                    out.append((r, c, x, y, None, None, None, None, None, None, True))
                    continue
                for i in first:
                    held[tuple(hull[i].tolist())] = float(tops[i])
                spots = list(held)
                t, plane, tie = triangle_at(q, np.array(spots), [spots.index(tuple(hull[i].tolist())) for i in first])
                w = _parts(np.array([[spots[i] for i in t]]), q)[0]
                v = float(w @ [held[spots[i]] for i in t])
                done = near is not None and len(held) == len(old)
                out.append((r, c, x, y, [{"x": s[0], "y": s[1], "value": held[s]} for s in spots], *map(float, plane), tie, v, done))
            yield pd.DataFrame(out, columns=["r", "c", "x", "y", "near", "a", "b", "z", "tie", "v", "done"])

    near = pairs_within(grid, p.withColumn("id", F.lit(0)), start).groupBy("r", "c", sector(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).agg(F.min_by(spot, F.struct("d", "px", "py")).alias("s"))
    state = grid.select("r", "c", "x", "y").join(listed(near), ["r", "c"], "left").withColumn("near", F.lit(None).cast("array<struct<x: double, y: double, value: double>>"))
    parts = []
    while True:
        state = written(state.mapInPandas(solve, kinds))
        parts.append(state.filter("done").select("r", "c", "v"))
        state = state.filter("not done")
        if state.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts)
        cx, cy, reach = F.col("x") + F.col("a") / 2, F.col("y") + F.col("b") / 2, F.sqrt(F.col("z") + (F.col("a") ** 2 + F.col("b") ** 2) / 4) * (1 + 1e-9)
        span = lambda m, lo, hi: F.explode(F.sequence(F.floor(F.greatest(m - reach, F.lit(lo)) / side), F.floor(F.least(m + reach, F.lit(hi)) / side)))  # noqa: E731, B023
        rings = state.withColumn("bx", span(cx, x0, x1)).withColumn("by", span(cy, y0, y1)).select("r", "c", "x", "y", "a", "b", "z", "tie", "bx", "by")
        met = rings.join(p.select(F.col("x").alias("px"), F.col("y").alias("py"), "value", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")), ["bx", "by"])
        dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
        depth = dx * dx + dy * dy - (F.col("a") * dx + F.col("b") * dy + F.col("z"))
        met = met.withColumn("depth", depth).filter("depth <= tie").groupBy("r", "c", sector(dx, dy)).agg(F.min_by(spot, F.struct("depth", "px", "py")).alias("s"))
        state = state.select("r", "c", "x", "y", "near").join(listed(met), ["r", "c"], "left")


def swath(points_on: DataFrame, baseline: list[tuple[float, float]], half_width: float) -> DataFrame:
    """bin (nearest vertex of the baseline), n, min, mean and max of (x, y, v) within the half width."""
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in baseline])
    d = F.transform(line, lambda q, i: F.struct(F.sqrt((F.col("x") - q["x"]) ** 2 + (F.col("y") - q["y"]) ** 2).alias("d"), i.alias("i")))
    t = points_on.select("v", F.array_min(d).alias("q")).filter(F.col("q.d") <= half_width)
    return t.groupBy(F.col("q.i").alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))


# rings: arrays of (x, y)


def ring_area(ring: Column) -> Column:
    """The shoelace area of a ring, closed or not."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def line_length(line: Column) -> Column:
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.sqrt((F.element_at(line, i + 1)["x"] - F.element_at(line, i)["x"]) ** 2 + (F.element_at(line, i + 1)["y"] - F.element_at(line, i)["y"]) ** 2))
    return F.when(F.size(line) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    n = F.size(ring)
    nxt = lambda i: F.element_at(ring, (i + 1) % n + 1)
    cross = lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"]
    total = lambda f: F.aggregate(F.transform(ring, f), F.lit(0.0), lambda a, x: a + x)
    area = total(cross)
    moment = lambda k: total(lambda p, i: (p[k] + nxt(i)[k]) * cross(p, i)) / (3 * area)
    return moment("x"), moment("y")


def bounding_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def buffer_point(x: Column, y: Column, distance: float, segments: int = 16) -> Column:
    """A regular ring round a point."""
    turn = 2 * math.pi / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.struct((x + distance * F.cos(i * turn)).alias("x"), (y + distance * F.sin(i * turn)).alias("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    n = F.size(ring)
    hits = F.filter(
        F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.element_at(ring, (i + 1) % n + 1).alias("q"))),
        lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.when(e["q"]["y"] != e["p"]["y"], e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]),
    )
    return F.size(hits) % 2 == 1


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The monotone chain."""
    p = sorted(set(points))
    if len(p) < 3:
        return p
    out: list[tuple[float, float]] = []
    for half in (p, p[::-1]):
        base = len(out)
        for q in half:
            while len(out) - base >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        out.pop()
    return out


def simplify(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas and Peucker."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (x1, y1), (x2, y2) = line[a], line[b]
        size = math.hypot(x2 - x1, y2 - y1)
        far, at = tolerance, None
        for i in range(a + 1, b):
            x, y = line[i]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / size if size else math.hypot(x - x1, y - y1)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[i] for i in sorted(keep)]


def clip_ring(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """A ring cut by a rectangle, side by side."""
    sides = ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1))
    for axis, at, sign in sides:
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = sign * (p[axis] - at) >= 0, sign * (q[axis] - at) >= 0
            if a:
                out.append(p)
            if a != b:
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return []
    return ring


def ring_udf(f, *args):
    """A ring function as an Arrow-batched Column function."""
    if (spark := SparkSession.getActiveSession()) is not None:
        workers_see_package(spark)

    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: [{"x": x, "y": y} for x, y in f([(p["x"], p["y"]) for p in r], *args)])

    return F.pandas_udf(run, "array<struct<x:double,y:double>>")
