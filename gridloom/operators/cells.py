"""Cell-wise, global, zonal and classification operators on grids and band tables.

A band table is (r, c, b1, b2, ...). Global statistics are one row that is
joined back; ranks come from quantile bins, so no sort puts a grid in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.formula import to_sql
from gridloom.functions.spectral import two_sided_p
from gridloom.operators.focal import moments
from gridloom.plans.lineage import written


def band_formula(bands: DataFrame, formula: str, names: list[str]) -> DataFrame:
    """(r, c, v) of a band formula; see :mod:`gridloom.functions.formula`."""
    return bands.select("r", "c", F.expr(to_sql(formula, names)).alias("v"))


def stack(grids: dict[str, DataFrame]) -> DataFrame:
    """Equally laid out grids side by side, as a band table."""
    out = None
    for name, g in grids.items():
        g = g.withColumnRenamed("v", name)
        out = g if out is None else out.join(g, ["r", "c"])
    return out


def with_global(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds statistics of the whole table to every row (one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table marked for broadcast after its rows were counted; more than ``most`` of them are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return F.broadcast(df)


def _bin(df: DataFrame, value: str, bins: int) -> Column:
    """The number of ``bins`` - 1 quantiles below a value."""
    q = df.select(F.col(value).cast("double").alias("q"))
    cuts = sorted(set(q.approxQuantile("q", [i / bins for i in range(1, bins)], 0.001))) if bins > 1 else []
    return (F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)).cast("int")


def value_ranks(df: DataFrame, value: str = "v", bins: int = 64) -> DataFrame:
    """One row a distinct value that is not null: ``n``, its rows, and ``below``, the rows of smaller values.

    Rows are counted by value first, so a value that most rows hold is one row. Values are cut at quantiles;
    counts are summed up within a bin and moved by the sizes of the bins before it.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")))
    counts = counts.withColumn("_bin", _bin(counts, value, bins))
    before = counts.groupBy("_bin").agg(F.sum("n").alias("_n"))
    before = before.select("_bin", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    ahead = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("_k", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(F.broadcast(before), "_bin")  # one row a bin
    return out.select(value, "n", (F.col("_k") + F.col("_at")).alias("below"))


def nearest_rank(df: DataFrame, q: float, value: str = "v") -> DataFrame:
    """One row ``x``: the value at index round((n - 1) * q) of the sorted values."""
    r = with_global(value_ranks(df, value), _n=F.sum("n"))
    at = F.floor((F.col("_n") - 1) * F.lit(q) + 0.5)
    return r.filter((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select(F.col(value).alias("x"))


def dos1(grid: DataFrame, q: float = 0.001) -> DataFrame:
    """Dark-object subtraction, not below 0."""
    return grid.crossJoin(F.broadcast(nearest_rank(grid, q))).select("r", "c", F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - F.col("x"), F.lit(0.0))).alias("v"))


def histogram_match(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Source values moved to the reference's distribution: rank, then linear between neighbours."""
    ref = value_ranks(reference).select(F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("n"))).alias("nth"), F.col("v").alias("x"))
    n_ref = reference.agg(F.count("v").alias("m"))
    src = with_global(source.select("r", "c", "v").join(value_ranks(source).select("v", "below"), "v"), _n=F.count("*")).crossJoin(F.broadcast(n_ref))
    pos = F.col("below") / F.greatest(F.col("_n") - 1, F.lit(1)) * (F.col("m") - 1)
    src = src.select("r", "c", pos.alias("pos"), "m").withColumn("lo", F.floor("pos"))
    src = src.withColumn("hi", F.least(F.col("lo") + 1, F.col("m") - 1))
    lo, hi = ref.select((F.col("nth") - 1).alias("lo"), F.col("x").alias("a")), ref.select((F.col("nth") - 1).alias("hi"), F.col("x").alias("b"))
    part = F.col("pos") - F.col("lo")
    out = src.join(lo, "lo").join(hi, "hi").select("r", "c", (F.col("a") * (1 - part) + F.col("b") * part).alias("v"))
    return source.select("r", "c").join(out, ["r", "c"], "left")


def moment_match(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Source moved to the reference's mean and (population) deviation."""
    stats = lambda df, a, b: df.agg(F.avg("v").alias(a), F.stddev_pop("v").alias(b))
    both = stats(source, "m1", "s1").crossJoin(stats(reference, "m2", "s2"))
    return source.crossJoin(F.broadcast(both)).select("r", "c", ((F.col("v") - F.col("m1")) * (F.col("s2") / F.col("s1")) + F.col("m2")).alias("v"))


# zones


def zonal(cells: DataFrame) -> DataFrame:
    """Eleven statistics of each zone of (r, c, v, zone); zone 0 and null values take no part. Smallest value wins ties."""
    cells = cells.filter("zone <> 0 AND v IS NOT NULL")
    base = cells.groupBy("zone").agg(
        F.count("*").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev"),
        F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"),
    )
    uses = written(cells.groupBy("zone", "v").agg(F.count("*").alias("k")))
    modes = uses.groupBy("zone").agg(
        F.min(F.struct((-F.col("k")).alias("k"), "v"))["v"].alias("majority"), F.min(F.struct("k", "v"))["v"].alias("minority"), F.count("*").alias("variety")
    )
    return base.join(modes, "zone").join(zone_medians(uses), "zone").select("zone", "count", "sum", "mean", "std_dev", "min", "max", "range", "median", "variety", "majority", "minority")


def zone_medians(uses: DataFrame, bins: int = 64) -> DataFrame:
    """(zone, median) from (zone, v, k): only the values of the bins that hold a zone's middle meet in a task."""
    uses = uses.withColumn("b", _bin(uses, "v", bins))
    sizes = uses.groupBy("zone", "b").agg(F.sum("k").alias("n"))
    up = Window.partitionBy("zone").orderBy("b")  # at most ``bins`` rows a zone
    sizes = sizes.withColumns({"to": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("zone"))})
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    sizes = sizes.select("zone", "b", (F.col("to") - F.col("n")).alias("at"), "to", low.alias("low"), high.alias("high"))
    holds = sizes.filter("(at < low and low <= to) or (at < high and high <= to)").drop("to")
    rows = uses.join(holds, ["zone", "b"])
    w = Window.partitionBy("zone", "b").orderBy("v")
    rows = rows.withColumn("to", F.col("at") + F.sum("k").over(w)).withColumn("from", F.col("to") - F.col("k"))
    at = lambda n: F.max(F.when(F.col("from").__lt__(F.col(n)) & (F.col(n) <= F.col("to")), F.col("v")))
    return rows.groupBy("zone").agg(((at("low") + at("high")) / 2).alias("median"))


def zonal_raster(cells: DataFrame, stat: str = "mean") -> DataFrame:
    """Every cell of a zone takes the zone's statistic."""
    table = zonal(cells).select("zone", F.col(stat).cast("double").alias("s"))
    return cells.join(table, "zone", "left").select("r", "c", F.col("s").alias("v"))


def morans_i(grid: DataFrame) -> DataFrame:
    """One row: i, expected, z_score and p_value of the global index with queen neighbours."""
    g = with_global(grid.filter("v IS NOT NULL"), _m=F.avg("v")).select("r", "c", (F.col("v") - F.col("_m")).alias("d"))
    wide = grid.select("r", "c").join(g, ["r", "c"], "left").withColumnRenamed("d", "v")
    near = moments(wide, 1).filter("v IS NOT NULL").withColumns({"near": F.col("s") - F.col("v"), "k": F.col("n") - 1})
    t = near.agg(
        F.count("*").cast("double").alias("n"), F.sum("k").cast("double").alias("w"), F.sum(F.col("v") * F.col("near")).alias("top"),
        F.sum(F.col("v") * F.col("v")).alias("m2"), F.sum(F.pow("v", F.lit(4))).alias("m4"), F.sum(4.0 * F.col("k") * F.col("k")).alias("s2"),
    )
    t = t.selectExpr("*", "(n / w) * (top / m2) AS i", "-1 / (n - 1) AS expected", "2 * w AS s1", "(m4 / n) / ((m2 / n) * (m2 / n)) AS b2")
    var = (
        "(n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * w * w))"
        " / ((n - 1) * (n - 2) * (n - 3) * w * w) - expected * expected"
    )
    t = t.selectExpr("i", "expected", "n", f"{var} AS var_").selectExpr("i", "expected", "(i - expected) / sqrt(CASE WHEN var_ > 0 THEN var_ ELSE 1 / ((n - 1) * (n - 1)) END) AS z_score")
    return t.selectExpr("*", f"{two_sided_p('z_score')} AS p_value")


def getis_ord(grid: DataFrame, k: int = 1) -> DataFrame:
    """(r, c, z, p): Gi* of each cell over its square window, partial at the edges."""
    m = moments(grid, k).crossJoin(F.broadcast(grid.agg(F.avg("v").alias("gm"), F.stddev_pop("v").alias("gs"), F.count("v").cast("double").alias("gn"))))
    z = "CASE WHEN v IS NULL THEN NULL WHEN gs * sqrt((gn * n - n * n) / (gn - 1)) > 2.220446049250313e-16 THEN (s - gm * n) / (gs * sqrt((gn * n - n * n) / (gn - 1))) ELSE 0E0 END"
    return m.selectExpr("r", "c", f"{z} AS z").selectExpr("r", "c", "z", f"{two_sided_p('z')} AS p")


# classification


def signatures(cells: DataFrame) -> DataFrame:
    """(label, mean, std_dev, n) of (label, v), labels rounded, at least two values each; deviations at least 1e-10."""
    label = F.floor(F.col("label") + 0.5)
    s = cells.filter("label IS NOT NULL AND v IS NOT NULL").groupBy(label.alias("label")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std_dev"), F.count("*").alias("n"))
    return s.filter("n >= 2").withColumns({"label": F.col("label").cast("double"), "std_dev": F.greatest("std_dev", F.lit(1e-10))})


def minimum_distance(grid: DataFrame, classes: DataFrame) -> DataFrame:
    """The label of the nearest mean; the first label on ties. ``classes`` are counted and broadcast."""
    table = F.broadcast(few(classes).agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("a")))
    best = F.expr("array_min(transform(a, x -> named_struct('d', abs(v - x.mean), 'l', x.label))).l")
    return grid.crossJoin(table).select("r", "c", F.when(F.col("v").isNotNull(), best).alias("v"))


def maximum_likelihood(grid: DataFrame, classes: DataFrame) -> DataFrame:
    """The label of the largest Gaussian log-likelihood; the first label on ties."""
    table = F.broadcast(few(classes).agg(F.sort_array(F.collect_list(F.struct("label", "mean", "std_dev"))).alias("a")))
    best = F.expr("array_min(transform(a, x -> named_struct('d', ln(x.std_dev) + (v - x.mean) * (v - x.mean) / (2 * x.std_dev * x.std_dev), 'l', x.label))).l")
    return grid.crossJoin(table).select("r", "c", F.when(F.col("v").isNotNull(), best).alias("v"))


def _nearest(centres: list[float]) -> Column:
    c = ", ".join(f"named_struct('d', abs(v - {x!r}D), 'i', {i})" for i, x in enumerate(centres, 1))
    return F.expr(f"array_min(array({c})).i")


def kmeans(grid: DataFrame, k: int = 5, iterations: int = 100, convergence: float = 1e-3) -> DataFrame:
    """One-dimensional k-means from evenly spaced sorted values; labels from 1. Only k centres are on the driver."""
    values = written(value_ranks(grid))  # distinct values and their rows: all that the passes read
    n = values.agg(F.sum("n")).first()[0]
    at = [min(i * n // k + n // (2 * k), n - 1) for i in range(k)]
    seeds = values.filter(F.exists(F.array(*[F.lit(a) for a in at]), lambda a: (F.col("below") <= a) & (a < F.col("below") + F.col("n"))))
    got = [(r["below"], r["n"], r["v"]) for r in seeds.collect()]  # k rows at most
    centres = [float(next(v for below, m, v in got if below <= a < below + m)) for a in at]
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    for _ in range(iterations):
        means = {r["i"]: r["m"] for r in values.groupBy(_nearest(centres).alias("i")).agg(mean.alias("m")).collect()}
        new = [float(means.get(i, c)) for i, c in enumerate(centres, 1)]
        moved = max(abs(a - b) for a, b in zip(new, centres))
        centres = new
        if moved < convergence:
            break
    return grid.select("r", "c", F.when(F.col("v").isNotNull(), _nearest(centres).cast("double")).alias("v"))


def isodata(
    grid: DataFrame, k: int = 5, least: int = 2, most: int = 10, iterations: int = 50, min_samples: int = 10,
    max_std: float = 10.0, min_merge: float = 5.0, convergence: float = 1e-3,
) -> DataFrame:
    """ISODATA in one dimension: assign, drop small, split wide, merge near, until centres rest."""
    values = written(grid.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")))  # all that the passes read
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    total, square = F.sum(F.col("v") * F.col("n")), F.sum((F.col("v") - lo) ** 2 * F.col("n"))
    centres = [lo + (hi - lo) * (i + 0.5) / k for i in range(k)]
    for _ in range(iterations):
        rows = values.groupBy(_nearest(centres).alias("i")).agg((total / F.sum("n")).alias("m"), (square / F.sum("n")).alias("q"), F.sum("n").alias("n"))
        rows = rows.select("m", F.sqrt(F.greatest(F.col("q") - (F.col("m") - lo) ** 2, F.lit(0.0))).alias("s"), "n").collect()  # one a centre
        stats = sorted((r["m"], r["s"], r["n"]) for r in rows)
        big = [x for x in stats if x[2] >= min_samples]
        stats = big if len(big) >= least else stats
        new: list[float] = []
        for m, s, n in stats:
            if s > max_std and len(stats) + len(new) < 2 * most and n >= 2 * min_samples and len(new) + 1 < most:
                new += [m - s / 2, m + s / 2]
            else:
                new.append(m)
        new.sort()
        merged: list[float] = []
        for x in new:
            if merged and x - merged[-1] < min_merge and len(new) > least:
                merged[-1] = (merged[-1] + x) / 2
            else:
                merged.append(x)
        rest = len(merged) == len(centres) and max(abs(a - b) for a, b in zip(merged, centres)) < convergence
        centres = merged
        if rest:
            break
    return grid.select("r", "c", F.when(F.col("v").isNotNull(), _nearest(centres).cast("double")).alias("v"))


def covariance(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sample covariance and count of complete rows; one row comes to the driver."""
    full = df.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = full.agg(F.count("*"), *[F.avg(n) for n in names], *[F.covar_samp(names[i], names[j]) for i, j in pairs]).first()
    n, mean = row[0], np.array(row[1 : 1 + len(names)], float)
    cov = np.zeros((len(names),) * 2)
    for (i, j), x in zip(pairs, row[1 + len(names) :]):
        cov[i, j] = cov[j, i] = x
    return mean, cov, n


def principal_components(bands: DataFrame, names: list[str], keep: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(r, c, pc1, ...), eigenvalues and vectors; each vector's largest part is positive."""
    mean, cov, _ = covariance(bands, names)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: keep or len(names)]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    score = lambda v: sum((F.col(n) - float(m)) * float(x) for n, m, x in zip(names, mean, v))
    return bands.select("r", "c", *[score(vectors[:, k]).alias(f"pc{k + 1}") for k in range(len(order))]), values, vectors


# pansharpening on equally laid out tables


def brovey(df: DataFrame, pan: str, names: list[str]) -> DataFrame:
    """Bands scaled by pan over their mean; null where that is not positive."""
    total = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return df.select("r", "c", *[F.when(total > 0, F.col(n) * F.col(pan) / F.when(total > 0, total)).alias(n) for n in names])


def gram_schmidt(df: DataFrame, pan: str, names: list[str]) -> DataFrame:
    """Bands plus the detail of pan, matched to the simulated one, by each band's regression gain."""
    sim = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    t = df.withColumn("_s", sim).dropna(subset=["_s", pan])
    gains = t.agg(F.avg("_s").alias("ms"), F.stddev_pop("_s").alias("ss"), F.avg(pan).alias("mp"), F.stddev_pop(pan).alias("sp"), *[(F.covar_pop("_s", n) / F.var_pop("_s")).alias(f"g_{n}") for n in names])
    t = df.withColumn("_s", sim).crossJoin(F.broadcast(gains))
    detail = (F.col(pan) - F.col("mp")) * F.col("ss") / F.col("sp") + F.col("ms") - F.col("_s")
    return t.select("r", "c", *[(F.col(n) + F.col(f"g_{n}") * detail).alias(n) for n in names])


def pca_pansharpen(df: DataFrame, pan: str, names: list[str]) -> DataFrame:
    """The first component is replaced by pan, matched to its mean and deviation."""
    mean, cov, _ = covariance(df.dropna(subset=[pan]), names)
    values, vectors = np.linalg.eigh(cov)
    first = vectors[:, -1] * (1 if vectors[:, -1].sum() >= 0 else -1)
    pc = sum((F.col(n) - float(m)) * float(x) for n, m, x in zip(names, mean, first))
    stats = df.withColumn("_c", pc).agg(F.avg(pan).alias("mp"), F.stddev_samp(pan).alias("sp"), F.stddev_samp("_c").alias("sc"))
    t = df.withColumn("_c", pc).crossJoin(F.broadcast(stats))
    new = (F.col(pan) - F.col("mp")) * F.col("sc") / F.col("sp")
    return t.select("r", "c", *[(F.col(n) + (new - F.col("_c")) * float(x)).alias(n) for n, x in zip(names, first)])


def mad(df: DataFrame, before: list[str], after: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Multivariate alteration detection: (r, c, mad1, ...) and canonical correlations, least change last."""
    variates, rho = _variates(df, before, after, F.lit(1.0))
    return df.select("r", "c", *[c for c in df.columns if c not in ("r", "c")], *variates), rho


def _variates(df: DataFrame, before: list[str], after: list[str], w: Column) -> tuple[list[Column], np.ndarray]:
    """The variates as expressions of the bands, from one pass of weighted moments; and the correlations."""
    names, b = before + after, len(before)
    full = df.dropna(subset=names)
    pairs = [(i, j) for i in range(2 * b) for j in range(i, 2 * b)]
    row = full.agg(F.sum(w), *[F.sum(w * F.col(n)) for n in names], *[F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    total, mean = row[0], np.array(row[1 : 1 + 2 * b], float) / row[0]
    cov = np.zeros((2 * b, 2 * b))
    for (i, j), x in zip(pairs, row[1 + 2 * b :]):
        cov[i, j] = cov[j, i] = x / total - mean[i] * mean[j]
    s11, s22, s12 = cov[:b, :b], cov[b:, b:], cov[:b, b:]
    root = np.linalg.inv(np.linalg.cholesky(s11))
    values, u = np.linalg.eigh(root @ s12 @ np.linalg.solve(s22, s12.T) @ root.T)
    order = np.argsort(values)[::-1]
    rho, a = np.sqrt(np.clip(values[order], 0, 1)), root.T @ u[:, order]
    a = a * np.sign(a[np.abs(a).argmax(0), np.arange(b)])
    v = np.linalg.solve(s22, s12.T @ a)
    v = v / np.sqrt(np.maximum((v * (s22 @ v)).sum(0), 1e-300))
    side = lambda ns, m, x: sum((F.col(n) - float(c)) * float(y) for n, c, y in zip(ns, m, x))
    return [(side(before, mean[:b], a[:, k]) - side(after, mean[b:], v[:, k])).alias(f"mad{k + 1}") for k in range(b)], rho


def ir_mad(df: DataFrame, before: list[str], after: list[str], iterations: int = 25, tol: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """Reweighted MAD: cells weigh by the chi-square chance of no change, until the correlations rest."""
    b, last, weight = len(before), None, F.lit(1.0)
    df = written(df)
    for _ in range(iterations):
        variates, rho = _variates(df, before, after, weight)
        if last is not None and np.abs(rho - last).max() < tol:
            break
        last = rho
        z = sum((v * v / float(max(2 * (1 - rho[k]), 1e-12)) for k, v in enumerate(variates)), F.lit(0.0))
        weight = chi_square_tail(z, b)  # of the bands themselves, so rounds do not nest
    return df.select("r", "c", *[c for c in df.columns if c not in ("r", "c")], *variates), rho


def chi_square_tail(x: Column, k: int) -> Column:
    """The chance that a chi-square value of ``k`` degrees exceeds ``x``, by its finite sum (odd k: with a normal tail)."""
    half = x / 2
    if k % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, k // 2):
            term = term * half / i
            total = total + term
        return F.exp(-half) * total
    tail = F.expr("0D")
    term = F.sqrt(2 * x / np.pi) * F.exp(-half)
    for i in range(3, k + 1, 2):
        tail = tail + term
        term = term * x / i
    u = 1 / (1 + 0.3275911 * F.sqrt(half))
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return poly * F.exp(-half) + tail
