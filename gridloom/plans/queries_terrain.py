"""Queries of the window operators: terrain, morphology, texture, focal statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import surface as sf
from gridloom.functions.surface import num
from gridloom.operators import focal, windows
from gridloom.plans.recipes import g_class, g_qty, nine, with_
from gridloom.plans.registry import r6, register, rounded

Z = with_("g", nine())


PREP = sf.prepare()


def prepared(text: str) -> str:
    """SQL ``y``: the nine neighbours and the derivatives that a formula names."""
    cols = "".join(f", CASE WHEN full9 THEN {t} END {k}" for k, t in sf.needed(text, PREP).items())
    return with_("g", nine(), f"y AS (SELECT *{cols} FROM z)")


def three(name: str, text: str, full: bool = True, extra: str = "") -> None:
    """A formula over z1..z9 of cells whose nine values are all there (or, if not ``full``, any)."""
    expr = r6(f"CASE WHEN {'full9' if full else 'true'} {extra} THEN {text} END")
    register(
        name,
        lambda s, d: focal.surface(g_qty(s, d), only=text).select("r", "c", F.expr(expr.replace("full9", "full")).alias("v")),
        prepared(text) + f"SELECT r, c, {expr} AS v FROM y",
    )


def several(name: str, parts: dict[str, str]) -> None:
    """Several formulas from one pass."""
    text = " ".join(parts.values())
    out = {k: r6(f"CASE WHEN full9 THEN {t} END") for k, t in parts.items()}
    register(
        name,
        lambda s, d: focal.surface(g_qty(s, d), only=text).select("r", "c", *[F.expr(t.replace("full9", "full")).alias(k) for k, t in out.items()]),
        prepared(text) + f"SELECT r, c, {', '.join(f'{t} AS {k}' for k, t in out.items())} FROM y",
    )


for units in ("degrees", "percent", "radians"):
    three(f"slope_{units}", sf.slope(units=units))
    if units != "percent":
        three(f"aspect_{units}", sf.aspect(units=units))
three("aspect_compass", sf.aspect(units="compass"))
three("northness", f"cos({sf.aspect('radians')})")
three("eastness", f"sin({sf.aspect('radians')})")
three("hillshade", sf.hillshade())
three("hillshade_normalized", sf.hillshade(normalized=True))
three("multidirectional_hillshade", sf.multidirectional_hillshade())
for kind in ("general", "profile", "plan"):
    three(f"curvature_{kind}", sf.curvature(kind))
    three(f"curvature_{kind}_zt", sf.curvature(kind, method="zevenbergen"))
    three(f"curvature_{kind}_simplified", sf.curvature(kind, formula="simplified"))
CURVES = sf.curvatures(sf.EVANS)
for kind, text in CURVES.items():
    three(f"advanced_curvature_{kind}", text)
several("all_curvatures", CURVES)
several("evans_young", {f"{k}_": f"e{k}" for k in "pqrst"})
several("zevenbergen_thorne", {f"{k}_": f"z{k}" for k in "pqrst"})
several("horn", {"p_": "gx", "q_": "gy"})
several("northness_eastness", {"northness": f"cos({sf.aspect('radians')})", "eastness": f"sin({sf.aspect('radians')})"})
hx, hy = sf.horn()
register(
    "extract_window",
    lambda s, d: focal.pivot3(g_qty(s, d)).filter("full").drop("full"),
    Z + "SELECT r, c, z1, z2, z3, z4, z5, z6, z7, z8, z9 FROM z WHERE full9",
)
three("shape_index", sf.shape_index())
three("curvedness", sf.curvedness())
three("pennock", sf.pennock())
three("accumulation_zones", sf.accumulation_zones())
three("surface_area_ratio", sf.surface_area_ratio())
three("contour_lines", sf.contour(100.0), full=False, extra="AND z5 IS NOT NULL")
INNER = "AND r BETWEEN 1 AND 30 AND c BETWEEN 1 AND 30 AND z5 IS NOT NULL"
three("sobel_edge", sf.sobel(), full=False, extra=INNER)
three("laplacian", "z2 + z8 + z4 + z6 - 4 * z5", full=False, extra=INNER)
three("lbp", sf.lbp())
three("lbp_uniform", sf.lbp_uniform())
D8 = f"CASE WHEN z5 IS NULL THEN 0 ELSE {sf.d8()} END"
register("flow_direction_raw", lambda s, d: focal.pivot3(g_qty(s, d)).select("r", "c", F.expr(D8).cast("int").alias("d")), Z + f"SELECT r, c, CAST({D8} AS INT) AS d FROM z")
near = [1, 2, 3, 4, 6, 7, 8, 9]
lows = ", ".join(f"CASE WHEN z{i} < z5 THEN z5 - z{i} END" for i in near)
NEIGHBOUR = {
    "max_downslope_change": f"coalesce(greatest({lows}), 0E0)",
    "min_downslope_change": f"coalesce(least({lows}), 0E0)",
    "max_upslope_change": f"coalesce(greatest({', '.join(f'CASE WHEN z{i} > z5 THEN z{i} - z5 END' for i in near)}), 0E0)",
    "num_downslope": f"CAST({' + '.join(f'(CASE WHEN z{i} < z5 THEN 1 ELSE 0 END)' for i in near)} AS DOUBLE)",
    "num_upslope": f"CAST({' + '.join(f'(CASE WHEN z{i} > z5 THEN 1 ELSE 0 END)' for i in near)} AS DOUBLE)",
}
register(
    "neighbour_stats",
    lambda s, d: focal.pivot3(g_qty(s, d)).filter("z5 IS NOT NULL").select("r", "c", *[F.expr(t).alias(k) for k, t in NEIGHBOUR.items()]),
    Z + f"SELECT r, c, {', '.join(f'{t} AS {k}' for k, t in NEIGHBOUR.items())} FROM z WHERE z5 IS NOT NULL",
)

# focal statistics: any window, partial at the edges
NEAR = lambda k, circ=False, src="g": (
    f"w AS (SELECT m.r, m.c, m.v AS v0, n.r - m.r AS dr, n.c - m.c AS dc, n.v FROM {src} m JOIN {src} n ON abs(n.r - m.r) <= {k} AND abs(n.c - m.c) <= {k}"
    + (f" AND (n.r - m.r) * (n.r - m.r) + (n.c - m.c) * (n.c - m.c) <= {k * k}" if circ else "") + ")"
)
AGG = {
    "mean": "avg(v)", "stddev": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "range": "max(v) - min(v)", "sum": "sum(v)",
    "count": "CASE WHEN count(v) > 0 THEN CAST(count(v) AS DOUBLE) END", "median": "median(v)",
    "percentile": "list_sort(list(v) FILTER (v IS NOT NULL))[CAST(floor(0.9E0 * (count(v) - 1) + 0.5E0) AS INT) + 1]",
}
for stat, agg in AGG.items():
    for circ in (False, True):
        k = 2
        register(
            f"focal_{stat}{'_circular' * circ}",
            lambda s, d, stat=stat, circ=circ, k=k: rounded(focal.statistic(g_qty(s, d), k, stat, circ, 90.0)),
            with_("g", NEAR(k, circ)) + f"SELECT r, c, {r6(agg)} AS v FROM w GROUP BY r, c",
        )
register(
    "focal_majority",
    lambda s, d: focal.statistic(g_class(s, d), 2, "majority"),
    with_("g", "gc", NEAR(2, src="gc")) + "SELECT r, c, v FROM (SELECT r, c, v, row_number() OVER (PARTITION BY r, c ORDER BY count(*) DESC, v) k FROM w WHERE v IS NOT NULL GROUP BY r, c, v) WHERE k = 1",
)


def window(name: str, fn, sql_value: str, k: int, where: str = "true", src: str = "g") -> None:
    register(name, lambda s, d: rounded(fn(g_qty(s, d))), with_("g", NEAR(k, src=src)) + f"SELECT r, c, {r6(f'CASE WHEN {where} THEN {sql_value} END')} AS v FROM w GROUP BY r, c, v0")


OTHERS = "FILTER (NOT (dr = 0 AND dc = 0))"
FULL = lambda k: f"v0 IS NOT NULL AND count(*) = {(2 * k + 1) ** 2}"
window("tpi", lambda g: windows.tpi(g, 3), f"v0 - avg(v) {OTHERS}", 3, FULL(3))
window("tri", lambda g: windows.tri(g, 2), f"sqrt(avg((v - v0) * (v - v0)) {OTHERS})", 2, FULL(2))
window("dev", lambda g: windows.dev(g, 3), f"CASE WHEN count(v) {OTHERS} < 2 THEN NULL WHEN var_pop(v) {OTHERS} < 1e-20 THEN 0E0 ELSE (v0 - avg(v) {OTHERS}) / stddev_pop(v) {OTHERS} END", 3, FULL(3))
window("diff_from_mean_elev", lambda g: windows.diff_from_mean(g, 3), f"v0 - avg(v) {OTHERS}", 3, FULL(3))
window("percent_elev_range", lambda g: windows.percent_range(g, 3), "CASE WHEN max(v) - min(v) < 2.220446049250313e-16 THEN 0E0 ELSE (v0 - min(v)) / (max(v) - min(v)) * 100 END", 3, FULL(3))
for name, k, f in (("lee_filter", 3, windows.lee),):
    mean, ci2 = "avg(v)", "(var_pop(v) / (avg(v) * avg(v)))"
    window(name, lambda g, f=f, k=k: f(g, 2 * k + 1, 4.0), f"CASE WHEN abs({mean}) < 1e-15 THEN {mean} WHEN {ci2} <= 0.25E0 THEN {mean} ELSE {mean} + (1 - 0.25E0 / {ci2}) * (v0 - {mean}) END", k, "v0 IS NOT NULL")

# morphology: square and cross elements
def morph(k: int, cross: bool = False) -> tuple[str, str, str]:
    """SQL of erosion and dilation of a named source, and the cells of the element."""
    n = 4 * k + 1 if cross else (2 * k + 1) ** 2
    on = f"abs(n.r - m.r) <= {k} AND abs(n.c - m.c) <= {k}" + (" AND (n.r = m.r OR n.c = m.c)" if cross else "")
    one = lambda name, src, f: f"{name} AS (SELECT m.r, m.c, CASE WHEN count(n.v) = {n} THEN {f}(n.v) END v FROM {src} m JOIN {src} n ON {on} GROUP BY m.r, m.c)"
    return one


for shape in ("square", "cross"):
    one = morph(1, shape == "cross")
    e, dl = one("e", "g", "min"), one("dl", "g", "max")
    op, cl = one("o", "e", "max"), one("k", "dl", "min")
    tail = "" if shape == "square" else "_cross"
    register(f"morph_erode{tail}", lambda s, d, p=shape: windows.erode(g_qty(s, d), 1, p), with_("g", e) + "SELECT r, c, v FROM e")
    register(f"morph_dilate{tail}", lambda s, d, p=shape: windows.dilate(g_qty(s, d), 1, p), with_("g", dl) + "SELECT r, c, v FROM dl")
    register(f"morph_opening{tail}", lambda s, d, p=shape: windows.opening(g_qty(s, d), 1, p), with_("g", e, op) + "SELECT r, c, v FROM o")
    register(f"morph_closing{tail}", lambda s, d, p=shape: windows.closing(g_qty(s, d), 1, p), with_("g", dl, cl) + "SELECT r, c, v FROM k")
    register(f"morph_gradient{tail}", lambda s, d, p=shape: windows.gradient(g_qty(s, d), 1, p), with_("g", e, dl) + "SELECT r, c, dl.v - e.v AS v FROM e JOIN dl USING (r, c)")
    register(f"morph_top_hat{tail}", lambda s, d, p=shape: windows.top_hat(g_qty(s, d), 1, p), with_("g", e, op) + "SELECT r, c, g.v - o.v AS v FROM g JOIN o USING (r, c)")
    register(f"morph_black_hat{tail}", lambda s, d, p=shape: windows.black_hat(g_qty(s, d), 1, p), with_("g", dl, cl) + "SELECT r, c, k.v - g.v AS v FROM g JOIN k USING (r, c)")

# windows over derived layers
normals = sf.normal()
NORM = "nv AS (SELECT r, c, " + ", ".join(f"CASE WHEN full9 THEN {t} END {k}" for k, t in zip(("x", "y", "zz"), normals)) + " FROM z)"
NSUM = lambda k: f"ns AS (SELECT m.r, m.c, count(*) cells, count(n.x) k, sum(n.x) sx, sum(n.y) sy, sum(n.zz) sz FROM nv m JOIN nv n ON abs(n.r - m.r) <= {k} AND abs(n.c - m.c) <= {k} GROUP BY m.r, m.c)"
RBAR = "(sqrt(sx * sx + sy * sy + sz * sz) / k)"
SPH = f"CASE WHEN g.v IS NULL OR cells < 9 OR k < 2 THEN NULL WHEN {RBAR} >= 1 THEN 0E0 WHEN {RBAR} < 1e-10 THEN pi() ELSE sqrt(-2 * ln({RBAR})) END"
register("spherical_std_dev", lambda s, d: rounded(windows.spherical_std_dev(g_qty(s, d), 1)), with_("g", nine(), NORM, NSUM(1)) + f"SELECT r, c, {r6(SPH)} AS v FROM ns JOIN g USING (r, c)")
NDEV = "nd AS (SELECT m.r, m.c, avg(acos(greatest(-1E0, least(1E0, (n.x * s.sx + n.y * s.sy + n.zz * s.sz) / nullif(sqrt(s.sx * s.sx + s.sy * s.sy + s.sz * s.sz), 0))))) a FROM nv m JOIN ns s ON s.r = m.r AND s.c = m.c JOIN nv n ON abs(n.r - m.r) <= 1 AND abs(n.c - m.c) <= 1 WHERE n.x IS NOT NULL GROUP BY m.r, m.c)"
register("normal_vector_deviation", lambda s, d: rounded(windows.normal_deviation(g_qty(s, d), 1)), with_("g", nine(), NORM, NSUM(1), NDEV) + f"SELECT r, c, {r6(f'CASE WHEN g.v IS NULL OR cells < 9 OR k < 2 OR {RBAR} < 1e-10 THEN NULL ELSE degrees(a) END')} AS v FROM ns JOIN g USING (r, c) LEFT JOIN nd USING (r, c)")
vx, vy = sf.horn(1 / 8)  # unnormalised gradients
VN = f"nv AS (SELECT r, c, CASE WHEN full9 THEN -{vy} / sqrt(1 + {vx} * {vx} + {vy} * {vy}) END x, CASE WHEN full9 THEN -{vx} / sqrt(1 + {vx} * {vx} + {vy} * {vy}) END y, CASE WHEN full9 THEN 1 / sqrt(1 + {vx} * {vx} + {vy} * {vy}) END zz FROM z)"
register("vrm", lambda s, d: rounded(windows.vrm(g_qty(s, d), 1)), with_("g", nine(), VN, NSUM(1)) + f"SELECT r, c, {r6(f'CASE WHEN r BETWEEN 2 AND 29 AND c BETWEEN 2 AND 29 AND k > 0 THEN 1 - {RBAR} END')} AS v FROM ns")
ASP = f"nv AS (SELECT r, c, CASE WHEN full9 AND NOT (abs({hx}) < 1e-10 AND abs({hy}) < 1e-10) THEN -{hy} / sqrt({hx} * {hx} + {hy} * {hy}) END x, CASE WHEN full9 AND NOT (abs({hx}) < 1e-10 AND abs({hy}) < 1e-10) THEN -{hx} / sqrt({hx} * {hx} + {hy} * {hy}) END y, 0E0 zz FROM z)"
register("circular_variance_aspect", lambda s, d: rounded(windows.circular_variance(g_qty(s, d), 1)), with_("g", nine(), ASP, NSUM(1)) + f"SELECT r, c, {r6(f'CASE WHEN g.v IS NULL OR cells < 9 OR k < 2 THEN NULL ELSE 1 - sqrt(sx * sx + sy * sy) / k END')} AS v FROM ns JOIN g USING (r, c)")
EDGE = f"ed AS (SELECT r, c, CASE WHEN true {INNER} THEN {sf.sobel()} END v FROM z)"
register("edge_density", lambda s, d: rounded(windows.edge_density(g_qty(s, d), 3, 500.0)), with_("g", nine(), EDGE) + f"SELECT m.r, m.c, {r6('CASE WHEN gg.v IS NULL OR count(*) < 49 OR count(n.v) = 0 THEN NULL ELSE CAST(count(*) FILTER (n.v > 500) AS DOUBLE) / count(n.v) END')} AS v FROM ed m JOIN g gg ON gg.r = m.r AND gg.c = m.c JOIN ed n ON abs(n.r - m.r) <= 3 AND abs(n.c - m.c) <= 3 GROUP BY m.r, m.c, gg.v")
