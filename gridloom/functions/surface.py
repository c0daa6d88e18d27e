"""Surface derivatives and shading as SQL expressions over z1..z9.

The text is plain SQL (both Spark's and ANSI engines'), so a formula can be
put in ``expr``, in a view or in an external check unchanged. Formulas name the
columns of :func:`prepare`, which are computed once, before them; ``cs`` is the
cell size. It is taken for granted that none of the nine is null.
"""

from __future__ import annotations

import math
import re


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}E0"


def horn(cs: float = 1.0, zf: float = 1.0) -> tuple[str, str]:
    """East and south gradients by Horn's weights."""
    k = num(zf / (8.0 * cs))
    return (
        f"(((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) * {k})",
        f"(((z7 + 2 * z8 + z9) - (z1 + 2 * z2 + z3)) * {k})",
    )


def evans(cs: float = 1.0) -> dict[str, str]:
    """p, q (north positive), r, s, t by Evans and Young's least squares."""
    a, b, c = num(6 * cs), num(3 * cs * cs), num(4 * cs * cs)
    return {
        "p": f"((z3 + z6 + z9 - z1 - z4 - z7) / {a})",
        "q": f"((z1 + z2 + z3 - z7 - z8 - z9) / {a})",
        "r": f"((z1 + z3 + z4 + z6 + z7 + z9 - 2 * (z2 + z5 + z8)) / {b})",
        "s": f"((z3 + z7 - z1 - z9) / {c})",
        "t": f"((z1 + z2 + z3 + z7 + z8 + z9 - 2 * (z4 + z5 + z6)) / {b})",
    }


def zevenbergen(cs: float = 1.0) -> dict[str, str]:
    """p, q, r, s, t by central differences."""
    return {
        "p": f"((z6 - z4) / {num(2 * cs)})",
        "q": f"((z2 - z8) / {num(2 * cs)})",
        "r": f"((z4 - 2 * z5 + z6) / {num(cs * cs)})",
        "s": f"((z3 - z1 - z9 + z7) / {num(4 * cs * cs)})",
        "t": f"((z2 - 2 * z5 + z8) / {num(cs * cs)})",
    }


def prepare(cs: float = 1.0, zf: float = 1.0) -> dict[str, str]:
    """Formulas of the prepared columns: gx, gy (Horn), ep eq er es et (Evans-Young), zp zq zr zs zt (central differences)."""
    x, y = horn(cs, zf)
    return {"gx": x, "gy": y} | {f"e{k}": v for k, v in evans(cs).items()} | {f"z{k}": v for k, v in zevenbergen(cs).items()}


def needed(text: str, prepared: dict[str, str]) -> dict[str, str]:
    """The prepared columns that a formula names."""
    return {k: v for k, v in prepared.items() if re.search(rf"\b{k}\b", text)}


EVANS = {k: f"e{k}" for k in "pqrst"}
CENTRAL = {k: f"z{k}" for k in "pqrst"}


def slope(units: str = "degrees") -> str:
    x, y = "gx", "gy"
    g = f"sqrt({x} * {x} + {y} * {y})"
    return {"degrees": f"degrees(atan({g}))", "radians": f"atan({g})", "percent": f"({g} * 100)"}[units]


def aspect(units: str = "degrees") -> str:
    """The compass direction of steepest descent, clockwise from north; null where it is flat."""
    x, y = "gx", "gy"
    turn = f"atan2(-{x}, {y})"  # east and north parts of the descent
    rad = f"(CASE WHEN {turn} < 0 THEN {turn} + {num(2 * math.pi)} ELSE {turn} END)"
    out = {
        "degrees": f"degrees({rad})",
        "radians": rad,
        "compass": f"CAST(1 + CAST(floor((degrees({rad}) + 22.5E0) / 45) AS INT) % 8 AS DOUBLE)",
    }[units]
    return f"CASE WHEN abs({x}) < 1e-10 AND abs({y}) < 1e-10 THEN NULL ELSE {out} END"


def hillshade(azimuth: float = 315.0, altitude: float = 45.0, normalized: bool = False) -> str:
    x, y = "gx", "gy"
    az, zen = math.radians(450.0 - azimuth), math.radians(90.0 - altitude)
    shade = (
        f"greatest(0E0, least(1E0, ({num(math.cos(zen))} + {num(math.sin(zen))} * ({y} * {num(math.sin(az))} - {x} * {num(math.cos(az))}))"
        f" / sqrt(1 + {x} * {x} + {y} * {y})))"
    )
    return shade if normalized else f"floor({shade} * 255 + 0.5E0)"


def curvatures(d: dict[str, str]) -> dict[str, str]:
    """Fourteen curvatures from p, q, r, s, t."""
    p, q, r, s, t = (d[k] for k in "pqrst")
    g = f"({p} * {p} + {q} * {q})"
    w = f"(1 + {g})"
    flat = lambda x: f"(CASE WHEN {g} < 1e-20 THEN 0E0 ELSE {x} END)"
    mean = f"(-((1 + {q} * {q}) * {r} - 2 * {p} * {q} * {s} + (1 + {p} * {p}) * {t}) / (2 * {w} * sqrt({w})))"
    gauss = f"(({r} * {t} - {s} * {s}) / ({w} * {w}))"
    kh = flat(f"-({q} * {q} * {r} - 2 * {p} * {q} * {s} + {p} * {p} * {t}) / ({g} * sqrt({w}))")
    kv = flat(f"-({p} * {p} * {r} + 2 * {p} * {q} * {s} + {q} * {q} * {t}) / ({g} * {w} * sqrt({w}))")
    m = f"sqrt(greatest({mean} * {mean} - {gauss}, 0E0))"
    e = f"(({kv} - {kh}) / 2)"
    return {
        "mean_h": mean, "gaussian_k": gauss, "unsphericity_m": m, "difference_e": e,
        "minimal_kmin": f"({mean} - {m})", "maximal_kmax": f"({mean} + {m})", "horizontal_kh": kh, "vertical_kv": kv,
        "horizontal_excess_khe": f"({m} - {e})", "vertical_excess_kve": f"({m} + {e})", "accumulation_ka": f"({kh} * {kv})",
        "ring_kr": f"({m} * {m} - {e} * {e})",
        "rotor": flat(f"(({p} * {p} - {q} * {q}) * {s} - {p} * {q} * ({r} - {t})) / ({g} * sqrt({g}))"),
        "laplacian": f"({r} + {t})",
    }


def curvature(kind: str = "general", method: str = "evans", formula: str = "full") -> str:
    """General, profile or plan curvature, in full or without the denominators."""
    d = EVANS if method == "evans" else CENTRAL
    if formula == "full":
        c = curvatures(d)
        return {"general": c["mean_h"], "profile": c["vertical_kv"], "plan": c["horizontal_kh"]}[kind]
    p, q, r, s, t = (d[k] for k in "pqrst")
    if kind == "general":
        return f"(-({r} + {t}) / 2)"
    g = f"({p} * {p} + {q} * {q})"
    top = f"{p} * {p} * {r} + 2 * {p} * {q} * {s} + {q} * {q} * {t}" if kind == "profile" else f"{q} * {q} * {r} - 2 * {p} * {q} * {s} + {p} * {p} * {t}"
    return f"(CASE WHEN {g} < 1e-20 THEN 0E0 ELSE -({top}) / {g} END)"


def hessian_extremes() -> tuple[str, str]:
    """The larger and the smaller eigenvalue of the Hessian by central differences."""
    r, s, t = "zr", "zs", "zt"
    half = f"sqrt((({r} - {t}) / 2) * (({r} - {t}) / 2) + {s} * {s})"
    return f"(({r} + {t}) / 2 + {half})", f"(({r} + {t}) / 2 - {half})"


def shape_index() -> str:
    hi, lo = hessian_extremes()
    return (
        f"CASE WHEN abs({hi} - {lo}) < 1e-20 THEN (CASE WHEN abs({hi}) < 1e-20 THEN NULL WHEN {hi} > 0 THEN 1E0 ELSE -1E0 END)"
        f" ELSE {num(2 / math.pi)} * atan(({hi} + {lo}) / ({hi} - {lo})) END"
    )


def curvedness() -> str:
    hi, lo = hessian_extremes()
    return f"sqrt(({hi} * {hi} + {lo} * {lo}) / 2)"


def normal(cs: float = 1.0) -> tuple[str, str, str]:
    """The unit surface normal."""
    x, y = horn(cs)
    n = f"sqrt(1 + {x} * {x} + {y} * {y})"
    return f"(-{x} / {n})", f"(-{y} / {n})", f"(1 / {n})"


def multidirectional_hillshade(altitude: float = 45.0) -> str:
    """Mark's four azimuths, each weighted by its closeness to the aspect."""
    x, y = "gx", "gy"
    zen = math.radians(90.0 - altitude)
    top, bottom = [], []
    for azimuth in (225.0, 270.0, 315.0, 360.0):
        az = math.radians(450.0 - azimuth)
        s, c = num(math.sin(az)), num(math.cos(az))
        shade = f"greatest(0E0, ({num(math.cos(zen))} + {num(math.sin(zen))} * ({y} * {s} - {x} * {c})) / sqrt(1 + {x} * {x} + {y} * {y}))"
        along = f"({x} * {s} + {y} * {c})"
        weight = f"(CASE WHEN {x} * {x} + {y} * {y} < 1e-20 THEN 1E0 ELSE greatest(1 - {along} * {along} / ({x} * {x} + {y} * {y}), 0E0) END)"
        top.append(f"{shade} * {weight}")
        bottom.append(weight)
    return f"floor(least(({' + '.join(top)}) / ({' + '.join(bottom)}), 1E0) * 255 + 0.5E0)"


def pennock(slope_at: float = 3.0, profile_at: float = 0.1, plan_at: float = 0.0) -> str:
    s, v, h = slope(), curvature("profile"), curvature("plan")
    side = lambda a, b: f"(CASE WHEN {h} > {num(plan_at)} THEN {a} ELSE {b} END)"
    return (
        f"CAST(CASE WHEN {s} <= {num(slope_at)} THEN 1 WHEN {v} > {num(profile_at)} THEN {side(2, 3)}"
        f" WHEN {v} < {num(-profile_at)} THEN {side(6, 7)} ELSE {side(4, 5)} END AS DOUBLE)"
    )


def accumulation_zones() -> str:
    h, v = curvature("plan"), curvature("profile")
    return f"CAST(CASE WHEN {h} < 0 AND {v} < 0 THEN 1 WHEN {h} < 0 THEN 2 WHEN {v} < 0 THEN 3 ELSE 4 END AS DOUBLE)"


def sobel() -> str:
    """Gradient magnitude; a null neighbour counts as 0."""
    z = [f"coalesce(z{i}, 0E0)" for i in range(1, 10)]
    x = f"(({z[2]} + 2 * {z[5]} + {z[8]}) - ({z[0]} + 2 * {z[3]} + {z[6]}))"
    y = f"(({z[6]} + 2 * {z[7]} + {z[8]}) - ({z[0]} + 2 * {z[1]} + {z[2]}))"
    return f"sqrt({x} * {x} + {y} * {y})"


#: The ring round the centre, clockwise from the north-west.
RING = (1, 2, 3, 6, 9, 8, 7, 4)


def lbp() -> str:
    """Eight bits, the first of the ring being the highest: neighbours not below the centre."""
    bits = " + ".join(f"(CASE WHEN z{n} >= z5 THEN {1 << (7 - i)} ELSE 0 END)" for i, n in enumerate(RING))
    return f"CAST({bits} AS DOUBLE)"


def lbp_uniform() -> str:
    """Bits set if the ring changes at most twice, else 9."""
    on = [f"(CASE WHEN z{n} >= z5 THEN 1 ELSE 0 END)" for n in RING]
    turns = " + ".join(f"abs({a} - {b})" for a, b in zip(on, on[1:] + on[:1]))
    return f"CAST(CASE WHEN {turns} <= 2 THEN {' + '.join(on)} ELSE 9 END AS DOUBLE)"


def surface_area_ratio(cs: float = 1.0) -> str:
    """Area of the eight triangles round the centre over their plane area."""
    ring = [(1, -1, 1), (2, 0, 1), (3, 1, 1), (6, 1, 0), (9, 1, -1), (8, 0, -1), (7, -1, -1), (4, -1, 0)]
    parts = []
    for (n, x1, y1), (m, x2, y2) in zip(ring, ring[1:] + ring[:1]):
        x1, y1, x2, y2 = (v * cs for v in (x1, y1, x2, y2))
        u, v = f"(z{n} - z5)", f"(z{m} - z5)"
        a = f"({num(y1)} * {v} - {num(y2)} * {u})"
        b = f"({num(x2)} * {u} - {num(x1)} * {v})"
        c = num((x1 * y2 - x2 * y1) ** 2)
        parts.append(f"sqrt({a} * {a} + {b} * {b} + {c})")
    return f"(({' + '.join(parts)}) / {num(8 * cs * cs)})"


def crossing(a: str, b: str, interval: float = 10.0, base: float = 0.0) -> str:
    """The lowest contour level from the lower value on that is at most the higher; null if there is none."""
    i, o = num(interval), num(base)
    level = f"({o} + ceil((least({a}, {b}) - {o}) / {i}) * {i})"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = {b} THEN NULL WHEN {level} <= greatest({a}, {b}) THEN {level} END)"


def contour(interval: float = 10.0, base: float = 0.0) -> str:
    """The right neighbour's crossing, else the lower one's."""
    return f"coalesce({crossing('z5', 'z6', interval, base)}, {crossing('z5', 'z8', interval, base)})"


def d8(cs: float = 1.0) -> str:
    """The neighbour of the steepest drop (1 to 8, counter-clockwise from east, the first on ties); 0 without one."""
    codes = list(enumerate((6, 3, 2, 1, 4, 7, 8, 9), 1))
    drop = lambda n, i: f"coalesce((z5 - z{n}) / {num(cs if i % 2 else cs * math.sqrt(2))}, -1E0)"
    best = f"greatest({', '.join(drop(n, i) for i, n in codes)})"
    cases = " ".join(f"WHEN {drop(n, i)} = {best} THEN {i}" for i, n in codes)
    return f"CASE WHEN {best} <= 0 THEN 0 {cases} END"
