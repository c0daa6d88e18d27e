"""Spectral indices, calibration, masks and radar scaling as SQL text over band columns."""

from __future__ import annotations

import math

from gridloom.functions.surface import num


def guarded(top: str, bottom: str) -> str:
    """Null where the denominator is under 1e-10 in size."""
    return f"(CASE WHEN abs({bottom}) < 1e-10 THEN NULL ELSE ({top}) / ({bottom}) END)"


def normalized_difference(a: str, b: str) -> str:
    return guarded(f"{a} - {b}", f"{a} + {b}")


#: Indices that are a normalized difference of two bands (fixed values).
PAIRS = {
    "ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "mndwi": ("green", "swir"), "nbr": ("nir", "swir"), "ndre": ("nir", "red_edge"),
    "gndvi": ("nir", "green"), "ngrdi": ("green", "red"), "ndsi": ("green", "swir"), "ndbi": ("swir", "nir"), "ndmi": ("nir", "swir"),
    "dual_pol_water_index": ("co_pol", "cross_pol"),
}


def savi(n: str, r: str, soil: float = 0.5) -> str:
    return guarded(f"({n} - {r}) * {num(1 + soil)}", f"{n} + {r} + {num(soil)}")


def evi(n: str, r: str, b: str, g: float = 2.5, c1: float = 6.0, c2: float = 7.5, l_: float = 1.0) -> str:
    return guarded(f"{num(g)} * ({n} - {r})", f"{n} + {num(c1)} * {r} - {num(c2)} * {b} + {num(l_)}")


def evi2(n: str, r: str) -> str:
    return guarded(f"2.5E0 * ({n} - {r})", f"{n} + 2.4E0 * {r} + 1")


def bsi(s: str, r: str, n: str, b: str) -> str:
    return guarded(f"({s} + {r}) - ({n} + {b})", f"({s} + {r}) + ({n} + {b})")


def reci(n: str, e: str) -> str:
    return f"(CASE WHEN abs({e}) < 1e-10 THEN NULL ELSE {n} / {e} - 1 END)"


def msavi(n: str, r: str) -> str:
    inner = f"((2 * {n} + 1) * (2 * {n} + 1) - 8 * ({n} - {r}))"
    return f"(CASE WHEN {inner} < 0 THEN NULL ELSE (2 * {n} + 1 - sqrt({inner})) / 2 END)"


def band_math(a: str, b: str, op: str) -> str:
    """add, subtract, multiply, divide, power, min or max of two columns, null if either is."""
    text = {
        "add": f"{a} + {b}", "subtract": f"{a} - {b}", "multiply": f"{a} * {b}", "divide": guarded(a, b),
        "power": f"power({a}, {b})", "min": f"least({a}, {b})", "max": f"greatest({a}, {b})",
    }[op]
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {text} END)"


#: Upper limits of the dNBR severity classes 1 to 5; what is above is 6 (fixed values).
SEVERITY = (-0.25, 0.1, 0.27, 0.44, 0.66)


def burn_severity(x: str, limits: tuple[float, ...] = SEVERITY) -> str:
    cases = " ".join(f"WHEN {x} < {num(t)} THEN {i}E0" for i, t in enumerate(limits, 1))
    return f"CASE WHEN {x} IS NULL THEN NULL {cases} ELSE {len(limits) + 1}E0 END"


def landsat_toa(x: str, mult: float, add: float, elevation: float) -> str:
    return f"(({num(mult)} * {x} + {num(add)}) / {num(math.sin(math.radians(elevation)))})"


def landsat_sr(x: str) -> str:
    """Collection 2 surface reflectance (fixed scale and offset); 0 is fill."""
    return f"(CASE WHEN {x} = 0 THEN NULL ELSE {x} * 2.75e-5 - 0.2E0 END)"


def s2_reflectance(x: str, quantification: float = 10000.0, offset: float = 0.0) -> str:
    return f"(({x} + {num(offset)}) / {num(quantification)})"


def linear_to_db(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 10 * log10({x}) END)"


def db_to_linear(x: str) -> str:
    return f"power(10E0, {x} / 10)"


def water_mask(x: str, threshold: float, below: bool = True) -> str:
    return f"(CASE WHEN {x} {'<' if below else '>'} {num(threshold)} THEN 1 ELSE 0 END)"


def reclassify(x: str, classes: list[tuple[float, float, float]], default: float | None = None) -> str:
    """First (low, high, value) with low <= x < high; the last class is closed above."""
    cases = []
    for i, (lo, hi, v) in enumerate(classes):
        cases.append(f"WHEN {x} >= {num(lo)} AND {x} {'<=' if i == len(classes) - 1 else '<'} {num(hi)} THEN {num(v)}")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(cases)} ELSE {'NULL' if default is None else num(default)} END"


def change_class(x: str, down: float = -1.0, up: float = 1.0) -> str:
    """1 decrease, 2 none, 3 increase."""
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {num(down)} THEN 1E0 WHEN {x} > {num(up)} THEN 3E0 ELSE 2E0 END"


def excluded_bits(q: str, bits: int) -> str:
    return f"(({q} & {bits}) = 0)"


def log_transform(x: str) -> str:
    return f"(sign({x}) * ln(1 + abs({x})))"


#: Abramowitz and Stegun 26.2.17 (fixed values).
_CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided_p(z: str) -> str:
    """Twice the upper tail of the normal distribution beyond ``abs(z)``, by a polynomial."""
    t = f"(1 / (1 + 0.2316419E0 * abs({z})))"
    poly = "0E0"
    for c in reversed(_CDF):
        poly = f"({t} * ({num(c)} + {poly}))"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) > 8 THEN 0E0 ELSE 2 * 0.3989422804014327E0 * exp(-{z} * {z} / 2) * {poly} END)"
