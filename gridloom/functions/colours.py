"""Colour schemes as SQL text: stops, classes, and cells as red, green, blue and opacity."""

from __future__ import annotations

from gridloom.functions.surface import num

# Stops (place, red, green, blue) of the schemes, and the ten landform classes.
STOPS: dict[str, tuple[tuple[float, int, int, int], ...]] = {
    "terrain": ((0.0, 34, 139, 34), (0.25, 144, 190, 60), (0.5, 220, 200, 80), (0.75, 180, 120, 60), (1.0, 255, 255, 255)),
    "divergent": ((0.0, 44, 62, 180), (0.25, 120, 160, 220), (0.5, 240, 240, 240), (0.75, 220, 120, 80), (1.0, 180, 30, 30)),
    "grayscale": ((0.0, 0, 0, 0), (1.0, 255, 255, 255)),
    "ndvi": ((0.0, 120, 70, 20), (0.3, 200, 170, 60), (0.5, 240, 230, 100), (0.7, 100, 180, 50), (1.0, 10, 100, 20)),
    "blue_white_red": ((0.0, 33, 102, 172), (0.25, 103, 169, 207), (0.5, 247, 247, 247), (0.75, 239, 138, 98), (1.0, 178, 24, 43)),
    "water": ((0.0, 240, 249, 255), (0.25, 186, 228, 250), (0.5, 80, 180, 230), (0.75, 30, 120, 200), (1.0, 8, 48, 107)),
    "accumulation": ((0.0, 255, 255, 212), (0.25, 254, 217, 142), (0.5, 254, 153, 41), (0.75, 204, 76, 2), (1.0, 102, 37, 6)),
    "imhof1": ((0.0, 88, 122, 88), (0.2, 142, 165, 110), (0.45, 196, 178, 119), (0.7, 168, 130, 94), (0.9, 217, 200, 178), (1.0, 252, 248, 240)),
    "imhof2": ((0.0, 79, 109, 102), (0.2, 116, 144, 132), (0.45, 154, 158, 153), (0.7, 178, 169, 161), (0.9, 224, 216, 213), (1.0, 250, 250, 252)),
    "imhof3": ((0.0, 108, 121, 78), (0.25, 173, 156, 96), (0.5, 192, 137, 84), (0.75, 158, 96, 64), (0.92, 220, 198, 168), (1.0, 248, 240, 230)),
    "imhof4": ((0.0, 60, 72, 80), (0.3, 110, 100, 130), (0.55, 174, 142, 162), (0.8, 222, 196, 196), (1.0, 250, 240, 235)),
    "bw1": ((0.0, 28, 28, 28), (0.3, 90, 90, 90), (0.5, 150, 150, 150), (0.7, 210, 210, 210), (1.0, 252, 252, 252)),
    "bw2": ((0.0, 10, 10, 10), (0.45, 80, 80, 80), (0.55, 230, 230, 230), (1.0, 255, 255, 255)),
    "desert_dry": ((0.0, 196, 174, 124), (0.3, 212, 174, 116), (0.55, 188, 118, 80), (0.8, 158, 96, 76), (1.0, 240, 232, 220)),
    "pastel": ((0.0, 184, 220, 244), (0.25, 192, 232, 200), (0.5, 244, 232, 184), (0.75, 244, 196, 184), (1.0, 232, 200, 232)),
}
LANDFORMS = (
    (255, 255, 255), (56, 168, 0), (198, 219, 124), (255, 255, 115), (255, 200, 65), (233, 150, 0), (255, 85, 0), (196, 0, 0), (132, 0, 168), (0, 92, 230),
)


def channel(scheme: str, t: str, k: int) -> str:
    """Channel ``k`` (0 red, 1 green, 2 blue) at ``t`` from 0 to 1, as an integer."""
    if scheme == "geomorphons":
        cases = " ".join(f"WHEN {t} * 10 < {i + 1} THEN {c[k]}" for i, c in enumerate(LANDFORMS[:-1]))
        return f"CASE {cases} ELSE {LANDFORMS[-1][k]} END"
    stops = STOPS[scheme]
    cases = [f"WHEN {t} <= 0 THEN {stops[0][k + 1]}", f"WHEN {t} >= 1 THEN {stops[-1][k + 1]}"]
    for a, b in zip(stops, stops[1:]):
        cases.append(f"WHEN {t} <= {num(b[0])} THEN CAST(floor({a[k + 1]} + ({b[k + 1] - a[k + 1]}) * (({t} - {num(a[0])}) / {num(b[0] - a[0])}) + 0.5E0) AS INT)")
    return f"CASE {' '.join(cases)} END"


def rgba(scheme: str, v: str, low: str, high: str, empty: tuple[int, int, int, int] = (0, 0, 0, 0)) -> dict[str, str]:
    """``red``, ``green``, ``blue`` and ``opacity`` of a value over a range; ``empty`` where it is null."""
    t = f"(({v} - {low}) / CASE WHEN {high} > {low} THEN {high} - {low} ELSE 1E0 END)"
    names = ("red", "green", "blue")
    out = {n: f"CASE WHEN {v} IS NULL THEN {empty[k]} ELSE {channel(scheme, t, k)} END" for k, n in enumerate(names)}
    return out | {"opacity": f"CASE WHEN {v} IS NULL THEN {empty[3]} ELSE 255 END"}


# Names of bands by what they show.
BANDS: dict[str, tuple[str, ...]] = {
    "blue": ("b02", "blue", "coastal", "banda_azul", "sr_b1", "sr_b2", "blue_l8", "blue_l9"),
    "green": ("b03", "green", "banda_verde", "sr_b3", "green_l8", "green_l9"),
    "red": ("b04", "red", "banda_roja", "rouge", "sr_b4", "sr_b4c", "red_l8", "red_l9"),
    "nir": ("b08", "b8", "nir", "nir08", "infrared", "proche_infrarouge", "sr_b5", "nir_l8", "nir_l9"),
    "swir1": ("b11", "swir1", "swir16", "mid_infrared", "sr_b6", "swir1_l8", "swir1_l9"),
    "swir2": ("b12", "swir2", "swir22", "sr_b7", "swir2_l8", "swir2_l9"),
    "thermal": ("st_b10", "st_b11", "thermal", "tirs1", "tirs2", "b10", "lwir1", "lwir"),
    "sar_vv": ("vv", "vv_amplitude"),
    "sar_vh": ("vh", "vh_amplitude"),
    "sar_hh": ("hh", "hh_amplitude"),
    "sar_hv": ("hv", "hv_amplitude"),
    "pan": ("pan", "panchromatic"),
}


def band_type(key: str, common: str | None = None) -> str:
    """What a band shows, by its common name if it has one, else by its key; unknown otherwise."""
    name = f"lower(coalesce({common}, {key}))" if common else f"lower({key})"
    cases = " ".join(f"WHEN {name} IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in BANDS.items())
    return f"CASE {cases} ELSE 'unknown' END"
