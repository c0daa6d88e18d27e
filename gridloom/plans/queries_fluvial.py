"""Queries of the channel operators."""

from __future__ import annotations

import math

from gridloom.functions.surface import num
from gridloom.operators import fluvial as fl
from gridloom.operators.graph import cell_of
from gridloom.plans.queries_graph import ACC, BASE, d8
from gridloom.plans.recipes import g_qty, with_
from gridloom.plans.registry import r6, register, rounded

STREAM = ACC + ", se AS (SELECT a.r, a.c, ed.r2, ed.c2, len * 30E0 AS len, a.v AS acc, b.v AS acc2, x.v AS z, y.v AS z2 FROM ac a JOIN g x ON x.r = a.r AND x.c = a.c LEFT JOIN ed ON ed.r = a.r AND ed.c = a.c LEFT JOIN ac b ON b.r = r2 AND b.c = c2 LEFT JOIN g y ON y.r = r2 AND y.c = c2 WHERE a.v >= 3)"
streams = lambda s, d: fl.stream_edges(d8(s, d), g_qty(s, d), 3.0)
register("channel_steepness", lambda s, d: rounded(fl.steepness(streams(s, d))), BASE + STREAM + f" SELECT r, c, {r6('greatest((z - z2) / len, 0E0) * power(acc + 1, 0.45E0)')} AS v FROM se".replace("greatest((z - z2) / len, 0E0)", "(CASE WHEN z2 IS NULL THEN NULL ELSE greatest((z - z2) / len, 0E0) END)"))
FX = lambda a: f"power(1 / (({a} + 1) * 900E0), 0.45E0)"
WALK = f", wk AS (SELECT r, c, r AS r0, c AS c0, 0E0 AS x FROM se UNION ALL SELECT se.r2, se.c2, r0, c0, x + se.len * ({FX('se.acc')} + {FX('se.acc2')}) / 2 FROM wk JOIN se ON se.r = wk.r AND se.c = wk.c WHERE se.r2 IS NOT NULL)"
register("chi_transform", lambda s, d: rounded(cell_of(fl.chi(streams(s, d))).select("r", "c", "chi")), BASE + STREAM + WALK + f" SELECT r0 AS r, c0 AS c, {r6('max(x)')} AS chi FROM wk GROUP BY r0, c0")
register("long_profile", lambda s, d: rounded(fl.main_stems(streams(s, d)).drop("outlet")))
register("concavity_index", lambda s, d: rounded(fl.concavity(streams(s, d), [0.1, 0.3, 0.5, 0.7, 0.9])))
T = num(math.tan(math.radians(80.0)))
register("energy_cone", lambda s, d: rounded(fl.energy_cone(g_qty(s, d), s.createDataFrame([(4, 4), (20, 25)], "r int, c int"), 80.0, 50.0)),
    with_("g", "so AS (SELECT r sr, c sc, v sz FROM g WHERE (r = 4 AND c = 4) OR (r = 20 AND c = 25))") + f"SELECT r, c, {r6(f'CASE WHEN v IS NULL THEN NULL ELSE greatest(max(sz + 50 - {T} * sqrt((r - sr) * (r - sr) + (c - sc) * (c - sc))) - v, 0E0) END')} AS v FROM g, so GROUP BY r, c, v")
