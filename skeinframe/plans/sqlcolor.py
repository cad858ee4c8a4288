"""The colour formulas as DuckDB SQL text, for oracles."""

from __future__ import annotations

from skeinframe.functions.color import TO_XYZ, WHITE


def lab_columns(r: str = "r", g: str = "g", b: str = "b") -> str:
    """A select list: everything of the source and l, a, b_ (as lab_l, lab_a, lab_b), through nested subqueries' names."""
    lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    xyz = [f"(({lin(r)}) * {w[0]} + ({lin(g)}) * {w[1]} + ({lin(b)}) * {w[2]}) / {n}" for w, n in zip(TO_XYZ, WHITE, strict=True)]
    f = lambda t: f"(CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE ({t}) / (3 * 36.0::DOUBLE / 841) + 4.0::DOUBLE / 29 END)"
    x, y, z = map(f, xyz)
    return f"116 * {y} - 16 AS lab_l, 500 * ({x} - {y}) AS lab_a, 200 * ({y} - {z}) AS lab_b"


def ciede2000(source: str, columns: str) -> str:
    """SELECT columns, de FROM source, which has l1, a1, b1, l2, a2, b2."""
    hue = lambda b, a: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
    return f"""SELECT {columns}, sqrt(tl * tl + tc * tc + th * th + rt * tc * th) AS de FROM (
SELECT *, (l2 - l1) / (1 + 0.015 * (ml - 50) * (ml - 50) / sqrt(20 + (ml - 50) * (ml - 50))) AS tl, (c2 - c1) / (1 + 0.045 * mc) AS tc,
 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS th, -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0::DOUBLE, 7))) AS rt FROM (
SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.2 * cos(radians(4 * mh - 63)) AS t FROM (
SELECT *, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
 CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM (
SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, {hue("b1", "p1")} AS h1, {hue("b2", "p2")} AS h2 FROM (
SELECT *, a1 * (1 + stretch) AS p1, a2 * (1 + stretch) AS p2 FROM (
SELECT *, 0.5 * (1 - sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25.0::DOUBLE, 7)))) AS stretch FROM (
SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cb FROM ({source}))))))))"""
