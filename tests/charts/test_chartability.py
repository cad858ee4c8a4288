"""The five signals of a chart against plain loops over its cells."""

import random

import pytest
from skeinframe.operators import quality


def plain(g):
    h, w = len(g), len(g[0])
    on = lambda y, x: 0 <= y < h and 0 <= x < w and g[y][x] != 0
    inside = [(y, x) for y in range(h) for x in range(w) if on(y, x)]
    kept = sum(all(on(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for y, x in inside)
    blocks = [on(y, x) + on(y, x + 1) + on(y + 1, x) + on(y + 1, x + 1) for y in range(h - 1) for x in range(w - 1)]
    corners, edges = sum(b in (1, 3) for b in blocks), sum(b == 2 for b in blocks)
    x0, x1 = min(x for _, x in inside), max(x for _, x in inside)
    y0, y1 = min(y for y, _ in inside), max(y for y, _ in inside)
    box = [on(y, x) != on(y, x1 - (x - x0)) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
    return len({g[y][x] for y, x in inside}), kept / len(inside), corners / (corners + edges) if corners + edges else 0.0, sum(box) / len(box)


def test_signals_equal_plain_loops(spark):
    r = random.Random(5)
    noise = [[r.choice([0, 0, 1, 2, 3]) for _ in range(11)] for _ in range(9)]
    block = [[1 if 2 <= y < 7 and 2 <= x < 9 else 0 for x in range(12)] for y in range(10)]
    lop = [[2 if x >= y else 0 for x in range(8)] for y in range(8)]
    charts = {1: noise, 2: block, 3: lop}
    cells = spark.createDataFrame([(k, y * len(g[0]) + x, y, x, v) for k, g in charts.items() for y, row in enumerate(g) for x, v in enumerate(row)], "chart_id long, idx long, y int, x int, pal_idx int")
    palette = spark.createDataFrame([(k, v, 60 * v, 250 - 70 * v, 30) for k in charts for v in range(4)], "chart_id long, pal_idx int, r int, g int, b int")
    found = {x.chart_id: x for x in quality.chartability(cells, palette, [0]).collect()}
    assert set(found) == set(charts)
    for k, g in charts.items():
        x = found[k]
        assert (x.colours, x.survival, x.corner_ratio, x.mismatch) == pytest.approx(plain(g))
    assert (found[2].regions, found[2].specks, found[2].largest, found[2].mismatch) == (1, 0, 1.0, 0.0)
    assert found[2].s_colour == 1.0 and found[3].s_symmetry < 1.0
