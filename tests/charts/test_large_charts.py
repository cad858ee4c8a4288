"""Structures for large charts against plain versions: tiles with seams, sweeps, scanlines, one pass over candidate grids."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from skeinframe.operators import grid, quality, regions, tiles
from skeinframe.sources import tables

CELLS = "chart_id long, idx long, y int, x int, pal_idx int"


def charts(seed, w=30, h=26):
    """Noise, a spiral, one colour, stripes; some cells missing in the last."""
    r = random.Random(seed)
    spiral = [[0] * w for _ in range(h)]
    y, x, dy, dx = 0, 0, 0, 1
    spiral[0][0] = 1
    for _ in range(3000):
        ny, nx = y + dy, x + dx
        ahead = (y + 2 * dy, x + 2 * dx)
        if not (0 <= ny < h and 0 <= nx < w) or (0 <= ahead[0] < h and 0 <= ahead[1] < w and spiral[ahead[0]][ahead[1]]) or spiral[ny][nx]:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < h and 0 <= nx < w) or spiral[ny][nx]:
                break
        y, x = ny, nx
        spiral[y][x] = 1
    kinds = [lambda y, x: r.randrange(2), lambda y, x: spiral[y][x], lambda y, x: 4, lambda y, x: y % 3, lambda y, x: r.randrange(3)]
    rows = [(c, y * w + x, y, x, f(y, x)) for c, f in enumerate(kinds) for y in range(h) for x in range(w)]
    return [q for q in rows if q[0] != 4 or r.random() < 0.9]


@pytest.mark.parametrize("tile", [1, 7, 13, 100])
@pytest.mark.parametrize("eight,sentinel", [(False, None), (True, 1)])
def test_tiled_labels_equal_whole_ones(spark, tile, eight, sentinel):
    df = spark.createDataFrame(charts(tile), CELLS)
    want = sorted(map(tuple, regions.label_regions(df, "pal_idx", eight, sentinel).collect()))
    assert sorted(map(tuple, tiles.label_regions_tiled(df, "pal_idx", eight, sentinel, tile).collect())) == want


def test_components_of_chains_stars_and_lone_edges(spark):
    r = random.Random(1)
    edges = [(1, i, i + 1) for i in range(300)] + [(2, 7, i) for i in range(8, 200)] + [(3, 5, 9), (3, 9, 5), (3, 4, 4)] + [(4, *sorted(r.sample(range(400), 2))) for _ in range(250)]
    got = {(x.chart_id, x.node): x.root for x in tiles.components(spark.createDataFrame(edges, "chart_id long, a long, b long")).collect()}
    around = {}
    for c, a, b in edges:
        around.setdefault((c, a), set()).add((c, b))
        around.setdefault((c, b), set()).add((c, a))
    for start in around:
        seen, queue = {start}, deque([start])
        while queue:
            for n in around[queue.popleft()] - seen:
                seen.add(n)
                queue.append(n)
        least = min(seen)[1]
        assert got.get(start, start[1]) == least
    assert tiles.components(spark.createDataFrame([], "chart_id long, a long, b long")).count() == 0


def depths(inside):
    """Breadth-first from the outside."""
    out, level = {}, [p for p in inside if any(n not in inside for n in around(p))]
    d = 0
    while level:
        out |= dict.fromkeys(level, d)
        level = list({n for p in level for n in around(p) if n in inside and n not in out})
        d += 1
    return out


def around(p):
    y, x = p
    return [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]


@pytest.mark.parametrize("bands", [None, 2, 1])
def test_depth_of_masked_shapes(spark, bands):
    r = random.Random(3)
    rows = []
    for c in range(6):
        for y in range(25):
            for x in range(21):
                if c < 4 or r.random() < 0.97:
                    inside = [True, (x - 10) ** 2 + (y - 12) ** 2 < 100, r.random() < 0.9, x < 3 or (y > 15 and x != 10), None if r.random() < 0.03 else True, True][c]
                    rows.append((c, y, x, inside))
    got = {(q.chart_id, q.y, q.x): q.depth for q in grid.edge_depth(spark.createDataFrame(rows, "chart_id long, y int, x int, inside boolean"), bands).collect()}
    for c in range(6):
        want = depths({(y, x) for k, y, x, inside in rows if k == c and inside})
        for k, y, x, _ in rows:
            if k == c:
                deep = want.get((y, x), -1)
                assert got[c, y, x] == (deep if bands is None else min(deep, bands))


def test_border_of_a_long_shape(spark):
    rows = [(1, 0, x, True, "n") for x in range(3000)] + [(2, y, x, True, "n") for y in range(9) for x in range(9)]
    got = grid.shape_border(spark.createDataFrame(rows, "chart_id long, y int, x int, inside boolean, code string"), ["a", "b"], 3)
    found = {(q.chart_id, q.y, q.x): (q.code, q.collapsed) for q in got.collect()}
    assert found[1, 0, 1500] == ("a", True) and found[2, 4, 4] == ("n", False) and found[2, 1, 4] == ("b", False) and found[2, 2, 4] == ("b", False)


def inside_by_crossings(cx, cy, edges):
    n = sum((y1 > cy) != (y2 > cy) and cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges)
    return len(edges) >= 3 and n % 2 == 1


def ring(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1], strict=True)]


def test_mask_by_scanline_equals_crossings(spark):
    """Polygons that cross themselves, reach off the grid, have corners on centres; two edges only; none."""
    r = random.Random(2)
    shapes = {i: ring([(r.uniform(-5, 30), r.uniform(-5, 30)) for _ in range(r.choice([3, 7, 40]))]) for i in range(6)}
    shapes[6] = ring([(0.5, 0.5), (10.5, 0.5), (10.5, 10.5), (0.5, 10.5)])
    shapes[7] = ring([(1.0, 1.0), (20.0, 20.0)])
    cells = [(s, y, x, "k") for s in range(9) for y in range(25) for x in range(25)]
    edges = [(s, *map(float, e)) for s, v in shapes.items() for e in v]
    got = grid.shape_mask(spark.createDataFrame(cells, "shape_id long, y int, x int, code string"), spark.createDataFrame(edges, "shape_id long, x1 double, y1 double, x2 double, y2 double"))
    assert got.columns == ["shape_id", "y", "x", "code", "inside"]
    rows = got.collect()
    assert len(rows) == len(cells)
    for q in rows:
        assert q.inside == inside_by_crossings(q.x + 0.5, q.y + 0.5, shapes.get(q.shape_id, [])), q


def test_mask_of_a_polygon_of_100_000_edges(spark):
    """A circle; a cell is inside unless its centre lies on the rim."""
    n, radius = 100_000, 190.0
    edges = spark.range(n).select(F.lit(1).cast("long").alias("shape_id"), *[(200 + radius * f((F.col("id") + k) * (2 * math.pi / n))).alias(name) for name, f, k in (("x1", F.cos, 0), ("y1", F.sin, 0), ("x2", F.cos, 1), ("y2", F.sin, 1))])
    cells = spark.range(400 * 400).select(F.lit(1).cast("long").alias("shape_id"), (F.col("id") / 400).cast("int").alias("y"), (F.col("id") % 400).cast("int").alias("x"))
    away = F.sqrt((F.col("x") - 199.5) ** 2 + (F.col("y") - 199.5) ** 2)
    wrong = grid.shape_mask(cells, edges).where((F.abs(away - radius) > 0.01) & (F.col("inside") != (away < radius)))
    assert wrong.count() == 0


def test_one_pass_fit_equals_the_two_measures(spark):
    r = random.Random(4)
    rows = []
    for i in range(12):
        for y in range(24):
            for x in range(18):
                v = [255 if i < 4 else 120, 30, 200][(x // [9, 6, 3, 2][i % 4] + y // [8, 6, 4, 2][i % 4]) % 3] if i < 8 else (0 if (x - 9) ** 2 + (y - 12) ** 2 < 50 + i else 255)
                rows.append((i, y * 18 + x, y, x, v, v, min(255, v + r.randrange(3))))
    df = spark.createDataFrame(rows, "image_id long, idx long, y int, x int, r int, g int, b int")
    candidates = [2, 5, 6, 9, 18, 20]
    want = {}
    for pos, w in enumerate(candidates):
        h = max(1, int(w * 24 / 18 + 0.5))
        mixed = {q.image_id: q.mixed_share for q in quality.mode_cells(df, w, h, 18, 24).collect()}
        lost = {q.image_id: q.lost or 0.0 for q in quality.sub_stitch_share(df, w, 18).collect()}
        for i in range(12):
            if mixed[i] < 0.35 and lost[i] < 0.42:
                want.setdefault(i, candidates[pos])
    fit = quality.smallest_fit(df, 18, 24, candidates)
    assert {q.image_id: q.stitches for q in fit.collect()} == {i: want.get(i) for i in range(12)} and len(set(want.values())) > 1
    assert fit._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + fit._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 3


def test_designs_by_jdbc_in_ranges(spark):
    """An in-memory database: ranges of updated_at, pushed filters, nulls and the upper end kept."""
    url = "jdbc:derby:memory:designs;create=true"
    rows = [(f"d{i}", "u", f"n{i}", '{"width": 1}' if i % 3 else "no chart", None, None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, user_id string, name string, chart_data string, design_meta string, stitch_progress string, at long")
    df = df.withColumn("updated_at", F.when(F.col("at") % 10 != 0, F.timestamp_seconds(F.col("at") * 86400))).drop("at")
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df.write.format("jdbc").options(url=url, dbtable="designs", createTableColumnTypes="name VARCHAR(40)", **options).mode("overwrite").save()
    got = tables.read_designs_jdbc(spark, url, "designs", "updated_at", 4, **options)
    assert got.rdd.getNumPartitions() == 4 and "chart" in got.columns
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r[0] for r in rows)
    some = got.where("name = 'n7'").select("id", "name")
    assert "PushedFilters: [*IsNotNull(NAME)" in some._jdf.queryExecution().toString().replace("name", "NAME").replace("\"", "")
    assert [r.id for r in some.collect()] == ["d7"]
    one = tables.read_designs_jdbc(spark, url, "(SELECT * FROM designs WHERE \"name\" = 'n7') d", "updated_at", 4, **options)
    assert one.count() == 1
