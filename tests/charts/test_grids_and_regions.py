"""Grid, codec, region and stream operators: round trips, identities and brute force."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from skeinframe.functions import labmath
from skeinframe.operators import grid, image, matching, quality, regions
from skeinframe.sources import codec


def cells_of(spark, grids, name="pal_idx"):
    rows = [(c, y * len(g[0]) + x, y, x, v) for c, g in grids.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    kind = "string" if isinstance(rows[0][4], str) else "int"
    return spark.createDataFrame(rows, f"chart_id long, idx long, y int, x int, {name} {kind}")


def random_grids(seed, n=4, h=9, w=11, colours=3):
    r = random.Random(seed)
    return {c: [[r.choices(range(colours), [6, 3, 1])[0] for _ in range(w)] for _ in range(h)] for c in range(n)}


def back(rows, value="pal_idx"):
    out = {}
    for r in rows:
        out.setdefault(r.chart_id, {})[(r.y, r.x)] = r[value]
    return {c: [[g[y, x] for x in range(max(k[1] for k in g) + 1)] for y in range(max(k[0] for k in g) + 1)] for c, g in out.items()}


def components(g, eight=False):
    h, w = len(g), len(g[0])
    label = {}
    for s in [(y, x) for y in range(h) for x in range(w)]:
        if s in label:
            continue
        label[s], stack = s[0] * w + s[1], [s]
        while stack:
            y, x = stack.pop()
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)) + (((1, 1), (1, -1), (-1, 1), (-1, -1)) if eight else ()):
                t = (y + dy, x + dx)
                if 0 <= t[0] < h and 0 <= t[1] < w and t not in label and g[t[0]][t[1]] == g[y][x]:
                    label[t] = label[s]
                    stack.append(t)
    return label


def test_labels_by_search(spark):
    grids = random_grids(1)
    for eight in (False, True):
        found = {(r.chart_id, r.y, r.x): r.region for r in regions.label_regions(cells_of(spark, grids), eight=eight).collect()}
        assert found == {(c, *k): v for c, g in grids.items() for k, v in components(g, eight).items()}


def test_rotations_and_composites_are_identities(spark):
    grids = random_grids(2)
    cells = cells_of(spark, grids).withColumns({"width": F.lit(11), "height": F.lit(9)})
    turned = cells
    for _ in range(4):
        turned = grid.rotate_cells(turned, 90)
    assert back(turned.collect()) == grids
    base = cells_of(spark, {0: [["a", "b"], ["c", "d"]]}, "code")
    layers = spark.createDataFrame([], "chart_id long, layer_id string, z int, kind string, off_x int, off_y int, scale int")
    own = spark.createDataFrame([], "layer_id string, row int, col int, code string")
    dims = spark.createDataFrame([(0, 2, 2)], "chart_id long, width int, height int")
    assert sorted(r.code for r in grid.composite_layers(base, layers, own, dims, "-").collect()) == ["a", "b", "c", "d"]
    assert back(grid.merge_edits(cells, cells, cells, "pal_idx").join(cells.select("chart_id", "idx", "y", "x"), ["chart_id", "idx"]).collect()) == grids


def test_chart_round_trip_and_errors(spark):
    grids = {c: [[f"t{v}" for v in line] for line in g] for c, g in random_grids(3).items()}
    cells = cells_of(spark, grids, "code")
    dims = spark.createDataFrame([(c, 11, 9) for c in grids], "chart_id long, width int, height int")
    names = spark.createDataFrame([("t0", "n", "F", "#000000"), ("t1", "n", None, "#111111"), ("t2", "n", "F", "#222222")], "code string, name string, family string, hex string")
    charts = codec.cells_to_chart(cells, dims, names)
    assert back(codec.chart_to_cells(charts).collect(), "code") == grids
    first = charts.first().chart
    assert sum(first.usage.values()) == 99 and {s.name for s in first.sections} == {"F", "Other"}
    assert charts.where("error IS NOT NULL").count() == 0
    assert codec.cells_to_chart(cells, dims, names.where("code <> 't2'")).where("error IS NULL").count() < 4


def test_progress_text(spark):
    dims = spark.createDataFrame([(1, 3, 2), (2, 3, 2), (3, 2, 2)], "design_id int, w int, h int")
    done = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 5), (3, 9)], "design_id int, idx long")
    text = {r.design_id: r.stitch_progress for r in codec.encode_progress(done, dims).collect()}
    assert text == {1: "P1|3|2|0.2.3.1", 2: "P1|3|2|6", 3: None}
    rows = spark.createDataFrame([(1, text[1]), (2, "P1|3|2|5"), (3, "nonsense"), (4, "P1|2|2|1.2.1"), (5, None)], "design_id int, stitch_progress string")
    got = {r.design_id: (r.done, r.error is not None) for r in codec.decode_progress(rows).collect()}
    assert got == {1: ([0, 1, 5], False), 2: (None, True), 3: (None, True), 4: ([1, 2], False), 5: (None, True)}


def test_despeckle_and_depth(spark):
    g = [[0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 2], [0, 0, 0, 2]]
    assert back(grid.despeckle(cells_of(spark, {0: g})).collect())[0] == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 2], [0, 0, 0, 2]]
    ring = grid.edge_depth(cells_of(spark, {0: [[0] * 5] * 5}).withColumn("inside", F.lit(True)), 1)
    assert ring.where("depth = 0").count() == 16


def test_holes_and_gaps():
    g = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0]])
    assert regions.fill_holes(g, 0)[1, 1] == 1 and (regions.fill_holes(g, 0)[:, 3] == 0).all()
    assert regions.bridge_gaps(np.array([[0, 0, 0], [2, 0, 2], [0, 0, 0]]), 0)[1, 1] == 2


def test_gaps_in_a_column_come_first_and_protected_cells_stay(spark):
    cross = np.array([[0, 3, 0], [2, 0, 2], [0, 3, 0]])
    assert regions.bridge_gaps(cross, 0)[1, 1] == 3
    kept = np.zeros((3, 3), bool)
    kept[1, 1] = True
    assert regions.bridge_gaps(cross, 0, kept)[1, 1] == 0
    hole = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    assert regions.fill_holes(hole, 0, kept)[1, 1] == 0
    # two background colours are one ground: neither fills the other, and a hole open to either stays
    two = np.array([[1, 1, 1, 1], [1, 0, 9, 1], [1, 1, 9, 1]])
    assert (regions.fill_holes(two, [0, 9]) == two).all()
    cells = cells_of(spark, {0: hole.tolist(), 1: two.tolist()})
    backgrounds = spark.createDataFrame([(0, 0), (1, 0), (1, 9)], "chart_id long, background int")
    out = back(regions.hole_fill(cells, backgrounds).collect())
    assert out == {0: [[1] * 3] * 3, 1: two.tolist()}
    assert back(regions.hole_fill(cells, backgrounds, protected=cells.where("idx = 4")).collect())[0] == hole.tolist()


def engine_confetti_by_search(g, min_size, colours):
    """Cell by cell, as the rule says: regions of the old grid in order, neighbours of the grid as it is by then."""
    h, w = len(g), len(g[0])
    old, new = [list(r) for r in g], [list(r) for r in g]
    members = {}
    for k, v in sorted(components(old, True).items()):
        members.setdefault(v, []).append(k)
    for _, own in sorted(members.items()):
        v = old[own[0][0]][own[0][1]]
        line = any({(y + i * a, x + i * b) for i in range(3)} <= set(own) for y, x in own for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)))
        if len(own) > min_size or v in colours or line:
            continue
        near = [new[y + a][x + b] for y, x in own for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= y + a < h and 0 <= x + b < w and new[y + a][x + b] != v]
        if near:
            best = max(sorted(set(near)), key=near.count)
            for y, x in own:
                new[y][x] = best
    return new


def test_engine_confetti(spark):
    grids = random_grids(6, n=5, colours=3)
    cells = cells_of(spark, grids)
    none = cells.where("false")
    for size, colours in ((2, []), (4, [0])):
        changed = {(r.chart_id, r.idx): r.replacement for r in regions.engine_confetti(cells, size, colours, none).collect()}
        got = {c: [[changed.get((c, y * 11 + x), v) for x, v in enumerate(line)] for y, line in enumerate(g)] for c, g in grids.items()}
        assert got == {c: engine_confetti_by_search(g, size, colours) for c, g in grids.items()}
    pair = [[0, 0, 0, 0], [0, 1, 1, 0], [0, 0, 0, 0]]  # a region of the size itself goes; corners count
    assert regions.engine_confetti(cells_of(spark, {0: pair}), 2, [], none).count() == 2
    assert regions.engine_confetti(cells_of(spark, {0: pair}), 2, [], cells_of(spark, {0: pair}).where("idx = 5")).count() == 0


def test_cell_windows():
    assert quality.cell_windows(3, 10) == [(0, 3), (3, 6), (6, 10)]
    for cells in (3, 4, 7, 10):
        for length in (10, 11, 23):
            own = quality.cell_windows(cells, length, mirror=True)
            assert own == [(length - b, length - a) for a, b in own[::-1]] or cells % 2 == 0 and length % 2 == 1
            assert sorted(p for a, b in own for p in range(a, b)) == list(range(length))
    assert quality.cell_windows(5, 3) == [(0, 1), (0, 1), (1, 2), (1, 2), (2, 3)]


def test_votes_by_lab_and_first_dark_pixel(spark):
    pixels = [(1, y * 4 + x, y, x, 240, 240, 200) for y in range(4) for x in range(4)]
    pixels[1], pixels[2], pixels[5], pixels[6] = (1, 1, 0, 1, 90, 0, 0), (1, 2, 0, 2, 0, 0, 90), (1, 5, 1, 1, 0, 0, 90), (1, 6, 1, 2, 90, 0, 0)
    px = spark.createDataFrame(pixels, "image_id long, idx long, y int, x int, r int, g int, b int")
    clusters = spark.createDataFrame([(1, 0, 240, 240, 200), (1, 1, 90, 0, 0), (1, 2, 0, 0, 90)], "image_id long, cluster_id int, r int, g int, b int")
    named = clusters.select("image_id", "cluster_id", F.element_at(F.array(F.lit("bg"), F.lit("red"), F.lit("blue")), F.col("cluster_id") + 1).alias("code"))
    assert [tuple(r) for r in image.vote_cells(px, clusters, named, "bg", 1, 1, 4, 4).collect()] == [(1, 0, 0, "red")]
    around = {(r.y, r.x): r.code for r in image.vote_cells(px, clusters, named, "bg", 3, 2, 4, 4, fitted=(1, 0, 1, 1)).collect()}
    assert around == {(y, x): "red" if (y, x) == (0, 1) else "bg" for y in range(2) for x in range(3)}
    # nearer in RGB to the first, in Lab to the second
    one = spark.createDataFrame([(1, 0, 0, 0, 40, 90, 200)], "image_id long, idx long, y int, x int, r int, g int, b int")
    pair = np.array([[0, 90, 160], [90, 90, 240]])
    lab = labmath.rgb_to_lab(np.vstack([[40, 90, 200], pair]))
    nearest = int(((lab[1:] - lab[0]) ** 2).sum(axis=1).argmin())
    table = spark.createDataFrame([(1, i, *map(int, c)) for i, c in enumerate(pair)], "image_id long, cluster_id int, r int, g int, b int")
    assert image.nearest_cluster(one, table).first().cluster_id == nearest


def test_clusters_reserve_neutrals_cap_vivid_and_follow_the_mask(spark):
    bright = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 255, 255), (255, 0, 255)]
    rows = [(1, i, *((30, 30, 30) if i < 60 else (128, 128, 128) if i < 200 else bright[i % 6]), i < 60) for i in range(800)] + [(2, 0, 255, 255, 255, True)]
    px = spark.createDataFrame(rows, "image_id long, idx long, r int, g int, b int, flat boolean")
    found = [r for r in image.derive_clusters(px, 6, skip_white=248).collect()]
    own = [r for r in found if r.image_id == 1]
    assert sum(r.protected and max(r.r, r.g, r.b) - min(r.r, r.g, r.b) > 50 for r in own) <= 2
    assert {(r.r, r.g, r.b) for r in own if r.protected} >= {(30, 30, 30), (128, 128, 128)}
    assert [(r.r, r.g, r.b) for r in found if r.image_id == 2] == [(255, 255, 255)]
    # 60 flat pixels are too few, 260 are enough
    assert len({(r.r, r.g, r.b) for r in image.derive_clusters(px, 6, flat="flat").where("image_id = 1").collect()}) > 2
    wide = px.where("image_id = 1").withColumn("flat", F.col("idx") < 260)
    assert image.natural_colour_count(wide).first().colours == 8 and image.natural_colour_count(wide.withColumn("flat", F.col("idx") < 200), flat="flat").first().colours == 2


def test_family_shade_rules():
    threads = pd.DataFrame([("a", "Red", 200, 20, 20), ("b", "Red", 150, 10, 10), ("c", "Blue", 20, 20, 200), ("d", "Green", 20, 160, 20)], columns=["code", "family", "r", "g", "b"])
    lab = labmath.rgb_to_lab(threads[["r", "g", "b"]].to_numpy())
    palette = threads.assign(pos=range(4), l=lab[:, 0], a=lab[:, 1], b2=lab[:, 2])

    def clusters(*rows):
        rgb = np.array([r[:3] for r in rows])
        x = labmath.rgb_to_lab(rgb)
        return pd.DataFrame({"image_id": 1, "cluster_id": range(len(rows)), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "population": [r[3] for r in rows], "protected": False, "l": x[:, 0], "a": x[:, 1], "b2": x[:, 2], "c": np.hypot(x[:, 1], x[:, 2]), "h": np.degrees(np.arctan2(x[:, 2], x[:, 1])) % 360})

    codes = lambda *rows: matching.assign_shades(clusters(*rows), palette, 48).sort_values("cluster_id").code.tolist()
    # a small cluster takes the nearest of the whole palette, though only red is in use, and does not claim it
    assert codes((200, 20, 20, 900), (20, 160, 20, 10)) == ["a", "d"]
    # no family fits a grey: the nearest thread
    grey = codes((90, 90, 90, 900))
    assert grey == [palette.code[int(np.argmin([d for d in [(lab[i, 0] - clusters((90, 90, 90, 1)).l[0]) ** 2 + 0.49 * (np.hypot(*lab[i, 1:]) - clusters((90, 90, 90, 1)).c[0]) ** 2 + max(0, ((lab[i, 1:] - clusters((90, 90, 90, 1))[["a", "b2"]].to_numpy()[0]) ** 2).sum() - (np.hypot(*lab[i, 1:]) - clusters((90, 90, 90, 1)).c[0]) ** 2) for i in range(4)]]))]]


def test_palette_helpers(spark):
    palette = spark.createDataFrame([(1, 0, 200, 10, 10), (1, 1, 203, 12, 10), (1, 2, 10, 10, 200), (1, 3, 12, 200, 12)], "chart_id long, pal_idx int, r int, g int, b int")
    usage = spark.createDataFrame([(1, 0, 1000), (1, 1, 20), (1, 2, 5), (1, 3, 700)], "chart_id long, pal_idx int, n long")
    merged = {r.pal_idx: r.survivor for r in image.merge_near_duplicates(palette, usage).collect()}
    assert merged == {0: 0, 1: 0, 2: 2, 3: 3}
    culled = {r.pal_idx: r.survivor for r in image.cull_tiny(palette, usage, 10).collect()}
    assert culled[2] in (0, 1, 3) and culled[0] == 0


def test_natural_colours(spark):
    rows = [(1, i, *((10, 10, 10) if i % 2 else (200, 200, 200)), i) for i in range(200)] + [(1, 200 + i, 90, 10, 200, i) for i in range(3)]
    pixels = spark.createDataFrame([(a, i, r, g, b) for a, i, r, g, b, _ in rows], "image_id long, idx long, r int, g int, b int")
    assert image.natural_colour_count(pixels).first().colours == 2
