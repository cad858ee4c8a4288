"""Connected regions of equal colour, and what is done with them.

Labelling is a graph search over one chart, which is bounded, so it runs as one numpy call for each chart; only integer
columns cross to Python. Everything about regions that is counting, ranking or joining stays in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.operators.grid import neighbours

FOUR = ((-1, 0), (0, -1))
EIGHT = (*FOUR, (-1, -1), (-1, 1))


def label_grid(values: np.ndarray, present: np.ndarray, eight: bool = False) -> np.ndarray:
    """The smallest flat index of each cell's region of equal values; -1 where not present.

    Rounds of "take the smaller label of an equal neighbour", each followed by pointer jumping.
    """
    h, w = values.shape
    flat = np.arange(h * w).reshape(h, w)
    pairs = []
    for dy, dx in EIGHT if eight else FOUR:
        here = np.s_[-dy:h, max(0, -dx) : w - max(0, dx)]
        there = np.s_[0 : h + dy, max(0, dx) : w + min(0, dx)]
        same = (values[here] == values[there]) & present[here] & present[there]
        pairs.append((flat[here][same], flat[there][same]))
    a = np.concatenate([p[0] for p in pairs])
    b = np.concatenate([p[1] for p in pairs])
    label = np.arange(h * w)
    while len(a):
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    return np.where(present.ravel(), label, -1).reshape(h, w)


def label_regions(cells: DataFrame, value: str = "pal_idx", eight: bool = False, sentinel: int | None = None) -> DataFrame:
    """(chart_id, idx, y, x, value, region): region is the smallest idx of the component; sentinel cells have none."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        h, w = int(y.max()) + 1, int(x.max()) + 1
        grid, present, idx = np.zeros((h, w), np.int64), np.zeros((h, w), bool), np.zeros((h, w), np.int64)
        grid[y, x], present[y, x], idx[y, x] = pdf[value].to_numpy(), True, pdf.idx.to_numpy()
        if sentinel is not None:
            present &= grid != sentinel
        found = label_grid(grid, present, eight)
        out = pdf[["chart_id", "idx", "y", "x", value]].copy()
        own = found[y, x]
        out["region"] = pd.array(np.where(own >= 0, idx.ravel()[np.maximum(own, 0)], 0), dtype="Int64")
        out.loc[own < 0, "region"] = pd.NA
        return out

    kinds = dict(cells.dtypes)
    schema = f"chart_id {kinds['chart_id']}, idx bigint, y int, x int, {value} {kinds[value]}, region bigint"
    return cells.select("chart_id", F.col("idx").cast("long").alias("idx"), "y", "x", value).groupBy("chart_id").applyInPandas(label, schema)


def region_stats(labelled: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, region, value, size, y0, y1, x0, x1)."""
    return labelled.where("region IS NOT NULL").groupBy("chart_id", "region", value).agg(F.count("*").alias("size"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def find_confetti(cells: DataFrame, max_size: int, value: str = "pal_idx", sentinel: int | None = None) -> DataFrame:
    """Regions of at most max_size cells."""
    return region_stats(label_regions(cells, value, sentinel=sentinel), value).where(F.col("size") <= max_size)


def _surrounding(labelled: DataFrame, small: DataFrame, value: str, sentinel: int | None, tie: Column) -> DataFrame:
    """(chart_id, region, replacement): the commonest colour next to each small region, counted by touching edges."""
    around = neighbours(labelled, value)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("v")) for i, c in enumerate(("up", "down", "left", "right"))])
    rows = around.join(small.select("chart_id", "region"), ["chart_id", "region"], "left_semi").select("chart_id", "region", "idx", value, F.inline(sides))
    rows = rows.where((F.col("v") != F.col(value)) & (F.lit(True) if sentinel is None else F.col("v") != sentinel))
    counts = rows.groupBy("chart_id", "region", "v").agg(F.count("*").alias("n"), F.min(F.struct("idx", "side")).alias("met"))
    return counts.groupBy("chart_id", "region").agg(F.max_by("v", F.struct("n", tie)).alias("replacement"))


def confetti_plan(cells: DataFrame, max_size: int, value: str = "pal_idx", sentinel: int | None = None) -> DataFrame:
    """(chart_id, idx, region, replacement) for cells of small regions that touch another colour; read from the old grid.

    Ties go to the colour met first: by cell, then up, down, left, right. An equal neighbour is always in the region.
    """
    labelled = label_regions(cells, value, sentinel=sentinel)
    small = region_stats(labelled, value).where(F.col("size") <= max_size)
    first = F.struct((-F.col("met.idx")).alias("i"), (-F.col("met.side")).alias("s"))
    best = _surrounding(labelled, small, value, sentinel, first)
    return labelled.join(best, ["chart_id", "region"]).select("chart_id", "idx", "region", "replacement")


def confetti_counts(cells: DataFrame, max_size: int, value: str = "pal_idx", sentinel: int | None = None) -> DataFrame:
    """(chart_id, found, cleaned): small regions, and those with a replacement."""
    found = find_confetti(cells, max_size, value, sentinel).groupBy("chart_id").agg(F.count("*").alias("found"))
    cleaned = confetti_plan(cells, max_size, value, sentinel).groupBy("chart_id").agg(F.count_distinct("region").alias("cleaned"))
    return found.join(cleaned, "chart_id", "left").fillna(0, ["cleaned"])


def background_region(cells: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, region, value, size, sides): the largest region that touches the border; ties to the lower region."""
    labelled = label_regions(cells, value)
    frame = cells.groupBy("chart_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    edge = labelled.join(frame, "chart_id").withColumn("sides", F.filter(F.array(F.when(F.col("y") == 0, "top"), F.when(F.col("y") == F.col("h"), "bottom"), F.when(F.col("x") == 0, "left"), F.when(F.col("x") == F.col("w"), "right")), lambda s: s.isNotNull()))
    per = edge.groupBy("chart_id", "region", value).agg(F.count("*").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sides")))).alias("sides")).where(F.size("sides") > 0)
    best = per.groupBy("chart_id").agg(F.max(F.struct("size", (-F.col("region")).alias("minus"), value, "sides")).alias("b"))
    return best.select("chart_id", (-F.col("b.minus")).alias("region"), f"b.{value}", "b.size", "b.sides")


def fill_holes(grid: np.ndarray, backgrounds, protected: np.ndarray | None = None, passes: int = 5) -> np.ndarray:
    """Enclosed background cells with three or more coloured 4-neighbours take their majority, in place, row by row.

    backgrounds: one colour or several, which count as one ground. Protected cells stay.
    """
    g = grid.copy()
    h, w = g.shape
    ground = set(np.atleast_1d(backgrounds).tolist())
    kept = np.zeros(g.shape, bool) if protected is None else protected
    for _ in range(passes):
        open_ = np.isin(g, list(ground))
        labels = label_grid(open_.astype(np.int64), open_)
        border = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
        enclosed = open_ & ~np.isin(labels, border[border >= 0]) & ~kept
        changed = False
        for y, x in zip(*np.nonzero(enclosed), strict=True):
            near = [v for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= b < h and 0 <= a < w and (v := int(g[b, a])) not in ground]
            if len(near) >= 3:
                g[y, x] = max(dict.fromkeys(near), key=near.count)
                changed = True
        if not changed:
            break
    return g


def bridge_gaps(grid: np.ndarray, backgrounds, protected: np.ndarray | None = None, passes: int = 2) -> np.ndarray:
    """Inner background cells between two equal colours in a column, else in a row, take that colour, in place."""
    g = grid.copy()
    ground = set(np.atleast_1d(backgrounds).tolist())
    inner = np.isin(g, list(ground))
    inner[[0, -1]], inner[:, [0, -1]] = False, False
    if protected is not None:
        inner &= ~protected
    for _ in range(passes):
        for y, x in zip(*np.nonzero(inner & np.isin(g, list(ground))), strict=True):
            for a, b in ((g[y - 1, x], g[y + 1, x]), (g[y, x - 1], g[y, x + 1])):
                if a == b and int(a) not in ground:
                    g[y, x] = a
                    break
    return g


def _per_chart(cells: DataFrame, backgrounds: DataFrame, protected: DataFrame | None, value: str, work) -> DataFrame:
    """work(grid, backgrounds, protected) for each chart: order within a chart matters, so it is a helper for each."""
    kinds = dict(cells.dtypes)
    rows = cells.select("chart_id", "idx", "y", "x", value).join(backgrounds.groupBy("chart_id").agg(F.array_sort(F.collect_set("background")).alias("grounds")), "chart_id")
    if protected is None:
        rows = rows.withColumn("kept", F.lit(False))
    else:
        marked = protected.select("chart_id", "idx").distinct().withColumn("kept", F.lit(True))
        rows = rows.join(marked, ["chart_id", "idx"], "left").fillna(False, ["kept"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        grounds = np.asarray(pdf.grounds.iloc[0], np.int64)
        grid = np.full((int(y.max()) + 1, int(x.max()) + 1), grounds[0], np.int64)
        kept = np.zeros(grid.shape, bool)
        grid[y, x], kept[y, x] = pdf[value].to_numpy(), pdf.kept.to_numpy(bool)
        out = pdf[["chart_id", "idx", "y", "x", value]].copy()
        out[value] = work(grid, grounds, kept)[y, x].astype(pdf[value].dtype)
        return out

    return rows.groupBy("chart_id").applyInPandas(run, f"chart_id {kinds['chart_id']}, idx {kinds['idx']}, y int, x int, {value} {kinds[value]}")


def hole_fill(cells: DataFrame, backgrounds: DataFrame, value: str = "pal_idx", protected: DataFrame | None = None) -> DataFrame:
    """cells with holes filled; backgrounds (chart_id, background), one or more for each chart; protected (chart_id, idx)."""
    return _per_chart(cells, backgrounds, protected, value, fill_holes)


def gap_bridge(cells: DataFrame, backgrounds: DataFrame, value: str = "pal_idx", protected: DataFrame | None = None) -> DataFrame:
    """cells with gaps bridged; backgrounds and protected as in hole_fill()."""
    return _per_chart(cells, backgrounds, protected, value, bridge_gaps)


def cluster_patches(cells: DataFrame, value: str = "cluster_id") -> DataFrame:
    """(chart_id, value, largest, patches): the largest component and the number of components of each cluster."""
    stats = region_stats(label_regions(cells, value), value)
    return stats.groupBy("chart_id", value).agg(F.max("size").alias("largest"), F.count("*").alias("patches"))


def has_run(y: np.ndarray, x: np.ndarray, n: int = 3) -> bool:
    """Whether n of the places follow one another in a row, a column or a diagonal."""
    own = set(zip(y.tolist(), x.tolist(), strict=True))
    return any(all((a + i * dy, b + i * dx) in own for i in range(1, n)) for a, b in own for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)))


def clean_confetti(grid: np.ndarray, present: np.ndarray, min_size: int, protected_colours: set[int], kept: np.ndarray) -> np.ndarray:
    """Small 8-connected regions take the commonest colour of the 8 neighbours of their cells, one after another.

    Regions are those of the grid as it was, in the order of their first cells; neighbours are read as they are by then.
    Ties go to the lowest colour. Protected colours, regions with a kept cell and those with a run of three stay.
    """
    g = grid.copy()
    h, w = g.shape
    labels = label_grid(grid, present, eight=True).ravel()
    order = np.argsort(labels, kind="stable")
    order = order[labels[order] >= 0]
    starts = np.flatnonzero(np.append(True, labels[order][1:] != labels[order][:-1])) if len(order) else []
    sizes = np.diff(np.append(starts, len(order)))
    for a, n in zip(np.asarray(starts)[sizes <= min_size].tolist(), sizes[sizes <= min_size].tolist(), strict=True):
        y, x = np.divmod(order[a : a + n], w)
        own = int(grid[y[0], x[0]])
        if own in protected_colours or kept[y, x].any() or has_run(y, x):
            continue
        tally: dict[int, int] = {}
        for cy, cx in zip(y.tolist(), x.tolist(), strict=True):
            for b in range(max(0, cy - 1), min(h, cy + 2)):
                for c in range(max(0, cx - 1), min(w, cx + 2)):
                    if present[b, c] and (v := int(g[b, c])) != own:
                        tally[v] = tally.get(v, 0) + 1
        if tally:
            g[y, x] = max(sorted(tally), key=tally.get)
    return g


def engine_confetti(cells: DataFrame, min_size: int, protected_colours: list[int], protected_cells: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, idx, replacement) of the cells that clean_confetti() changes: regions of up to min_size cells.

    protected_cells (chart_id, idx). The grid changes as it goes, so it is a helper for each chart.
    """
    kinds = dict(cells.dtypes)
    marked = protected_cells.select("chart_id", "idx").distinct().withColumn("kept", F.lit(True))
    rows = cells.select("chart_id", "idx", "y", "x", value).join(marked, ["chart_id", "idx"], "left").fillna(False, ["kept"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        shape = (int(y.max()) + 1, int(x.max()) + 1)
        grid, present, kept = np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
        grid[y, x], present[y, x], kept[y, x] = pdf[value].to_numpy(), True, pdf.kept.to_numpy(bool)
        new = clean_confetti(grid, present, min_size, set(protected_colours), kept)[y, x]
        out = pdf[["chart_id", "idx"]].assign(replacement=new.astype(pdf[value].dtype))
        return out[new != pdf[value].to_numpy()]

    return rows.groupBy("chart_id").applyInPandas(run, f"chart_id {kinds['chart_id']}, idx {kinds['idx']}, replacement {kinds[value]}")


def region_profile(cells: DataFrame, rejected: Column | None = None, value: str = "pal_idx", siblings: DataFrame | None = None) -> DataFrame:
    """Regions with fill ratio, elongation, hollow and kind: too-small, sparse-composite, thin-stroke, gappy-rectangle, solid-blob.

    Hollow: over 30 % of the box's inside is of other colours. A gappy rectangle is hollow and has a sibling; which regions
    have one is the caller's to say: siblings (chart_id, region), by default none, or same_box_siblings(). rejected: which
    regions are looked at, over region_stats columns.
    """
    labelled = label_regions(cells, value)
    stats = region_stats(labelled, value)
    stats = stats.where(rejected) if rejected is not None else stats
    boxes = stats.withColumns({"bh": F.col("y1") - F.col("y0") + 1, "bw": F.col("x1") - F.col("x0") + 1})
    inner = labelled.join(boxes.select("chart_id", "region", "y0", "y1", "x0", "x1"), ["chart_id", "region"]).where("y > y0 AND y < y1 AND x > x0 AND x < x1").groupBy("chart_id", "region").agg(F.count("*").alias("own_inner"))
    rows = boxes.join(inner, ["chart_id", "region"], "left").fillna(0, ["own_inner"])
    room = F.greatest(F.col("bh") - 2, F.lit(0)) * F.greatest(F.col("bw") - 2, F.lit(0))
    rows = rows.withColumns({
        "fill": F.col("size") / (F.col("bh") * F.col("bw")),
        "elongation": F.greatest("bh", "bw") / F.least("bh", "bw"),
        "hollow": (room > 0) & ((room - F.col("own_inner")) / F.greatest(room, F.lit(1)) > 0.3),
    })
    if siblings is None:
        rows = rows.withColumn("sibling", F.lit(False))
    else:
        rows = rows.join(siblings.select("chart_id", "region").distinct().withColumn("sibling", F.lit(True)), ["chart_id", "region"], "left").fillna(False, ["sibling"])
    kind = (
        F.when((F.col("bh") < 5) | (F.col("bw") < 5), "too-small")
        .when(F.col("fill") < 0.30, F.when(F.col("size") >= 300, "sparse-composite").otherwise("thin-stroke"))
        .when(F.col("hollow") & F.col("sibling"), "gappy-rectangle")
        .otherwise("solid-blob")
    )
    return rows.withColumn("kind", kind).select("chart_id", "region", value, "size", "fill", "elongation", "hollow", "kind")


def same_box_siblings(stats: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, region) of regions with another one of their colour whose box has the same height and width."""
    boxes = stats.select("chart_id", "region", value, (F.col("y1") - F.col("y0")).alias("bh"), (F.col("x1") - F.col("x0")).alias("bw"))
    return boxes.withColumn("n", F.count("*").over(Window.partitionBy("chart_id", value, "bh", "bw"))).where("n > 1").select("chart_id", "region")
