"""Cells of charts: fills, turns, layers, edits, masks, tiles, neighbours. Built-in functions and windows only.

Tables are long: (chart_id, idx, y, x, value). Windows are partitioned by chart_id and something, so data dealt out by
chart_id once serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank_cells(dims: DataFrame, code: str) -> DataFrame:
    """Every cell of canvases (chart_id, width, height) in one colour."""
    rows = dims.select("chart_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)).alias("idx"))
    return rows.select("chart_id", "idx", F.floor(F.col("idx") / F.col("width")).cast("int").alias("y"), (F.col("idx") % F.col("width")).cast("int").alias("x"), F.lit(code).alias("code"))


# Inches of a brick cover, of an outline's margin, and a stocking's width to its height.
BRICK_LENGTH, BRICK_WIDTH, BRICK_DEPTH = 8.5, 4.5, 2.75
MARGIN, STOCKING = 1.0, 0.4059
BRICK_PANELS = [("top", BRICK_LENGTH, BRICK_WIDTH), ("endLeft", BRICK_DEPTH, BRICK_WIDTH), ("endRight", BRICK_DEPTH, BRICK_WIDTH), ("sideTop", BRICK_LENGTH, BRICK_DEPTH), ("sideBottom", BRICK_LENGTH, BRICK_DEPTH)]


def canvas_dims(designs: DataFrame) -> DataFrame:
    """designs (shape, width_in, height_in, mesh) with canvas_w, canvas_h (inches), stitches_w and stitches_h."""
    brick, stocking, round_ = F.col("shape") == "brick", F.col("shape") == "stocking", F.col("shape").isin("circle", "oval")
    w = F.when(brick, BRICK_LENGTH + 2 * BRICK_DEPTH).when(stocking, F.col("height_in") * STOCKING + 2 * MARGIN).when(round_, F.col("width_in") + 2 * MARGIN).otherwise(F.col("width_in"))
    h = F.when(brick, BRICK_WIDTH + 2 * BRICK_DEPTH).when(stocking | round_, F.col("height_in") + 2 * MARGIN).otherwise(F.col("height_in"))
    stitches = lambda inches: F.floor(inches * F.col("mesh") + 0.5).cast("int")
    return designs.withColumns({"canvas_w": w, "canvas_h": h}).withColumns({"stitches_w": stitches(F.col("canvas_w")), "stitches_h": stitches(F.col("canvas_h"))})


def brick_panels(designs: DataFrame) -> DataFrame:
    """Five rows (design_id, panel, stitches_w, stitches_h) for each brick design (design_id, mesh)."""
    panels = F.array(*[F.struct(F.lit(n).alias("panel"), F.lit(w).alias("w"), F.lit(h).alias("h")) for n, w, h in BRICK_PANELS])
    rows = designs.select("design_id", "mesh", F.inline(panels))
    return rows.select("design_id", "panel", F.floor(F.col("w") * F.col("mesh") + 0.5).cast("int").alias("stitches_w"), F.floor(F.col("h") * F.col("mesh") + 0.5).cast("int").alias("stitches_h"))


def pattern_value(spec: dict) -> Column:
    """The tone number of a cell (columns y, x) in a pattern: solid, stripes, bargello or gingham."""
    kind, width = spec["type"], int(spec.get("width", 1))
    band = lambda c: F.floor(c / width)
    if kind == "solid":
        return F.lit(0).cast("long")
    if kind == "stripes":
        return F.pmod(band(F.col("y" if spec.get("direction", "rows") == "rows" else "x")), F.lit(int(spec["tones"])))
    if kind == "bargello":
        total, offsets = 0, [0]
        for step in spec["steps"]:
            total += step
            offsets.append(total)
        offsets = [o - min(offsets) for o in offsets[: len(spec["steps"])]]
        offset = F.get(F.array(*map(F.lit, offsets)), (F.col("x") % len(offsets)).cast("int"))
        return F.pmod(F.floor((F.col("y") + offset) / width), F.lit(int(spec["tones"])))
    if kind == "gingham":
        return F.pmod(band(F.col("y")), F.lit(2)) + F.pmod(band(F.col("x")), F.lit(2))
    raise ValueError(f"unknown pattern {kind!r}")


def pattern_fill(cells: DataFrame, mask: DataFrame, spec: dict, value: str = "code") -> DataFrame:
    """cells with the masked ones (chart_id, idx) filled by a pattern of spec["colours"]."""
    colours = F.array(*map(F.lit, spec["colours"]))
    inside = mask.select("chart_id", "idx").distinct().withColumn("inside", F.lit(True))
    rows = cells.join(inside, ["chart_id", "idx"], "left")
    return rows.withColumn(value, F.when(F.col("inside"), F.get(colours, pattern_value(spec).cast("int"))).otherwise(F.col(value))).drop("inside")


def rotate_cells(cells: DataFrame, degrees: int) -> DataFrame:
    """Cells (chart_id, y, x, width, height, ...) turned clockwise by quarter turns, with new idx, width and height."""
    y, x, w, h = (F.col(c) for c in ("y", "x", "width", "height"))
    turns = {0: (y, x, w, h), 90: (x, h - 1 - y, h, w), 180: (h - 1 - y, w - 1 - x, w, h), 270: (w - 1 - x, y, h, w)}
    if degrees % 360 not in turns:
        raise ValueError("quarter turns only")
    ny, nx, nw, nh = turns[degrees % 360]
    rows = cells.select(*[c for c in cells.columns if c not in ("y", "x", "width", "height", "idx")], ny.alias("y"), nx.alias("x"), nw.alias("width"), nh.alias("height"))
    return rows.withColumn("idx", (F.col("y").cast("long") * F.col("width") + F.col("x")))


def recolour(cells: DataFrame, old: object, new: object, selection: DataFrame | None = None, value: str = "code") -> DataFrame:
    """old replaced by new, everywhere or only in selected cells (chart_id, idx)."""
    hit = F.col(value) == F.lit(old)
    if selection is None:
        return cells.withColumn(value, F.when(hit, F.lit(new)).otherwise(F.col(value)))
    rows = cells.join(selection.select("chart_id", "idx").distinct().withColumn("selected", F.lit(True)), ["chart_id", "idx"], "left")
    return rows.withColumn(value, F.when(hit & F.col("selected"), F.lit(new)).otherwise(F.col(value))).drop("selected")


def expand_layers(layers: DataFrame, layer_cells: DataFrame, dims: DataFrame) -> DataFrame:
    """(chart_id, layer_id, z, kind, row, col, idx, code): a native cell as its scale x scale block, clipped to the canvas.

    layers (chart_id, layer_id, z, kind, off_x, off_y, scale); layer_cells (layer_id, row, col, code); dims (chart_id,
    width, height). Ranges are clipped before they are exploded, so cells off the canvas cost nothing.
    """
    rows = layer_cells.join(layers, "layer_id").join(dims, "chart_id")
    first = lambda at, off: F.greatest(F.lit(0), F.col(off) + F.col(at) * F.col("scale"))
    last = lambda at, off, size: F.least(F.col(size), F.col(off) + (F.col(at) + 1) * F.col("scale")) - 1
    rows = rows.withColumns({"y0": first("row", "off_y"), "y1": last("row", "off_y", "height"), "x0": first("col", "off_x"), "x1": last("col", "off_x", "width")}).where("y0 <= y1 AND x0 <= x1")
    keys = ["chart_id", "layer_id", "z", "kind", "row", "col", "code"]
    rows = rows.select(*keys, "width", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select(*keys, "width", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return rows.select(*keys, (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("idx"))


def composite_layers(base: DataFrame, layers: DataFrame, layer_cells: DataFrame, dims: DataFrame, sentinel: str) -> DataFrame:
    """base cells (chart_id, idx, code) under layers: the topmost code that isn't the sentinel wins."""
    top = expand_layers(layers, layer_cells.where(F.col("code") != sentinel), dims).groupBy("chart_id", "idx").agg(F.max_by("code", "z").alias("top"))
    return base.join(top, ["chart_id", "idx"], "left").withColumn("code", F.coalesce("top", "code")).drop("top")


def merge_edits(base: DataFrame, before: DataFrame, after: DataFrame, value: str = "code") -> DataFrame:
    """Cells changed from before to after take after's value, others base's. All (chart_id, idx, value).

    A chart whose numbers of cells differ takes after whole.
    """
    named = lambda df, name: df.select("chart_id", "idx", F.col(value).alias(name))
    rows = named(base, "b").join(named(before, "o"), ["chart_id", "idx"], "full").join(named(after, "n"), ["chart_id", "idx"], "full")
    whole = F.max(F.col("b").isNull() | F.col("o").isNull() | F.col("n").isNull()).over(Window.partitionBy("chart_id"))
    rows = rows.withColumn("whole", whole)
    merged = F.when(F.col("whole"), F.col("n")).when(~F.col("o").eqNullSafe(F.col("n")), F.col("n")).otherwise(F.col("b"))
    return rows.select("chart_id", "idx", merged.alias(value)).where(F.col(value).isNotNull())


def attribute_edits(base: DataFrame, before: DataFrame, after: DataFrame, layers: DataFrame, layer_cells: DataFrame, dims: DataFrame, sentinel: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits of a composite given back to what was edited: (layer edits, new base, counts by chart).

    A changed cell belongs to the topmost visible layer there; without one, to the base; edits on border layers are
    discarded; a native cell drawn as a block is refused unless all its cells on the canvas now have the new code.
    """
    named = lambda df, name: df.select("chart_id", "idx", F.col("code").alias(name))
    now = named(after, "new")
    changed = named(before, "old").join(now, ["chart_id", "idx"]).where("old <> new").select("chart_id", "idx", "new")
    drawn = expand_layers(layers, layer_cells.where(F.col("code") != sentinel), dims)
    cell = F.struct("z", "layer_id", "kind", "row", "col")
    hit = changed.join(drawn, ["chart_id", "idx"]).groupBy("chart_id", "idx", "new").agg(F.max(cell).alias("t"))
    on_base = changed.join(hit.select("chart_id", "idx"), ["chart_id", "idx"], "left_anti")
    hit = hit.select("chart_id", "idx", "new", "t.*")
    wanted = hit.where("kind <> 'border'").groupBy("chart_id", "layer_id", "row", "col").agg(F.min("new").alias("new"), F.count("*").alias("n"))
    blocks = drawn.join(now, ["chart_id", "idx"]).join(wanted.select("chart_id", "layer_id", "row", "col", F.col("new").alias("want")), ["chart_id", "layer_id", "row", "col"])
    whole = blocks.groupBy("chart_id", "layer_id", "row", "col").agg(F.min(F.col("new") == F.col("want")).alias("whole"))
    judged = wanted.join(whole, ["chart_id", "layer_id", "row", "col"])
    edits = judged.where("whole").select("chart_id", "layer_id", "row", "col", F.col("new").alias("code"))
    counts = (
        on_base.groupBy("chart_id").agg(F.count("*").alias("touched"), F.lit(0).cast("long").alias("discarded"), F.lit(0).cast("long").alias("refused"))
        .unionByName(hit.where("kind = 'border'").groupBy("chart_id").agg(F.lit(0).cast("long").alias("touched"), F.count("*").alias("discarded"), F.lit(0).cast("long").alias("refused")))
        .unionByName(judged.groupBy("chart_id").agg(F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))), F.lit(0)).alias("touched"), F.lit(0).cast("long").alias("discarded"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("n"))), F.lit(0)).alias("refused")))
        .groupBy("chart_id").agg(F.sum("touched").alias("touched"), F.sum("discarded").alias("discarded"), F.sum("refused").alias("refused"))
    )
    new_base = base.join(on_base, ["chart_id", "idx"], "left").withColumn("code", F.coalesce("new", "code")).drop("new")
    return edits, new_base, counts


def diff_charts(a: DataFrame, b: DataFrame, sample: int = 12, value: str = "code") -> DataFrame:
    """(chart_id, n_diff, first, same_size): differing cells, and the first of them as (y, x, old, new). Cells carry y, x."""
    named = lambda df, name: df.select("chart_id", "idx", F.struct("y", "x").alias(f"{name}_at"), F.col(value).alias(name))
    rows = named(a, "old").join(named(b, "new"), ["chart_id", "idx"], "full")
    at = F.coalesce("old_at", "new_at")
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    entry = F.struct("idx", at["y"].alias("y"), at["x"].alias("x"), "old", "new")
    return rows.groupBy("chart_id").agg(
        F.count_if(differs).alias("n_diff"),
        F.slice(F.array_sort(F.collect_list(F.when(differs, entry))), 1, sample).alias("first"),
        (F.count_if(F.col("old_at").isNull() | F.col("new_at").isNull()) == 0).alias("same_size"),
    )


def shape_mask(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cells (shape_id, y, x, ...) with `inside`: centres inside a polygon by even-odd crossings.

    edges (shape_id, x1, y1, x2, y2). Fewer than three edges: nothing is inside. By scanline: an edge becomes its crossings
    with the rows that it spans, and cells and crossings of a row, in order of x, are counted together. So work follows cells
    and crossings, however many edges a polygon has, and a row, not a shape, is what a task holds.
    """
    rows = cells.groupBy("shape_id").agg(F.min("y").alias("top"), F.max("y").alias("low"))
    named = edges.select("shape_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    first = F.greatest(F.col("top").cast("long"), F.floor(F.least("y1", "y2") - 0.5))
    last = F.least(F.col("low").cast("long"), F.ceil(F.greatest("y1", "y2") - 0.5))
    spans = named.join(rows, "shape_id").withColumns({"first": first, "last": last}).where("first <= last AND y1 <> y2")
    at = spans.withColumn("y", F.explode(F.sequence("first", "last")))
    cy = F.col("y") + 0.5
    at = at.where((F.col("y1") > cy) != (F.col("y2") > cy))
    crossings = at.select("shape_id", F.col("y").cast(cells.schema["y"].dataType).alias("y"), ((F.col("x2") - F.col("x1")) * (cy - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("__at"), F.lit(0).alias("__cell"))
    enough = named.groupBy("shape_id").agg((F.count("*") >= 3).alias("__enough"))
    own = cells.withColumns({"__at": F.col("x") + F.lit(0.5).cast("double"), "__cell": F.lit(1)})
    row = Window.partitionBy("shape_id", "y")
    crossing = 1 - F.col("__cell")
    # a crossing at a centre is not to its right
    upto = row.orderBy("__at", "__cell").rowsBetween(Window.unboundedPreceding, 0)
    beyond = F.sum(crossing).over(row) - F.sum(crossing).over(upto)
    both = own.unionByName(crossings, allowMissingColumns=True).withColumn("__odd", beyond % 2 == 1).where("__cell = 1")
    out = both.join(enough, "shape_id", "left").withColumn("inside", F.coalesce(F.col("__enough") & F.col("__odd"), F.lit(False)))
    return out.select(*cells.columns, "inside")


def stitchable_fraction(masked: DataFrame) -> DataFrame:
    return masked.groupBy("shape_id").agg(F.avg(F.col("inside").cast("double")).alias("fraction"))


def tile_fill(canvas: DataFrame, motif: DataFrame, motif_w: int, motif_h: int, origin: tuple[int, int] = (0, 0), scale: float = 1.0, sentinel: str = "", region: DataFrame | None = None) -> DataFrame:
    """canvas cells (chart_id, idx, y, x) with the motif's code repeated from origin; cells outside region get the sentinel.

    Scale: 1 or more rounds; exactly 1/N shrinks the motif first; other fractions are native size. motif (row, col, code).
    """
    inverse = round(1 / scale) if 0 < scale < 1 else 1
    if inverse > 1 and abs(scale * inverse - 1) < 1e-9:
        small = downsample_cells(motif.select(F.lit(0).alias("chart_id"), F.col("row").alias("y"), F.col("col").alias("x"), "code"), inverse, motif_w, motif_h, "code")
        motif, motif_w, motif_h = small.select(F.col("y").alias("row"), F.col("x").alias("col"), "code"), max(1, motif_w // inverse), max(1, motif_h // inverse)
    s = max(1, int(scale + 0.5)) if scale >= 1 else 1
    at = lambda c, o, size: F.floor(F.pmod(F.col(c) - o, F.lit(size * s)) / s).cast("int")
    rows = canvas.withColumns({"row": at("y", origin[1], motif_h), "col": at("x", origin[0], motif_w)})
    rows = rows.join(F.broadcast(motif.select("row", "col", F.col("code").alias("tile"))), ["row", "col"], "left").drop("row", "col")
    if region is not None:
        rows = rows.join(region.select("chart_id", "idx").distinct().withColumn("in_region", F.lit(True)), ["chart_id", "idx"], "left").withColumn("tile", F.when(F.col("in_region"), F.col("tile"))).drop("in_region")
    return rows.withColumn("code", F.coalesce("tile", F.lit(sentinel))).drop("tile")


def downsample_cells(cells: DataFrame, n: int, width: int, height: int, value: str = "pal_idx") -> DataFrame:
    """(chart_id, y, x, value): the commonest value of each n x n block, ties to the first met row by row.

    Rows and columns beyond whole blocks go; an axis shorter than n is one block.
    """
    block = lambda c, size: F.floor(F.col(c) / n) if size >= n else F.lit(0).cast("long")
    rows = cells.select("chart_id", block("y", height).alias("by"), block("x", width).alias("bx"), "y", "x", value).where((F.col("by") < max(1, height // n)) & (F.col("bx") < max(1, width // n)))
    counts = rows.groupBy("chart_id", "by", "bx", value).agg(F.count("*").alias("n"), F.min(F.col("y").cast("long") * width + F.col("x")).alias("first"))
    best = counts.groupBy("chart_id", "by", "bx").agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
    return best.select("chart_id", F.col("by").cast("int").alias("y"), F.col("bx").cast("int").alias("x"), value)


def neighbours(cells: DataFrame, value: str, eight: bool = False) -> DataFrame:
    """cells with up, down, left, right (and nw, ne, sw, se): neighbours' values, null off the grid. Two sorts, no join."""
    row, col = Window.partitionBy("chart_id", "y").orderBy("x"), Window.partitionBy("chart_id", "x").orderBy("y")
    rows = cells.withColumns({"left": F.lag(value).over(row), "right": F.lead(value).over(row)})
    out = {"up": F.lag(value).over(col), "down": F.lead(value).over(col)}
    if eight:
        out |= {"nw": F.lag("left").over(col), "ne": F.lag("right").over(col), "sw": F.lead("left").over(col), "se": F.lead("right").over(col)}
    return rows.withColumns(out)


def colour_contacts(cells: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, a, b, n, interleave): cells of a with a 4-neighbour of colour b, and the smaller of both sides' shares."""
    around = F.array_distinct(F.array_compact(F.array("up", "down", "left", "right")))
    pairs = neighbours(cells, value).select("chart_id", F.col(value).alias("a"), F.explode_outer(around).alias("b")).where("b IS NOT NULL AND a <> b")
    n = pairs.groupBy("chart_id", "a", "b").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("chart_id", F.col(value).alias("a")).agg(F.count("*").alias("size"))
    share = n.join(sizes, ["chart_id", "a"]).withColumn("share", F.col("n") / F.col("size"))
    pair = Window.partitionBy("chart_id", F.least("a", "b"), F.greatest("a", "b"))
    return share.withColumn("interleave", F.min("share").over(pair)).select("chart_id", "a", "b", "n", "interleave")


def linear_runs(cells: DataFrame, min_run: int = 3, value: str = "pal_idx") -> DataFrame:
    """cells with `in_run`: part of min_run or more equal values along a row, a column or a diagonal."""
    y, x = F.col("y"), F.col("x")
    rows, flags = cells.repartition("chart_id"), []
    for i, (line, along) in enumerate(((y, x), (x, y), (y - x, x), (y + x, x))):
        w = Window.partitionBy("chart_id", line).orderBy(along)
        new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
        rows = rows.withColumn(f"new{i}", new).withColumn(f"run{i}", F.sum(f"new{i}").over(w)).withColumn(f"len{i}", F.count("*").over(Window.partitionBy("chart_id", line, f"run{i}")))
        flags.append(F.col(f"len{i}") >= min_run)
    return rows.withColumn("in_run", flags[0] | flags[1] | flags[2] | flags[3]).select(*cells.columns, "in_run")


def despeckle(cells: DataFrame, protected: DataFrame | None = None, value: str = "pal_idx", support: int = 6) -> DataFrame:
    """cells where one without an equal among its 8 neighbours takes the commonest neighbour's value, if 6 agree.

    Ties go to the lowest value. protected (chart_id, idx) stay. All is read from the old grid.
    """
    rows = neighbours(cells, value, eight=True)
    around = F.array_sort(F.array_compact(F.array("up", "down", "left", "right", "nw", "ne", "sw", "se")))
    best = F.array_max(F.transform(F.array_distinct("around"), lambda v: F.struct(F.size(F.filter("around", lambda u: u == v)).alias("n"), (-v).alias("minus"))))
    rows = rows.withColumn("around", around).withColumn("best", best)
    flips = ~F.array_contains("around", F.col(value)) & (F.col("best.n") >= support)
    if protected is not None:
        rows = rows.join(protected.select("chart_id", "idx").distinct().withColumn("keep", F.lit(True)), ["chart_id", "idx"], "left")
        flips = flips & F.col("keep").isNull()
    return rows.withColumn(value, F.when(flips, -F.col("best.minus")).otherwise(F.col(value)).cast(cells.schema[value].dataType)).select(*cells.columns)


def edge_depth(cells: DataFrame, bands: int | None = None) -> DataFrame:
    """cells (chart_id, y, x, inside) with `depth`: 4-connected distance from the outside, up to `bands` if given; -1 outside.

    Cells next to the outside, to a cell that isn't there or to the grid's edge have depth 0. A shortest way to the outside
    stays inside until its last step, so this is the distance in rows plus columns to the nearest outside cell, and two
    sweeps give it for any depth: along rows the distance to the nearest outside cell of the row, then along columns the
    smallest of that plus the rows in between, upwards and downwards.
    """
    across, down = Window.partitionBy("chart_id", "y").orderBy("x"), Window.partitionBy("chart_id", "x").orderBy("y")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    after = lambda w: w.rowsBetween(0, Window.unboundedFollowing)
    out = ~F.coalesce(F.col("inside"), F.lit(False))
    x, y = F.col("x"), F.col("y")
    gone = lambda c, step, w: ~F.lag(c, step).over(w).eqNullSafe(F.col(c) - step)  # noqa: E731  the next cell isn't there
    rows = cells.withColumns({"__l": F.when(out, x).when(gone("x", 1, across), x - 1), "__r": F.when(out, x).when(gone("x", -1, across), x + 1)})
    rows = rows.withColumn("__row", F.least(x - F.max("__l").over(before(across)), F.min("__r").over(after(across)) - x))
    # what lies above or below a gap is outside, at distance 0
    up = F.least(F.col("__row") - y, F.when(gone("y", 1, down), 1 - y))
    low = F.least(F.col("__row") + y, F.when(gone("y", -1, down), 1 + y))
    rows = rows.withColumns({"__u": up, "__d": low})
    far = F.least(F.min("__u").over(before(down)) + y, F.min("__d").over(after(down)) - y) - 1
    far = F.least(far, F.lit(bands)) if bands is not None else far
    return rows.withColumn("depth", F.when(out, F.lit(-1)).otherwise(far).cast("int")).select(*cells.columns, "depth")


def shape_border(cells: DataFrame, colours: list[str], bands: int, value: str = "code") -> DataFrame:
    """cells whose outermost bands take colours by depth (the last one repeats); `collapsed` where nothing is left inside."""
    rows = edge_depth(cells, bands)
    ring = (F.col("depth") >= 0) & (F.col("depth") < bands)
    left = F.max((F.col("depth") >= bands).cast("int")).over(Window.partitionBy("chart_id"))
    tone = F.get(F.array(*map(F.lit, colours)), F.least(F.col("depth"), F.lit(len(colours) - 1)))
    return rows.withColumn(value, F.when(ring, tone).otherwise(F.col(value))).withColumn("collapsed", left == 0)
