"""Chart quality: chartability signals and verdicts, and how well images fit a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions.color import is_plain_white, rgb_to_lab, with_ciede2000
from skeinframe.operators.grid import neighbours
from skeinframe.operators.regions import label_regions, region_stats


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def chartability(cells: DataFrame, palette: DataFrame, background: list[int], value: str = "pal_idx") -> DataFrame:
    """(chart_id, signals..., overall, verdict, worst) for cells and a palette (chart_id, value, r, g, b).

    Five signals over the colours that aren't background, each scored 0 to 1; weights 1, 1, 1.2, 1, 0.5. Under 0.15
    surviving erosion or over 24 colours: Unusable. Cutoffs .4, .65, .85. worst: signals under .7, the lowest first.
    """
    rows = cells.select("chart_id", F.col("idx").cast("long").alias("idx"), "y", "x", value).withColumn("fg", ~F.col(value).isin(background))
    charts = rows.select("chart_id").distinct()
    used = rows.where("fg").groupBy("chart_id", value).agg(F.count("*").alias("n")).join(palette, ["chart_id", value]).withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    colours = used.groupBy("chart_id").agg(F.count("*").alias("colours"))
    a, b = used.select("chart_id", F.col(value).alias("i"), F.col("lab").alias("p")), used.select("chart_id", F.col(value).alias("j"), F.col("lab").alias("q"))
    closest = with_ciede2000(a.join(b, "chart_id").where("i < j"), "p", "q").groupBy("chart_id").agg(F.min("de").alias("min_de"))
    stats = region_stats(label_regions(rows.where("fg"), value), value)
    pieces = stats.groupBy("chart_id").agg(F.count("*").alias("regions"), F.count_if(F.col("size") <= 2).alias("specks"), (F.max("size") / F.sum("size")).alias("largest"))
    near = neighbours(rows.withColumn("m", F.col("fg").cast("int")), "m", eight=True)
    around = F.coalesce(F.col("up"), F.lit(0)) + F.coalesce(F.col("down"), F.lit(0)) + F.coalesce(F.col("left"), F.lit(0)) + F.coalesce(F.col("right"), F.lit(0))
    block = F.col("m") + F.col("right") + F.col("down") + F.col("se")  # null at the last row and column
    shape = near.groupBy("chart_id").agg(
        F.sum("m").alias("foreground"), F.count_if((F.col("m") == 1) & (around == 4)).alias("survivors"),
        F.count_if(block.isin(1, 3)).alias("corners"), F.count_if(block == 2).alias("edges"),
    )
    box = rows.where("fg").groupBy("chart_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = rows.join(box, "chart_id").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("chart_id", "y", "x", "fg", (F.col("x1") - (F.col("x") - F.col("x0"))).alias("mx"))
    mirror = inside.select("chart_id", "y", F.col("x").alias("mx"), F.col("fg").alias("mirrored"))
    symmetry = inside.join(mirror, ["chart_id", "y", "mx"]).groupBy("chart_id").agg(F.avg((F.col("fg") != F.col("mirrored")).cast("double")).alias("mismatch"))
    out = charts
    for part in (colours, closest, pieces, shape, symmetry):
        out = out.join(part, "chart_id", "left")
    out = out.fillna(0, ["colours", "regions", "specks", "foreground", "survivors", "corners", "edges", "mismatch", "largest"]).fillna(100.0, ["min_de"])
    share = lambda p, q, empty: F.when(F.col(q) > 0, F.col(p) / F.col(q)).otherwise(F.lit(empty))
    out = out.withColumns({"per_colour": share("regions", "colours", 0.0), "survival": share("survivors", "foreground", 1.0), "corner_ratio": F.when(F.col("corners") + F.col("edges") > 0, F.col("corners") / (F.col("corners") + F.col("edges"))).otherwise(0.0)})
    out = out.withColumns({
        "s_colour": F.least(F.when(F.col("colours") <= 8, 1.0).otherwise(_clamp(1 - (F.col("colours") - 8) / 12)), _clamp(F.col("min_de") / 15)),
        "s_fragmentation": F.least(_clamp(1 - F.col("specks") / 40), _clamp(1 - F.greatest(F.lit(0.0), F.col("per_colour") - 3) / 12)),
        "s_feature_size": _clamp(F.col("survival") / 0.45),
        "s_diagonal": _clamp(1 - F.col("corner_ratio") / 0.6),
        "s_symmetry": _clamp(1 - F.col("mismatch") / 0.25),
    })
    names = ["colour", "fragmentation", "feature_size", "diagonal", "symmetry"]
    weights = [1.0, 1.0, 1.2, 1.0, 0.5]
    overall = sum((F.col(f"s_{n}") * w for n, w in zip(names[1:], weights[1:], strict=True)), F.col("s_colour")) / sum(weights)
    listed = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"s_{n}").alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]), lambda x: x["s"] < 0.7))
    out = out.withColumns({"overall": overall, "worst": F.transform(listed, lambda x: x["n"])})
    poor = (F.col("survival") < 0.15) | (F.col("colours") > 24) | (F.col("overall") < 0.4)
    verdict = F.when(poor, "Unusable").when(F.col("overall") < 0.65, "Poor").when(F.col("overall") < 0.85, "Minor").otherwise("Perfect")
    return out.withColumn("verdict", verdict).select("chart_id", "colours", "min_de", "regions", "specks", "largest", "survival", "corner_ratio", "mismatch", *[f"s_{n}" for n in names], "overall", "verdict", "worst")


def verdict_matrix(predicted: DataFrame, rated: DataFrame, on: str) -> DataFrame:
    """(predicted, rated, level, n): counts of verdict pairs, with totals as nulls and their grouping level."""
    rows = predicted.select(on, F.col("verdict").alias("predicted")).join(rated.select(on, F.col("verdict").alias("rated")), on)
    return rows.cube("predicted", "rated").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def source_census(pixels: DataFrame, top: int = 6) -> DataFrame:
    """(image_id, darkest, n_250, n_450, f_250, f_450, dark): channel sums, and the commonest dark 4-bit colours."""
    total = F.col("r") + F.col("g") + F.col("b")
    rows = pixels.select("image_id", total.alias("s"), F.shiftright("r", 4).alias("r4"), F.shiftright("g", 4).alias("g4"), F.shiftright("b", 4).alias("b4"))
    sums = rows.groupBy("image_id").agg(F.min("s").alias("darkest"), F.count_if(F.col("s") < 250).alias("n_250"), F.count_if(F.col("s") < 450).alias("n_450"), F.count("*").alias("n"))
    buckets = rows.where("s < 450").groupBy("image_id", "r4", "g4", "b4").agg(F.count("*").alias("n"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "r4", "g4", "b4")
    best = buckets.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    dark = best.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "r4", "g4", "b4", "n"))), lambda b: F.format_string("%x%x%x:%d", b["r4"], b["g4"], b["b4"], b["n"])).alias("dark"))
    out = sums.join(dark, "image_id", "left")
    return out.select("image_id", "darkest", "n_250", "n_450", F.round(F.col("n_250") / F.col("n"), 5).alias("f_250"), F.round(F.col("n_450") / F.col("n"), 5).alias("f_450"), F.coalesce("dark", F.array().cast("array<string>")).alias("dark"))


def cell_of(grid_w: int, grid_h: int, src_w: int, src_h: int) -> tuple[Column, Column]:
    """(cell y, cell x) of a pixel, rounded down."""
    return F.floor(F.col("y") * grid_h / src_h).cast("int"), F.floor(F.col("x") * grid_w / src_w).cast("int")


def cell_windows(cells: int, length: int, mirror: bool = False) -> list[tuple[int, int]]:
    """(from, to) of the pixels of each cell along a side: k * length / cells, rounded down, up to the next, one at least.

    mirror: bounds of the second half mirror those of the first, so that a cell and its mirror image see mirrored pixels.
    """
    bounds = [k * length // cells for k in range(cells + 1)]
    if mirror:
        bounds = [b if k <= cells - k else length - bounds[cells - k] for k, b in enumerate(bounds)]
    return [(a, min(max(a + 1, b), length)) for a, b in zip(bounds, bounds[1:], strict=False)]


def in_windows(pixels: DataFrame, grid_w: int, grid_h: int, src_w: int, src_h: int, mirror: bool = False) -> DataFrame:
    """pixels with cy and cx, a row for each cell whose window holds the pixel. Joined to tables of one side's pixels each."""
    spark = pixels.sparkSession
    for axis, cells, length in (("y", grid_h, src_h), ("x", grid_w, src_w)):
        rows = [(p, k) for k, (a, b) in enumerate(cell_windows(cells, length, mirror)) for p in range(a, b)]
        pixels = pixels.join(F.broadcast(spark.createDataFrame(rows, f"{axis} int, c{axis} int")), axis)  # at most length + cells rows
    return pixels


def mode_cells(pixels: DataFrame, grid_w: int, grid_h: int, src_w: int, src_h: int, share: float = 0.6, bucket: int = 48) -> DataFrame:
    """(image_id, cells, mixed, mixed_share): output cells whose commonest colour bucket has under `share` of the pixels."""
    coarse = F.struct(*[F.floor(F.col(c) / bucket).alias(c) for c in "rgb"])
    windows = in_windows(pixels.select("image_id", "y", "x", "r", "g", "b"), grid_w, grid_h, src_w, src_h)
    counts = windows.select("image_id", "cy", "cx", coarse.alias("bucket")).groupBy("image_id", "cy", "cx", "bucket").agg(F.count("*").alias("n"))
    cells = counts.groupBy("image_id", "cy", "cx").agg((F.max("n") / F.sum("n")).alias("top"))
    out = cells.groupBy("image_id").agg(F.count("*").alias("cells"), F.count_if(F.col("top") < share).alias("mixed"))
    return out.withColumn("mixed_share", F.col("mixed") / F.col("cells"))


def local_range(pixels: DataFrame) -> DataFrame:
    """pixels with `range`, the largest 3x3 spread of a channel (edges clamped), and kind: flat, ramp or edge."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    rows = pixels.withColumns({f"{c}{n}": f(c).over(row) for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))})
    rows = rows.withColumns({f"{c}{n}": f(f"{c}{n}").over(col) for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))})
    spread = F.greatest(*[F.col(f"{c}hi") - F.col(f"{c}lo") for c in "rgb"])
    return rows.withColumn("range", spread).select(*pixels.columns, "range", F.when(F.col("range") <= 8, "flat").when(F.col("range") <= 40, "ramp").otherwise("edge").alias("kind"))


def input_type(pixels: DataFrame) -> DataFrame:
    """(image_id, flat_share, ramp_share, kind, confidence): photo if under .15 flat or over .45 of the rest ramps."""
    counts = local_range(pixels).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "flat").alias("flat"), F.count_if(F.col("kind") == "ramp").alias("ramp"))
    rest = F.col("n") - F.col("flat")
    rows = counts.select("image_id", (F.col("flat") / F.col("n")).alias("flat_share"), F.when(rest > 0, F.col("ramp") / rest).otherwise(0.0).alias("ramp_share"))
    photo = (F.col("flat_share") < 0.15) | (F.col("ramp_share") > 0.45)
    margin = F.when(F.col("flat_share") < 0.15, (0.15 - F.col("flat_share")) / 0.15).otherwise(F.abs(F.col("ramp_share") - 0.45) / 0.45)
    return rows.withColumns({"kind": F.when(photo, "photo").otherwise("generated"), "confidence": _clamp(2 * margin)})


def sub_stitch_share(pixels: DataFrame, grid_w: int, src_w: int, white: int = 244) -> DataFrame:
    """(image_id, ink_share, lost): the share of ink that an erosion of half a stitch removes.

    Null where ink is not within (.02, .85) of the image or at most 50 pixels. Off the image is not ink.
    """
    r = max(1, int(src_w / grid_w / 2 + 0.5))
    ink = (~is_plain_white(F.col("r"), F.col("g"), F.col("b"), white)).cast("int")
    whole = lambda w: F.when(F.count("*").over(w) == 2 * r + 1, F.min("ink").over(w)).otherwise(0)
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)
    rows = pixels.select("image_id", "y", "x", ink.alias("ink"), ink.alias("own")).withColumn("ink", whole(row)).withColumn("ink", whole(col))
    sums = rows.groupBy("image_id").agg(F.avg(F.col("own").cast("double")).alias("ink_share"), F.sum("own").alias("n"), F.sum("ink").alias("kept"))
    fits = (F.col("ink_share") > 0.02) & (F.col("ink_share") < 0.85) & (F.col("n") > 50)
    return sums.select("image_id", "ink_share", F.when(fits, 1 - F.col("kept") / F.col("n")).alias("lost"))


def smallest_fit(pixels: DataFrame, src_w: int, src_h: int, candidates: list[int], max_lost: float = 0.42, max_mixed: float = 0.35, white: int = 244, share: float = 0.6, bucket: int = 48) -> DataFrame:
    """(image_id, stitches): the first candidate width, in order, at which neither measure warns; null if none.

    The measures are mode_cells and sub_stitch_share, for all candidates in one pass: the pixels are read once, eroded by each
    radius in one window over columns, and then counted once for each candidate grid.
    """
    spark = pixels.sparkSession
    sizes = [(pos, w, max(1, int(w * src_h / src_w + 0.5)), max(1, int(src_w / w / 2 + 0.5))) for pos, w in enumerate(candidates)]
    radii = sorted({r for *_, r in sizes})
    ink = (~is_plain_white(F.col("r"), F.col("g"), F.col("b"), white)).cast("int")
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")

    def eroded(name: str, r: int, w) -> Column:
        w = w.rowsBetween(-r, r)
        return F.when(F.count("*").over(w) == 2 * r + 1, F.min(name).over(w)).otherwise(0)

    coarse = F.struct(*[F.floor(F.col(c) / bucket).alias(c) for c in "rgb"])
    rows = pixels.select("image_id", "y", "x", coarse.alias("bucket"), ink.alias("ink"))
    rows = rows.withColumns({f"row_{r}": eroded("ink", r, row) for r in radii}).withColumns({f"kept_{r}": eroded(f"row_{r}", r, col) for r in radii})
    # windows of cells overlap where a grid is finer than the image; a pixel's ink counts with its first cell only
    cuts = {}
    for axis, length, at in (("y", src_h, 2), ("x", src_w, 1)):
        found = [(p, size[0], k) for size in sizes for k, (a, b) in enumerate(cell_windows(size[at], length)) for p in range(a, b)]
        table = spark.createDataFrame(found, f"{axis} int, pos int, c{axis} int").groupBy(axis).agg(F.collect_list(F.struct("pos", f"c{axis}")).alias(f"in_{axis}"))
        cuts[axis] = F.broadcast(table)  # a row for each line of pixels, with an entry or more for each candidate
    rows = rows.join(cuts["y"], "y").join(cuts["x"], "x")
    kept = F.element_at(F.create_map(*[v for pos, *_, r in sizes for v in (F.lit(pos), F.col(f"kept_{r}"))]), F.col("a.pos"))
    rows = rows.select("image_id", "bucket", "ink", *[f"kept_{r}" for r in radii], "in_x", "in_y", F.explode("in_y").alias("a"))
    rows = rows.withColumn("first_y", F.array_min(F.filter("in_y", lambda e: e["pos"] == F.col("a.pos")))["cy"])
    rows = rows.withColumn("own_x", F.filter("in_x", lambda e: e["pos"] == F.col("a.pos"))).select("image_id", "bucket", "ink", kept.alias("kept"), "a", "first_y", F.array_min("own_x")["cx"].alias("first_x"), F.explode("own_x").alias("b"))
    first = (F.col("a.cy") == F.col("first_y")) & (F.col("b.cx") == F.col("first_x"))
    own = lambda c: F.sum(F.when(first, F.col(c)).otherwise(0))
    counts = rows.groupBy("image_id", F.col("a.pos").alias("pos"), F.col("a.cy").alias("cy"), F.col("b.cx").alias("cx"), "bucket").agg(F.count("*").alias("n"), F.sum(first.cast("int")).alias("pixels"), own("ink").alias("ink"), own("kept").alias("kept"))
    cells = counts.groupBy("image_id", "pos", "cy", "cx").agg((F.max("n") / F.sum("n")).alias("top"), *[F.sum(c).alias(c) for c in ("pixels", "ink", "kept")])
    each = cells.groupBy("image_id", "pos").agg((F.count_if(F.col("top") < share) / F.count("*")).alias("mixed_share"), *[F.sum(c).alias(c) for c in ("pixels", "ink", "kept")])
    ink_share = F.col("ink") / F.col("pixels")
    lost = F.when((ink_share > 0.02) & (ink_share < 0.85) & (F.col("ink") > 50), 1 - F.col("kept") / F.col("ink")).otherwise(0.0)
    fits = (lost < max_lost) & (F.col("mixed_share") < max_mixed)
    best = each.groupBy("image_id").agg(F.min(F.when(fits, F.col("pos"))).alias("pos"))
    width = F.get(F.array(*map(F.lit, candidates)), F.col("pos"))
    return best.select("image_id", width.alias("stitches"))
