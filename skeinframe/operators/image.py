"""From pixels to thread charts: clusters, votes and palette steps.

Counting, joining and voting over pixels is Spark's; what is greedy over the few dozen colours of one image runs in numpy, in
a call for each image or, where millions of small images are usual, for many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions import labmath
from skeinframe.functions.color import is_plain_white, lab_chroma, lab_dist_sq, lab_hue, rgb_to_lab, with_ciede2000
from skeinframe.operators.groups import FIRST, firsts, flags, in_groups, ranges, whole_groups
from skeinframe.operators.quality import cell_of, in_windows
from skeinframe.operators.regions import label_regions

CLUSTER = "image_id long, cluster_id int, r int, g int, b int, population long, protected boolean"


def box_average(pixels: DataFrame, grid_w: int, grid_h: int, src_w: int, src_h: int) -> DataFrame:
    """(image_id, y, x, r, g, b, chroma, hue): mean colour of each output cell."""
    cy, cx = cell_of(grid_w, grid_h, src_w, src_h)
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("int").alias(c)
    cells = pixels.select("image_id", cy.alias("cy"), cx.alias("cx"), "r", "g", "b").groupBy("image_id", "cy", "cx").agg(mean("r"), mean("g"), mean("b"))
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    rows = cells.withColumn("lab", lab)
    return rows.select("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"), "r", "g", "b", lab_chroma(F.col("lab")).alias("chroma"), lab_hue(F.col("lab")).alias("hue"))


def nearest_cluster(pixels: DataFrame, clusters: DataFrame, white: int = 244) -> DataFrame:
    """(image_id, r, g, b, cluster_id) of distinct colours: -1 for plain white, else the nearest by squared Lab distance.

    Colours are matched once an image, not once a pixel; ties go to the lower cluster_id.
    """
    colours = pixels.select("image_id", "r", "g", "b").distinct()
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    fixed = clusters.withColumn("lab", lab).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "lab"))).alias("clusters"))
    rows = colours.withColumn("lab", lab).join(fixed, "image_id", "left")
    best = F.array_min(F.transform("clusters", lambda c: F.struct(lab_dist_sq(F.col("lab"), c["lab"]).alias("d"), c["cluster_id"].alias("id"))))
    return rows.select("image_id", "r", "g", "b", F.when(is_plain_white(F.col("r"), F.col("g"), F.col("b"), white), F.lit(-1)).otherwise(F.coalesce(best["id"], F.lit(-1))).alias("cluster_id"))


def vote_cells(pixels: DataFrame, clusters: DataFrame, threads: DataFrame, background: str, grid_w: int, grid_h: int, src_w: int, src_h: int, dark: float = 0.05, fitted: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(image_id, y, x, code): the majority thread of each cell's pixels.

    threads (image_id, cluster_id, code). Ties go to the first pixel. Where the background wins but 5 % of the pixels are
    dark (channel sum under 350), the commonest dark thread wins unless it is the background; ties go to the thread whose
    first dark pixel comes first. Windows are mirror-exact. fitted: (x, y, width, height) of the cells that the image
    covers, by default all; cells around it are background.
    """
    named = nearest_cluster(pixels, clusters).join(threads.select("image_id", "cluster_id", "code"), ["image_id", "cluster_id"], "left")
    named = named.select("image_id", "r", "g", "b", F.coalesce("code", F.lit(background)).alias("code"))
    ox, oy, rw, rh = fitted or (0, 0, grid_w, grid_h)
    rows = in_windows(pixels.select("image_id", "y", "x", "r", "g", "b").join(named, ["image_id", "r", "g", "b"]), rw, rh, src_w, src_h, mirror=True)
    rows = rows.select("image_id", (F.col("cy") + oy).alias("cy"), (F.col("cx") + ox).alias("cx"), "code", (F.col("y").cast("long") * src_w + F.col("x")).alias("at"), ((F.col("r") + F.col("g") + F.col("b")) < 350).alias("dark"))
    counts = rows.groupBy("image_id", "cy", "cx", "code").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if("dark").alias("n_dark"), F.min(F.when(F.col("dark"), F.col("at"))).alias("first_dark"))
    cells = counts.groupBy("image_id", "cy", "cx").agg(
        F.max_by("code", F.struct("n", -F.col("first"))).alias("top"), F.sum("n").alias("n"), F.sum("n_dark").alias("n_dark"),
        F.max(F.struct(F.col("n_dark").alias("k"), (-F.col("first_dark")).alias("f"), "code")).alias("darkest"),
    )
    lifted = (F.col("top") == background) & (F.col("n_dark") >= dark * F.col("n")) & (F.col("n_dark") > 0) & (F.col("darkest.code") != background)
    voted = cells.select("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"), F.when(lifted, F.col("darkest.code")).otherwise(F.col("top")).alias("code"))
    if fitted is None:
        return voted
    every = pixels.select("image_id").distinct()
    for axis, n in (("y", grid_h), ("x", grid_w)):
        every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(axis))
    around = every.where(~(F.col("x").between(ox, ox + rw - 1) & F.col("y").between(oy, oy + rh - 1)))
    return voted.unionByName(around.withColumn("code", F.lit(background)))


def limit_palette(usage: DataFrame, palette: DataFrame, max_colours: int, protected: list[int] = ()) -> DataFrame:
    """(chart_id, pal_idx, kept_idx): the most used and protected colours keep themselves, the rest go to the nearest kept.

    usage (chart_id, pal_idx, n); palette (chart_id, pal_idx, r, g, b). Nearest by squared Lab distance, ties to the lower.
    """
    rows = palette.join(usage, ["chart_id", "pal_idx"], "left").fillna(0, ["n"]).withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    place = F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc("n"), "pal_idx"))
    rows = rows.withColumn("kept", (place <= max_colours) | F.col("pal_idx").isin(list(protected)))
    folded = rows.where("kept").groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("pal_idx", "lab"))).alias("kept_colours"))
    best = F.array_min(F.transform("kept_colours", lambda k: F.struct(lab_dist_sq(F.col("lab"), k["lab"]).alias("d"), k["pal_idx"].alias("i"))))
    return rows.join(folded, "chart_id").select("chart_id", "pal_idx", F.when(F.col("kept"), F.col("pal_idx")).otherwise(best["i"]).alias("kept_idx"))


def remap(cells: DataFrame, mapping: DataFrame, to: str, value: str = "pal_idx") -> DataFrame:
    """cells with their palette index replaced by mapping's (chart_id, pal_idx, to)."""
    rows = cells.join(mapping.select("chart_id", F.col("pal_idx").alias(value), F.col(to).alias("new_value")), ["chart_id", value], "left")
    return rows.withColumn(value, F.coalesce("new_value", value)).select(*cells.columns)


def outline_colours(palette: DataFrame, usage: DataFrame, share: float = 0.03, gap: float = 20.0) -> DataFrame:
    """(chart_id, pal_idx, outline): used for at most 3 % of the cells and 20 L darker than the usage-weighted mean."""
    rows = palette.join(usage, ["chart_id", "pal_idx"], "left").fillna(0, ["n"]).withColumn("l", rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))["l"])
    w = Window.partitionBy("chart_id")
    total = F.sum("n").over(w)
    mean = F.when(total > 0, F.sum(F.col("l") * F.col("n")).over(w) / total).otherwise(50.0)
    flag = (F.col("n") > 0) & (F.col("n") <= share * total) & (mean - F.col("l") >= gap) & (F.count("*").over(w) >= 2)
    return rows.withColumn("outline", flag).select("chart_id", "pal_idx", "outline")


def _roots(parent: list[int]) -> list[int]:
    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    return [find(i) for i in range(len(parent))]


def merge_near_duplicates(palette: DataFrame, usage: DataFrame, contacts: DataFrame | None = None, max_de: float = 11.0, max_minority: float | None = 0.045, min_interleave: float | None = None, protected: list[int] = ()) -> DataFrame:
    """(chart_id, pal_idx, survivor): pairs closer than max_de whose lesser one has a minority share, closest first.

    Pairs are found by Spark; the greedy union over them, where the heavier original survives, is one call a chart.
    contacts: colour_contacts(), needed with min_interleave.
    """
    rows = palette.join(usage, ["chart_id", "pal_idx"], "left").fillna(0, ["n"]).withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    free = rows.where(~F.col("pal_idx").isin(list(protected)))
    side = lambda s: free.select("chart_id", F.col("pal_idx").alias(f"i{s}"), F.col("n").alias(f"n{s}"), F.col("lab").alias(f"lab{s}"))
    pairs = side("a").join(side("b"), "chart_id").where("ia < ib AND na + nb > 0")
    pairs = with_ciede2000(pairs, "laba", "labb").where(F.col("de") < max_de)
    if max_minority is not None:
        pairs = pairs.where(F.least("na", "nb") < max_minority * (F.col("na") + F.col("nb")))
    if min_interleave is not None:
        pairs = pairs.join(contacts.select("chart_id", F.col("a").alias("ia"), F.col("b").alias("ib"), "interleave"), ["chart_id", "ia", "ib"]).where(F.col("interleave") >= min_interleave)
    listed = pairs.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("de", "ia", "ib"))).alias("pairs"))
    entries = rows.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("pal_idx", "n"))).alias("entries")).join(listed, "chart_id", "left")

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chart, own, near in zip(pdf.chart_id, pdf.entries, pdf.pairs, strict=True):
            ids = [e["pal_idx"] for e in own]
            at = {i: k for k, i in enumerate(ids)}
            parent = list(range(len(ids)))
            for p in near if near is not None else ():
                top = _roots(parent)
                a, b = top[at[p["ia"]]], top[at[p["ib"]]]
                if a != b:
                    win, lose = (a, b) if own[a]["n"] >= own[b]["n"] else (b, a)
                    parent[lose] = win
            out += [(chart, i, ids[r]) for i, r in zip(ids, _roots(parent), strict=True)]
        return pd.DataFrame(out, columns=["chart_id", "pal_idx", "survivor"])

    return entries.groupBy("chart_id").applyInPandas(union, "chart_id long, pal_idx int, survivor int")


def cull_tiny(palette: DataFrame, usage: DataFrame, floor: int | None = None, protected: list[int] = ()) -> DataFrame:
    """(chart_id, pal_idx, survivor): colours of fewer than floor cells go to the nearest one left, smallest first.

    floor defaults to max(10, 0.08 % of the cells). At least two colours stay; protected ones neither go nor receive.
    """
    rows = palette.join(usage, ["chart_id", "pal_idx"], "left").fillna(0, ["n"])

    def cull(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pal_idx").reset_index(drop=True)
        ids, n = pdf.pal_idx.tolist(), pdf.n.to_numpy()
        least = max(10, int(0.0008 * n.sum() + 0.5)) if floor is None else floor
        lab = labmath.rgb_to_lab(pdf[["r", "g", "b"]].to_numpy())
        keep = np.array([i in protected for i in ids])
        left, parent = np.ones(len(ids), bool), list(range(len(ids)))
        if len(ids) >= 3:
            for i in sorted(np.flatnonzero(~keep & (n < least)), key=lambda i: n[i]):
                if left.sum() <= 2:
                    break
                pool = left & ~keep
                pool[i] = False
                if not pool.any():
                    continue
                de = np.where(pool, labmath.ciede2000(lab[i], lab), np.inf)
                parent[i] = int(de.argmin())
                left[i] = False
        return pd.DataFrame({"chart_id": pdf.chart_id, "pal_idx": ids, "survivor": [ids[r] for r in _roots(parent)]})

    return rows.select("chart_id", F.col("pal_idx").cast("int").alias("pal_idx"), "r", "g", "b", "n").groupBy("chart_id").applyInPandas(cull, "chart_id long, pal_idx int, survivor int")


def _spread(rgb: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The range of each channel in boxes of the given sizes, end to end."""
    at = np.cumsum(size) - size
    return np.maximum.reduceat(rgb, at) - np.minimum.reduceat(rgb, at) if len(size) else np.zeros((0, 3), rgb.dtype)


def _median_cuts(rgb: np.ndarray, image: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Median cuts of many images at once, into target[image] boxes each: (order, box's image, start, size).

    image rises. A box is order[start : start + size]; an image's boxes stand in the order in which they were made. Each round
    cuts one box of each image that needs more: that with the widest channel times its pixels.
    """
    order, start = np.arange(len(rgb)), firsts(image)
    of, size = image[start], np.diff(np.r_[start, len(rgb)])
    spread = _spread(rgb, size)
    for made in range(1, int(target.max())):
        weight = np.where(size > 1, spread.max(axis=1) * size, 0)
        best = np.lexsort((np.arange(len(of)), -weight, of))
        best = best[firsts(of[best])]
        best = best[(weight[best] > 0) & (target[of[best]] > made)]
        if not len(best):
            break
        rows, box = ranges(start[best], size[best]), np.repeat(np.arange(len(best)), size[best])
        own = order[rows]
        order[rows] = own[np.lexsort((rgb[own, spread[best].argmax(axis=1)[box]], box))]
        low = size[best] // 2
        starts, sizes = np.r_[start[best], start[best] + low], np.r_[low, size[best] - low]
        left = np.ones(len(of), bool)
        left[best] = False
        spread = np.vstack([spread[left], _spread(rgb[order[ranges(starts, sizes)]], sizes)])
        of, start, size = np.r_[of[left], of[best], of[best]], np.r_[start[left], starts], np.r_[size[left], sizes]
    return order, of, start, size


def _representatives(rgb: np.ndarray, size: np.ndarray, fusion: float = 12.0, near: float = 6.0) -> np.ndarray:
    """Colours of boxes that stand end to end: the mean of a tight box; of a wide one the mean of its largest greedy group, so
    that the colour is a real one."""
    start, box = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    at = np.arange(len(rgb)) - start[box]
    colour = np.floor(np.add.reduceat(rgb, start) / size[:, None] + 0.5)
    some = at % np.maximum(1, size // 64)[box] == 0
    apart = labmath.ciede2000(labmath.rgb_to_lab(colour)[box[some]], labmath.rgb_to_lab(rgb[some]))
    wide = (size >= 4) & ~(np.maximum.reduceat(apart, firsts(box[some])) <= fusion)
    some = wide[box] & (at % np.maximum(1, size // 512)[box] == 0)
    rest, of, best = rgb[some], box[some], np.zeros(len(size), np.int64)
    lab = labmath.rgb_to_lab(rest)
    while len(of):
        head = firsts(of)
        close = labmath.ciede2000(np.repeat(lab[head], np.diff(np.r_[head, len(of)]), axis=0), lab) <= near
        n, total = np.add.reduceat(close.astype(np.int64), head), np.add.reduceat(rest * close[:, None], head)
        larger = n > best[of[head]]
        colour[of[head][larger]] = np.floor(total[larger] / n[larger, None] + 0.5)
        best[of[head][larger]] = n[larger]
        left = np.bincount(of[~close], minlength=len(size))
        on = ~close & (left > best)[of]  # what is left of a box can't be larger than its best group
        rest, of, lab = rest[on], of[on], lab[on]
    return colour


def derive_clusters(pixels: DataFrame, target: int, sample: int = 24_000, skip_white: int | None = None, flat: str | None = None) -> DataFrame:
    """Rows of CLUSTER: reserved vivid colours (by 60 degree hue buckets) and neutral tones, then a median cut of the rest.

    Pixels are sampled by stride in Spark before they reach Python: at most `sample` an image, a size of the method
    itself. flat: a boolean column; only its pixels count where they are 200 and 5 % of the sample at least. Vivid: chroma
    at or over the image's 80th percentile and 20, for at most a third of the target. Neutral: of bands of 18 L with
    chroma up to 6, 20 pixels and 0.15 %, the darkest and the largest other one. An image of skipped white only has one
    white cluster. Small images are worked on many at once.
    """
    every = Window.partitionBy("image_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(every)
    rows = pixels.withColumn("stride", F.greatest(F.lit(1), F.ceil(n / sample))).where(F.col("idx") % F.col("stride") == 0)
    white = F.lit(False) if skip_white is None else F.coalesce(is_plain_white(F.col("r"), F.col("g"), F.col("b"), skip_white), F.lit(False))
    rows = rows.withColumns({"skipped": white, "plain": F.lit(True) if flat is None else F.coalesce(F.col(flat), F.lit(False))})

    def grouped(lab: np.ndarray, image: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of each pixel's reserved group in its image or -1, groups of each image)."""
        images, chroma = len(size), np.hypot(lab[:, 1], lab[:, 2])
        level = chroma[np.lexsort((chroma, image))][np.cumsum(size) - size + np.minimum(size - 1, (0.8 * size).astype(np.int64))]
        vivid = (chroma >= level[image]) & (chroma >= 20)
        bucket = (np.degrees(np.arctan2(lab[:, 2], lab[:, 1])) % 360 // 60).astype(np.int64)
        kept = np.bincount((image * 7 + bucket)[vivid], minlength=images * 7).reshape(-1, 7) >= np.maximum(4, 0.002 * size)[:, None]
        kept[:, 6] = False  # 360 degrees, by rounding
        kept &= np.cumsum(kept, axis=1) <= max(1, target // 3)
        group = np.where(vivid & kept[image, bucket], (np.cumsum(kept, axis=1) - 1)[image, bucket], -1)
        groups = kept.sum(axis=1)
        # the darkest and the largest other band of neutral tones
        band = np.where((group < 0) & (chroma <= 6), np.floor(lab[:, 0] / 18), -1).astype(np.int64)
        bands = max(0, int(band.max())) + 1
        size_of = np.bincount((image * bands + band)[band >= 0], minlength=images * bands).reshape(-1, bands)
        viable = (size_of >= np.maximum(20, 0.0015 * size)[:, None]) & (size >= 50)[:, None]
        darkest = viable.argmax(axis=1)
        others = np.where(viable & (np.arange(bands) != darkest[:, None]), size_of, 0)
        for chosen, has in ((darkest, viable.any(axis=1)), (others.argmax(axis=1), others.any(axis=1))):
            group = np.where((band >= 0) & has[image] & (band == chosen[image]), groups[image], group)
            groups = groups + has
        return group, groups

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            first, skipped, plain = (flags(table[c]) for c in (FIRST, "skipped", "plain"))
            rgb, image = np.stack([table[c].to_numpy() for c in ("r", "g", "b")], axis=1).astype(np.int64), np.cumsum(first) - 1
            images = int(image[-1]) + 1
            enough = np.bincount(image[~skipped & plain], minlength=images) >= np.maximum(200, 0.05 * np.bincount(image[~skipped], minlength=images))
            own = ~skipped & (plain | ~enough[image])
            bare = np.setdiff1d(np.arange(images), image[own])
            rgb, image = np.vstack([rgb[own], np.full((len(bare), 3), 255)]), np.r_[image[own], bare]
            if len(bare):
                by = np.argsort(image, kind="stable")
                rgb, image = rgb[by], image[by]
            group, groups = grouped(labmath.rgb_to_lab(rgb), image, np.bincount(image, minlength=images))
            reserved, rest = np.flatnonzero(group >= 0), np.flatnonzero(group < 0)
            reserved = reserved[np.lexsort((group[reserved], image[reserved]))]
            at = firsts(image[reserved] * (int(groups.max()) + 1) + group[reserved])
            order, of, start, size = _median_cuts(rgb[rest], image[rest], np.maximum(1, target - groups))
            by = np.argsort(of, kind="stable")
            of, start, size = of[by], start[by], size[by]
            place = groups[of] + np.arange(len(of)) - np.repeat(firsts(of), np.diff(np.r_[firsts(of), len(of)]))
            boxes = np.r_[reserved, rest[order[ranges(start, size)]]]
            sizes = np.r_[np.diff(np.r_[at, len(reserved)]), size].astype(np.int64)
            colour = _representatives(rgb[boxes], sizes)
            ids = table["image_id"].take(pa.array(np.flatnonzero(first)[np.r_[image[reserved[at]], of]]))
            yield _cluster_rows(ids, np.r_[group[reserved[at]], place], colour, sizes, np.arange(len(sizes)) < len(at))

    rows = rows.select(F.col("image_id").cast("long").alias("image_id"), "idx", "r", "g", "b", "skipped", "plain")
    return in_groups(rows, ["image_id"], ["idx"]).mapInArrow(cut, CLUSTER)


def _cluster_rows(ids: pa.ChunkedArray, place: np.ndarray, colour: np.ndarray, population: np.ndarray, protected: np.ndarray) -> pa.RecordBatch:
    """A batch of CLUSTER."""
    columns = [ids.combine_chunks(), pa.array(place, pa.int32()), *[pa.array(colour[:, k].astype(np.int32)) for k in range(3)], pa.array(population, pa.int64()), pa.array(protected, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["image_id", "cluster_id", "r", "g", "b", "population", "protected"])


def merge_clusters(clusters: DataFrame, threshold: float, ceiling: int, patches: DataFrame | None = None) -> DataFrame:
    """Rows of CLUSTER after repeated merging of the closest pair below a squared Lab distance, then down to a ceiling.

    A pair with populations over 8 to 1, or with patches of 8 cells or more on both sides, only merges within a quarter of
    the threshold. Down to the ceiling the pair with the least d (1 + log2 ratio) goes. Of colours over 12 apart in
    CIEDE2000 the larger keeps its colour. patches (image_id, cluster_id, largest). Small images are merged many at once.
    """
    rows = clusters.join(patches.select("image_id", "cluster_id", "largest"), ["image_id", "cluster_id"], "left") if patches is not None else clusters.withColumn("largest", F.lit(0).cast("long"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 20_000):
            at = np.flatnonzero(flags(table[FIRST]))
            size = np.diff(np.r_[at, table.num_rows])
            # images of as many clusters together, so that their pairs take PAIRS numbers at most
            for k in np.unique(size):
                same, most = at[size == k], max(1, PAIRS // int(2 * k) ** 2)
                for i in range(0, len(same), most):
                    rows = same[i : i + most, None] + np.arange(k)
                    rgb = np.stack([table[c].to_numpy() for c in ("r", "g", "b")], axis=1)[rows].astype(float)
                    population, largest, protected = (table[c].to_numpy()[rows] for c in ("population", "largest", "protected"))
                    image, place, *merged = _merged(rgb, population, protected, largest, threshold, ceiling)
                    yield _cluster_rows(table["image_id"].take(pa.array(same[i : i + most][image])), place, *merged)

    rows = rows.select(F.col("image_id").cast("long").alias("image_id"), "cluster_id", "r", "g", "b", F.col("population").cast("long").alias("population"), F.coalesce("protected", F.lit(False)).alias("protected"), F.coalesce(F.col("largest").cast("long"), F.lit(0)).alias("largest"))
    return in_groups(rows, ["image_id"], ["cluster_id"]).mapInArrow(merge, CLUSTER)


#: Numbers in the table of all pairs of clusters that images which are merged together may take.
PAIRS = 1 << 21


def _merged(rgb: np.ndarray, population: np.ndarray, protected: np.ndarray, largest: np.ndarray, threshold: float, ceiling: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, place, colour, population, protected) of what merge_clusters leaves of images of k clusters each.

    Arrays (images, k). A merged cluster comes after all others of its image, so a merge only adds a place; each round merges
    the best pair of every image that has one.
    """
    images, k = population.shape
    grown = lambda x: np.concatenate([x, np.zeros((images, k - 1, *x.shape[2:]), x.dtype)], axis=1)
    rgb, population, protected, largest, here = grown(rgb), grown(population), grown(protected), grown(largest), grown(np.ones((images, k), bool))
    lab, end = labmath.rgb_to_lab(rgb), np.full(images, k)

    def costs(i: np.ndarray, a: tuple, b: tuple, down: bool) -> np.ndarray:
        """Of merging clusters at a with those at b, in images i; inf: they don't merge. down: to the ceiling."""
        d = ((lab[i, a] - lab[i, b]) ** 2).sum(axis=-1)
        ratio = np.maximum(population[i, a], population[i, b]) / np.maximum(1, np.minimum(population[i, a], population[i, b]))
        if down:
            # two clusters without population have a ratio of 0 and go first
            cost = np.where(ratio < 1, -np.inf, d * (1 + np.log2(np.clip(ratio, 1, 64))))
        else:
            cost = np.where((d < threshold) & ((d <= threshold / 4) | ((ratio <= 8) & (np.minimum(largest[i, a], largest[i, b]) < 8))), d, np.inf)
        return np.where(here[i, a] & here[i, b] & (a < b), cost, np.inf)

    def merge_all(down: bool) -> None:
        places = np.arange(2 * k - 1)
        table = costs(np.arange(images)[:, None, None], places[:, None], places[None], down)
        on = np.arange(images)
        while len(on):
            cost = table[on]
            if down:
                forced = (here[on] & ~protected[on]).sum(axis=1) <= ceiling
                cost = np.where(forced[:, None, None] | ~(protected[on][:, :, None] | protected[on][:, None]), cost, np.inf)
                cost = np.where((here[on].sum(axis=1) > max(1, ceiling))[:, None, None], cost, np.inf)
            best = cost.reshape(len(on), -1).argmin(axis=1)
            has = cost.reshape(len(on), -1)[np.arange(len(on)), best] < np.inf
            on, best = on[has], best[has]
            i, j, new = best // (2 * k - 1), best % (2 * k - 1), end[on]
            wi, wj = np.maximum(1, population[on, i])[:, None], np.maximum(1, population[on, j])[:, None]
            apart = labmath.ciede2000(lab[on, i], lab[on, j])[:, None]
            mixed = np.floor((rgb[on, i] * wi + rgb[on, j] * wj) / (wi + wj) + 0.5)
            rgb[on, new] = np.where(apart > 12, np.where(wi >= wj, rgb[on, i], rgb[on, j]), mixed)
            lab[on, new] = labmath.rgb_to_lab(rgb[on, new])
            population[on, new], protected[on, new] = population[on, i] + population[on, j], protected[on, i] | protected[on, j]
            largest[on, new], here[on, new] = np.maximum(largest[on, i], largest[on, j]), True
            for gone in (i, j):
                here[on, gone] = False
                table[on, gone] = np.inf
                table[on, :, gone] = np.inf
            table[on, :, new] = costs(on[:, None], places[None], new[:, None], down)
            end[on] += 1

    if k > 1:
        merge_all(False)
        merge_all(True)
    image, at = np.nonzero(here)
    return image, (np.cumsum(here, axis=1) - 1)[image, at], rgb[image, at], population[image, at], protected[image, at]


def natural_colour_count(pixels: DataFrame, distance: int = 40, sample: int = 40_000, most: int = 300, flat: str | None = None) -> DataFrame:
    """(image_id, colours): groups of samples within an L1 distance of a group's first one, in pixel order.

    Groups of 6 samples and over 0.1 % count; at least 2, or 3 without samples. Past `most` groups a sample joins the
    nearest, as the method has it; samples are taken by stride in Spark. flat: a boolean column, other pixels don't count.
    """
    n = F.count("*").over(Window.partitionBy("image_id"))
    rows = pixels.withColumn("stride", F.greatest(F.lit(1), F.ceil(n / sample))).where(F.col("idx") % F.col("stride") == 0)

    rows = rows.withColumn("plain", F.lit(True) if flat is None else F.coalesce(F.col(flat), F.lit(False)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = pdf[pdf.plain].sort_values("idx")[["r", "g", "b"]].to_numpy(np.int64)
        rest, sizes, heads = rgb, [], []
        while len(rest) and len(heads) < most:  # the first one left founds a group; all within reach of it join
            near = np.abs(rest - rest[0]).sum(axis=1) <= distance
            heads.append(rest[0])
            sizes.append(int(near.sum()))
            rest = rest[~near]
        for x in rest:
            sizes[int(np.abs(np.array(heads) - x).sum(axis=1).argmin())] += 1
        total = sum(sizes)
        found = max(2, sum(s >= 6 and s / total > 0.001 for s in sizes)) if total else 3
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "colours": [found]})

    return rows.select("image_id", "idx", "r", "g", "b", "plain").groupBy("image_id").applyInPandas(count, "image_id long, colours int")


def colour_budget(kind: Column, whole: Column, flat: Column, max_colours: int, multiplier: float = 2.0, requested: int | None = None) -> Column:
    """Clusters to look for: photos by the multiplier, at least 16; flat art by its estimate plus 2, at least 3."""
    estimate = F.when(whole > 2 * flat, F.least(whole, F.lit(24))).otherwise(flat)
    if requested is not None:
        estimate = F.greatest(estimate, F.lit(requested))
    photo = max(16, int(max_colours * multiplier + 0.5))
    return F.when(kind == "photo", photo).otherwise(F.greatest(F.lit(3), estimate + 2))


def salient_islands(boxes: DataFrame, radius: int = 6, turn: float = 45.0, least: int = 4) -> DataFrame:
    """(image_id, region, size, r, g, b): 8-connected islands of cells whose hue stands out from the window around them.

    boxes: box_average(). Window: (2 radius + 1) squared; its circular mean hue counts cells of chroma 4 or more, at least
    6 of them. A cell stands out with chroma 5 and 45 degrees. Windows are separable: rows first, then columns.
    """
    counted = (F.col("chroma") >= 4).cast("int")
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    rows = boxes.withColumns({"cos": counted * F.cos(F.radians("hue")), "sin": counted * F.sin(F.radians("hue")), "k": counted})
    for w in (row, col):
        rows = rows.withColumns({c: F.sum(c).over(w) for c in ("cos", "sin", "k")})
    mean = F.pmod(F.degrees(F.atan2("sin", "cos")) + 360, F.lit(360.0))
    d = F.abs(F.col("hue") - mean)
    salient = (F.col("chroma") >= 5) & (F.col("k") >= 6) & (F.least(d, 360 - d) >= turn)
    marked = rows.withColumns({"mark": salient.cast("int"), "idx": F.col("y").cast("long") * 100_000 + F.col("x")})
    labelled = label_regions(marked.select(F.col("image_id").alias("chart_id"), "idx", "y", "x", "mark"), "mark", eight=True, sentinel=0).where("region IS NOT NULL")
    both = labelled.select(F.col("chart_id").alias("image_id"), "y", "x", "region").join(boxes, ["image_id", "y", "x"])
    mean_ = lambda c: F.floor(F.avg(c) + 0.5).cast("int").alias(c)
    return both.groupBy("image_id", "region").agg(F.count("*").alias("size"), mean_("r"), mean_("g"), mean_("b")).where(F.col("size") >= least)
