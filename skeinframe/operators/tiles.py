"""Connected regions of charts of any size: tiles are labelled by themselves, seams are united by star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.groups import FIRST, firsts, flags, in_groups, whole_groups
from skeinframe.operators.regions import label_grid
from skeinframe.sources.folders import shared_folder

NEXT = ((0, 1), (1, 0))
NEXT_EIGHT = (*NEXT, (1, 1), (1, -1))


#: Cells of the grid that several tiles are stacked in, to be labelled at once.
AREA = 1 << 20


def label_tiles(cells: DataFrame, value: str, eight: bool, sentinel: int | None, tile: int) -> DataFrame:
    """cells with ty, tx and `region`, the smallest idx of the component within the tile.

    Small tiles are labelled many at once, below each other with an empty row between two; a large one by itself.
    """

    def stacked(y: np.ndarray, x: np.ndarray, values: np.ndarray, idx: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(region, whether there is one) of the cells of whole tiles."""
        at = np.flatnonzero(first)
        own = np.cumsum(first) - 1
        y, x = y - np.minimum.reduceat(y, at)[own], x - np.minimum.reduceat(x, at)[own]
        height, width = np.maximum.reduceat(y, at) + 2, int(x.max()) + 1
        region, has = np.zeros(len(y), np.int64), np.zeros(len(y), bool)
        part = np.cumsum(height * width) // AREA
        for begin, end in pairwise([*firsts(part), len(part)]):
            rows = np.s_[at[begin] : at[end] if end < len(at) else len(y)]
            high = height[begin:end]
            down, along = y[rows] + (np.cumsum(high) - high)[own[rows] - begin], x[rows]
            grid, present = np.zeros((int(high.sum()), width), np.int64), np.zeros((int(high.sum()), width), bool)
            grid[down, along], present[down, along] = values[rows], True
            if sentinel is not None:
                present &= grid != sentinel
            found = label_grid(grid, present, eight)[down, along]
            least = np.full(grid.size, np.iinfo(np.int64).max)
            np.minimum.at(least, found[found >= 0], idx[rows][found >= 0])
            region[rows], has[rows] = np.where(found >= 0, least[np.maximum(found, 0)], 0), found >= 0
        return region, has

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            y, x, values, idx = (table[c].to_numpy() for c in ("y", "x", value, "idx"))
            region, has = stacked(y.astype(np.int64), x.astype(np.int64), values, idx, flags(table[FIRST]))
            yield from table.drop_columns(FIRST).append_column("region", pa.array(region, mask=~has)).combine_chunks().to_batches()

    kinds = dict(cells.dtypes)
    rows = cells.select("chart_id", F.col("idx").cast("long").alias("idx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    schema = f"chart_id {kinds['chart_id']}, idx bigint, y int, x int, {value} {kinds[value]}, ty int, tx int, region bigint"
    return in_groups(rows, ["chart_id", "ty", "tx"], ["idx"]).mapInArrow(label, schema)


def seam_edges(labelled: DataFrame, value: str, eight: bool, tile: int) -> DataFrame:
    """(chart_id, a, b), a < b: labels that touch across a seam and have one value."""
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = labelled.where("region IS NOT NULL").where(edge("y") | edge("x")).select("chart_id", "y", "x", value, "ty", "tx", "region")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in (NEXT_EIGHT if eight else NEXT)])
    here = rim.withColumn("step", F.explode(steps)).select("chart_id", (F.col("y") + F.col("step.dy")).alias("y"), (F.col("x") + F.col("step.dx")).alias("x"), value, F.col("ty").alias("from_ty"), F.col("tx").alias("from_tx"), F.col("region").alias("from"))
    # steps within a tile are left out before the join
    here = here.where((F.floor(F.col("y") / tile) != F.col("from_ty")) | (F.floor(F.col("x") / tile) != F.col("from_tx"))).drop("from_ty", "from_tx")
    both = here.join(rim.drop("ty", "tx"), ["chart_id", "y", "x", value])
    return both.where(F.col("from") != F.col("region")).select("chart_id", F.least("from", "region").alias("a"), F.greatest("from", "region").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(chart_id, node, root): for each node of edges (chart_id, a, b) the smallest of its component.

    Large-star and small-star in turn: every node's larger neighbours, then its smaller ones, are tied to the smallest node
    around it. Each round halves paths and is written to the shared folder; it ends when only stars are left.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        folder = shared_folder(spark, "stars")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    def least(df: DataFrame) -> DataFrame:
        """(chart_id, u, m): the smallest of u and its neighbours v."""
        return df.groupBy("chart_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    now = kept(edges.select("chart_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select("chart_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), ["chart_id", "u"]).select("chart_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        with_least = large.join(least(large), ["chart_id", "u"])
        small = with_least.select("chart_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(with_least.select("chart_id", "u", F.col("m").alias("v")))
        now = kept(small.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("chart_id", "u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select("chart_id", F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)


def label_regions_tiled(cells: DataFrame, value: str = "pal_idx", eight: bool = False, sentinel: int | None = None, tile: int = 512) -> DataFrame:
    """As regions.label_regions, for charts too large for one task: a call holds a tile of cells, or many small ones of about 100 000.

    region is the smallest idx of the whole component. Charts within one tile have no seams and no rounds of uniting.
    """
    spark = cells.sparkSession
    folder = shared_folder(spark, "tiles")
    made = label_tiles(cells, value, eight, sentinel, tile)
    made.write.parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    roots = components(seam_edges(made, value, eight, tile)).withColumnRenamed("node", "region")
    return made.join(roots, ["chart_id", "region"], "left").select("chart_id", "idx", "y", "x", value, F.coalesce("root", "region").alias("region"))
