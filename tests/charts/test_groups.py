"""Many small groups in one call: cut between groups, tiles and images together as by themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skeinframe.operators import groups, regions, tiles

CELLS = "chart_id long, idx long, y int, x int, pal_idx int"


@pytest.mark.parametrize("rows", [1, 5, 20, 1000])
@pytest.mark.parametrize("batch", [1, 3, 50])
def test_tables_end_between_groups(rows, batch):
    r = random.Random(rows * batch)
    sizes = [r.choice([1, 1, 2, 7, 30]) for _ in range(40)]
    group = np.repeat(np.arange(40), sizes)
    whole = pa.record_batch({"group": group, groups.FIRST: np.r_[True, group[1:] != group[:-1]]})
    got = list(groups.whole_groups((whole.slice(i, batch) for i in range(0, whole.num_rows, batch)), rows))
    assert [g for t in got for g in t["group"].to_pylist()] == group.tolist()
    for t in got:
        own = t["group"].to_pylist()
        assert all(own.count(g) == sizes[g] for g in set(own))
        assert len(own) <= rows + batch + 30
    assert list(groups.whole_groups([])) == []


def test_groups_are_whole_in_a_partition(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 613).alias("k"), (-F.col("id")).alias("id"))
    parts = groups.in_groups(df, ["k"], ["id"]).rdd.glom().collect()
    seen = [[(r.k, r.id, r[groups.FIRST]) for r in part] for part in parts]
    keys = [k for part in seen for k, _, first in part if first]
    assert len(keys) == len(set(keys)) == df.select("k").distinct().count()
    for part in seen:
        for before, (k, i, first) in zip([(0, 0, True), *part], part):
            assert first or (before[0] == k and before[1] < i)


def charts(n, seed=5):
    r = random.Random(seed)
    return [(c, y * 20 + x, y, x, r.randrange(2)) for c in range(n) for y in range(r.choice([1, 4, 20])) for x in range(20) if r.random() < 0.95]


@pytest.mark.parametrize("area", [1, 300, tiles.AREA])
@pytest.mark.parametrize("eight,sentinel", [(False, None), (True, 1)])
def test_stacked_tiles(spark, monkeypatch, area, eight, sentinel):
    """Tiles of many charts in one grid don't touch each other, wherever the grid ends."""
    monkeypatch.setattr(tiles, "AREA", area)
    df = spark.createDataFrame(charts(30), CELLS)
    want = sorted(map(str, regions.label_regions(df, "pal_idx", eight, sentinel).collect()))
    assert sorted(map(str, tiles.label_regions_tiled(df, "pal_idx", eight, sentinel, 7).collect())) == want


def test_no_call_for_each_tile(spark):
    df = spark.createDataFrame(charts(40), CELLS)
    made = tiles.label_tiles(df, "pal_idx", False, None, 7)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
