"""The Lab grid: its bounds hold, and it finds what all pairs give with far fewer of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skeinframe.functions.color import with_ciede2000
from skeinframe.operators import labindex, matching

PALETTE = "brand string, pos long, code string, r int, g int, b int"


def palette(seed, n, brands=3):
    r = random.Random(seed)
    rows = [(f"b{r.randrange(brands)}", i, f"c{i}", *(r.randrange(256) for _ in range(3))) for i in range(n)]
    rows += [("b0", n + i, f"c{n + i}", *rows[i][3:]) for i in range(min(n, 4))]  # equal colours
    return [*rows, ("lone", n + 9, "x", 1, 2, 3), *[("close", n + 10 + i, f"k{i}", 100, 100, 100 + i) for i in range(5)]]


def all_pairs(df):
    a = matching.with_lab(df).select("brand", F.col("pos").alias("pa"), F.col("code").alias("ca"), F.col("lab").alias("p"))
    b = matching.with_lab(df).select("brand", F.col("pos").alias("pb"), F.col("code").alias("cb"), F.col("lab").alias("q"))
    return with_ciede2000(a.join(b, "brand").where("pa <> pb"), "p", "q")


def test_the_stretch_adds_less_than_said():
    c = np.linspace(0, 300, 300_001)
    assert (c * 0.5 * (1 - np.sqrt(c**7 / (c**7 + 25.0**7)))).max() < 6.5
    light = np.linspace(0, 100, 10_001)
    assert (1 + 0.015 * (light - 50) ** 2 / np.sqrt(20 + (light - 50) ** 2)).max() < 1.7472


def test_no_colour_within_a_distance_lies_beyond_its_reach(spark):
    """Pairs of any distance, blues above all, where the rotation term is large."""
    r = random.Random(5)

    def channel(x):
        return min(255, max(0, x))

    rows = []
    for i in range(30_000):
        c = [r.randrange(256) for _ in range(3)] if i % 2 else [r.randrange(90), r.randrange(90), r.randrange(120, 256)]
        step = r.choice([3, 12, 50, 120])
        rows.append((*c, *(channel(x + r.randint(-step, step)) for x in c)))
    df = spark.createDataFrame(rows, "r int, g int, b int, r2 int, g2 int, b2 int")
    df = matching.with_lab(df).withColumn("p", F.col("lab"))
    df = with_ciede2000(matching.with_lab(df.drop("lab", "r", "g", "b").withColumnsRenamed({"r2": "r", "g2": "g", "b2": "b"})).withColumnRenamed("lab", "q"), "p", "q")
    reach_l, reach_ab = labindex.ciede_reach(F.col("de"), F.col("p"))
    plane = F.sqrt((F.col("p.a") - F.col("q.a")) ** 2 + (F.col("p.b") - F.col("q.b")) ** 2)
    out = df.select((F.abs(F.col("p.l") - F.col("q.l")) > reach_l).alias("l"), (plane > reach_ab).alias("ab"))
    assert out.where("l OR ab").count() == 0


@pytest.mark.parametrize("n,top", [(400, 1), (400, 3), (3, 5)])
@pytest.mark.parametrize("weighted", [False, True])
def test_nearest_threads_equal_all_pairs(spark, n, top, weighted):
    if weighted and top > 1:
        return
    rows = palette(n, n)[:n]
    r = random.Random(7)
    colours = [tuple(r.randrange(256) for _ in range(3)) for _ in range(250)] + [x[3:] for x in rows[:20]]
    threads, wanted = spark.createDataFrame(rows, PALETTE), spark.createDataFrame(colours, "r int, g int, b int")
    got = matching.weighted_match(wanted, threads) if weighted else matching.match_threads(wanted, threads, top)
    a = matching.with_lab(wanted.distinct()).withColumnRenamed("lab", "p")
    b = matching.with_lab(threads).select("pos", "brand", "code", F.col("lab").alias("q"))
    every = a.crossJoin(b)
    every = matching._weighted(every, "p", "q", "de") if weighted else with_ciede2000(every, "p", "q")
    best = {}
    for x in every.select("r", "g", "b", "de", "pos", "code").collect():
        best.setdefault((x.r, x.g, x.b), []).append((x.de, x.pos, x.code))
    want = {(*k, i + 1): (code, de) for k, v in best.items() for i, (de, _, code) in enumerate(sorted(v)[:top])}
    found = {(x.r, x.g, x.b, x["rank"]): (x.code, x.distance) for x in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and math.isclose(found[k][1], want[k][1], abs_tol=1e-9) for k in want)
    if n == 400:
        pairs = matching.candidate_pairs(wanted, threads, top, weighted)
        within_reach = labindex.near(*_near_input(wanted, threads, top, weighted))
        assert pairs.count() <= within_reach.count() < every.count() * (0.25 if top == 1 else 0.5)


def _near_input(wanted, threads, top, weighted):
    rows = matching.with_lab(wanted.distinct())
    right = matching.with_lab(threads).select("pos", "brand", "code", F.col("lab").alias("right_lab"))
    distance, reach = (matching._weighted, labindex.weighted_reach) if weighted else (with_ciede2000, labindex.ciede_reach)
    rows = labindex.bounded(rows, right, [], "lab", distance, top)
    return rows, right, [], "lab", *(F.coalesce(x, F.lit(labindex.FAR)) for x in reach(F.col("bound"), F.col("lab")))


@pytest.mark.parametrize("jnd", [2.3, 45.0])
def test_collisions_equal_all_pairs(spark, jnd):
    df = spark.createDataFrame(palette(11, 500), PALETTE)
    want = {(x.brand, x.ca, x.cb): x.de for x in all_pairs(df).where("pa < pb").where(F.col("de") < jnd).collect()}
    got = {(x.brand, x.code_a, x.code_b): x.de for x in matching.thread_collisions(df, jnd).collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    if jnd == 2.3:
        assert matching.collision_candidates(df, jnd).count() < all_pairs(df).where("pa < pb").count() / 10


@pytest.mark.parametrize("jnd", [2.3, 20.0, 0.0])
def test_collision_classes_give_all_pairs(spark, jnd):
    """No link is lost, and copies take a row each, not one for each pair of them."""
    rows = palette(17, 60)
    rows += [(x[0], 1000 + 200 * k + i, f"d{k}-{i}", *x[3:]) for k in range(6) for i, x in enumerate(rows)] + [("b0", 9000 + i, f"n{i}", None, 1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, PALETTE)
    want = {(x.brand, x.code_a, x.code_b): x.de for x in matching.thread_collisions(df, jnd).collect()}
    got = matching.collision_classes(df, jnd).collect()
    colour, pos = {(x[0], x[2]): x[3:] for x in rows}, {(x[0], x[2]): x[1] for x in rows}
    links = {(x.brand, frozenset((colour[x.brand, x.code_a], colour[x.brand, x.code_b]))): x.de for x in got}
    every = {}
    for brand in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == brand), key=lambda x: x[1])
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (brand, frozenset((a[3:], b[3:]))) in links and None not in a:
                    every[brand, a[2], b[2]] = links[brand, frozenset((a[3:], b[3:]))]
    assert every.keys() == want.keys() and all(math.isclose(every[k], want[k], abs_tol=1e-9) for k in want)
    assert all(pos[x.brand, x.code_a] < pos[x.brand, x.code_b] for x in got)
    copies = [x for x in got if colour[x.brand, x.code_a] == colour[x.brand, x.code_b]]
    assert len(copies) == (len(rows) - 3 - len({(x[0], *x[3:]) for x in rows if x[3] is not None}) if jnd else 0)
    assert len(got) < len(want) / 3 or not jnd


@pytest.mark.parametrize("block", [1, 3, 256])
@pytest.mark.parametrize("jnd", [2.3, 20.0, 0.0])
def test_collisions_list_every_pair_of_copies(spark, jnd, block):
    """Whatever the blocks, each pair once and in order, with rows that share a pos, or lack it or a channel, as all pairs have them."""
    rows = palette(19, 40)
    rows += [(x[0], (1000 + 200 * k + i) * (-1) ** k, f"d{k}-{i}", *x[3:]) for k in range(4) for i, x in enumerate(rows[:20])]
    rows += [("b0", 9000, "n", None, 1, 2), ("b0", None, "m", *rows[0][3:]), (None, 9001, "o", 1, 2, 3), (None, 9002, "p", 1, 2, 3)]
    rows += [(rows[0][0], 9003, f"q{i}", *rows[0][3:]) for i in range(2)] + [("hot", i, f"h{i}", 7, 8, 9) for i in range(25)]
    df = spark.createDataFrame(rows, PALETTE)
    want = {(x.brand, x.ca, x.cb): x.de for x in all_pairs(df).where("pa < pb").where(F.col("de") < jnd).collect()}
    got = matching.thread_collisions(df, jnd, block).collect()
    assert len(got) == len(want) and {(x.brand, x.code_a, x.code_b) for x in got} == want.keys()
    assert all(math.isclose(x.de, want[x.brand, x.code_a, x.code_b], abs_tol=1e-9) for x in got)
    assert sum(x.brand == "hot" for x in got) == (25 * 24 // 2 if jnd else 0)


def test_neighbours_equal_all_pairs(spark):
    df = spark.createDataFrame(palette(13, 500), PALETTE)
    best = {}
    for x in all_pairs(df).collect():
        best[x.brand, x.ca] = min(best.get((x.brand, x.ca), (math.inf,)), (x.de, x.pb, x.cb))
    got = {(x.brand, x.code): (x.nearest, x.de) for x in matching.nearest_neighbours(df).collect()}
    assert got.keys() == best.keys() and ("lone", "x") not in got
    assert all(got[k][0] == best[k][2] and math.isclose(got[k][1], best[k][0], abs_tol=1e-9) for k in best)
    assert matching.neighbour_candidates(df).count() < all_pairs(df).count() / 3


def test_copies_of_a_colour_are_not_compared(spark):
    """Many threads of few colours: nearest ones as of all pairs, from pairs that don't grow with the copies."""
    rows = [("b", i, f"c{i}", 40 * (i % 5), 60, 90) for i in range(200)] + [("b", 300 + i, f"l{i}", 250, 90 + i, 20) for i in range(3)] + [("b", 400, "n", None, 1, 2)]
    df = spark.createDataFrame(rows, PALETTE)
    best = {}
    for x in all_pairs(df.where("r IS NOT NULL")).collect():
        best[x.ca] = min(best.get(x.ca, (math.inf,)), (x.de, x.pb, x.cb))
    got = {x.code: (x.nearest, x.de) for x in matching.nearest_neighbours(df).collect()}
    assert got.keys() == best.keys()
    assert all(got[k][0] == best[k][2] and math.isclose(got[k][1], best[k][0], abs_tol=1e-9) for k in best)
    colours = df.select("r", "g", "b")
    assert matching.candidate_pairs(colours, df, 2).count() <= 8 * 8 * 2
    found = [(x["rank"], x.code) for x in matching.match_threads(colours, df, 3).where("r = 40").collect()]
    assert sorted(found) == [(1, "c1"), (2, "c6"), (3, "c11")]


def test_no_threads_no_colours(spark):
    none, some = spark.createDataFrame([], PALETTE), spark.createDataFrame(palette(1, 5), PALETTE)
    for a, b in ((none, some), (some, none)):
        assert matching.match_threads(a, b).count() == 0
    assert matching.thread_collisions(none).count() == 0 and matching.nearest_neighbours(none).count() == 0
