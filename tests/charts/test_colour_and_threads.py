"""Colour formulas against published values, thread and stash rules against hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from skeinframe.functions import labmath
from skeinframe.functions.color import hex_to_rgb, rgb_to_lab, with_ciede2000
from skeinframe.functions.text import baseline_rate, ceil_safe, normalise_code
from skeinframe.operators import matching, stash, threads
from skeinframe.sources import tables

# Pairs of Lab colours and their difference, from Sharma, Wu and Dalal (2005), table 1.
SHARMA = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615), (50.0, 2.8361, -74.02, 50.0, 0.0, -82.7485, 3.4412), (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669), (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977), (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.903), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (63.0109, -31.0961, -5.8663, 62.8187, -29.7946, -4.0864, 1.263), (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000(spark):
    lab = lambda a, b, c: F.struct(F.col(a).alias("l"), F.col(b).alias("a"), F.col(c).alias("b"))
    rows = spark.createDataFrame(SHARMA, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double").withColumns({"p": lab("l1", "a1", "b1"), "q": lab("l2", "a2", "b2")})
    for r in with_ciede2000(rows, "p", "q").collect():
        assert r.de == pytest.approx(r.want, abs=1e-4)
    s = np.array(SHARMA)
    assert labmath.ciede2000(s[:, :3], s[:, 3:6]) == pytest.approx(s[:, 6], abs=1e-4)


def test_hex_and_lab(spark):
    rows = spark.createDataFrame([("#abc",), (" AABBCC ",), ("#12",), (None,), ("#GG0000",)], "h string").select(hex_to_rgb(F.col("h")).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in rows] == [(170, 187, 204), (170, 187, 204), None, None, None]
    lab = spark.range(1).select(rgb_to_lab(F.lit(255), F.lit(255), F.lit(255)).alias("w")).first().w
    assert (lab.l, lab.a, lab.b) == pytest.approx((100, 0, 0), abs=0.01)


def test_codes_and_rates(spark):
    rows = spark.createDataFrame([("0321",), (" white ",), ("Snow White",), ("000",), ("b5200",), ("03",)], "c string").select(normalise_code(F.col("c")).alias("c")).collect()
    assert [r.c for r in rows] == ["321", "BLANC", "B5200", "0", "B5200", "3"]
    rows = spark.createDataFrame([(10,), (12,), (16,)], "m int").select(baseline_rate(F.col("m")).alias("b")).collect()
    assert [(round(r.b.rate, 3), r.b.provenance) for r in rows] == [(1.094, "sourced"), (1.312, "derived"), (1.75, "fallback")]
    assert spark.range(1).select(ceil_safe(F.lit(3.0000000001)).alias("c")).first().c == 3


def test_thread_needs(spark):
    lines = spark.createDataFrame([("appletons-crewel", 12, 1440), ("appletons-tapestry", 14, 100), ("appletons-crewel", 10, 100), ("silk-and-ivory", 13, 1690), (None, 18, 324), ("dmc-perle-5", 18, 0)], "product string, mesh int, cell_count long")
    got = {(r["product"], r.mesh): r for r in threads.thread_needs(lines, tables.products(spark), tables.coverage(spark), tables.guidance(spark)).collect()}
    yd = 1 / 0.9144
    r = got["appletons-crewel", 12]
    assert r.yards == pytest.approx(10 * 1.2 * yd * 3.5) and r.yards_max == pytest.approx(10 * 1.2 * yd * 4) and r.units == math.ceil(10 * 1.2 * 3.5 / 25) and r.units_max == 2 and r.blurb is None
    assert "not appropriate" in got["appletons-tapestry", 14].error and "no strand guidance" in got["appletons-crewel", 10].error
    assert got["silk-and-ivory", 13].yards == pytest.approx(10 * 28.8 / 20) and got["silk-and-ivory", 13].rate_from == "tabulated"
    assert got[None, 18].units is None and got[None, 18].yards == pytest.approx(2 * yd * 3)
    assert got["dmc-perle-5", 18].units == 0


def test_reconcile_and_ledger(spark):
    own = spark.createDataFrame([(1, "DMC ", "1", 2.0, "skein"), (1, "dmc", "1", 0.5, "skein"), (1, "dmc", "2", 9.0, "card"), (1, "dmc", "3", 0.0, "skein")], "user_id int, brand string, code string, quantity double, unit string")
    need = spark.createDataFrame([(1, "dmc", "1", 2.0, 3.0, "skein"), (1, "dmc", "2", 1.0, 1.0, "skein"), (1, "dmc", "3", 1.0, 2.0, "skein"), (1, "dmc", "4", 1.0, 2.0, "skein")], "user_id int, brand string, code string, need_min double, need_max double, unit string")
    got = {r.code: (r.status, r.other_unit, r.shortfall_min, r.shortfall_max) for r in stash.reconcile_stash(need, own).collect()}
    assert got == {"1": ("likely-sufficient", None, 0, 1), "2": ("unit-mismatch", "card", None, None), "3": ("short", None, 1, 2), "4": ("not-in-stash", None, 1, 2)}
    moves = [(1, i, p, q) for i, (p, q) in enumerate([(True, 3), (False, 5), (True, 2), (False, 1), (False, 4), (True, 1)])]
    ledger = stash.stash_ledger(spark.createDataFrame(moves, "user_id int, move_id int, is_purchase boolean, quantity int"), ["user_id"], ["move_id"])
    assert [r.balance for r in ledger.orderBy("move_id").collect()] == [3, 0, 2, 1, 0, 1]


def test_matching(spark):
    palette = spark.createDataFrame([("x", "a", "f", 255, 0, 0, 0), ("x", "b", "f", 250, 0, 0, 1), ("x", "c", "g", 0, 0, 255, 2)], "brand string, code string, family string, r int, g int, b int, pos int")
    colours = spark.createDataFrame([(254, 0, 0), (0, 10, 240)], "r int, g int, b int")
    assert {(r.r, r["rank"]): r.code for r in matching.match_threads(colours, palette, 2).collect()} == {(254, 1): "a", (254, 2): "b", (0, 1): "c", (0, 2): "b"}
    assert [(r.code_a, r.code_b) for r in matching.thread_collisions(palette).collect()] == [("a", "b")]
    assert {r.code: r.nearest for r in matching.nearest_neighbours(palette).collect()}["a"] == "b"
    assert {r.r: r.code for r in matching.weighted_match(colours, palette).collect()} == {254: "a", 0: "c"}
