"""Suggestions from a stash against one need and one owned thread after another."""

import random

import numpy as np
from skeinframe.functions import labmath
from skeinframe.operators import stash

THREADS = "brand string, code string, r int, g int, b int"


def test_suggestions_equal_all_pairs(spark):
    r = random.Random(4)
    palette = [("b", str(i), 100 + r.randrange(12), 100 + r.randrange(12), 100) for i in range(60)] + [("b", "far", 255, 0, 0), ("b", "none", None, 1, 2)]
    own = [(r.randrange(4), "b", r.choice(palette)[1], float(r.randrange(3)), r.choice(["skein", "card"])) for _ in range(60)] + [(1, "b", "none", 2.0, "skein"), (2, "b", "other", 2.0, "skein")]
    needs = [(r.randrange(5), "b", r.choice(palette)[1]) for _ in range(80)] + [(1, "b", "none"), (2, "b", "other"), (0, "b", "none")]
    threads, stock = spark.createDataFrame(palette, THREADS), spark.createDataFrame(own, "user_id int, brand string, code string, quantity double, unit string")
    lab = {c: labmath.rgb_to_lab(np.array([x]))[0] for _, c, *x in palette if None not in x}
    known = {c for _, c, *_ in palette}
    total = {}
    for user, _, code, n, _ in own:
        if n > 0:
            total[user, code] = total.get((user, code), 0.0) + n
    want = {}
    for user, _, code in needs:
        if code not in known:
            continue
        if (user, code) in total:
            want[user, code] = (code, total[user, code], True)
        elif code in lab:
            near = [(round(float(labmath.ciede2000(lab[code], lab[c])), 9), f"b::{c}", c) for u, c in total if u == user and c in lab]
            near = [x for x in near if x[0] <= 5]
            if near:
                want[user, code] = (min(near)[2], total[user, min(near)[2]], False)
    got = stash.suggest_from_stash(spark.createDataFrame(needs, "user_id int, brand string, code string"), stock, threads)
    assert got.columns == ["user_id", "key", "suggested_key", "de", "exact", "quantity"]
    assert {(x.user_id, x.key[3:]): (x.suggested_key[3:], x.quantity, x.exact) for x in got.collect()} == want and len(want) > 20
    # a user's needs and threads never all meet: no join is by the user alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    conditions = [x.split("Join Inner, ")[1] for x in plan.splitlines() if "Join Inner, " in x]
    assert conditions and all(x.count(" = ") > 1 or "user_id" not in x for x in conditions)
