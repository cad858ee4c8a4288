"""What people own, what they need, and what changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.functions.color import rgb_to_lab, with_ciede2000
from skeinframe.functions.text import stash_key
from skeinframe.operators import labindex


def index_stash(stash: DataFrame) -> DataFrame:
    """(user_id, key, unit, quantity): lines of one key and unit summed; units stay apart."""
    return stash.groupBy("user_id", stash_key(F.col("brand"), F.col("code")).alias("key"), "unit").agg(F.sum("quantity").alias("quantity"))


def reconcile_stash(requirements: DataFrame, stash: DataFrame) -> DataFrame:
    """requirements (user_id, brand, code, need_min, need_max, unit) with owned, status, other_unit and shortfalls.

    No line for the key: not-in-stash. A line, but none in the unit: unit-mismatch, with the smallest other unit. Else
    sufficient, likely-sufficient or short. One aggregate over the stash serves both questions: its units as a map.
    """
    owned = index_stash(stash).groupBy("user_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "quantity"))).alias("units"))
    rows = requirements.withColumn("key", stash_key(F.col("brand"), F.col("code"))).join(owned, ["user_id", "key"], "left")
    q = F.col("units")[F.col("unit")]
    status = F.when(F.col("units").isNull(), "not-in-stash").when(q.isNull(), "unit-mismatch").when(q >= F.col("need_max"), "sufficient").when(q >= F.col("need_min"), "likely-sufficient").otherwise("short")
    rows = rows.withColumn("owned", F.when(F.col("units").isNull(), F.lit(0.0)).otherwise(q.cast("double"))).withColumn("status", status)
    gap = lambda need: F.when(F.col("status") == "unit-mismatch", F.lit(None).cast("long")).otherwise(F.ceil(F.greatest(F.lit(0.0), F.col(need) - F.col("owned"))).cast("long"))
    other = F.when(F.col("status") == "unit-mismatch", F.array_min(F.map_keys("units")))
    return rows.withColumns({"other_unit": other, "shortfall_min": gap("need_min"), "shortfall_max": gap("need_max")}).drop("units")


def top_up_list(reconciled: DataFrame) -> DataFrame:
    return reconciled.where(F.col("status").isin("short", "not-in-stash", "likely-sufficient"))


def reconcile_summary(reconciled: DataFrame, *by: str) -> DataFrame:
    """must_buy, may_need_more, covered and uncomparable lines, by the given columns."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return reconciled.groupBy(*by).agg(n("short", "not-in-stash").alias("must_buy"), n("likely-sufficient").alias("may_need_more"), n("sufficient").alias("covered"), n("unit-mismatch").alias("uncomparable"))


def suggest_from_stash(needs: DataFrame, stash: DataFrame, threads: DataFrame, max_de: float = 5.0) -> DataFrame:
    """For needs (user_id, brand, code): the owned thread to use instead, if any.

    Exactly the thread itself (quantity above 0): difference 0. Else the closest owned shade of any brand within max_de,
    ties in stash order (key). Needs without a known colour give no row. Pairs of colours are compared once, not for each
    user or thread; a user's needs meet their stash by equal keys, then by colour, of which the first owned key stands.
    """
    rgb = ["r", "g", "b"]
    shades = threads.select(stash_key(F.col("brand"), F.col("code")).alias("key"), *rgb).dropDuplicates(["key"])
    own = index_stash(stash).where("quantity > 0").groupBy("user_id", "key").agg(F.sum("quantity").alias("quantity"))
    want = needs.select("user_id", stash_key(F.col("brand"), F.col("code")).alias("key")).distinct().join(shades, "key")
    rows = want.join(own, ["user_id", "key"], "left")
    exact = rows.where("quantity IS NOT NULL").select("user_id", "key", F.col("key").alias("suggested_key"), F.lit(0.0).alias("de"), F.lit(True).alias("exact"), "quantity").where(F.col("de") <= max_de)
    other = rows.where("quantity IS NULL").drop("quantity")
    owned = own.join(shades, "key").groupBy("user_id", *rgb).agg(F.min(F.struct("key", "quantity")).alias("first"))
    wanted = other.select("user_id", *rgb).distinct()
    close = close_colours(want.select(*rgb), threads.select(*rgb), max_de)
    found = wanted.join(close, rgb).join(owned.withColumnsRenamed({c: f"{c}2" for c in rgb}), ["user_id", *[f"{c}2" for c in rgb]])
    best = found.groupBy("user_id", *rgb).agg(F.min(F.struct("de", "first")).alias("best"))
    near = other.join(best, ["user_id", *rgb])
    return exact.unionByName(near.select("user_id", "key", F.col("best.first.key").alias("suggested_key"), "best.de", F.lit(False).alias("exact"), F.col("best.first.quantity").alias("quantity")))


def close_colours(left: DataFrame, right: DataFrame, max_de: float) -> DataFrame:
    """(r, g, b, r2, g2, b2, de): distinct colours of left and right within max_de."""
    rgb, known = ["r", "g", "b"], "r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL"
    a, b = (x.where(known).distinct().withColumn("lab", rgb_to_lab(*map(F.col, rgb))) for x in (left, right))
    b = b.withColumnsRenamed({c: f"{c}2" for c in rgb} | {"lab": "right_lab"})
    pairs = labindex.near(a, b, [], "lab", *labindex.ciede_reach(F.lit(max_de), F.col("lab")))
    return with_ciede2000(pairs, "lab", "right_lab").where(F.col("de") <= max_de).drop("lab", "right_lab")


def stash_box(stash: DataFrame, threads: DataFrame) -> DataFrame:
    """Stash lines in box order: brand, family (empty if unknown), code."""
    names = threads.select(stash_key(F.col("brand"), F.col("code")).alias("key"), "family").dropDuplicates(["key"])
    rows = stash.withColumn("key", stash_key(F.col("brand"), F.col("code"))).join(names, "key", "left").drop("key")
    return rows.withColumn("family", F.coalesce("family", F.lit(""))).orderBy("brand", "family", "code")


def apply_purchases(stash: DataFrame, purchases: DataFrame, now: str) -> DataFrame:
    """(user_id, key, unit, quantity, updated_at): purchases of more than nothing added; touched lines stamped."""
    bought = index_stash(purchases.where("quantity > 0")).withColumnRenamed("quantity", "bought")
    old = index_stash(stash)
    both = old.join(bought, ["user_id", "key", "unit"], "full")
    total = F.coalesce("quantity", F.lit(0.0)) + F.coalesce("bought", F.lit(0.0))
    return both.select("user_id", "key", "unit", total.alias("quantity"), F.when(F.col("bought").isNotNull(), F.lit(now).cast("timestamp")).alias("updated_at"))


def consume_stash(stash: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """The same after use: never below 0; what is not owned is ignored."""
    out = index_stash(used.where("quantity > 0")).withColumnRenamed("quantity", "used")
    rows = index_stash(stash).join(out, ["user_id", "key", "unit"], "left")
    left = F.greatest(F.lit(0.0), F.col("quantity") - F.coalesce("used", F.lit(0.0)))
    return rows.select("user_id", "key", "unit", left.alias("quantity"), F.when(F.col("used").isNotNull(), F.lit(now).cast("timestamp")).alias("updated_at"))


#: Keys with more moves than this are scanned in segments, but at most so many keys.
HEAVY, MOST_HEAVY = 1_000_000, 1000
#: Segments of a heavy key; segments of all moves where only the last balances are asked for.
SEGMENTS, MOST_SEGMENTS = 64, 1000


def stash_ledger(moves: DataFrame, keys: list[str], order: list[str], heavy: int | None = HEAVY) -> DataFrame:
    """moves with `balance` after each, where a balance never falls below 0 at any step.

    With S the running sum of signed quantities, the clamped balance is S - min(0, smallest S so far): no loop needed.
    A start balance goes in as a first purchase.

    A key with more than `heavy` moves (None: no key) doesn't go to one task. Its moves are cut into SEGMENTS by quantiles of
    the first order column. A segment's sum and smallest running sum are all that later ones need from it, as
    (sum, smallest) of two neighbours gives that of both: each segment is scanned by itself, the totals of a key's segments
    in order, and both are put together row by row.
    """
    signed = F.when(F.col("is_purchase"), F.col("quantity")).otherwise(-F.col("quantity"))
    if heavy is None:
        return _scanned(moves, signed, keys, order)
    n = moves.select(*keys).count()
    if n <= heavy:
        return _scanned(moves, signed, keys, order)
    least = max(heavy, n // MOST_HEAVY)
    # of the column's own type, which may be a number, a date or a time with or without zone
    cuts = F.percentile_approx(order[0], [i / SEGMENTS for i in range(1, SEGMENTS)], 1000)
    some = moves.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > least).drop("__n")
    # at most MOST_HEAVY rows, as each stands for more than a MOST_HEAVYth of all
    some = F.broadcast(some.select(*[F.col(k).alias(f"__{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    light = _scanned(moves.join(some, same, "left_anti"), signed, keys, order)
    big = moves.join(some, same, "left_semi")
    bounds = big.groupBy(*keys).agg(cuts.alias("__cuts")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__cuts")
    rows = big.join(F.broadcast(bounds), same).withColumn("__seg", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(order[0]))), F.lit(0)))
    rows = rows.drop("__cuts", *[f"__{k}" for k in keys])
    return light.unionByName(_in_segments(rows, signed, keys, order).select(*light.columns))


def stash_balances(moves: DataFrame, keys: list[str], order: list[str], balances: DataFrame | None = None, heavy: int = HEAVY) -> DataFrame:
    """(keys, balance, order) after the last move of each key: what stash_ledger has in its last row, without the other rows.

    balances, of the same form, are where the keys start; moves that are not after a key's last one by order don't count. The
    end of a key follows from (sum, smallest running sum) of its segments, here ranges of the first order column that hold
    about `heavy` moves of all keys together (at most MOST_SEGMENTS), so that no task scans more of one key. What is counted
    at once is the given moves alone; balances are not worked out before the result is.
    """
    n = moves.count()
    by = [*keys, "__seg"] if n > heavy else keys
    rows = moves
    if n > heavy:
        segments = min(MOST_SEGMENTS, -(-n // heavy))
        cuts = F.percentile_approx(order[0], [i / segments for i in range(1, segments)], 10_000)
        rows = rows.join(F.broadcast(moves.agg(cuts.alias("__cuts"))))
        rows = rows.withColumn("__seg", F.greatest(F.lit(0), F.size(F.filter("__cuts", lambda x: x < F.col(order[0]))))).drop("__cuts")
    if balances is not None:
        last = balances.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*order).alias("__last"))
        rows = rows.join(last, same_keys(keys), "left").where(F.col("__last").isNull() | (F.struct(*order) > F.col("__last")))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("is_purchase"), F.col("quantity")).otherwise(-F.col("quantity"))
    rows = rows.select(*by, *order, signed.alias("signed")).withColumn("running", F.sum("signed").over(upto))
    ends = rows.groupBy(*by).agg(F.sum("signed").alias("sum"), F.min("running").alias("floor"), F.max(F.struct(*order)).alias("last"))
    if by is keys and balances is None:
        total = ends
    else:
        ends = ends if "__seg" in by else ends.withColumn("__seg", F.lit(0))
        if balances is not None:
            ends = ends.unionByName(balances.select(*keys, F.lit(-1).alias("__seg"), F.col("balance").alias("sum"), F.col("balance").alias("floor"), F.struct(*order).alias("last")))
        before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("floor", F.col("floor") + F.coalesce(F.sum("sum").over(before), F.lit(0)))
        total = ends.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.min("floor").alias("floor"), F.max("last").alias("last"))
    return total.select(*keys, (F.col("sum") - F.least(F.lit(0), F.col("floor"))).alias("balance"), *[f"last.{c}" for c in order])


def same_keys(keys: list[str]) -> Column:
    """That each key equals the column of its name with __ in front; null equals null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return same


def _scanned(moves: DataFrame, signed: Column, keys: list[str], order: list[str]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.withColumn("running", F.sum(signed).over(upto))
    return rows.withColumn("balance", F.col("running") - F.least(F.lit(0), F.min("running").over(upto))).drop("running")


def _in_segments(rows: DataFrame, signed: Column, keys: list[str], order: list[str]) -> DataFrame:
    """moves with a segment number `__seg` that rises with their order, scanned by segment."""
    upto = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum(signed).over(upto)).withColumn("lowest", F.min("running").over(upto))
    total = rows.groupBy(*keys, "__seg").agg(F.sum(signed).alias("sum"), F.min("running").alias("min"))
    before = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    total = total.withColumn("floor", F.min(F.col("start") + F.col("min")).over(before))
    # a row for each segment of a heavy key
    total = F.broadcast(total.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__seg").alias("__at"), "start", "floor"))
    same = F.col("__seg") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    running = F.col("running") + F.col("start")
    lowest = F.least(F.lit(0), F.col("lowest") + F.col("start"), F.col("floor"))
    return rows.join(total, same).withColumn("balance", running - lowest).drop("running", "lowest", "start", "floor", "__at", "__seg", *[f"__{k}" for k in keys])
