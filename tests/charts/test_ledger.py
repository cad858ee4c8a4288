"""The stash ledger with heavy keys against one step after another."""

import random

import pytest
from pyspark.sql import functions as F
from skeinframe.operators import stash
from skeinframe.streaming import marks

MOVES = "user_id long, ts long, move_id long, is_purchase boolean, quantity long"


def moves(seed, n=3000):
    """One user has half of all moves, some with the same time; a null user is heavy too."""
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 1, None, r.randrange(2, 40)]), r.randrange(500), i, r.random() < 0.48, r.randrange(20)) for i in range(n)]


def one_by_one(rows):
    out, balance = {}, {}
    for user, _, i, bought, quantity in sorted(rows, key=lambda m: (m[1], m[2])):
        balance[user] = max(0, balance.get(user, 0) + (quantity if bought else -quantity))
        out[i] = balance[user]
    return out


@pytest.mark.parametrize("heavy", [None, 10**6, 1000, 60, 1])
@pytest.mark.parametrize("segments", [2, 64])
def test_segments_change_nothing(spark, monkeypatch, heavy, segments):
    monkeypatch.setattr(stash, "SEGMENTS", segments)
    rows = moves(segments)
    got = stash.stash_ledger(spark.createDataFrame(rows, MOVES), ["user_id"], ["ts", "move_id"], heavy)
    assert got.columns == ["user_id", "ts", "move_id", "is_purchase", "quantity", "balance"]
    assert {r.move_id: r.balance for r in got.collect()} == one_by_one(rows)


def test_timestamps_as_order(spark):
    rows = moves(9, 800)
    df = spark.createDataFrame(rows, MOVES).withColumn("ts", F.timestamp_seconds("ts"))
    got = stash.stash_ledger(df, ["user_id"], ["ts", "move_id"], 100)
    assert {r.move_id: r.balance for r in got.collect()} == one_by_one(rows)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "double", "decimal(20,3)"])
def test_order_columns_of_other_types(spark, kind):
    rows = moves(10, 800)
    own = {"timestamp_ntz": F.timestamp_seconds("ts").cast(kind), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("ts").cast("int"))}
    df = spark.createDataFrame(rows, MOVES).withColumn("ts", own.get(kind, F.col("ts").cast(kind)))
    got = stash.stash_ledger(df, ["user_id"], ["ts", "move_id"], 100)
    assert {r.move_id: r.balance for r in got.collect()} == one_by_one(rows)


def test_heavy_key_without_times(spark):
    rows = [(1, None, i, i % 3 > 0, 2) for i in range(50)]
    got = stash.stash_ledger(spark.createDataFrame(rows, MOVES), ["user_id"], ["ts", "move_id"], 10)
    assert {r.move_id: r.balance for r in got.collect()} == one_by_one([(1, 0, *x[2:]) for x in rows])


def test_a_heavy_key_is_spread_over_tasks(spark):
    """No task sees more than a few hundredths of the key that has half of the rows."""
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("user_id"), (F.col("id") % 5000).alias("ts"), F.col("id").alias("move_id"), (F.col("id") % 3 == 0).alias("is_purchase"), F.lit(2).alias("quantity"))
    got = stash.stash_ledger(df, ["user_id"], ["ts", "move_id"], 5000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__seg" in plan and plan.count("Window") >= 3
    big = df.where("user_id = 1")
    cuts = big.selectExpr(f"percentile_approx(CAST(ts AS DOUBLE), array({', '.join(str(i / stash.SEGMENTS) for i in range(1, stash.SEGMENTS))}), 1000)").first()[0]
    sizes = big.groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("ts")))).count().collect()
    assert max(r["count"] for r in sizes) < n / 2 / 20
    assert got.where("user_id = 1").count() == n / 2 + 1


def test_batches_of_heavy_keys_without_zone(spark, monkeypatch):
    monkeypatch.setattr(stash.stash_ledger, "__defaults__", (100,))
    rows = moves(12, 900)
    df = spark.createDataFrame(rows, MOVES).withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    half = F.col("ts") < F.timestamp_seconds(F.lit(250)).cast("timestamp_ntz")
    got = marks.stash_batch(marks.stash_batch(None, df.where(half), ["user_id"]), df.where(~half), ["user_id"])
    after, last = one_by_one(rows), {}
    for user, t, i, *_ in rows:
        last[user] = max(last.get(user, (-1, -1)), (t, i))
    want = {user: after[i] for user, (_, i) in last.items() if user is not None}  # a null user's first balance is no start
    assert {r.user_id: r.balance for r in got.collect() if r.user_id is not None} == want


def test_no_moves(spark):
    assert stash.stash_ledger(spark.createDataFrame([], MOVES), ["user_id"], ["ts", "move_id"]).count() == 0


@pytest.mark.parametrize("heavy", [10**6, 200, 30, 1])
def test_batches_are_the_ledger_of_all_moves(spark, heavy):
    """Three batches, each cut into ranges of time; keys with no moves in a batch keep their balance, null is a key."""
    rows = moves(14, 900)
    df = spark.createDataFrame(rows, MOVES).withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz"))
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    balances = None
    for part in (at < 150, (at >= 150) & (at < 160), at >= 160):
        balances = marks.stash_batch(balances, df.where(part), ["user_id"], heavy)
    after, last = one_by_one(rows), {}
    for user, t, i, *_ in rows:
        last[user] = max(last.get(user, (-1, -1)), (t, i))
    assert balances.columns == ["user_id", "balance", "ts", "move_id"]
    assert {r.user_id: (r.balance, r.move_id) for r in balances.collect()} == {u: (after[i], i) for u, (_, i) in last.items()}


@pytest.mark.parametrize("heavy", [10**6, 2])
def test_late_moves_without_a_key(spark, heavy):
    first = marks.stash_batch(None, spark.createDataFrame([(None, 5, 1, True, 3), (None, 6, 2, False, 1)], MOVES), ["user_id"], heavy)
    more = spark.createDataFrame([(None, 4, 3, False, 9), (None, 6, 2, True, 9), (None, 7, 5, True, 2), (1, 1, 6, True, 4)], MOVES)
    assert {(r.user_id, r.balance) for r in marks.stash_batch(first, more, ["user_id"], heavy).collect()} == {(None, 4), (1, 4)}
    assert {(r.user_id, r.late) for r in marks.late_moves(first, more, ["user_id"]).collect()} == {(None, 2)}


def test_plans_of_batches_stay_small(spark):
    """A batch on top of another reads the earlier moves twice with their cuts, for what is late and for where keys start."""
    df = spark.createDataFrame(moves(15, 900), MOVES)
    got = marks.stash_batch(marks.stash_batch(None, df.where("ts < 250"), ["user_id"], 100), df.where("ts >= 250"), ["user_id"], 100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 6
