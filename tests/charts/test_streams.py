"""Marks, saves and stash movements as running streams, against the same rows as a table."""

import os
import random

import pytest
from pyspark.sql import functions as F
from skeinframe.operators.stash import stash_ledger
from skeinframe.streaming import ledger, marks, snapshot

MOVES = "code string, at long, move_id long, is_purchase boolean, quantity long"


def in_batches(spark, tmp_path, batches, schema):
    """A stream that reads one batch of rows at a time, in order."""
    for i, rows in enumerate(batches):
        folder = f"{tmp_path}/in/{i}"
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.parquet(folder)
        part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
        os.utime(f"{folder}/{part}", (1000 + i, 1000 + i))
    kinds = spark.read.parquet(f"{tmp_path}/in/0").schema
    return spark.readStream.schema(kinds).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(stream, tmp_path, mode="append"):
    """All that a stream gives."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode(mode).trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def some_moves(seed, n=400, seconds=120):
    r = random.Random(seed)
    return [(r.choice(["a", "b", "c", None]), r.randrange(seconds) * 1_000_000 + r.choice([0, 0, 999, 1]), i, r.random() < 0.5, r.randrange(9)) for i in range(n)]


def plain_ledger(rows):
    """Move by move, in order of (time, id)."""
    out, balance = {}, {}
    for code, at, i, bought, quantity in sorted(rows, key=lambda m: (m[1], m[2])):
        balance[code] = max(0, balance.get(code, 0) + (quantity if bought else -quantity))
        out[i] = (code, balance[code])
    return out


@pytest.mark.parametrize("n_batches", [1, 4, 9])
def test_disorder_inside_the_watermark_changes_nothing(spark, tmp_path, n_batches):
    """Rows are out of order by up to 8 seconds, the delay is 20: as the batch ledger, no late rows."""
    r = random.Random(n_batches)
    rows = sorted(some_moves(n_batches), key=lambda m: m[1] + r.uniform(0, 8_000_000))
    size = -(-len(rows) // n_batches)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", 10**9, -1, True, 1)]]
    got = run(ledger.stream_ledger(in_batches(spark, tmp_path, batches, MOVES), ["code"], "20 seconds"), tmp_path).where("move_id >= 0").collect()
    assert not any(x.late for x in got) and len(got) == len(rows)
    table = spark.createDataFrame(rows, MOVES).withColumnRenamed("at", "ts")
    batch = {x.move_id: (x.code, x.balance) for x in stash_ledger(table, ["code"], ["ts", "move_id"]).collect()}
    assert {x.move_id: (x.code, x.balance) for x in got} == batch == plain_ledger(rows)


def test_moves_beyond_the_watermark_are_late_and_counted(spark, tmp_path):
    """What is late by its batch's watermark is given out as late; the rest is the ledger of what was in time."""
    rows = some_moves(3, seconds=60)
    batches = [rows[:150], rows[150:250], rows[250:], [("end", 10**9, -1, True, 1)]]
    want_late, mark = set(), 0
    for batch in batches:
        want_late |= {m[2] for m in batch if m[1] <= mark}
        mark = max(mark, *(m[1] // 1000 * 1000 - 5_000_000 for m in batch))
    assert 30 < len(want_late) < 250
    out = run(ledger.stream_ledger(in_batches(spark, tmp_path, batches, MOVES), ["code"], "5 seconds"), tmp_path)
    got = out.where("move_id >= 0").collect()
    assert sorted(x.move_id for x in got) == list(range(400))
    assert {x.move_id for x in got if x.late} == want_late
    in_time = plain_ledger([m for m in rows if m[2] not in want_late])
    assert {x.move_id: (x.code, x.balance) for x in got if not x.late} == in_time
    now = {x.code: (x.balance, x.n_late) for x in ledger.latest_balances(out, ["code"]).collect() if x.code != "end"}
    for code in {m[0] for m in rows}:
        late = sum(m[0] == code for m in rows if m[2] in want_late)
        assert now[code] == (max((m[1], m[2], in_time[m[2]][1]) for m in rows if m[0] == code and m[2] in in_time)[2], late)


def test_a_timer_gives_out_balances_of_a_quiet_key(spark, tmp_path):
    """Key a has no further moves; another key's moves the watermark past it."""
    batches = [[("a", 5_000_000, 1, True, 4)], [("b", 60_000_000, 2, True, 1)], [("b", 63_000_000, 3, True, 1)]]
    got = run(ledger.stream_ledger(in_batches(spark, tmp_path, batches, MOVES), ["code"], "1 second"), tmp_path).collect()
    assert {(x.code, x.move_id, x.balance) for x in got} == {("a", 1, 4.0), ("b", 2, 1.0)}


def test_a_ledger_stops_and_goes_on(spark, tmp_path):
    """State is in the checkpoint: a second run goes on from it."""
    rows = sorted(some_moves(8, 120), key=lambda m: m[1])
    in_batches(spark, tmp_path, [rows[:60]], MOVES)
    first = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run(ledger.stream_ledger(first, ["code"], "0 seconds"), tmp_path)
    for i, more in enumerate([rows[60:], [("end", 10**9, -1, True, 1)]], 1):
        spark.createDataFrame(more, MOVES).withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        out = run(ledger.stream_ledger(first, ["code"], "0 seconds"), tmp_path)
    got = {x.move_id: (x.code, x.balance) for x in out.where("NOT late AND move_id >= 0").collect()}
    late = {x.move_id for x in out.where("late").collect()}
    assert got == plain_ledger([m for m in rows if m[2] not in late]) and len(got) + len(late) == 120


MARKS = "design_id long, at long, idx long, mark_id long, done boolean"


def some_marks(seed, n=150, designs=3):
    r = random.Random(seed)
    return [(r.randrange(designs), r.randrange(60) * 1_000_000, r.randrange(10), i, r.random() < 0.5) for i in range(n)]


def cells(df):
    return sorted((r.design_id, r.idx, r.done, r.mark_id) for r in df.collect())


def test_marks_stream_as_batch(spark, tmp_path):
    rows = some_marks(7)
    stream = in_batches(spark, tmp_path, [rows[:50], rows[50:100], rows[100:]], MARKS)
    snapshot.stream_snapshot(stream, f"{tmp_path}/out", f"{tmp_path}/check", 8).trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(rows, MARKS).withColumn("ts", F.timestamp_micros("at"))
    assert cells(snapshot.snapshot(spark, f"{tmp_path}/out")) == cells(marks.apply_marks(table))


def size_of(folder, batch):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f"batch={batch}" in d and f.endswith(".parquet"))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """A large state, then marks of one design: one part is written, the others stay; repeats give the same; old versions go."""
    folder = f"{tmp_path}/out"
    ts = F.timestamp_seconds(F.col("id") % 50)
    state = spark.range(200_000).select((F.col("id") % 500).alias("design_id"), (F.col("id") / 500).cast("long").alias("idx"), (F.col("id") % 2 == 0).alias("done"), ts.alias("ts"), F.col("id").alias("mark_id"))
    snapshot.write_batch(state, folder, 0, 32)
    some = spark.range(20).select(F.lit(7).cast("long").alias("design_id"), F.col("id").alias("idx"), F.lit(True).alias("done"), F.timestamp_seconds(F.lit(100)).alias("ts"), (F.col("id") + 10**6).alias("mark_id"))
    for _ in range(2):  # a repeated batch
        snapshot.write_batch(some, folder, 1, 32)
    assert len([p for p, b in snapshot.versions(spark, folder).items() if 1 in b]) == 1
    assert size_of(folder, 1) < size_of(folder, 0) / 10
    want = cells(marks.merge_marks(marks.apply_marks(state), some))
    assert cells(snapshot.snapshot(spark, folder)) == want
    snapshot.write_batch(some, folder, 2, 32)
    snapshot.write_batch(some, folder, 3, 32)
    assert max(len(b) for b in snapshot.versions(spark, folder).values()) == 2 and snapshot.finished(spark, folder) == {0, 2, 3}
    assert cells(snapshot.snapshot(spark, folder)) == want


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = spark.createDataFrame(some_marks(1), MARKS).withColumn("ts", F.timestamp_micros("at"))
    snapshot.write_batch(rows, folder, 0, 4)
    before = cells(snapshot.snapshot(spark, folder))
    newer = rows.withColumns({"done": ~F.col("done"), "mark_id": F.col("mark_id") + 1000})
    snapshot.write_batch(newer, folder, 1, 4)
    os.remove(f"{folder}/_done/1")
    assert cells(snapshot.snapshot(spark, folder)) == before
    snapshot.write_batch(newer, folder, 1, 4)
    assert cells(snapshot.snapshot(spark, folder)) == cells(marks.apply_marks(rows.unionByName(newer)))


def test_autosave_stream_as_batch(spark, tmp_path):
    """Bursts with repeats of marks; the last batch moves the watermark past all of them."""
    r = random.Random(2)
    rows, at = [], 0
    for i in range(120):
        at += r.choice([200_000, 900_000, 3_000_000])
        rows.append((r.randrange(2), at, r.randrange(9), i, True))
    rows += rows[10:20]
    rows.sort(key=lambda m: m[1])
    batches = [rows[:40], rows[40:80], rows[80:], [(99, 10**12, 0, 10**6, True)]]
    stream = in_batches(spark, tmp_path, batches, MARKS)
    got = run(marks.autosave(marks.without_repeats(stream), late=None), tmp_path)
    table = spark.createDataFrame(rows, MARKS).withColumn("ts", F.timestamp_micros("at"))
    want = marks.autosave(marks.without_repeats(table))
    assert sorted(map(tuple, got.where("design_id < 99").collect())) == sorted(map(tuple, want.collect()))
