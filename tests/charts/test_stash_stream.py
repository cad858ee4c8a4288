"""Batches of stash movements: those of the same instant count, those before the last one do not."""

from __future__ import annotations

from skeinframe.streaming import marks

MOVES = "code string, ts long, move_id long, is_purchase boolean, quantity long"


def test_late_moves_are_dropped_and_counted(spark):
    first = spark.createDataFrame([("a", 5, 1, True, 3), ("b", 5, 2, True, 1)], MOVES)
    balances = marks.stash_batch(None, first, ["code"])
    more = spark.createDataFrame([("a", 4, 3, True, 9), ("a", 5, 1, True, 9), ("a", 5, 4, True, 7), ("a", 6, 5, True, 2), ("c", 1, 6, True, 4)], MOVES)
    assert {(r.code, r.late) for r in marks.late_moves(balances, more, ["code"]).collect()} == {("a", 2)}
    assert {(r.code, r.balance) for r in marks.stash_batch(balances, more, ["code"]).collect()} == {("a", 12), ("b", 1), ("c", 4)}
