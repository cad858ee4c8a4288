"""The stash ledger as a stream: keyed state, moves applied in event-time order.

A balance never falls below 0 at any step, so order matters. A key's moves wait in its state until the watermark has passed
them and are then applied by (ts, move_id). What is applied together is everything up to the watermark, and what comes later
with a time up to the watermark is late: it is not applied but given out, marked, so that it can be counted by key. So the
result is that of the batch ledger over all moves that were not late, however the input was cut into micro-batches.

State: a balance and the moves of a key within the watermark's delay, as bytes. A key's timer wakes it when the watermark
passes its first waiting move, so balances go out without further moves of that key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A waiting move: microseconds, id, signed quantity.
MOVE = np.dtype([("ts", "<i8"), ("move_id", "<i8"), ("signed", "<f8")])
STATE = "balance double, waiting binary"
#: Seconds: a time no watermark reaches, early in the year 2200; pandas ends in 2262.
NEVER = 7_258_118_400
#: Stands for the watermark before there is one: nothing is late yet.
FIRST = -(1 << 62)


def clamped(start: float, signed: np.ndarray) -> np.ndarray:
    """Balances after each of some signed quantities, never below 0: running sums less the smallest so far, if negative."""
    running = start + np.cumsum(signed)
    return running - np.minimum(np.minimum.accumulate(running), 0.0)


def applied(balance: float, waiting: np.ndarray, upto: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(balance, what still waits, moves up to a time in order, balances after them)."""
    now = waiting["ts"] <= upto
    ready = np.sort(waiting[now], order=["ts", "move_id"])
    after = clamped(balance, ready["signed"])
    return (float(after[-1]) if len(after) else balance), waiting[~now], ready, after


def stream_ledger(moves: DataFrame, keys: list[str], delay: str = "10 seconds") -> DataFrame:
    """(keys, ts, move_id, balance, late): each move once, with the balance after it, or late and without one.

    moves: a stream of (keys, ts, move_id, is_purchase, quantity). Append mode. Moves of one key with equal (ts, move_id)
    are all applied. Null keys are a key. Rows without ts have no place in time: they are given out as late.
    """
    kinds = dict(moves.dtypes)
    signed = F.when(F.col("is_purchase"), F.col("quantity")).otherwise(-F.col("quantity")).cast("double")
    # Spark keeps rows from the function whose event time is behind the watermark. They are to be counted by key, so the
    # column that is marked as event time here lies beyond any watermark, and the moves' own time is a plain column.
    never = F.timestamp_seconds(F.lit(NEVER)).alias("clock", metadata={"spark.watermarkDelayMs": 0})
    rows = moves.withWatermark("ts", delay).select(*keys, F.unix_micros("ts").alias("at"), F.col("move_id").cast("long").alias("move_id"), signed.alias("signed"), never)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, held = state.get if state.exists else (0.0, b"")
        waiting, late = [np.frombuffer(held, MOVE)], []
        mark = state.getCurrentWatermarkMs() * 1000 or FIRST
        for pdf in batches:
            on_time = (pdf["at"] > mark).to_numpy(dtype=bool, na_value=False) if len(pdf) else np.zeros(0, bool)
            fresh = pdf[on_time]
            new = np.empty(len(fresh), MOVE)
            new["ts"], new["move_id"], new["signed"] = fresh["at"], fresh["move_id"], fresh["signed"]
            waiting.append(new)
            late.append(pdf[~on_time])
        balance, rest, ready, after = applied(balance, np.concatenate(waiting), mark)
        state.update((balance, rest.tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["ts"].min()) // 1000, mark // 1000, 0) + 1)
        done = pd.DataFrame({"at": ready["ts"], "move_id": ready["move_id"], "balance": after, "late": False})
        dropped = pd.concat([pd.DataFrame({"at": x["at"], "move_id": x["move_id"], "balance": np.nan, "late": True}) for x in late]) if late else done[:0]
        for out in (done, dropped):
            if len(out):
                yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "at", "move_id", "balance", "late"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at long, move_id long, balance double, late boolean"
    out = rows.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, F.timestamp_micros("at").alias("ts"), "move_id", F.when(~F.col("late"), F.col("balance")).alias("balance"), "late")


def latest_balances(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, balance, ts, n_late) from a written ledger."""
    last = F.max(F.when(~F.col("late"), F.struct("ts", "move_id", "balance"))).alias("m")
    return ledger.groupBy(*keys).agg(last, F.count_if("late").alias("n_late")).select(*keys, "m.balance", "m.ts", "n_late")
