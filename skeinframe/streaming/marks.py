"""Progress marks and stash movements, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.operators.stash import HEAVY, same_keys, stash_balances


def expand_marks(marks: DataFrame, dims: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(design_id, idx, ts, mark_id, done) for marks of one cell, a rectangle or a colour.

    marks (design_id, mark_id, ts, done, kind, x0, y0, x1, y1, code): kind cell uses x0, y0; rect takes corners in any
    order and is clamped; code needs cells (design_id, idx, code). dims (design_id, width, height).
    """
    keep = ["design_id", "mark_id", "ts", "done"]
    rows = marks.where("kind IN ('cell', 'rect')").join(dims, "design_id")
    x1, y1 = F.when(F.col("kind") == "cell", F.col("x0")).otherwise(F.col("x1")), F.when(F.col("kind") == "cell", F.col("y0")).otherwise(F.col("y1"))
    rows = rows.withColumns({
        "lx": F.greatest(F.lit(0), F.least(F.col("x0"), x1)), "hx": F.least(F.col("width") - 1, F.greatest(F.col("x0"), x1)),
        "ly": F.greatest(F.lit(0), F.least(F.col("y0"), y1)), "hy": F.least(F.col("height") - 1, F.greatest(F.col("y0"), y1)),
    }).where("lx <= hx AND ly <= hy")
    rows = rows.select(*keep, "width", "lx", "hx", F.explode(F.sequence("ly", "hy")).alias("y")).select(*keep, "width", "y", F.explode(F.sequence("lx", "hx")).alias("x"))
    out = rows.select("design_id", (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("idx"), "ts", "mark_id", "done")
    if cells is not None:
        coded = marks.where("kind = 'code'").select(*keep, "code").join(cells.select("design_id", "idx", "code"), ["design_id", "code"])
        out = out.unionByName(coded.select("design_id", F.col("idx").cast("long").alias("idx"), "ts", "mark_id", "done"))
    return out


def apply_marks(marks: DataFrame) -> DataFrame:
    """(design_id, idx, done, ts, mark_id): the last mark of each cell by (ts, mark_id). marks: cell marks."""
    last = F.max(F.struct("ts", "mark_id", "done")).alias("m")
    return marks.groupBy("design_id", "idx").agg(last).select("design_id", "idx", "m.done", "m.ts", "m.mark_id")


def merge_marks(snapshot: DataFrame, marks: DataFrame) -> DataFrame:
    """A snapshot (design_id, idx, done, ts, mark_id) with more marks; an older mark never undoes a newer one."""
    return apply_marks(snapshot.unionByName(marks.select(*snapshot.columns)))


def autosave(marks: DataFrame, quiet: str = "1500 milliseconds", late: str | None = "10 seconds") -> DataFrame:
    """(design_id, saved_from, saved_at, n_marks, last_idx, last_done): one save for each burst of marks followed by quiet.

    The same on a table and on a stream (append mode; the watermark bounds the state). late=None: ts has a watermark already,
    as after without_repeats, and a query can have only one.
    """
    rows = marks.withWatermark("ts", late) if marks.isStreaming and late is not None else marks
    bursts = rows.groupBy("design_id", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n_marks"), F.max(F.struct("ts", "mark_id", "idx", "done")).alias("m"))
    return bursts.select("design_id", F.col("w.start").alias("saved_from"), F.col("w.end").alias("saved_at"), "n_marks", F.col("m.idx").alias("last_idx"), F.col("m.done").alias("last_done"))


def without_repeats(marks: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Marks once each, by mark_id."""
    return marks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mark_id"]) if marks.isStreaming else marks.dropDuplicates(["mark_id"])


def stash_batch(balances: DataFrame | None, moves: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """(keys, balance, ts, move_id) after a batch of moves (keys, ts, move_id, is_purchase, quantity), on top of earlier ones.

    The clamp at 0 makes order matter: moves that are not after a key's last one by (ts, move_id) are left to late_moves.
    Batches must therefore follow each other in time; ledger.stream_ledger takes disorder within a watermark.
    """
    return stash_balances(moves, keys, ["ts", "move_id"], balances, heavy)


def late_moves(balances: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, late): how many moves of each key are not after its last one, which stash_batch leaves out."""
    last = balances.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("ts", "move_id").alias("__last"))
    return moves.join(last, same_keys(keys)).where(F.struct("ts", "move_id") <= F.col("__last")).groupBy(*keys).agg(F.count("*").alias("late"))
