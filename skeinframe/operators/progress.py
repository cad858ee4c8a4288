"""How much of a chart is stitched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.functions.text import percent
from skeinframe.operators.usage import NOT_STITCHABLE


def _with_done(cells: DataFrame, done: DataFrame, value: str, sentinel: object) -> DataFrame:
    marked = done.select("chart_id", "idx").distinct().withColumn("done", F.lit(True))
    return cells.where(F.col(value).cast("string") != str(sentinel)).join(marked, ["chart_id", "idx"], "left")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count("done").alias("completed"))
    fraction = F.when(F.col("total") == 0, 0.0).otherwise(F.col("completed") / F.col("total"))
    return out.withColumns({"remaining": F.col("total") - F.col("completed"), "fraction": fraction, "percent": percent(F.col("completed"), F.col("total"))})


def progress_stats(cells: DataFrame, done: DataFrame, value: str = "code", sentinel: object = NOT_STITCHABLE) -> DataFrame:
    """(chart_id, total, completed, remaining, fraction, percent) without sentinel cells; a chart of only these has 0 of 0."""
    sums = _sums(_with_done(cells, done, value, sentinel), "chart_id")
    return cells.select("chart_id").distinct().join(sums, "chart_id", "left").fillna(0)


def progress_by_colour(cells: DataFrame, done: DataFrame, value: str = "code", sentinel: object = NOT_STITCHABLE) -> DataFrame:
    """The same by colour; order by remaining, descending, to see what is left."""
    return _sums(_with_done(cells, done, value, sentinel), "chart_id", value)


def progress_status(designs: DataFrame, decoded: DataFrame) -> DataFrame:
    """(design_id, status): ok, needsMigration where saved and current dimensions differ, missing without a saved one.

    designs (design_id, width, height); decoded as decode_progress() gives it.
    """
    saved = decoded.where("error IS NULL").select("design_id", "w", "h")
    rows = designs.select("design_id", "width", "height").join(saved, "design_id", "left")
    same = (F.col("w") == F.col("width")) & (F.col("h") == F.col("height"))
    return rows.select("design_id", F.when(F.col("w").isNull(), "missing").when(same, "ok").otherwise("needsMigration").alias("status"))
