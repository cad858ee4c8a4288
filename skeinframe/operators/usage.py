"""Stitches by colour: usage lines, counts from runs, legends, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOT_STITCHABLE = "__NOT_STITCHABLE__"
# Glyphs that stay legible when small, in order of preference.
GLYPHS = list("ABCDEFGHJKLMNPQRSTUVWXYZ2345679abcdefghkmnpqrstuwy+=/\\#%&@*<>~^!?")


def usage_lines(charts: DataFrame, exclude: tuple[str, ...] = (NOT_STITCHABLE,)) -> DataFrame:
    """(chart_id, id, label, count) for (chart_id, palette array<struct<id,name>>, usage map<string,bigint>).

    A usage key is a palette index, or where the palette has no such entry the id itself. Counts of 0 or less and
    excluded ids go. The palette is looked up in the row, so nothing is shuffled.
    """
    rows = charts.select("chart_id", "palette", F.explode("usage").alias("key", "count"))
    entry = F.get("palette", F.col("key").try_cast("int"))
    return rows.select("chart_id", F.coalesce(entry["id"], F.col("key")).alias("id"), entry["name"].alias("label"), "count").where((F.col("count") > 0) & ~F.col("id").isin(*exclude))


def usage_counts(charts: DataFrame) -> DataFrame:
    """(chart_id, pal_idx, cell_count) straight from runs (chart_id, runs), without making cells."""
    runs = charts.select("chart_id", F.explode("runs").alias("r"))
    return runs.groupBy("chart_id", F.col("r")[0].alias("pal_idx")).agg(F.sum(F.col("r")[1].cast("long")).alias("cell_count"))


def assign_symbols(palette: DataFrame, pool: list[str] = GLYPHS, sentinel: str = NOT_STITCHABLE) -> DataFrame:
    """(chart_id, pal_idx, symbol) for (chart_id, pal_idx, code, symbol).

    The first colour to claim a symbol keeps it; the k-th free colour gets the k-th glyph nobody keeps, and after these
    {1}, {2}, ... The sentinel gets none.
    """
    rows = palette.withColumn("out", F.col("code") == sentinel).withColumn("wish", F.when(~F.col("out") & (F.col("symbol") != ""), F.col("symbol")))
    first = F.row_number().over(Window.partitionBy("chart_id", "wish").orderBy("pal_idx")) == 1
    rows = rows.withColumn("kept", F.when(F.col("wish").isNotNull() & first, F.col("wish")))
    whole = Window.partitionBy("chart_id")
    rows = rows.withColumn("used", F.collect_set("kept").over(whole))
    free = F.col("kept").isNull() & ~F.col("out")
    rows = rows.withColumn("k", F.sum(free.cast("int")).over(whole.orderBy("pal_idx").rowsBetween(Window.unboundedPreceding, 0)))
    glyphs = F.array_except(F.array(*map(F.lit, pool)), F.col("used"))
    numbered = F.array_except(F.transform(F.sequence(F.lit(1), F.col("k") + F.size("used")), lambda n: F.format_string("{%d}", n)), F.col("used"))
    more = F.get(numbered, F.col("k") - F.size(glyphs) - 1)
    symbol = F.when(F.col("out"), "").when(~free, F.col("kept")).otherwise(F.coalesce(F.get(glyphs, F.col("k") - 1), more))
    return rows.select("chart_id", "pal_idx", symbol.alias("symbol"))


def legend(palette: DataFrame, symbols: DataFrame, usage: DataFrame, sentinel: str = NOT_STITCHABLE) -> DataFrame:
    """(chart_id, place, symbol, code, name, hex, cell_count): most used first, ties in palette order."""
    rows = palette.where(F.col("code") != sentinel).drop("symbol").join(symbols, ["chart_id", "pal_idx"]).join(usage, ["chart_id", "pal_idx"], "left").fillna(0, ["cell_count"])
    place = F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc("cell_count"), "pal_idx"))
    return rows.select("chart_id", place.alias("place"), "symbol", "code", "name", "hex", "cell_count")


def colours_in_selection(cells: DataFrame, selection: DataFrame, value: str = "pal_idx", sentinel: object = NOT_STITCHABLE) -> DataFrame:
    """(chart_id, value, n) of selected cells (chart_id, idx), without the sentinel."""
    inside = cells.where(F.col(value).cast("string") != str(sentinel)).join(selection.select("chart_id", "idx").distinct(), ["chart_id", "idx"], "left_semi")
    return inside.groupBy("chart_id", value).agg(F.count("*").alias("n"))
