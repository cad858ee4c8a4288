"""Charts and progress between their stored forms (runs, arrays, text) and long cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Symbols of a chart's palette entries, in order, reused when they run out.
SYMBOLS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!@#$%^&*+=?<>/\\|~○●□■△▲▽▼◇◆☆★")


def run_spans(runs: Column, total: Column) -> Column:
    """array<struct<pal_idx, start, end>> of runs [[idx, len], ...], cut at `total` cells (end exclusive)."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<pal_idx:int,start:bigint,end:bigint>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        end = F.least(a["at"] + F.greatest(r[1], F.lit(0)), total).cast("long")
        span = F.struct(r[0].cast("int").alias("pal_idx"), a["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(end > a["at"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(runs, start, step, lambda a: a["out"])


def chart_to_cells(charts: DataFrame, strict: bool = False) -> DataFrame:
    """(chart_id, idx, y, x, pal_idx, code) for (chart_id, chart); unknown palette index: empty code.

    Runs beyond width * height are cut. strict adds `error` where the runs don't fill the chart exactly.
    """
    w, h = F.col("chart.width"), F.col("chart.height")
    rows = charts.select("chart_id", w.alias("w"), (w * h).cast("long").alias("total"), F.col("chart.palette").alias("palette"), F.col("chart.pixelsRLE").alias("runs"))
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r[1])
    rows = rows.withColumn("error", F.when(length != F.col("total"), F.format_string("decoded %d cells, not %d", length, "total")))
    spans = rows.select("chart_id", "w", "palette", "error", F.explode(run_spans(F.col("runs"), F.col("total"))).alias("s"))
    cells = spans.select("chart_id", "w", "error", F.col("s.pal_idx").alias("pal_idx"), F.coalesce(F.get("palette", F.col("s.pal_idx"))["id"], F.lit("")).alias("code"), F.explode(F.sequence("s.start", F.col("s.end") - 1)).alias("idx"))
    out = ["chart_id", "idx", F.floor(F.col("idx") / F.col("w")).cast("int").alias("y"), (F.col("idx") % F.col("w")).cast("int").alias("x"), "pal_idx", "code"]
    return cells.select(*out, *(["error"] if strict else []))


def cell_runs(cells: DataFrame, value: str) -> DataFrame:
    """(chart_id, start, value, len): maximal runs of equal values in flat order. One exchange, on chart_id."""
    order = Window.partitionBy("chart_id").orderBy("idx")
    new = (~F.col(value).eqNullSafe(F.lag(value).over(order))) | F.lag("idx").over(order).isNull()
    marked = cells.select("chart_id", "idx", value, new.cast("int").alias("new"))
    numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("chart_id", "run").agg(F.min("idx").alias("start"), F.first(value).alias(value), F.count("*").alias("len")).drop("run")


def cells_to_runs(cells: DataFrame, value: str = "pal_idx") -> DataFrame:
    """(chart_id, runs): [[value, len], ...] in flat order."""
    runs = cell_runs(cells, value)
    ordered = F.array_sort(F.collect_list(F.struct("start", F.array(F.col(value).cast("int"), F.col("len").cast("int")).alias("r"))))
    return runs.groupBy("chart_id").agg(F.transform(ordered, lambda s: s["r"]).alias("runs"))


def cells_to_chart(cells: DataFrame, dims: DataFrame, threads: DataFrame) -> DataFrame:
    """(chart_id, chart, error) for cells (chart_id, idx, code): palette in first-seen order, usage, symbols, sections, runs.

    dims (chart_id, width, height); threads (code, name, family, hex). A code that threads lacks is an error. Sections are
    families ("Other" for null) in first-seen order.
    """
    runs = cell_runs(cells, "code")
    seen = runs.groupBy("chart_id", "code").agg(F.min("start").alias("first"), F.sum("len").alias("n"))
    numbered = seen.withColumn("pal_idx", F.row_number().over(Window.partitionBy("chart_id").orderBy("first")) - 1)
    named = numbered.join(threads.select("code", "name", "family", "hex").dropDuplicates(["code"]), "code", "left").withColumn("missing", F.col("hex").isNull())
    symbols = F.array(*map(F.lit, SYMBOLS))
    entry = F.struct("pal_idx", "code", "name", "family", "hex", "n", F.coalesce("family", F.lit("Other")).alias("section"), "missing")
    palettes = named.groupBy("chart_id").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    pieces = runs.join(numbered.select("chart_id", "code", "pal_idx"), ["chart_id", "code"]).groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("start", F.array("pal_idx", F.col("len").cast("int")).alias("r")))).alias("runs"))
    rows = palettes.join(pieces, "chart_id").join(dims, "chart_id")
    by_index = lambda value: F.map_from_entries(F.transform("p", lambda e: F.struct(e["pal_idx"].cast("string"), value(e))))
    sections = F.transform(F.array_distinct(F.transform("p", lambda e: e["section"])), lambda s: F.struct(s.alias("name"), F.transform(F.filter("p", lambda e: e["section"] == s), lambda e: e["pal_idx"]).alias("paletteIndexes")))
    chart = F.struct(
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        F.transform("p", lambda e: F.struct(e["code"].alias("id"), e["name"].alias("name"), e["family"].alias("family"), e["hex"].alias("hex"))).alias("palette"),
        by_index(lambda e: F.get(symbols, e["pal_idx"] % len(SYMBOLS))).alias("symMap"), by_index(lambda e: e["n"]).alias("usage"),
        sections.alias("sections"), F.transform("runs", lambda s: s["r"]).alias("pixelsRLE"),
    )
    missing = F.transform(F.filter("p", lambda e: e["missing"]), lambda e: e["code"])
    return rows.select("chart_id", chart.alias("chart"), F.when(F.size(missing) > 0, F.concat(F.lit("unknown code "), F.array_join(missing, ", "))).alias("error"))


def corpus_to_cells(grids: DataFrame) -> DataFrame:
    """(label, r, col, val) for (label, gw, grid array<int>)."""
    rows = grids.select("label", "gw", F.posexplode("grid").alias("i", "val"))
    return rows.select("label", F.floor(F.col("i") / F.col("gw")).cast("int").alias("r"), (F.col("i") % F.col("gw")).cast("int").alias("col"), "val")


def motif_cells(motifs: DataFrame) -> DataFrame:
    """(motif_id, row, col, code) for (motif_id, width, height, cells array<array<string>>); ragged motifs are skipped."""
    whole = motifs.where((F.size("cells") == F.col("height")) & F.forall("cells", lambda r: F.size(r) == F.col("width")))
    rows = whole.select("motif_id", F.posexplode("cells").alias("row", "line"))
    return rows.select("motif_id", "row", F.posexplode("line").alias("col", "code"))


def cells_to_motif(selection: DataFrame, sentinel: str) -> DataFrame:
    """(chart_id, width, height, cells) of the bounding box of selected cells (chart_id, y, x, code); gaps get the sentinel."""
    box = selection.groupBy("chart_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.map_from_entries(F.collect_list(F.struct(F.struct("y", "x"), "code"))).alias("codes"))
    line = lambda y: F.transform(F.sequence("x0", "x1"), lambda x: F.coalesce(F.col("codes")[F.struct(y.alias("y"), x.alias("x"))], F.lit(sentinel)))
    return box.select("chart_id", (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"), F.transform(F.sequence("y0", "y1"), line).alias("cells"))


PROGRESS = r"^P1\|(\d+)\|(\d+)\|(\d+(?:\.\d+)*)$"


def decode_progress(designs: DataFrame) -> DataFrame:
    """(design_id, w, h, done array<bigint>, error) for (design_id, stitch_progress): `P1|W|H|r0.r1...`, runs from not done."""
    text = F.col("stitch_progress")
    part = lambda i: F.regexp_extract(text, PROGRESS, i)
    rows = designs.select("design_id", text.rlike(PROGRESS).alias("ok"), part(1).try_cast("long").alias("w"), part(2).try_cast("long").alias("h"), F.transform(F.filter(F.split(part(3), r"\."), lambda s: s != ""), lambda s: s.cast("long")).alias("runs"))
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r)
    error = F.when(~F.coalesce("ok", F.lit(False)), "not a progress text").when(length != F.col("w") * F.col("h"), "runs don't fill the grid")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"), F.lit(False).alias("done"))
    step = lambda a, r: F.struct((a["at"] + r).alias("at"), F.when(a["done"] & (r > 0), F.concat(a["out"], F.sequence(a["at"], a["at"] + r - 1))).otherwise(a["out"]).alias("out"), (~a["done"]).alias("done"))
    rows = rows.withColumn("error", error)
    return rows.select("design_id", "w", "h", F.when(F.col("error").isNull(), F.aggregate("runs", start, step, lambda a: a["out"])).alias("done"), "error")


def encode_progress(done: DataFrame, dims: DataFrame) -> DataFrame:
    """(design_id, stitch_progress, error) for done cells (design_id, idx) and dims (design_id, w, h)."""
    cells = done.select("design_id", "idx").distinct()
    island = cells.withColumn("island", F.col("idx") - F.row_number().over(Window.partitionBy("design_id").orderBy("idx")))
    runs = island.groupBy("design_id", "island").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"))
    per = runs.groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    rows = dims.select("design_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")).join(per, "design_id", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    edges = F.concat(F.flatten(F.transform("runs", lambda r: F.array(r["s"], r["e"]))), F.array(F.col("w") * F.col("h")))
    rows = rows.withColumn("edges", edges)
    lengths = F.filter(F.transform("edges", lambda e, i: F.struct(i.alias("i"), (e - F.when(i > 0, F.get("edges", i - 1)).otherwise(F.lit(0))).alias("n"))), lambda x: (x["n"] > 0) | (x["i"] == 0))
    body = F.array_join(F.transform(lengths, lambda x: x["n"].cast("string")), ".")
    bad = F.exists("runs", lambda r: (r["s"] < 0) | (r["e"] > F.col("w") * F.col("h")))
    return rows.select("design_id", F.when(~bad, F.concat(F.lit("P1|"), F.col("w").cast("string"), F.lit("|"), F.col("h").cast("string"), F.lit("|"), body)).alias("stitch_progress"), F.when(bad, "index out of range").alias("error"))
