"""Threads, thread quantities and palette checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinframe.functions.color import hex_digits, hex_to_lab, lab_chroma, rgb_to_lab
from skeinframe.functions.text import baseline_rate, ceil_safe, literal_map, normalise_code

# Provenances, from least to most trusted.
PROVENANCE = ["unverified", "screen-estimate", "retailer-web", "manufacturer-web", "manufacturer-card", "measured"]
TRUSTED = "manufacturer-card"
#: The threads dimension is small by nature; a larger one is joined without a broadcast hint.
MOST_BROADCAST = 100_000


def small(table: DataFrame) -> DataFrame:
    """table with a broadcast hint if it has at most MOST_BROADCAST rows."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def rank(provenance: Column) -> Column:
    return literal_map({p: i for i, p in enumerate(PROVENANCE)}, "map<string,int>")[provenance]


def search_threads(threads: DataFrame, query: str) -> DataFrame:
    """Rows with the trimmed query in name, code or family, whatever the case; all rows for a blank one."""
    wanted = query.strip().lower()
    if not wanted:
        return threads
    found = [F.lower(c).contains(wanted) for c in ("name", "code", "family")]
    return threads.where(found[0] | found[1] | found[2])


def matchable_shades(shades: DataFrame, available: DataFrame | None = None, trusted_only: bool = False, include_sentinel: bool = False, include_discontinued: bool = False) -> DataFrame:
    """Shades a colour may be matched to, with their lab.

    available (brand_id, code): brands listed there keep only the listed codes, whatever the other options say.
    """
    rows = shades.withColumn("norm_code", normalise_code(F.col("code")))
    if available is not None:
        listed = available.select("brand_id", normalise_code(F.col("code")).alias("norm_code")).distinct()
        brands = listed.select("brand_id").distinct().withColumn("limited", F.lit(True))
        rows = rows.join(listed.withColumn("listed", F.lit(True)), ["brand_id", "norm_code"], "left").join(brands, "brand_id", "left").where("limited IS NULL OR listed").drop("limited", "listed")
    if not include_sentinel:
        rows = rows.where(~F.coalesce("sentinel", F.lit(False)))
    if not include_discontinued:
        rows = rows.where(~F.coalesce("discontinued", F.lit(False)))
    if trusted_only:
        rows = rows.where(rank(F.col("provenance")) >= PROVENANCE.index(TRUSTED))
    return rows.withColumn("lab", F.coalesce("lab", hex_to_lab(F.col("hex")))).where("lab IS NOT NULL").drop("norm_code")


def default_product(brand: Column, mesh: Column, override: Column | None = None) -> Column:
    """The product of a brand for a mesh; an override counts only if it belongs to the brand."""
    plain = F.when(brand == "appletons", F.when(mesh <= 12, "appletons-tapestry").otherwise("appletons-crewel")).when(brand == "dmc", F.when(mesh >= 16, "dmc-perle-5").otherwise("dmc-perle-3"))
    if override is None:
        return plain
    return F.when(override.startswith(F.concat(brand, F.lit("-"))), override).otherwise(plain)


def _strands_generic(mesh: Column) -> tuple[Column, Column]:
    low = F.when(mesh >= 18, 2.0).when(mesh >= 13, 3.0).when(mesh >= 10, 4.0).otherwise(5.0)
    high = F.when(mesh >= 18, 4.0).when(mesh >= 13, 4.0).when(mesh >= 10, 6.0).otherwise(8.0)
    return low, high


def thread_needs(lines: DataFrame, products: DataFrame, coverage: DataFrame, guidance: DataFrame, stitch: str = "basketweave", safety: bool = False) -> DataFrame:
    """lines (product, mesh, cell_count, optional strands_used) with yards and units, or an error in place of them.

    A null product is a generic divisible thread of unknown unit size. The three tables are small and broadcast.
    """
    rows = lines if "strands_used" in lines.columns else lines.withColumn("strands_used", F.lit(None).cast("double"))
    rows = rows.join(F.broadcast(products), "product", "left").join(F.broadcast(coverage), ["product", "mesh"], "left").join(F.broadcast(guidance), ["product", "mesh"], "left")
    generic = F.col("product").isNull()
    low, high = _strands_generic(F.col("mesh"))
    rows = rows.withColumns({
        "base": baseline_rate(F.col("mesh"), safety),
        "low": F.when(generic, low).otherwise(F.col("min_strands")),
        "high": F.when(generic, high).otherwise(F.col("max_strands")),
        "divisible": generic | (F.col("strand_type") == "divisible"),
    })
    given = F.col("strands_used").isNotNull()
    guided = F.col("divisible") & ~given
    error = (
        F.when(~generic & F.col("strand_type").isNull(), F.concat(F.lit("unknown product "), F.col("product")))
        .when(guided & ~generic & F.col("kind").isNull(), F.concat(F.lit("no strand guidance for "), F.col("product_name"), F.lit(" at "), F.col("mesh").cast("string"), F.lit(" mesh")))
        .when(guided & (F.col("kind") == "not-appropriate"), F.concat(F.col("product_name"), F.lit(" is not appropriate for "), F.col("mesh").cast("string"), F.lit(" mesh")))
    )
    middle = (F.col("low") + F.col("high")) / 2
    tabulated = F.col("sq_in_per_unit").isNotNull() & F.col("yards_per_unit").isNotNull()
    rate = F.when(F.col("divisible"), F.col("base.rate") * F.coalesce("strands_used", middle)).when(tabulated, F.col("yards_per_unit") / F.col("sq_in_per_unit")).otherwise(F.col("base.rate"))
    factor = 0.75 if stitch == "continental" else 1.0
    rows = rows.withColumn("error", error).withColumn("sq_inches", F.col("cell_count") / (F.col("mesh") * F.col("mesh")))
    rows = rows.withColumn("yards", F.when(F.col("error").isNull(), F.col("sq_inches") * rate * factor))
    spans = guided & (F.col("high") > F.col("low"))
    units = lambda y: F.when(F.col("yards_per_unit").isNull() | y.isNull(), F.lit(None).cast("long")).when((y > 0) & (F.col("yards_per_unit") > 0), ceil_safe(y / F.col("yards_per_unit")).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({
        "yards_min": F.when(spans, F.col("yards") * F.col("low") / middle).otherwise(F.col("yards")),
        "yards_max": F.when(spans, F.col("yards") * F.col("high") / middle).otherwise(F.col("yards")),
        "has_range": spans & F.col("error").isNull(),
    })
    rows = rows.withColumns({"units": units(F.col("yards")), "units_min": units(F.col("yards_min")), "units_max": units(F.col("yards_max")), "rate_from": F.when(F.col("divisible") | ~tabulated, F.col("base.provenance")).otherwise("tabulated")})
    return rows.withColumn("blurb", order_blurb(stitch)).drop("base", "low", "high", "divisible", "kind", "min_strands", "max_strands", "sq_in_per_unit", "strand_type")


def order_blurb(stitch: str) -> Column:
    """A note where the span of strands changes how many units to order; else null."""
    ending = {
        "decorative": "Decorative stitches use more: take the upper figure as the least.",
        "continental": "This is for continental stitch; basketweave needs about a third more.",
    }.get(stitch, "This is for basketweave; continental needs about a third less.")
    why = F.when(F.col("range_reason") == "tension", "Strands depend on your tension").otherwise("Guidance for this thread is not confirmed")
    span = F.format_string(" (%s-%s strands at %s mesh), so order %s to %s units. ", F.col("low").cast("int").cast("string"), F.col("high").cast("int").cast("string"), F.col("mesh").cast("string"), F.col("units_min").cast("string"), F.col("units_max").cast("string"))
    return F.when(F.col("has_range") & (F.col("units_max") > F.col("units_min")), F.concat(why, span, F.lit(ending)))


def shopping_summary(needs: DataFrame) -> DataFrame:
    """(design_id, total_yards, total_units, unresolved): units of resolved lines; ids of lines without a unit count, sorted.

    A total over different colours is a size of the order, not something to buy.
    """
    open_ = F.col("units").isNull()
    return needs.groupBy("design_id").agg(
        F.coalesce(F.sum("yards"), F.lit(0.0)).alias("total_yards"), F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("total_units"),
        F.array_sort(F.collect_list(F.when(open_, F.col("colour_id")))).alias("unresolved"),
    )


def requirement_rows(needs: DataFrame) -> DataFrame:
    """(design_id, user_id, brand, code, need_min, need_max, unit) of resolved lines, for a stash."""
    return needs.where("units IS NOT NULL").select("design_id", "user_id", "brand", "code", F.col("units_min").alias("need_min"), F.col("units_max").alias("need_max"), F.lit("skein").alias("unit"))


def mixed_brands(colours: DataFrame) -> DataFrame:
    """(design_id, brands) of designs whose colours (design_id, brand) come from more than one brand."""
    return colours.groupBy("design_id").agg(F.array_sort(F.collect_set("brand")).alias("brands")).where(F.size("brands") > 1)


def thread_families(threads: DataFrame) -> DataFrame:
    """(brand, family, hue, chroma, min_l, max_l): circular mean hue over shades of chroma above 3, null without any."""
    rows = threads.withColumn("lab", rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("c", lab_chroma(F.col("lab")))
    vivid = F.col("c") > 3
    part = lambda k: F.sum(F.when(vivid, F.col(f"lab.{k}") / F.col("c")))
    out = rows.groupBy("brand", "family").agg(part("a").alias("cos"), part("b").alias("sin"), F.avg("c").alias("chroma"), F.min("lab.l").alias("min_l"), F.max("lab.l").alias("max_l"))
    return out.select("brand", "family", F.when(F.col("cos").isNotNull(), F.pmod(F.degrees(F.atan2("sin", "cos")) + 360, F.lit(360.0))).alias("hue"), "chroma", "min_l", "max_l")


def palette_issues(shades: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand_id, level, code, check) rows.

    shades (brand_id, code, hex, lab, provenance, sentinel, discontinued); brands (brand_id, expected_count, available
    array<string>), one row for each listed brand, so that a brand listed twice shows.
    """
    s = shades.withColumn("norm", normalise_code(F.col("code")))
    row = lambda df, level, check, code=None: df.select("brand_id", F.lit(level).alias("level"), (code if code is not None else F.lit(None).cast("string")).alias("code"), F.lit(check).alias("check"))
    code = F.col("code")
    has_code = F.coalesce(F.trim("code"), F.lit("")) != ""
    counts = shades.groupBy("brand_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("sentinel", F.lit(False))).alias("sentinels"))
    known = brands.dropDuplicates(["brand_id"])
    sized = known.join(counts, "brand_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = known.where("available IS NOT NULL").select("brand_id", F.explode_outer("available").alias("listed")).withColumn("norm", normalise_code(F.col("listed")))
    missing = listed.where("norm IS NOT NULL").join(s.select("brand_id", "norm").distinct(), ["brand_id", "norm"], "left_anti")
    usable = listed.join(s.select("brand_id", "norm"), ["brand_id", "norm"]).select("brand_id").distinct()
    checks = [
        row(brands.where("trim(coalesce(brand_id, '')) = ''"), "error", "no brand id"),
        row(brands.groupBy("brand_id").count().where("count > 1"), "error", "duplicate brand"),
        row(sized.where("n = 0"), "error", "no shades"),
        row(shades.where(~has_code), "error", "no code"),
        row(shades.where("hex IS NULL AND lab IS NULL"), "error", "no colour", code),
        row(shades.where(F.col("hex").isNotNull() & hex_digits(F.col("hex")).isNull()), "error", "bad hex", code),
        row(shades.where("provenance IS NULL"), "error", "no provenance", code),
        row(shades.where(rank(F.col("provenance")) < PROVENANCE.index(TRUSTED)), "warning", "below trust", code),
        row(shades.where(has_code).groupBy("brand_id", "code").count().where("count > 1"), "error", "duplicate code", code),
        row(counts.where("sentinels > 1"), "error", "several sentinels"),
        row(missing, "error", "available code without shade", F.col("listed")),
        row(known.where("available IS NOT NULL").join(usable, "brand_id", "left_anti"), "error", "all excluded"),
        row(sized.where("expected_count IS NOT NULL AND expected_count <> n"), "warning", "unexpected count"),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def palette_report(shades: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand_id, shades, trusted, trusted_fraction, ok) for each brand, and overall with a null brand_id."""
    trusted = (rank(F.col("provenance")) >= PROVENANCE.index(TRUSTED)).cast("int")
    sums = shades.groupBy("brand_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(trusted, F.lit(0))).alias("t"))
    errors = palette_issues(shades, brands).where("level = 'error'").groupBy("brand_id").agg(F.count("*").alias("errors"))
    rows = brands.select("brand_id").distinct().join(sums, "brand_id", "left").join(errors, "brand_id", "left").fillna(0, ["n", "t", "errors"])
    out = rows.rollup("brand_id").agg(F.sum("n").alias("shades"), F.sum("t").alias("trusted"), (F.sum("errors") == 0).alias("ok"))
    return out.select("brand_id", "shades", "trusted", F.when(F.col("shades") > 0, F.col("trusted") / F.col("shades")).otherwise(0.0).alias("trusted_fraction"), "ok")


def palette_disclaimer(shades: DataFrame) -> DataFrame:
    """(brand_id, weakest): the least trusted provenance of a brand's current shades."""
    current = shades.where(~F.coalesce("discontinued", F.lit(False)))
    return current.groupBy("brand_id").agg(F.min_by("provenance", rank(F.col("provenance"))).alias("weakest"))


def palette_code_diff(available: DataFrame, shades: DataFrame) -> DataFrame:
    """(brand_id, code, side): normalised codes only offered ('missing') or only in the palette ('not-offered')."""
    a = available.select("brand_id", normalise_code(F.col("code")).alias("code"))
    b = shades.select("brand_id", normalise_code(F.col("code")).alias("code"))
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("not-offered")))
