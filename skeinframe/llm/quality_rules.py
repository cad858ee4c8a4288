"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Measures. Every whole text gets word, symbol, line and repetition counts (`with_measures`), per row and without a shuffle.

Thresholds. Each rule rejects a document whose ratio is above a cutoff. The rules go together: level j of a fixed ladder
holds one cutoff for each rule, and each level is stricter than the one before in all of them. Labelled documents that
pass the base rules are split by a hash of their text (so copies stay together): a third chooses, the rest is the holdout.
By stratum (lang), the first part names the level that rejects most of its bad documents (quality = 0), of equal ones the
loosest, among those that reject no more than `risk` of its good ones (quality = 1); if none rejects a bad one, the
strictest of them.
The holdout certifies: of its n good documents, k would be rejected at a level by any rule. The hypothesis "more than
`risk` of good documents are rejected" is dismissed at the exact binomial tail P(Bin(n, risk) <= k), the test behind the
Clopper-Pearson bound. Along the ladder, from loose to the chosen level, levels are taken while each is dismissed at
delta / strata: fixed-sequence testing within a stratum, Bonferroni between strata. So with probability 1 - delta all
strata at once lose at most `risk` of their good documents. A stratum without enough labels for the first level (60 to 90
good ones in the holdout) has only the base rules.

Base rules (too short, too repetitive) are fixed and stand apart.

Cases. Null text: no words, so base_failed. Null lang: a stratum of its own. Labels are joined on doc_id; a doc_id with
several labels is good if any says so; labels without a document, null ids and other qualities count for nothing. Rows that share a
doc_id are measured each. No labels or empty tables: all rules off, no rows. Extra columns are dropped by `verdicts` and
kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Names given to working columns; they don't clash with a table's own.
P = "__q_"


def c(name: str) -> Column:
    return F.col(P + name)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and its measures, as columns named with the prefix P. All columns of docs stay.

    Repeated 8-word windows are found within a row in O(n log n): hashes are sorted with their places, equal neighbours
    are repeats, and the words they cover are added up as a union of intervals. Rows without a repeat skip all of it.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = [F.col(f"`{x}`") for x in docs.columns]
    words = docs.select(*keep, F.filter(F.split(body, SPACE), lambda w: w != "").alias(P + "words"), F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias(P + "lines"))
    slots = F.when(F.size(c("words")) >= WINDOW, F.sequence(F.lit(1), F.size(c("words")) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    counted = words.select(
        *keep,
        F.size(c("words")).cast("long").alias(P + "n_words"),
        F.length(F.array_join(c("words"), "")).cast("long").alias(P + "word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias(P + "n_symbols"),
        F.regexp_count(body, F.lit(r"[!A-Z]")).cast("long").alias(P + "n_loud"),
        F.size(c("lines")).cast("long").alias(P + "n_lines"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(P + "n_dup_lines"),
        F.transform(slots, lambda i: F.xxhash64(F.slice(c("words"), i, WINDOW))).alias(P + "windows"),
    )
    measured = [c(x) for x in ("n_words", "word_chars", "n_symbols", "n_loud", "n_lines", "n_dup_lines")]
    repeats = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    placed = F.when(repeats, F.array_sort(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ordered = counted.select(*keep, *measured, placed.alias(P + "placed"))
    same = lambda x, at: F.coalesce(F.get(c("placed"), at).getField("h") == x.getField("h"), F.lit(False))
    twice = F.transform(F.filter(c("placed"), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.getField("i"))
    found = ordered.select(*keep, *measured, F.array_sort(twice).alias(P + "starts"))
    cover = F.aggregate(
        c("starts"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")),
        lambda a, s: F.struct((a["n"] + (s + WINDOW) - F.greatest(s, a["end"])).cast("long").alias("n"), (s + WINDOW).cast("int").alias("end")),
        lambda a: a["n"],
    )
    # inline() stands between the measures and later filters: a filter pushed below would work the arrays out anew
    return found.select(*keep, F.inline(F.array(F.struct(*measured, cover.alias(P + "n_repeat_words")))))


def base_failed() -> Column:
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def ratios() -> dict[str, Column]:
    """What the rules look at: higher is worse."""
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "symbols": c("n_symbols") / words,
        "loud": c("n_loud") / F.greatest(c("word_chars"), F.lit(1)),
        "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
        "repeats": c("n_repeat_words") / words,
        "word_length": c("word_chars") / words,
    }


#: The ladder: cutoffs by level, from loose to strict. It is fixed beforehand: one taken from the labelled data would spoil the test.
GRIDS = {
    "symbols": [2.0, 1.5, 1.2, 1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "loud": [0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2],
    "dup_lines": [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35],
    "repeats": [0.3, 0.29, 0.28, 0.27, 0.26, 0.25, 0.24, 0.23, 0.22, 0.21, 0.2, 0.19],
    "word_length": [40.0, 36.0, 32.0, 30.0, 28.0, 26.0, 24.0, 22.0, 20.0, 18.0, 17.0, 16.0],
}
LEVELS = len(GRIDS["symbols"])


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series at x + 8; the error is below 1e-11."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + F.lit(float(i)))
    return series - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p (1 is returned above): the k-th term times a falling series.

    The series is followed until its terms are below exp(-72) of the first, as they fall like exp(-d^2 / 2 n p).
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_term = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(nd * p) + 50)).cast("int")
    terms = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(
        terms,
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (kd - j) * (1 - p) / ((nd - kd + j + 1) * p)).alias("t"), (a["s"] + a["t"] * (kd - j) * (1 - p) / ((nd - kd + j + 1) * p)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(kd > nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_term) * series))


def stratum(column: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


#: Up to so many labels are broadcast, so that only labelled texts are measured for the test.
MOST_LABELS = 2_000_000
#: One text of so many is used to choose a level; the others are the holdout.
CHOOSING = 3


def chooses(text: Column) -> Column:
    """True for texts of the part that chooses a level, false for the holdout."""
    return F.pmod(F.xxhash64(F.lit("holdout"), text), F.lit(CHOOSING)) == 0


def certified_levels(docs: DataFrame, labels: DataFrame, strata: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, level, n_good, n_rejected, p_value, n_bad, n_bad_rejected), the certified level of each stratum that has one.

    All counts are those of the holdout. Only numbers are shuffled: measures are taken where texts are read. The result
    has a row for each stratum.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).groupBy("id").agg(F.max("quality").alias("quality"))
    known = cut(known.where("quality IN (0, 1) AND id IS NOT NULL").select("id", (F.col("quality") == 1).alias("good")))
    few = known.count() <= MOST_LABELS
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), stratum(strata).alias("stratum"), chooses(text).alias("chooses"), text.alias("text"))
    if few:
        plain = plain.join(F.broadcast(known), "id")
    rows = with_measures(plain).where(~base_failed()).select("id", "stratum", "chooses", *(["good"] if few else []), *[v.alias(k) for k, v in ratios().items()])
    if not few:
        rows = rows.join(known, "id")
    # how many levels reject a document: those from LEVELS - n on, as cutoffs fall along the ladder
    over = F.greatest(*[sum((F.col(rule) > x).cast("int") for x in grid) for rule, grid in GRIDS.items()])
    counts = rows.groupBy("stratum", "chooses", "good", over.alias("over")).agg(F.count("*").alias("n"))
    by_stratum = counts.groupBy("stratum").agg(F.collect_list(F.struct("chooses", "good", "over", "n")).alias("bins"))  # 52 bins at most

    def total(choosing: bool, good: bool, from_level: Column | None = None) -> Column:
        held = lambda b: (b["chooses"] == choosing) & (b["good"] == good) & (F.lit(True) if from_level is None else b["over"] >= LEVELS - from_level)
        return F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(held(b), b["n"]).otherwise(F.lit(0)))

    level = F.col("level")
    tested = by_stratum.select("stratum", "bins", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")).select(
        "stratum",
        "level",
        (total(True, True, level) <= F.lit(risk) * total(True, True)).alias("allowed"),
        total(True, False, level).alias("caught"),
        total(False, True).alias("n_good"),
        total(False, True, level).alias("n_rejected"),
        total(False, False).alias("n_bad"),
        total(False, False, level).alias("n_bad_rejected"),
    )
    tested = tested.withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk))
    one = F.lit(1)
    number = by_stratum.agg(F.count("*").alias("strata")).withColumn("one", one)  # one row
    tests = tested.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("level", "n_good", "n_rejected", "p_value", "n_bad", "n_bad_rejected", "allowed", "caught"))).alias("tests"))
    tests = tests.withColumn("one", one).join(F.broadcast(number), "one")
    allowed = F.filter("tests", lambda t: t["allowed"])
    catching = F.filter(allowed, lambda t: t["caught"] > 0)
    best = F.array_max(F.transform(catching, lambda t: F.struct(t["caught"].alias("caught"), (-t["level"]).alias("loose"))))
    chosen = F.coalesce(-best["loose"], F.array_max(F.transform(allowed, lambda t: t["level"])))
    failed = F.filter("tests", lambda t: t["p_value"] > F.lit(delta) / F.col("strata"))
    certified = F.when(F.size(failed) > 0, F.get(failed, F.lit(0))["level"]).otherwise(F.size("tests")) - 1
    last = F.when(F.size(allowed) > 0, F.least(certified, chosen)).otherwise(-1)
    return tests.where(last >= 0).select("stratum", F.inline(F.array(F.get("tests", last)))).drop("allowed", "caught")


def certified_cutoffs(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, p_value): certified_levels() rule by rule."""
    cutoffs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*map(F.lit, grid)).alias("grid")) for r, grid in GRIDS.items()]))
    return certified_levels(docs, labels, **options).withColumn("r", cutoffs).select("stratum", "r.rule", F.get("r.grid", F.col("level")).alias("cutoff"), "n_good", "n_rejected", "p_value")


#: More strata than this are joined by a shuffle instead of a broadcast.
MOST_STRATA = 10_000


def judged(docs: DataFrame, labels: DataFrame, strata: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """All columns of docs, the measures, and P + "base_failed" and P + "kept"."""
    levels = certified_levels(docs, labels, strata, risk, delta)
    cutoffs = cut(levels.select(F.col("stratum").alias(P + "stratum"), *[F.get(F.array(*map(F.lit, grid)), F.col("level")).alias(f"{P}cut_{r}") for r, grid in GRIDS.items()]))
    if cutoffs.count() <= MOST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    rows = with_measures(docs).withColumn(P + "stratum", stratum(strata)).join(cutoffs, P + "stratum", "left")
    above = [F.coalesce(value > c(f"cut_{rule}"), F.lit(False)) for rule, value in ratios().items()]
    rejected = above[0]
    for x in above[1:]:
        rejected = rejected | x
    return rows.withColumn(P + "base_failed", base_failed()).withColumn(P + "kept", ~c("base_failed") & ~rejected)


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each document."""
    rows = judged(docs.select("doc_id", "text", "lang"), labels, **options)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[c(x).alias(x) for x in (*MEASURES, "base_failed", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judged(docs, labels, **options).where(c("kept")).select(*[F.col(f"`{x}`") for x in docs.columns])
