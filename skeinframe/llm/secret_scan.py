"""Secret scan: fixed patterns, and a battery of randomness tests with length-aware false-discovery control. DataFrame only.

Patterns (assign, access, hex) are found in whole texts, leftmost and not overlapping within a kind. Positions come from
the pieces between matches: split() and regexp_extract_all() with one pattern cut a text the same way.

Battery. Runs of 20 or more of A-Za-z0-9+/_- outside pattern spans are candidates. The encoding is inferred (hex, base32,
base64 or base64url) and symbols become their codes in its alphabet of k. Three tests of "codes are uniform and
independent": chi-squared over the alphabet, z_c = (X2 - (k-1)) / sqrt(2 (k-1) (n-1) / n), upper side only; Wald-Wolfowitz
runs of the upper and lower half, z_r; serial correlation at lag one, z_s. The statistic is the root of the sum of their
squares: small for random strings, large for words, paths and counters.

False discoveries. What ordinary text scores is taken from the corpus: every distinct text, without pattern spans and
candidates, is cut end to end into stretches of its letters and digits, of each class's length in turn, and so each class
has its own null distribution that grows with the input. Copies count once. A candidate's p-value is the share of its class's null at or below its statistic, weighted by length
(longer strings tell more). Benjamini-Hochberg over all candidates at level `fdr` sets one cutoff a class. Statistics
are counted in steps of 1/8, rounded against the candidate, so only (class, step) counts are shuffled.

Cases. Null text: as empty. Null or repeated doc_id: rows are scanned each. No candidates or empty tables: no cutoffs,
no random spans. Texts are never cut; offsets count code points, ends exclusive. Extra columns are dropped by `scan` and
kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = "__s_"
KINDS = ("assign", "access", "hex", "random")
# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: First lengths of the classes.
CLASSES = (20, 28, 40, 56, 80)
#: Statistics are counted in this many steps of 1/8.
STEPS = 160
#: Strings shorter than this have their squared counts folded in one number; longer ones, which might not fit, in a struct.
PACKED = 1 << 18
HEX_LOWER, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def c(name: str) -> Column:
    return F.col(P + name)


def matches(text: Column, pattern: str, gate: Column, rank: int, group: int = 0) -> tuple[Column, Column, Column]:
    """Arrays of the pieces between matches, of the matches, and of a group of each; empty where the gate is false."""
    none = F.array().cast("array<string>")
    regex = F.lit(pattern)
    return (
        F.when(gate, F.split(text, pattern, -1)).otherwise(none),
        F.when(gate, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none),
        F.when(gate, F.regexp_extract_all(text, regex, F.lit(group))).otherwise(none),
    )


def placed(name: str, rank: int) -> Column:
    """Spans from the columns that matches() made under a name."""
    pieces, found = c(f"{name}_pieces"), c(f"{name}_found")
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        begin = (acc["at"] + F.length(F.get(pieces, i))).cast("int")
        end = (begin + F.length(F.get(found, i))).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), F.lit(rank).cast("int").alias("rank"), end.alias("end")))).alias("spans"))

    places = F.sequence(F.lit(0), F.size(found) - 1)
    return F.when(F.size(found) > 0, F.aggregate(places, start, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN))


def codes(token: Column) -> Column:
    """A token's symbols as codes in its inferred alphabet, with the alphabet's size in front."""
    chars = F.split(F.translate(token, "-_", "+/"), "")
    lower = F.split(F.lower(token), "")
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.concat(F.array(F.lit(16)), F.transform(lower, lambda x: F.instr(F.lit(HEX_LOWER), x) - 1)))
        .when(token.rlike("^[A-Z2-7]+$"), F.concat(F.array(F.lit(32)), F.transform(chars, lambda x: F.instr(F.lit(BASE32), x) - 1)))
        .otherwise(F.concat(F.array(F.lit(64)), F.transform(chars, lambda x: F.instr(F.lit(BASE64), x) - 1)))
    )


def battery(coded: Column) -> Column:
    """The statistic of an array of codes as codes() makes it."""
    k = coded[0].cast("double")
    v = F.slice(coded, 2, F.size(coded) - 1)
    n = (F.size(coded) - 1).cast("double")
    zero = F.lit(0).cast("long")
    whole = lambda x: F.lit(x).cast("long")
    low = lambda a, mask: a.bitwiseAND(whole(mask))
    # The folds carry one number, not a struct: several times cheaper, as structs are made anew for each symbol.
    # squares: the j-th of equal sorted codes adds 2 j - 1; sum << 25, equal ones so far << 7, last code + 1
    packed = F.aggregate(
        F.sort_array(v),
        zero,
        lambda a, x: F.when(low(a, 127) == x + 1, a + F.shiftleft(2 * low(F.shiftright(a, 7), PACKED - 1) + 1, 25) + 128).otherwise(F.shiftleft(F.shiftright(a, 25) + 1, 25) + 129 + x),
        lambda a: F.shiftright(a, 25),
    )
    wide = F.aggregate(
        F.sort_array(v),
        F.struct(F.lit(-1).alias("last"), zero.alias("run"), zero.alias("sum")),
        lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(whole(1)).alias("run"), (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(whole(1))).alias("sum")),
        lambda a: a["sum"],
    )
    squares = F.when(F.size(v) < PACKED, packed).otherwise(wide)
    z_c = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    rest = F.transform(F.array(F.struct(z_c.alias("z_c"), (coded[0] / 2).cast("int").alias("half"), v.alias("v"))), lambda y: after_chi_squared(y, n, coded))
    return F.get(rest, 0)


def after_chi_squared(y: Column, n: Column, coded: Column) -> Column:
    """battery()'s struct. The sums are left out where chi-squared alone says the last step, which they can't lower."""
    v, half = y["v"], y["half"]
    zero = F.lit(0).cast("long")
    odd = lambda a: a.bitwiseAND(F.lit(1).cast("long")) == 1
    # changes of half << 1, the last code's half
    changes = F.aggregate(
        v,
        F.when(coded[1] >= half, zero + 1).otherwise(zero),
        lambda a, x: F.when(x >= half, F.when(odd(a), a).otherwise(a + 3)).otherwise(F.when(odd(a), a + 1).otherwise(a)),
        lambda a: F.shiftright(a, 1),
    )
    # products of neighbours << 7, last code
    products = F.aggregate(v, zero, lambda a, x: F.shiftleft(F.shiftright(a, 7) + a.bitwiseAND(F.lit(127).cast("long")) * x, 7) + x, lambda a: F.shiftright(a, 7))
    sums = F.struct(
        F.size(F.filter(v, lambda x: x >= half)).alias("up"), (changes + 1).alias("runs"),
        F.aggregate(v, zero, lambda a, x: a + x).alias("s"), F.aggregate(v, zero, lambda a, x: a + x * x).alias("ss"), products.alias("sx"),
    )
    sums = F.when(y["z_c"] < STEPS / 8, sums)
    return F.struct(y["z_c"].alias("z_c"), n.alias("n"), sums.alias("t"), coded[1].cast("double").alias("first"), F.element_at(coded, -1).cast("double").alias("last"))


def statistic(b: Column) -> Column:
    """From battery(): the root of the sum of squares; strings of one half of the alphabet count as not random.

    Where chi-squared alone says the last step, it stands for the root.
    """
    n, t = b["n"], b["t"]
    up = t["up"].cast("double")
    down = n - up
    mean_runs = 2 * up * down / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_r = (t["runs"] - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-9)))
    m = t["s"] / n
    spread = t["ss"] - n * m * m
    r = (t["sx"] - m * (2 * t["s"] - b["first"] - b["last"]) + (n - 1) * m * m) / F.greatest(spread, F.lit(1e-9))
    z_s = (r + 1 / n) * F.sqrt(n)
    z_c = F.greatest(b["z_c"], F.lit(0.0))
    return F.when(t.isNull(), z_c).when((var_runs > 0) & (spread > 0), F.sqrt(z_c * z_c + z_r * z_r + z_s * z_s)).otherwise(F.lit(1e3))


def step_of(value: Column) -> Column:
    return F.least(F.ceil(value * 8), F.lit(STEPS)).cast("int")


def class_of(length: Column) -> Column:
    return sum((length >= x).cast("int") for x in CLASSES[1:])


def may_assign(text: Column) -> Column:
    """False only where no assign pattern can match: a cheap search for its words."""
    low = F.lower(text)
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs, P + "base" (pattern spans) and P + "cands" (candidates: start, end, class, step)."""
    text = c("text")
    keep = [F.col(f"`{x}`") for x in docs.columns]
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(P + "text"))
    gates = {
        "assign": (ASSIGN, may_assign(text), 2),
        "access": (ACCESS, text.contains("AKIA"), 0),
        "hex": (HEX, text.rlike("[0-9a-f]{24}"), 0),
        "random": (CANDIDATE, text.rlike("[A-Za-z0-9+/_-]{20}"), 0),
    }
    cut = []
    for rank, (name, (pattern, gate, group)) in enumerate(gates.items()):
        pieces, found, inner = matches(text, pattern, gate, rank, group)
        cut += [pieces.alias(f"{P}{name}_pieces"), found.alias(f"{P}{name}_found")] + ([inner.alias(f"{P}{name}_inner")] if group else [])
    rows = rows.select(*keep, *cut)
    assign = F.filter(placed("assign", 0), lambda s, i: F.length(F.get(c("assign_inner"), i)) >= 6)
    rows = rows.select(*keep, F.concat(assign, placed("access", 1), placed("hex", 2)).alias(P + "base"), placed("random", 3).alias(P + "runs"), c("random_found"))
    free = lambda s: ~F.exists(c("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.select(*keep, c("base"), F.filter(F.arrays_zip(c("runs").alias("s"), c("random_found").alias("t")), lambda z: free(z["s"])).alias(P + "free"))
    rows = rows.select(*keep, c("base"), F.transform(c("free"), lambda z: F.struct(z["s"].alias("s"), codes(z["t"]).alias("codes"))).alias(P + "coded"))
    rows = rows.select(*keep, c("base"), F.transform(c("coded"), lambda z: F.struct(z["s"].alias("s"), battery(z["codes"]).alias("b"))).alias(P + "tested"))
    cands = F.transform(c("tested"), lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), class_of(z["s"]["end"] - z["s"]["start"]).alias("cls"), step_of(statistic(z["b"])).alias("step")))
    # inline(): see quality_rules.py
    return rows.select(*keep, F.inline(F.array(F.struct(F.array_sort(c("base")).alias(P + "base"), cands.alias(P + "cands")))))


def null_steps(docs: DataFrame) -> DataFrame:
    """(cls, step, n) of ordinary text: how many stretches of each class have a step.

    Each distinct text, without pattern spans and candidates, is cut end to end into stretches of its letters and digits, of
    20, 28, 40, 56 and 80 in turn; each character counts once, and what is left at the end counts if it has one of these lengths. A text's steps are worked out in its row, as small numbers;
    what is shuffled to count copies once are these and 128 bits of the text's hash, not texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text, F.length(text)).alias("k"), text.alias("t"))
    # pattern spans and candidates are what is tested
    plain = F.when(may_assign(F.col("t")), F.regexp_replace("t", ASSIGN, " ")).otherwise(F.col("t"))
    rows = rows.select("h", "k", plain.alias("t"))
    # candidates are the pieces of 20 symbols and more; the rest is joined, letters and digits only. \w (ASCII) is a seventh
    # of the time of the same class as ranges
    short = F.array_join(F.filter(F.split("t", r"[^\w+/-]+"), lambda w: F.length(w) < CLASSES[0]), "")
    for symbol in "+/_-":
        short = F.replace(short, F.lit(symbol), F.lit(""))
    rows = rows.select("h", "k", short.alias("t"))
    turn = sum(CLASSES)
    rows = rows.select("h", "k", F.regexp_extract_all("t", F.lit(f".{{1,{turn}}}"), F.lit(0)).alias("turns"))
    starts = [sum(CLASSES[:i]) + 1 for i in range(len(CLASSES))]
    cut = F.flatten(F.transform("turns", lambda c: F.array(*[F.substring(c, a, n) for a, n in zip(starts, CLASSES, strict=True)])))
    coded = F.transform(F.filter(cut, lambda x: F.length(x).isin(*CLASSES)), codes)
    steps = F.transform(F.transform(coded, battery), lambda b: (class_of(b["n"]) * (STEPS + 1) + step_of(statistic(b))).cast("smallint"))
    once = rows.select("h", "k", steps.alias("steps")).groupBy("h", "k").agg(F.first("steps").alias("steps"))
    counts = once.select(F.explode_outer("steps").alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))
    return counts.select(F.floor(F.col("code") / (STEPS + 1)).cast("int").alias("cls"), (F.col("code") % (STEPS + 1)).cast("int").alias("step"), "n")


def cutoffs(found: DataFrame, docs: DataFrame, fdr: float) -> dict[int, int]:
    """The largest step that counts as random, by class. found: with_spans(docs); at most classes * steps rows move."""
    cands = found.select(F.explode_outer(P + "cands").alias("x")).where("x IS NOT NULL").groupBy("x.cls", "x.step").agg(F.count("*").alias("n"))
    null = null_steps(docs)
    both = cands.select("cls", "step", F.col("n").alias("n"), F.lit(0).cast("long").alias("n0")).unionByName(null.select("cls", "step", F.lit(0).cast("long").alias("n"), F.col("n").alias("n0")))
    counts: dict[int, dict[int, list[int]]] = {}
    for r in both.groupBy("cls", "step").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0")).collect():  # at most len(CLASSES) * STEPS rows
        counts.setdefault(r.cls, {})[r.step] = [r.n, r.n0]
    total = {k: [sum(x) for x in zip(*v.values(), strict=True)] for k, v in counts.items()}
    m = sum(t[0] for t in total.values())
    if not m:
        return {}
    mean = sum(CLASSES[k] * t[0] for k, t in total.items()) / m
    steps = []
    for k, v in counts.items():
        below = 0
        for s in sorted(v):
            below += v[s][1]
            steps.append(((1 + below) / (1 + total[k][1]) * mean / CLASSES[k], k, s, v[s][0]))
    taken, best = 0, -1.0
    for p, _, _, n in sorted(steps):
        taken += n
        if n and p * m <= fdr * taken:
            best = p
    return {k: max(s for p, j, s, _ in steps if j == k and p <= best) for k in {j for p, j, _, _ in steps if p <= best}}


def all_spans(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """docs, P + "base" and P + "all": spans (start, rank of the kind, end), sorted."""
    rows = with_spans(docs)
    limits = cutoffs(with_spans(docs.select("text")), docs.select("text"), fdr)

    def random(x: Column) -> Column:
        most = F.lit(-1)
        for k, s in sorted(limits.items()):
            most = F.when(x["cls"] == k, F.lit(s)).otherwise(most)
        return x["step"] <= most

    more = F.transform(F.filter(c("cands"), random), lambda x: F.struct(x["start"].alias("start"), F.lit(3).cast("int").alias("rank"), x["end"].alias("end")))
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns], c("base"), F.array_sort(F.concat(c("base"), more)).alias(P + "all"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    rows = all_spans(docs.select("doc_id", "text"), fdr)
    count = lambda rank: F.size(F.filter(c("base"), lambda s: s["rank"] == rank)).cast("long")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(c("base")), 256).alias("base_sha256"), written(c("all")).alias("spans"),
    )


MASK = "[SECRET]"


def redact(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """docs with each secret's span (overlapping ones together) as MASK; n_chars, if there, follows the text."""
    rows = all_spans(docs, fdr)
    text = F.col("text").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at"))

    def step(a: Column, s: Column) -> Column:
        more = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MASK))).otherwise(a["out"])
        return F.struct(more.alias("out"), F.greatest(a["at"], s["end"]).cast("int").alias("at"))

    clean = F.aggregate(c("all"), start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    new = F.when(F.size(c("all")) > 0, clean).otherwise(text)
    rows = rows.withColumn(P + "clean", new)
    changed = F.size(c("all")) > 0
    columns = {"text": c("clean"), "n_chars": F.when(changed, F.length(c("clean"))).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(columns[x].cast(docs.schema[x].dataType).alias(x) if columns.get(x) is not None else F.col(f"`{x}`")) for x in docs.columns])
