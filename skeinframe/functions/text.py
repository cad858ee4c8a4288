"""Keys, codes, units and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YARDS_PER_METRE = 1 / 0.9144

# Codes that name the same thread in different lists.
CODE_ALIASES = {"WHITE": "BLANC", "BLANC": "BLANC", "ECRU": "ECRU", "SNOW WHITE": "B5200"}

# Single-strand basketweave rates in metres a square inch by mesh.
SOURCED_RATES = {10: 1.0, 13: 1.3, 18: 2.0}
DERIVED_RATES = {12: 1.2, 14: 1.44}
FALLBACK_RATE = 1.75
SAFETY_RATE = 2.0

# Units of stash lines.
UNITS = ("skein", "card", "hank", "spool")


def literal_map(values: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]).cast(kind)


def stash_key(brand: Column, code: Column) -> Column:
    return F.concat(F.lower(F.trim(brand)), F.lit("::"), F.lower(F.trim(code)))


def normalise_code(code: Column) -> Column:
    """Upper case and trimmed; aliases resolved; all-digit codes without leading zeros, at least "0"."""
    bare = F.upper(F.trim(code))
    alias = literal_map(CODE_ALIASES, "map<string,string>")[bare]
    digits = F.regexp_replace(bare, "^0+(?=.)", "")
    return F.coalesce(alias, F.when(bare.rlike("^[0-9]+$"), digits).otherwise(bare))


def to_unit(text: Column) -> Column:
    return F.when(text.isin(*UNITS), text).otherwise(F.lit("skein"))


def ceil_safe(x: Column) -> Column:
    """Ceiling that forgives what binary fractions add to a whole number."""
    return F.ceil(x - 1e-9)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), for negative numbers too."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """To one decimal; 0 of 0 is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / whole * 1000 + 0.5) / 10)


def baseline_rate(mesh: Column, safety: bool = False) -> Column:
    """struct(rate, provenance): yards of single strand a square inch."""
    if safety:
        return F.struct(F.lit(SAFETY_RATE).alias("rate"), F.lit("sourced").alias("provenance"))
    by_mesh = lambda table: literal_map({k: v * YARDS_PER_METRE for k, v in table.items()}, "map<int,double>")[mesh.cast("int")]
    sourced, derived = by_mesh(SOURCED_RATES), by_mesh(DERIVED_RATES)
    return F.struct(
        F.coalesce(sourced, derived, F.lit(FALLBACK_RATE)).alias("rate"),
        F.when(sourced.isNotNull(), "sourced").when(derived.isNotNull(), "derived").otherwise("fallback").alias("provenance"),
    )
