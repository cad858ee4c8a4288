"""Near colours by a grid over Lab, exact for CIEDE2000 and for the hue-weighted distance.

Threads lie in cells of L_STEP x AB_STEP x AB_STEP. A colour first gets an upper bound of its n-th best distance from n threads
of the nearest occupied cells. Threads that could be as near lie in a box around it, whose cells are joined by equality.

How far. With S_L = 1 + .015 (L-50)^2 / sqrt(20 + (L-50)^2) <= 1.7471 a difference in L alone gives dE >= |dL| / 1.7471. The
rotation term is at most sqrt(3) in size, so the terms of chroma and hue together are at least (1 - sqrt(3)/2) times the sum of
their squares. Their divisors are at most 1 + .045 C', C' the mean chroma after the stretch of a, and that stretch adds at most
6.5 to a chroma (its largest value is 6.37, near 17). dC'^2 + dH'^2 is the squared distance in the plane of the stretched a
and b, at least da^2 + db^2. With d that distance and c the colour's chroma, the mean chroma is at most c + d/2 + 6.5, so
dE >= .366 d / (1.2925 + .045 c + .0225 d), solved below for d. The weighted distance is at least dL^2 + .49 (da^2 + db^2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinframe.functions.color import lab_chroma
from skeinframe.operators.threads import small

L_STEP, AB_STEP = 10, 20
#: Cells of either axis; what lies outside counts to the last ones.
L_CELLS, AB_CELLS = (0, 9), (-6, 5)
#: Farther than any two colours in L, a or b.
FAR = 1000.0
CELL = ("cell_l", "cell_a", "cell_b")
#: Against rounding.
SLACK = 1e-6

Distance = Callable[[DataFrame, str, str, str], DataFrame]
Reach = Callable[[Column, Column], tuple[Column, Column]]


def ciede_reach(u: Column, lab: Column) -> tuple[Column, Column]:
    """(in L, in a and b): how far a colour within dE u can be."""
    k = u / (1 - 3**0.5 / 2) ** 0.5
    d = k * (1.2925 + 0.045 * lab_chroma(lab)) / F.when(k < 40, 1 - 0.0225 * k)
    return 1.7472 * u + SLACK, F.coalesce(d, F.lit(FAR)) + SLACK


def weighted_reach(u: Column, lab: Column) -> tuple[Column, Column]:
    return F.sqrt(u) + SLACK, F.sqrt(u) / 0.7 + SLACK


def _cell(x: Column, step: int, ends: tuple[int, int]) -> Column:
    return F.greatest(F.lit(ends[0]), F.least(F.lit(ends[1]), F.floor(x / step).cast("int")))


def with_cell(df: DataFrame, lab: str) -> DataFrame:
    """df with its cell; a null colour has none."""
    parts = ((CELL[0], "l", L_STEP, L_CELLS), (CELL[1], "a", AB_STEP, AB_CELLS), (CELL[2], "b", AB_STEP, AB_CELLS))
    return df.withColumns({name: F.when(F.col(lab).isNotNull(), _cell(F.col(lab)[k], step, ends)) for name, k, step, ends in parts})


def near(left: DataFrame, right: DataFrame, on: list[str], lab: str, reach_l: Column, reach_ab: Column) -> DataFrame:
    """Pairs of left and right in which right's `right_lab` is in left's box. right: a palette, with columns `on` and others."""
    box = {"cell_l": (lab + ".l", L_STEP, L_CELLS, reach_l), "cell_a": (lab + ".a", AB_STEP, AB_CELLS, reach_ab), "cell_b": (lab + ".b", AB_STEP, AB_CELLS, reach_ab)}
    rows = left
    for name, (at, step, ends, reach) in box.items():
        rows = rows.withColumn(name, F.explode(F.sequence(_cell(F.col(at) - reach, step, ends), _cell(F.col(at) + reach, step, ends))))
    return rows.join(small(with_cell(right, "right_lab")), [*on, *CELL]).drop(*CELL)


def bounded(left: DataFrame, right: DataFrame, on: list[str], lab: str, distance: Distance, n: int) -> DataFrame:
    """left (distinct rows) with `bound`, which at least n of right's colours (of the same `on`) don't exceed; null where it
    has fewer cells.

    The distances of one thread of each of the nearest occupied cells are compared. Cells are few (1440 at most for each
    `on`), so these are found cell by cell.
    """
    named = with_cell(right, "right_lab").groupBy(*on, *CELL).agg(F.min("right_lab").alias("right_lab"))
    wanted = with_cell(left, lab).select(*on, *[F.col(c).alias(f"at_{c}") for c in CELL]).where("at_cell_l IS NOT NULL").distinct()
    gap = sum((F.col(c) - F.col(f"at_{c}")) * (F.col(c) - F.col(f"at_{c}")) * (1 if c == "cell_l" else 4) for c in CELL)
    pairs = wanted.join(F.broadcast(named), on if on else F.lit(True)).select(*on, *[f"at_{c}" for c in CELL], F.struct(gap.alias("gap"), *CELL, "right_lab").alias("x"))
    best = pairs.groupBy(*on, *[f"at_{c}" for c in CELL]).agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, 3 * n + 5), lambda x: x["right_lab"]).alias("some"))
    best = best.select(*on, *[F.col(f"at_{c}").alias(c) for c in CELL], "some")
    rows = with_cell(left, lab).join(F.broadcast(best), [*on, *CELL], "left").drop(*CELL)
    rows = distance(rows.select(*left.columns, F.explode_outer("some").alias("other")), lab, "other", "bound")
    return rows.groupBy(*left.columns).agg(F.get(F.array_sort(F.collect_list("bound")), F.lit(n - 1)).alias("bound"))


def candidates(left: DataFrame, right: DataFrame, on: list[str], lab: str, distance: Distance, reach: Reach, n: int) -> DataFrame:
    """Pairs with `distance`, among them for each row of left the n nearest of right: no farther than the row's bound."""
    rows = bounded(left, right, on, lab, distance, n)
    reach_l, reach_ab = (F.coalesce(x, F.lit(FAR)) for x in reach(F.col("bound"), F.col(lab)))
    pairs = distance(near(rows, right, on, lab, reach_l, reach_ab), lab, "right_lab", "distance")
    return pairs.where(F.col("bound").isNull() | (F.col("distance") <= F.col("bound") + SLACK)).drop("bound")
