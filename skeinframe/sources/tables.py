"""Reading designs, merging changes, and the fixed product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinframe.functions.text import YARDS_PER_METRE

CHART = (
    "width int, height int, palette array<struct<id:string,name:string,family:string,hex:string>>, symMap map<string,string>, usage map<string,bigint>, "
    "sections array<struct<name:string,paletteIndexes:array<int>>>, pixelsRLE array<array<int>>"
)
DESIGN = "id string, user_id string, name string, chart_data string, design_meta string, stitch_progress string, updated_at timestamp"

# Product, name, yards a unit, strand type.
PRODUCTS = [
    ("essentials-card", "Essentials (card)", 10.0, "single"),
    ("essentials-skein", "Essentials (skein)", 30.0, "single"),
    ("milan-card", "Milan (card)", 10.0, "single"),
    ("milan-skein", "Milan (skein)", 30.0, "single"),
    ("pepper-pot", "Pepper Pot", 30.0, "single"),
    ("planet-earth-silk", "Planet Earth Silk", 30.0, "single"),
    ("silk-and-ivory", "Silk & Ivory", 28.8, "single"),
    ("vineyard-silk-classic", "Vineyard Silk Classic", 30.0, "single"),
    ("dmc-perle-3", "DMC Pearl Cotton #3 (15m skein)", 15 * YARDS_PER_METRE, "single"),
    ("dmc-perle-5", "DMC Pearl Cotton #5 (25m skein)", 25 * YARDS_PER_METRE, "single"),
    ("appletons-crewel", "Appletons Crewel Wool", 25 * YARDS_PER_METRE, "divisible"),
    ("appletons-tapestry", "Appletons Tapestry Wool", 10 * YARDS_PER_METRE, "divisible"),
]
# Product, mesh, square inches a unit covers.
COVERAGE = [
    ("essentials-card", 18, 4.0), ("essentials-skein", 18, 16.0), ("milan-card", 13, 5.0), ("milan-skein", 13, 20.0), ("pepper-pot", 13, 20.0), ("pepper-pot", 18, 15.0),
    ("planet-earth-silk", 13, 20.0), ("silk-and-ivory", 13, 20.0), ("silk-and-ivory", 14, 19.0), ("silk-and-ivory", 16, 17.0), ("silk-and-ivory", 18, 15.0),
]
# Product, mesh, kind, fewest and most strands, why a range.
GUIDANCE = [
    ("appletons-crewel", 12, "strands", 3.0, 4.0, "tension"),
    ("appletons-crewel", 13, "strands", 3.0, 4.0, None),
    ("appletons-crewel", 14, "strands", 2.0, 3.0, "tension"),
    ("appletons-crewel", 18, "strands", 2.0, 2.0, None),
    ("appletons-tapestry", 10, "strands", 1.0, 1.0, None),
    ("appletons-tapestry", 12, "strands", 1.0, 1.0, None),
    ("appletons-tapestry", 13, "strands", 1.0, 1.0, None),
    ("appletons-tapestry", 14, "not-appropriate", None, None, None),
    ("appletons-tapestry", 18, "not-appropriate", None, None, None),
]


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, "product string, product_name string, yards_per_unit double, strand_type string")


def coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COVERAGE, "product string, mesh int, sq_in_per_unit double")


def guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GUIDANCE, "product string, mesh int, kind string, min_strands double, max_strands double, range_reason string")


def parse_designs(rows: DataFrame) -> DataFrame:
    """Typed charts: `chart` (null where chart_data is no chart) beside the other columns."""
    return rows.withColumn("chart", F.from_json("chart_data", CHART)).drop("chart_data")


def read_designs(spark: SparkSession, path: str, source: str = "parquet", **options: str) -> DataFrame:
    """Design rows with typed charts, from parquet, json or jdbc; the schema is given, never inferred."""
    reader = spark.read.format(source).options(**options)
    return parse_designs((reader if source == "jdbc" else reader.schema(DESIGN)).load(*([path] if path else [])))


def read_designs_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """Designs of a database table in `parts` ranges of a number, date or timestamp column, each read by a task of its own.

    column is spelt as the database has it.
    The ends come from one aggregate that the database answers; rows outside or null go to the first and last range. Filters
    and column choices on the result are part of the database's query.
    """
    given = options | {"url": url}
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = spark.read.format("jdbc").options(**given, query=f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}").load().first()
    reader = spark.read.format("jdbc").options(**given, dbtable=table)
    if ends[0] is not None and ends[0] < ends[1]:
        reader = reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts))
    rows = reader.load()
    return parse_designs(rows.withColumnsRenamed({c: c.lower() for c in rows.columns}))


def merge_rows(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """base with changed rows replaced, new ones added, and those flagged in column `deleted` dropped. Null keys are equal."""
    same = [base[k].eqNullSafe(changes[k]) for k in keys]
    both = same[0]
    for x in same[1:]:
        both = both & x
    kept = base.join(changes, both, "left_anti")
    new = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
    return kept.unionByName(new)
