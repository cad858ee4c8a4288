"""Charts, threads, stashes and images as views over the general test tables, and the same views in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (table, filter, {column: expression}); the expressions hold in Spark and, with VARCHAR for STRING, in DuckDB.
PLAIN = {
    "cells": (
        "orders",
        None,
        {
            "chart_id": "CAST(FLOOR(o_orderkey / 400) AS BIGINT)",
            "idx": "o_orderkey % 400",
            "y": "CAST(FLOOR((o_orderkey % 400) / 20) AS INT)",
            "x": "CAST(o_orderkey % 20 AS INT)",
            "pal_idx": "CASE WHEN o_custkey % 10 < 6 THEN 0 WHEN o_custkey % 10 < 9 THEN 1 ELSE 2 END",
        },
    ),
    "threads": (
        "part",
        None,
        {
            "brand": "lower(p_brand)",
            "code": "CAST(p_partkey AS STRING)",
            "name": "p_name",
            "family": "p_type",
            "r": "CAST((p_partkey * 53 + 17) % 256 AS INT)",
            "g": "CAST((p_partkey * 101 + 71) % 256 AS INT)",
            "b": "CAST((p_partkey * 197 + 29) % 256 AS INT)",
            "pos": "p_partkey",
        },
    ),
    "designs": (
        "orders",
        None,
        {
            "design_id": "o_orderkey",
            "user_id": "o_custkey",
            "brand": "CASE WHEN o_orderkey % 2 = 0 THEN 'appletons' ELSE 'dmc' END",
            "mesh": "CASE o_orderkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 13 WHEN 3 THEN 14 ELSE 18 END",
            "updated_at": "o_orderdate",
        },
    ),
    "order_rows": (
        "orders",
        None,
        {
            "order_id": "o_orderkey",
            "design_id": "o_orderkey + (o_custkey % 3) * 7",
            "user_id": "o_custkey",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'cancelled' END",
            "created_at": "o_orderdate",
        },
    ),
    "marks": (
        "events",
        None,
        {"mark_id": "event_id", "ts": "ts", "design_id": "user_id", "idx": "CAST(FLOOR(value) AS BIGINT) % 400", "done": "event_type <> 'error'"},
    ),
    "moves": (
        "events",
        None,
        {"move_id": "event_id", "ts": "ts", "user_id": "user_id", "is_purchase": "event_type IN ('purchase', 'signup')", "quantity": "CAST(FLOOR(value / 10) AS BIGINT)"},
    ),
    "ratings": (
        "labels",
        None,
        {"doc_id": "doc_id", "verdict": "CASE WHEN quality = 1 AND toxic = 0 THEN 'Perfect' WHEN quality = 1 THEN 'Minor' WHEN toxic = 0 THEN 'Poor' ELSE 'Unusable' END"},
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in PLAIN:
        source, where, columns = PLAIN[name]
        rows = table(spark, sf_dir, source)
        return (rows.where(where) if where else rows).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    if name == "stash":
        lines = table(spark, sf_dir, "lineitem").where("l_quantity < 25").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        return lines.selectExpr(*[f"{e} AS {c}" for c, e in STASH.items()])
    if name == "usage":
        return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS design_id", "l_partkey % 24 AS pal_idx", "l_quantity").groupBy("design_id", "pal_idx").agg((F.sum("l_quantity").cast("long") * 20).alias("cell_count"))
    if name == "pixels":
        rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "explode(sequence(0, 63)) AS pos")
        channel = "CAST(FLOOR(128 + 240 * CAST(embedding[{}] AS DOUBLE)) AS INT)".format
        return rows.selectExpr("vec_id AS image_id", "CAST(pos AS BIGINT) AS idx", "CAST(FLOOR(pos / 8) AS INT) AS y", "CAST(pos % 8 AS INT) AS x", f"{channel('pos')} AS r", f"{channel('CAST(pos * 7 % 64 AS INT)')} AS g", f"{channel('CAST(pos * 13 % 64 AS INT)')} AS b")
    raise KeyError(name)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same rows as a stream, for views of one table; ts as an instant, which event time has to be."""
    source, where, columns = PLAIN[name]
    # a stream's path is a folder or a pattern; this one fits the table whether it is one file or a folder of files
    rows = spark.readStream.schema(table(spark, sf_dir, source).schema).parquet(f"{sf_dir}/{source}.parque[t]")
    return (rows.where(where) if where else rows).selectExpr(*[f"CAST({e} AS TIMESTAMP) AS ts" if c == "ts" else f"{e} AS {c}" for c, e in columns.items()])


STASH = {
    "user_id": "l_suppkey",
    "brand": "lower(p_brand)",
    "code": "CAST(l_partkey AS STRING)",
    "quantity": "l_quantity / 10",
    "unit": "CASE l_returnflag WHEN 'A' THEN 'skein' WHEN 'N' THEN 'card' ELSE 'hank' END",
}

SQL = {
    name: "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in columns.items()) + f" FROM {source}" for name, (source, _, columns) in PLAIN.items()
} | {
    "stash": "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in STASH.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 25",
    "usage": "SELECT l_orderkey AS design_id, l_partkey % 24 AS pal_idx, CAST(SUM(l_quantity) AS BIGINT) * 20 AS cell_count FROM lineitem GROUP BY l_orderkey, l_partkey % 24",
    "pixels": "SELECT vec_id AS image_id, CAST(pos AS BIGINT) AS idx, CAST(FLOOR(pos / 8) AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(FLOOR(128 + 240 * CAST(embedding[pos+1] AS DOUBLE)) AS INT) AS r, CAST(FLOOR(128 + 240 * CAST(embedding[pos*7%64+1] AS DOUBLE)) AS INT) AS g, CAST(FLOOR(128 + 240 * CAST(embedding[pos*13%64+1] AS DOUBLE)) AS INT) AS b FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings)",
}


def with_views(sql: str, *names: str) -> str:
    """sql with the named views in front as WITH clauses (sql may go on with `, more AS (...)`)."""
    return "WITH " + ", ".join(f"v_{n} AS ({SQL[n]})" for n in names) + sql
