"""Whose rows, the latest ones, orders, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible_rows(df: DataFrame, user: object, shared: bool = False, brand: str | None = None) -> DataFrame:
    """Rows of user; with shared, also those of nobody, and `owner` mine or preloaded."""
    mine = F.col("user_id") == F.lit(user)
    rows = df.where(mine | F.col("user_id").isNull()).withColumn("owner", F.when(mine, "mine").otherwise("preloaded")) if shared else df.where(mine)
    return rows.where(F.col("brand") == brand) if brand is not None else rows


def latest(df: DataFrame, n: int, at: str, tie: str, by: str = "user_id") -> DataFrame:
    """The n newest rows of each user, ties by falling `tie`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("place", place).where(F.col("place") <= n)


def latest_overall(df: DataFrame, n: int, at: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def order_report(orders: DataFrame, designs: DataFrame) -> DataFrame:
    """Orders with their design's name or "Deleted design"; size, mesh and brand from order_details where it is there."""
    rows = orders.join(designs.select("design_id", F.col("name").alias("design_name")), "design_id", "left")
    detail = {k: F.get_json_object("order_details", f"$.{k}") for k in ("width", "height", "mesh", "brand")} if "order_details" in orders.columns else {}
    return rows.withColumns({"design_name": F.coalesce("design_name", F.lit("Deleted design")), **detail})


def blocked_deletes(designs: DataFrame, orders: DataFrame) -> DataFrame:
    """designs with `blocked`: an order refers to them, so they can't be deleted."""
    used = orders.select("design_id").distinct().withColumn("blocked", F.lit(True))
    return designs.join(used, "design_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
