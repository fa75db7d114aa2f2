"""Team inventory views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.sources.tables import Tables


def _held(t: Tables) -> DataFrame:
    p = t.products.select(F.col("id").alias("pid"), F.col("name").alias("product_name"), "description", "price",
                          "category")
    inv = t.team_inventory.filter(F.col("quantity") > 0)
    return inv.join(p, inv.product_id == p.pid).drop("pid")


def team_inventory(t: Tables) -> DataFrame:
    """Roll-up per team and product: total quantity, entries, last obtained; by category, name.

    The entries are rolled up before the products' texts are joined; equal product rows count as often as they are there.
    """
    g = t.team_inventory.filter(F.col("quantity") > 0).groupBy("team_id", "product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.count_distinct("id").cast("bigint").alias("entries_count"),
        F.max("created_at").alias("last_obtained"),
    )
    p = t.products.groupBy(F.col("id").alias("pid"), F.col("name").alias("product_name"), "description", "price", "category").agg(
        F.count(F.lit(1)).alias("times"))
    return g.join(p, g.product_id == p.pid).select(
        "team_id", "product_id", "product_name", "description", "price", "category",
        (F.col("quantity") * F.col("times")).cast("bigint").alias("total_quantity"), "entries_count", "last_obtained",
    ).orderBy("team_id", "category", "product_name", "product_id")


def inventory_summary(t: Tables) -> DataFrame:
    """Per team: items held, product types, value at current prices, distinct categories.

    A product has one category, so both distinct counts are plain counts after grouping by (team, category, product)
    and (team, category).
    """
    products = _held(t).groupBy("team_id", "category", "product_id").agg(
        F.sum("quantity").alias("items"), F.sum(F.col("quantity") * F.col("price")).alias("value"))
    categories = products.groupBy("team_id", "category").agg(
        F.sum("items").alias("items"), F.sum("value").alias("value"), F.count("product_id").alias("types"))
    return categories.groupBy("team_id").agg(
        F.sum("items").cast("bigint").alias("total_items"),
        F.sum("types").cast("bigint").alias("product_types"),
        F.sum("value").cast("bigint").alias("total_value"),
        F.count("category").cast("bigint").alias("category_count"),
    )


def inventory_history(t: Tables) -> DataFrame:
    """Inventory entries with product name, price and value, newest first."""
    h = _held(t)
    return h.select("id", "team_id", "product_id", "quantity", "obtained_from", "reference_id", "created_at",
                    "product_name", "price", (F.col("quantity") * F.col("price")).alias("total_value")
                    ).orderBy("team_id", F.desc("created_at"), F.desc("id"))
