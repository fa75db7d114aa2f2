"""Order board and order listings.

The admin board merges purchases and donations, two unlike row shapes, with
``unionByName(allowMissingColumns=True)`` in one plan and sorts once: newest
first, purchases before donations at equal times, then id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.schemas import RECEIVED_DONATIONS_SHOWN
from coffer.sources.tables import Tables


def _type_rank():
    return F.when(F.col("type") == "purchase", 0).otherwise(1)


def _purchases(t: Tables) -> DataFrame:
    u = t.users.select(F.col("id").alias("uid"), "username")
    tm = t.teams.select(F.col("id").alias("tid"), F.col("name").alias("team_name"))
    p = t.products.select(F.col("id").alias("pid"), F.col("name").alias("product_name"))
    o = t.orders
    return (o.join(u, o.user_id == u.uid).join(tm, o.team_id == tm.tid).join(p, o.product_id == p.pid)
            .select(o["*"], "username", "team_name", "product_name", F.lit("purchase").alias("type")))


def _donation_rows(t: Tables) -> DataFrame:
    d = t.donations
    u = t.users.select(F.col("id").alias("uid"), "username")
    dt = t.teams.select(F.col("id").alias("dtid"), F.col("name").alias("team_name"))
    rt = t.teams.select(F.col("id").alias("rtid"), F.col("name").alias("recipient_team_name"))
    p = t.products.select(F.col("id").alias("pid"), F.col("name").alias("product_name"))
    j = (d.join(u, d.donor_id == u.uid).join(dt, d.donor_team_id == dt.dtid)
         .join(rt, d.recipient_team_id == rt.rtid).join(p, d.product_id == p.pid))
    return j.select(
        "id", "created_at", "username", "team_name", "product_name", "quantity",
        F.col("amount").alias("total_price"), F.lit("verified").alias("status"), F.lit(True).alias("verified"),
        "recipient_team_name", "message", F.lit("donation").alias("type"))


def admin_orders(t: Tables) -> DataFrame:
    """Purchases and donations on one board, newest first; at equal times purchases come first."""
    merged = _purchases(t).unionByName(_donation_rows(t), allowMissingColumns=True)
    return merged.orderBy(F.desc("created_at"), _type_rank(), F.desc("id"))


def order_board_summary(t: Tables) -> DataFrame:
    """Whole board: pending (= not verified, cancelled included), verified, total sales."""
    m = _purchases(t).unionByName(_donation_rows(t), allowMissingColumns=True)
    return m.agg(
        F.count_if(~F.col("verified")).cast("bigint").alias("pending_count"),
        F.count_if(F.col("verified")).cast("bigint").alias("verified_count"),
        F.coalesce(F.sum("total_price"), F.lit(0)).cast("bigint").alias("total_sales"),
    )


def _orders_with_product(t: Tables) -> DataFrame:
    p = t.products.select(F.col("id").alias("pid"), F.col("name").alias("product_name"), "description")
    return t.orders.join(p, t.orders.product_id == p.pid).drop("pid")


def user_orders(t: Tables) -> DataFrame:
    """Each user's orders with product name and description, newest first."""
    return _orders_with_product(t).orderBy("user_id", F.desc("created_at"), F.desc("id"))


def team_purchases(t: Tables) -> DataFrame:
    """Each team's orders with product and buyer, newest first."""
    u = t.users.select(F.col("id").alias("uid"), "username")
    o = _orders_with_product(t)
    return o.join(u, o.user_id == u.uid).drop("uid").orderBy("team_id", F.desc("created_at"), F.desc("id"))


def team_purchase_summary(t: Tables) -> DataFrame:
    """Per team with orders: count, spend, verified, pending (= not verified)."""
    return t.orders.groupBy("team_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("order_count"),
        F.sum("total_price").cast("bigint").alias("total_spent"),
        F.count_if(F.col("verified")).cast("bigint").alias("verified_count"),
        F.count_if(~F.col("verified")).cast("bigint").alias("pending_count"),
    )


def received_donations(t: Tables) -> DataFrame:
    """Per recipient team, its 10 newest donations with product, donor team and donor user.

    The donations are cut to 10 a team before the joins; keys that point nowhere are what ``check_foreign_keys`` reports.
    """
    w = Window.partitionBy("recipient_team_id").orderBy(F.desc("created_at"), F.desc("id"))
    d = t.donations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= RECEIVED_DONATIONS_SHOWN)
    p = t.products.select(F.col("id").alias("pid"), F.col("name").alias("product_name"))
    dt = t.teams.select(F.col("id").alias("dtid"), F.col("name").alias("donor_team_name"))
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("donor_username"))
    j = d.join(p, d.product_id == p.pid).join(dt, d.donor_team_id == dt.dtid).join(u, d.donor_id == u.uid)
    return j.select(
        *[d[c] for c in t.donations.columns], "product_name", "donor_team_name", "donor_username",
        F.col("rank").cast("bigint").alias("rank"),
        F.coalesce(F.trim(F.col("message")) != "", F.lit(False)).alias("has_message"))
