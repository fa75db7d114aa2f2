"""Store catalog and purchase helpers.

Per-viewer listings that would pair every viewer with every product or team
are computed per request instead: each store request is checked against its
own product and recipient by equi-joins, never by a cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars as fx
from coffer.sources.tables import Tables


def store_catalog(t: Tables) -> DataFrame:
    """Active products by category, name; NULL is_active drops out; missing stock shows 0."""
    p = t.products.filter(F.col("is_active"))
    return p.select(
        "id", "name", "description", "price", "category",
        fx.js_default(F.col("stock_quantity"), 0).cast("bigint").alias("stock_quantity"),
        "is_active", "created_at",
        fx.stock_status(F.col("stock_quantity")).alias("stock_status"),
    ).orderBy("category", "name", "id")


def catalog_categories(t: Tables) -> DataFrame:
    """Distinct categories of the active catalog, in catalog order (ascending)."""
    return t.products.filter(F.col("is_active")).select("category").distinct().orderBy("category")


def donatable_products(t: Tables) -> DataFrame:
    """Active products in stock, the five columns the donation form needs, by category, name."""
    p = t.products.filter(F.col("is_active") & (F.col("stock_quantity") > 0))
    return p.select("id", "name", "price", "stock_quantity", "category").orderBy("category", "name", "id")


def stock_status(t: Tables) -> DataFrame:
    """Every product with its shown stock (missing = 0) and its stock bucket."""
    s = F.col("stock_quantity")
    return t.products.select("id", "name", "is_active", s, fx.js_default(s, 0).cast("bigint").alias("stock_shown"),
                             fx.stock_status(s).alias("stock_status"))


def donation_targets(t: Tables, team_id: int | None) -> DataFrame:
    """Teams other than one (parameterised form). A NULL team has no targets (three-valued logic)."""
    return t.teams.filter(F.col("id") != F.lit(team_id).cast("bigint")).select("id", "name")


def donation_target_check(t: Tables, requests: DataFrame) -> DataFrame:
    """Target rule for every donation request: recipient exists and differs from the donor's team.

    The all-teams form of ``teams WHERE id != my_team``: instead of pairing every
    team with every other, each request is joined to its donor and its recipient.
    """
    r = requests.filter(F.col("kind") == "donate")
    u = t.users.select(F.col("id").alias("uid"), F.col("team_id").alias("donor_team_id"))
    tm = t.teams.select(F.col("id").alias("tid"), F.col("name").alias("recipient_name"))
    j = r.join(u, r.user_id == u.uid, "left").join(tm, r.recipient_team_id == tm.tid, "left")
    valid = F.coalesce((F.col("tid").isNotNull()) & (F.col("tid") != F.col("donor_team_id")), F.lit(False))
    return j.select("request_id", "user_id", "donor_team_id", "recipient_team_id", "recipient_name",
                    valid.alias("is_valid_target"))


def affordable_quantity(t: Tables, requests: DataFrame) -> DataFrame:
    """For each store request: max quantity the buyer can take, and whether one unit is affordable."""
    u = t.users.select(F.col("id").alias("uid"), "balance")
    p = t.products.select(F.col("id").alias("pid"), "price", "stock_quantity")
    j = requests.join(u, requests.user_id == u.uid).join(p, requests.product_id == p.pid)
    return j.select(
        "request_id", "user_id", "product_id", "balance", "price", "stock_quantity",
        fx.max_affordable(F.col("stock_quantity"), F.col("balance"), F.col("price")).alias("max_quantity"),
        (F.col("balance") >= F.col("price")).alias("can_afford"),
    )


def test_ledger_rows(t: Tables, name_pattern: str = "test_%") -> DataFrame:
    """Ledger rows of test data: description LIKE 'Test%', or the user's name matches a pattern (``_`` stands for any character).

    Shown with team and user name, by team, type, time.
    """
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("leader_name"), "team_id")
    tm = t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    rows = t.transactions.join(u, t.transactions.user_id == u.uid)
    j = rows.filter(F.col("description").like("Test%") | F.col("leader_name").like(name_pattern)).join(tm, "team_id")
    return j.select("team_id", "team_name", "leader_name", F.col("id").alias("transaction_id"), "type", "amount",
                    "description", "created_at").orderBy("team_id", "type", "created_at", "transaction_id")
