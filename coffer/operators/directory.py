"""Listings of users, teams, products and codes.

The application runs these per entity (``WHERE team_id = $1``); here each is
computed for all entities with the key as a column. The optional parameter of
a function is the single-entity form: the same DataFrame plus a filter that
Catalyst pushes into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars as fx
from coffer.sources.tables import Tables


def scan_products(t: Tables) -> DataFrame:
    """All products, newest first (id breaks ties), with their stock bucket."""
    return (t.products.withColumn("stock_status", fx.stock_status(F.col("stock_quantity")))
            .orderBy(F.desc("created_at"), F.desc("id")))


def user_ledger(t: Tables, user_id: int | None = None) -> DataFrame:
    """A user's ledger, newest first. Without a user: every user's, ordered by user.

    The global sort is range-partitioned on (user, time, id), so one user with
    a third of the ledger is spread over many sort tasks.
    """
    tx = t.transactions if user_id is None else t.transactions.filter(F.col("user_id") == F.lit(user_id))
    return tx.orderBy("user_id", F.desc("created_at"), F.desc("id"))


def user_ledger_sql(t: Tables, user_id: int) -> DataFrame:
    """The same listing as SQL text with a bound parameter (no string splicing of values)."""
    spark = t.transactions.sparkSession
    return spark.sql("SELECT * FROM {tx} WHERE user_id = :uid ORDER BY created_at DESC, id DESC",
                     args={"uid": user_id}, tx=t.transactions)


def lookup_user(t: Tables, keys: DataFrame) -> DataFrame:
    """Point lookup for many keys at once: each (request_id, user_id) gets the row or NULLs."""
    u = t.users.select(F.col("id").alias("found_id"), "username", "role", "team_id", "balance")
    return keys.join(u, keys.user_id == u.found_id, "left").select(
        "request_id", "user_id", "username", "role", "team_id", "balance")


def login_lookup(t: Tables, keys: DataFrame) -> DataFrame:
    """Lookup by user name for many keys (request_id, username): the session's user with the team's name, or a reason.

    A blank name is refused, an unknown one has no row. Passwords aren't handled.
    """
    u = t.users.select(F.col("username").alias("found"), F.col("id").alias("user_id"), "role", "team_id", "balance")
    tm = t.teams.select(F.col("id").alias("tid"), F.col("name").alias("team_name"))
    asked = keys.select("request_id", "username").withColumn("blank", F.coalesce(F.col("username") == "", F.lit(True)))
    j = asked.join(u, (asked.username == u.found) & ~asked.blank, "left").join(tm, F.col("team_id") == F.col("tid"), "left")
    reason = F.when(F.col("blank"), "username_required").when(F.col("user_id").isNull(), "unknown")
    return j.select("request_id", "username", "user_id", "role", "team_id", "team_name", "balance", reason.alias("reason"))


def table_counts(t: Tables) -> DataFrame:
    """Row count of each of the eight tables (status page and start-up check)."""
    # a global count gives a row for an empty table too
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in t.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def user_directory(t: Tables) -> DataFrame:
    """Users with team name (left join), labels for display, newest first."""
    teams = t.teams.select(F.col("id").alias("tid"), F.col("name").alias("team_name"))
    u = t.users.join(teams, t.users.team_id == teams.tid, "left")
    return u.select(
        "id", "username", "role", "team_id", "balance", "created_at", "team_name",
        F.coalesce(F.col("team_name"), F.lit(fx.UNASSIGNED_TEAM)).alias("team_label"),
        fx.role_label(F.col("role")).alias("role_label"),
    ).orderBy(F.desc("created_at"), F.desc("id"))


def team_leaders(t: Tables) -> DataFrame:
    """Teams with their leader's name and role (status page), by id."""
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("leader_name"),
                       F.col("role").alias("leader_role"))
    return (t.teams.join(u, t.teams.leader_id == u.uid, "left")
            .select("id", "name", "leader_id", "leader_name", "leader_role").orderBy("id"))


def team_directory(t: Tables) -> DataFrame:
    """Teams with leader name and member count (the correlated subquery, decorrelated), by name."""
    counts = (t.users.filter(F.col("team_id").isNotNull()).groupBy("team_id")
              .agg(F.count(F.lit(1)).alias("members")))
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("leader_name"))
    j = (t.teams.join(u, t.teams.leader_id == u.uid, "left")
         .join(counts, t.teams.id == counts.team_id, "left"))
    return j.select(
        "id", "name", "leader_id", "created_at", "leader_name",
        F.coalesce(F.col("members"), F.lit(0)).cast("bigint").alias("member_count"),
        F.coalesce(F.col("leader_name"), F.lit(fx.NO_LEADER)).alias("leader_label"),
    ).orderBy("name", "id")


def team_list(t: Tables) -> DataFrame:
    """All teams (id, name) by id, for pickers."""
    return t.teams.select("id", "name").orderBy("id")


def team_members(t: Tables, team_id: int | None = None) -> DataFrame:
    """Members of each team by username; the team's leader is marked."""
    users = t.users.filter(F.col("team_id").isNotNull())
    if team_id is not None:
        users = users.filter(F.col("team_id") == F.lit(team_id))
    leaders = t.teams.select(F.col("id").alias("tid"), "leader_id")
    j = users.join(leaders, users.team_id == leaders.tid, "left")
    return j.select(
        "team_id", "id", "username", "role", "balance",
        F.coalesce(F.col("leader_id") == F.col("id"), F.lit(False)).alias("is_leader"),
    ).orderBy("team_id", "username", "id")


def users_by_role(t: Tables) -> DataFrame:
    """Number of users per role, by role."""
    return t.users.groupBy("role").agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy("role")


def ledger_type_counts(t: Tables) -> DataFrame:
    """Ledger totals: all rows and the earn, donation_sent and purchase rows."""
    ty = F.col("type")
    return t.transactions.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_transactions"),
        F.count_if(ty == "earn").cast("bigint").alias("earn_count"),
        F.count_if(ty == "donation_sent").cast("bigint").alias("donation_sent_count"),
        F.count_if(ty == "purchase").cast("bigint").alias("purchase_count"),
    )


def deletable_users(t: Tables) -> DataFrame:
    """Delete guard for every user: admins and users with ledger rows are kept, with a reason."""
    has_rows = t.transactions.select(F.col("user_id").alias("uid")).distinct()
    j = t.users.join(has_rows, t.users.id == has_rows.uid, "left")
    reason = (F.when(F.col("role") == "admin", "admin")
              .when(F.col("uid").isNotNull(), "has_transactions"))
    return j.select("id", "username", "role", reason.alias("reason"),
                    reason.isNull().alias("can_delete"))


def code_listing(t: Tables) -> DataFrame:
    """Money codes with the redeeming user, status and formatted dates, newest first."""
    u = t.users.select(F.col("id").alias("uid"), F.col("username").alias("used_by_username"))
    j = t.money_codes.join(u, t.money_codes.used_by == u.uid, "left")
    return j.select(
        "id", "code", "amount", "used_by", "used_at", "created_at", "used_by_username",
        F.when(F.col("used_by").isNotNull(), fx.CODE_USED).otherwise(fx.CODE_AVAILABLE).alias("status"),
        F.coalesce(F.col("used_by_username"), F.lit(fx.NO_USER)).alias("used_by_label"),
        fx.format_ts(F.col("created_at")).alias("created_text"),
        F.coalesce(fx.format_ts(F.col("used_at")), F.lit(fx.NO_USER)).alias("used_text"),
    ).orderBy(F.desc("created_at"), F.desc("id"))


def available_codes(t: Tables) -> DataFrame:
    """Codes nobody has redeemed yet, newest first."""
    return t.money_codes.filter(F.col("used_by").isNull()).orderBy(F.desc("created_at"), F.desc("id"))
