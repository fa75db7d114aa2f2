"""Team finance and balance checks.

The team page sums the ledger of the team's members (the IN-list of member
ids becomes a join on the member frame, never a collected list) and the
stored balances. Both are partial aggregates per team, so a hot team costs
one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars as fx
from coffer.sources.tables import Tables


def team_finance(t: Tables) -> DataFrame:
    """Per team: earned, spent (purchases only), donated, received, stored balance, income."""
    ty, a = F.col("type"), F.col("amount")
    per_user = t.transactions.groupBy("user_id").agg(
        F.sum(F.when(ty == "earn", a).otherwise(0)).alias("earned"),
        F.sum(F.when(ty == "purchase", F.abs(a)).otherwise(0)).alias("spent"),
        F.sum(F.when(ty == "donation_sent", F.abs(a)).otherwise(0)).alias("donated"),
        F.sum(F.when(ty == "donation_received", a).otherwise(0)).alias("received"),
    )
    members = t.users.filter(F.col("team_id").isNotNull()).select(F.col("id").alias("user_id"), "team_id", "balance")
    per_team = members.join(per_user, "user_id", "left").groupBy("team_id").agg(
        F.sum("earned").alias("earned"), F.sum("spent").alias("spent"),
        F.sum("donated").alias("donated"), F.sum("received").alias("received"),
        F.sum("balance").alias("current_balance"),
    )
    j = t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name")).join(per_team, "team_id", "left")
    z = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in
         ("earned", "spent", "donated", "received", "current_balance")}
    return j.select("team_id", "team_name", *[v.alias(k) for k, v in z.items()],
                    (z["earned"] + z["received"]).alias("total_income"))


def team_member_stats(t: Tables) -> DataFrame:
    """Per team: member count, mean balance rounded half up (NULL without members), leader count."""
    per_team = t.users.filter(F.col("team_id").isNotNull()).groupBy("team_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("balance").alias("total"),
        F.count_if(F.col("role") == "team_leader").alias("leaders"),
    )
    j = t.teams.select(F.col("id").alias("team_id")).join(per_team, "team_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    mean = F.when(n > 0, fx.half_up(F.col("total").cast("double") / n.cast("double"))).cast("bigint")
    return j.select("team_id", n.alias("member_count"), mean.alias("average_balance"),
                    F.coalesce(F.col("leaders"), F.lit(0)).cast("bigint").alias("leader_count"))


def ledger_balances(t: Tables) -> DataFrame:
    """Per user: COALESCE(SUM(amount), 0) of the ledger, for every user."""
    sums = t.transactions.groupBy("user_id").agg(F.sum("amount").alias("ledger_sum"))
    j = t.users.join(sums, t.users.id == sums.user_id, "left")
    return j.select(t.users["*"], F.coalesce(F.col("ledger_sum"), F.lit(0)).cast("bigint").alias("ledger_balance"))


def recomputed_balances(t: Tables) -> DataFrame:
    """Users with the balance recomputed from the ledger (a new users snapshot)."""
    b = ledger_balances(t)
    return b.select("id", "username", "role", "team_id", F.col("ledger_balance").alias("balance"), "created_at")


def balance_audit(t: Tables) -> DataFrame:
    """V8: users whose stored balance differs from their ledger sum."""
    b = ledger_balances(t)
    return b.filter(F.col("balance") != F.col("ledger_balance")).select(
        "id", "username", F.col("balance").alias("stored_balance"), "ledger_balance",
        (F.col("balance") - F.col("ledger_balance")).alias("difference"))
