"""Team ranking by donated share of income.

Plan: the ledger is partially aggregated per user (map-side combine, one
shuffle on user_id), joined to the user dimension, then aggregated per team
(partial aggregation again, so a team holding a third of all users sends one
row per map task) and left-joined from teams so empty teams stay. The ranked
frame is one row per team; its position is a row_number over that small frame.
Pre-aggregating per user avoids the teams ⟕ users ⟕ ledger fan-out that the
original query undoes with COUNT(DISTINCT).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions import scalars as fx
from coffer.sources.tables import Tables


def ledger_by_user(transactions: DataFrame) -> DataFrame:
    """Per user: earned (earn), spent (|purchase| + |donation_sent|), donated (|donation_sent|)."""
    t, a = F.col("type"), F.col("amount")
    return transactions.groupBy("user_id").agg(
        F.sum(F.when(t == "earn", a).otherwise(0)).alias("earned"),
        F.sum(F.when(t.isin("purchase", "donation_sent"), F.abs(a)).otherwise(0)).alias("spent"),
        F.sum(F.when(t == "donation_sent", F.abs(a)).otherwise(0)).alias("donated"),
    )


def team_totals(tables: Tables) -> DataFrame:
    """One row per team (teams without members or ledger rows included, with zeros)."""
    members = tables.users.filter(F.col("team_id").isNotNull()).select(F.col("id").alias("user_id"), "team_id")
    per_user = members.join(ledger_by_user(tables.transactions), "user_id", "left")
    per_team = per_user.groupBy("team_id").agg(
        F.count("user_id").alias("member_count"),
        F.sum("earned").alias("earned"),
        F.sum("spent").alias("spent"),
        F.sum("donated").alias("donated"),
    )
    t = tables.teams.select(F.col("id"), F.col("name").alias("team_name"))
    j = t.join(per_team, t.id == per_team.team_id, "left")
    earned = F.coalesce(F.col("earned"), F.lit(0)).cast("bigint")
    spent = F.coalesce(F.col("spent"), F.lit(0)).cast("bigint")
    return j.select(
        "id", "team_name",
        F.coalesce(F.col("member_count"), F.lit(0)).cast("bigint").alias("member_count"),
        earned.alias("total_earned"),
        spent.alias("total_spent"),
        F.coalesce(F.col("donated"), F.lit(0)).cast("bigint").alias("total_donated"),
        (earned - spent).alias("current_balance"),
    )


def team_rankings(tables: Tables) -> DataFrame:
    """Ranked teams: score desc, ties by team name (stable sort over ORDER BY name)."""
    return ranked(team_totals(tables))


def ranked(totals: DataFrame) -> DataFrame:
    """Rows of ``team_totals`` with score, position, medal and progress."""
    totals = totals.withColumn(
        "donation_score", fx.donation_score(F.col("total_donated"), F.col("total_earned")))
    # One row per team: a single-partition window over an aggregated frame.
    w = Window.orderBy(F.desc("donation_score"), F.asc("team_name"), F.asc("id"))
    placed = totals.withColumn("position", F.row_number().over(w).cast("bigint"))
    return placed.select(
        "id", "team_name", "member_count", "total_earned", "total_spent", "total_donated",
        "current_balance", "donation_score", "position",
        fx.medal(F.col("position")).alias("medal"),
        fx.progress(F.col("donation_score")).alias("progress"),
    )


def team_rankings_pct(tables: Tables) -> DataFrame:
    """Two-decimal variant: exact decimal ratio rounded half-up to 2 places."""
    t = team_totals(tables)
    d, e = F.col("total_donated"), F.col("total_earned")
    exact = (d * 100).cast("decimal(20,0)") / e.cast("decimal(20,0)")
    pct = F.when(e > 0, F.round(exact, 2)).otherwise(F.lit(0)).cast("double")
    return t.select(
        "id", "team_name", "member_count", "total_earned", "total_donated", "total_spent",
        F.col("current_balance").alias("calculated_balance"),
        pct.alias("donation_score_percent"),
    )


def ranking_explain(tables: Tables) -> DataFrame:
    """Debug breakdown: raw sums next to the score formula text and its result."""
    t = team_totals(tables)
    d, e = F.col("total_donated"), F.col("total_earned")
    return t.select(
        "id", "team_name", "member_count", "total_earned", "total_spent", "total_donated", "current_balance",
        F.format_string("(%d / %d) * 100", d, e).alias("formula"),
        fx.donation_score(d, e).alias("result"),
    )
